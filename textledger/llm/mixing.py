"""Mixing sources to target weights by blocks of words.

Sources sort by code point, null last, and take ``WEIGHTS`` in turn. A target is
the source's share of all words, at most ``REPEATS`` times the source's size;
what that cuts off goes to the others by weight. Each source's documents, in id
order, are packed into blocks of ``BLOCK`` words. Output shards draw how many
slots each source gets: multinomially, from what is left of the sources'
targets, so that all shards together meet them. A source's slots run through a
pseudorandom permutation (a Feistel network) of its block indices, pass after
pass, so no block is taken more than ``REPEATS`` times; the last slot takes
only the words that the target still lacks. Blocks are joined by index.

Size counts ``[^ \\t-\\r]+`` runs. A null text has none and is never taken. Equal
ids are ordered by text checksum and size; repeated rows are documents of their
own. An empty table, or one without words, takes nothing. Reruns agree. The
number of sources must be such that a row for each fits the driver; of shards
there may be any number: the driver draws for ``GROUPS`` groups of them, and
each group draws for its shards in a task. Very long texts are cut by words
like others. Extra columns are carried by ``mixed``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, mix64, order_buckets, running_offsets, settle, slices, spare

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK = 64
#: Slots of an output shard, about.
SHARD_SLOTS = 1 << 14
#: Groups of shards that the driver draws for, at most.
GROUPS = 1024
SEED = 20240603
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights=WEIGHTS, repeats: int = REPEATS) -> dict:
    """Target words by source (in order): shares of the sum by weight, none above ``repeats`` times its size."""
    share = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    out, left, free = {}, float(sum(sizes.values())), list(sizes)
    while free:
        unit = left / sum(share[s] for s in free)
        full = [s for s in free if unit * share[s] > repeats * sizes[s]]
        if not full:
            return out | {s: unit * share[s] for s in free}
        for s in full:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
            free.remove(s)
    return out


def permuted(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``index`` (or its inverse): a four-round Feistel network, walked until it lands below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    x, todo = index.astype(np.uint64), np.ones(len(index), bool)
    mixed_ = lambda v, r: mix64(v + np.uint64((key * 4 + r) % 2**64)) & low
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & low
        for r in range(4):
            if back:
                left, right = right ^ mixed_(left, 3 - r), left
            else:
                left, right = right, left ^ mixed_(right, r)
        x[todo] = (left << np.uint64(half)) | right
        todo &= x >= np.uint64(n)
    return x.astype(np.int64)


def _key(src: int) -> int:
    return SEED + 7919 * src


def slots_for(words: int, size: int, src: int) -> tuple[int, int]:
    """How many slots take exactly ``words`` of a source of ``size`` words, and how many words the last one takes."""
    if not words:
        return 0, 0
    blocks, (passes, rest) = -(-size // BLOCK), divmod(words, size)
    tail = size - (blocks - 1) * BLOCK
    if not rest:
        return passes * blocks, BLOCK
    tail_at = int(permuted(np.array([blocks - 1]), blocks, _key(src), back=True)[0])
    n = -(-rest // BLOCK)
    got = lambda k: k * BLOCK - (BLOCK - tail) * (tail_at < k)
    while got(n) < rest:
        n += 1
    return passes * blocks + n, rest - got(n - 1)


def shard_counts(slots: list[int], shares: list[int], seed) -> Iterator[np.ndarray]:
    """For each share (a shard, or a group of so many) in turn: how many slots of each source it draws of what is left."""
    rng, left, ahead = np.random.default_rng(seed), np.array(slots, np.int64), sum(shares)
    for share in shares:
        want = int(left.sum() * share // ahead)
        draw = left.copy() if share == ahead else np.minimum(rng.multinomial(want, left / max(left.sum(), 1)) if want else left * 0, left)
        left, ahead = left - draw, ahead - share
        yield draw


def shard_groups(slots: list[int]) -> Iterator[tuple[int, int, int, list[int], list[int]]]:
    """At most GROUPS groups of shards: number, first shard, shards, each source's first slot and slots in it."""
    shards = max(1, round(sum(slots) / SHARD_SLOTS))
    groups = min(shards, GROUPS)
    shares = [shards // groups + (g < shards % groups) for g in range(groups)]
    first, used = 0, np.zeros(len(slots), np.int64)
    for g, (share, draw) in enumerate(zip(shares, shard_counts(slots, shares, SEED))):
        yield g, first, share, used.tolist(), draw.tolist()
        first, used = first + share, used + draw


def _slots(batches):
    """Groups of shards (see ``shard_groups``; by source also all slots, blocks and words of the last slot) to slots with their block."""
    for batch in slices(batches, 1):
        r = batch.to_pylist()[0]
        used = np.array(r["first"], np.int64)
        for shard, draw in enumerate(shard_counts(r["n"], [1] * r["shards"], (SEED, r["group"])), r["first_shard"]):
            for src in np.flatnonzero(draw).tolist():
                blocks = r["blocks"][src]
                for begin in range(0, int(draw[src]), 1 << 16):
                    at = used[src] + np.arange(begin, min(draw[src], begin + (1 << 16)), dtype=np.int64)
                    block = permuted(at % blocks, blocks, _key(src))
                    words = np.where(at == r["slots"][src] - 1, r["last"][src], BLOCK)
                    same = lambda v, t: pa.array(np.full(len(at), v), t)
                    yield pa.RecordBatch.from_arrays([same(shard, pa.int32()), pa.array(at), same(src, pa.int32()), pa.array(at // blocks), pa.array(block), pa.array(words.astype(np.int64))], names=["shard", "slot", "src", "pass", "block", "words"])
            used += draw


def mix(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The plan of a mix: documents with their place, and the pieces of them that slots take.

    Documents: ``row, doc_id, size, src, source_size, target, first`` (words of
    the source before it). Pieces: ``shard, slot, src, pass, row, from, to``
    (words of the document). ``row`` names a column that numbers the rows of
    ``docs``; without it they are numbered here.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("crc"), *([F.col(row).alias("row")] if row else []))
    base = settle(order_buckets(base, "doc_id", "bucket"), "sizes")
    sums = {r["source"]: r["w"] for r in base.groupBy("source").agg(F.sum("size").alias("w")).collect()}  # a row per source
    names = sorted((s for s in sums if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sums)
    sizes = {s: sums[s] for s in names}
    goal = targets(sizes, weights, repeats)
    listed = spark.createDataFrame([(i, s, sizes[s], goal[s]) for i, s in enumerate(names)], "src int, _source string, source_size long, target double")
    order = [F.col("doc_id").asc_nulls_first(), F.col("crc"), F.col("size")]
    placed = base.join(F.broadcast(listed), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")  # a row per source
    placed = running_offsets(placed, ["src"], "bucket", order, F.col("size"), "first").drop("bucket", "crc")
    placed = settle(placed if row else placed.withColumn("row", F.monotonically_increasing_id()), "placed")

    blocks = [-(-sizes[s] // BLOCK) for s in names]
    need = [slots_for(round(goal[s]), sizes[s], i) for i, s in enumerate(names)]
    slots, last = [n for n, _ in need], [w for _, w in need]
    plan = [(*group, slots, blocks, last) for group in shard_groups(slots)]  # GROUPS rows at most
    drawn = spark.createDataFrame(plan, "group int, first_shard int, shards int, first array<long>, n array<long>, slots array<long>, blocks array<long>, last array<long>")
    drawn = drawn.repartition(max(1, min(len(plan), 4 * spark.sparkContext.defaultParallelism)))
    taken = drawn.mapInArrow(_slots, "shard int, slot long, src int, pass long, block long, words long")
    pieces = placed.where("size > 0").select("row", "src", "first", "size", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("size") - 1) / BLOCK))).alias("block"))
    # The slots grow with the input, though they are spread out from a short list: never broadcast them.
    joined = taken.hint("merge").join(pieces, ["src", "block"])
    start, end = F.col("block") * BLOCK, F.col("block") * BLOCK + F.col("words")
    joined = joined.select("shard", "slot", "src", "pass", "row", F.greatest(start - F.col("first"), F.lit(0)).alias("from"), F.least(end - F.col("first"), F.col("size")).alias("to"))
    return placed, joined.where(F.col("from") < F.col("to"))


def taken_words(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document."""
    placed, pieces = mix(docs)
    taken = pieces.groupBy("row").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    return placed.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The words of ``text`` in ``spans`` (ordered, apart), with the white space between them as it was; a gap becomes a line feed."""
    at = [m.span() for m in _WORDS.finditer(text)]
    joined: list[list[int]] = []
    for a, b in spans:
        if joined and joined[-1][1] == a:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    if joined == [[0, len(at)]]:
        return text
    return "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in joined)


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per document and pass, its text the words taken in it.

    A document that a pass takes whole keeps its whole text. ``n_chars``, where
    there is such a column, is counted anew.
    """
    from pyspark.sql.types import LongType

    names = docs.columns
    row, taken = spare(docs, "row"), spare(docs, "spans")
    numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    _, pieces = mix(numbered, row=row)
    spans = pieces.groupBy("row", "pass").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias(taken))
    rows = numbered.join(spans.select(F.col("row").alias(row), taken), row).select(*names, taken)

    def apply(batches):
        for batch in slices(batches):
            texts, spans = column(batch, "text", ""), column(batch, taken)
            new = [cut(t, [(s["from"], s["to"]) for s in x]) for t, x in zip(texts, spans)]
            columns = {n: batch.column(n) for n in names}
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) for t in new], pa.int64())
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    schema = docs.schema
    for field in schema:
        if field.name == "n_chars":
            field.dataType = LongType()
    return rows.mapInArrow(apply, schema)
