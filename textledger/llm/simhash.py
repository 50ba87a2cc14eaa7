"""SimHash near-duplicates by a generalised pigeonhole principle.

A text's fingerprint has a bit where over half of its shingles' hashes have
it; texts whose fingerprints differ in ``RADIUS`` bits or fewer are linked.

1. Bits that go together are grouped, so that groups are nearly independent.
2. Every group's values are counted over all fingerprints. From these
   histograms follows how many pairs a part (some groups together) brings
   within a threshold. Dynamic programming gives each part a threshold, or
   leaves a part out, so that thresholds plus one sum to ``RADIUS + 1`` and
   the estimated work is least: two fingerprints that are near must then be
   within the threshold of some part.
3. Fingerprints meet where they agree on a part with as many of its bits
   masked as the threshold allows, and are verified.

Equal fingerprints are one node. A bucket of few nodes is compared in one task,
and what is linked in it is emitted as a star. In a larger one all nodes meet
its leader; where that leaves several components, nodes outside the largest
meet all others in tiles of bounded size. So nothing grows with the square of
a bucket but comparisons in arrays, and only of buckets that stay open.

Nulls: a null text is empty; texts without words have the fingerprint zero,
which is linked like any other. A null id is never a component's name, unless
it has no other. Texts of any length are read whole; repeated rows are each
returned; ties cannot matter. An empty table has no rows. Extra columns, of
any name, are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, lookup, settle, slices
from .links import components

SHINGLE, SEED = 3, 42
BITS, RADIUS = 64, 3
#: Bits of a group: few enough that the values of one can be counted in an array.
GROUP = 16
#: What it costs to deal a key, in comparisons of a pair.
KEY_COST = 16
#: Nodes of a bucket that are compared in one task, at most, and of one whose links are emitted as they are.
TILE, FEW = 1024, 8
#: Hashes whose bits are counted at once.
_RUN = 1 << 16


def fingerprint(text: str) -> int:
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = np.concatenate(([0], ends[:-1]))
    width = min(SHINGLE, len(words))
    spans = zip(begins[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist())
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _RUN):
        ones += np.unpackbits(hashes[i : i + _RUN].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in slices(batches):
        found = np.array([fingerprint(t) for t in column(batch, "text", "")], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """The settled ``doc_id, fp`` of every row."""
    return settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "simhashes")


# --- how to part the bits ------------------------------------------------------


def _bits(batch) -> np.ndarray:
    fps = np.ascontiguousarray(batch.column("fp").to_numpy()).astype("<i8")
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_groups(nodes: DataFrame) -> list[list[int]]:
    """Groups of GROUP bits with the most correlation inside, by how often each two bits are set together in all ``nodes``."""

    def together(batches):
        table = np.zeros((BITS, BITS))
        for batch in batches:
            bits = _bits(batch).astype(np.float64)
            table += bits.T @ bits
        x, y = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(table[x, y].astype(np.int64))], names=["x", "y", "n"])

    found = nodes.select("fp").mapInArrow(together, "x long, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).collect()  # a row per two bits
    n = nodes.count()
    table = np.zeros((BITS, BITS), np.int64)
    for r in found:
        table[r["x"], r["y"]] = table[r["y"], r["x"]] = r["n"]
    both = table / max(n, 1)
    one = np.diag(both)
    spread = np.sqrt(one * (1 - one))
    corr = np.abs(both - np.outer(one, one)) / np.maximum(np.outer(spread, spread), 1e-9)
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    while left:
        group = [max(left, key=lambda b: corr[b, left].sum())]
        while len(group) < GROUP:
            group.append(max((b for b in left if b not in group), key=lambda b: corr[b, group].sum()))
        groups.append(sorted(group))
        left = [b for b in left if b not in group]
    return groups


def histograms(nodes: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """How many nodes have each value of each group."""
    table = F.array(*[F.lit(_mask(g)).cast("long") for g in groups])
    values = nodes.select(F.posexplode(F.transform(table, lambda m: F.col("fp").bitwiseAND(m))).alias("group", "value"))
    found = values.groupBy("group", "value").agg(F.count("*").alias("n")).toPandas()  # 1 << GROUP values of each group at most
    out = []
    for g, group in enumerate(groups):
        own = found[found["group"] == g]
        bits = np.unpackbits(own["value"].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out.append(np.bincount(bits[:, group] @ (1 << np.arange(GROUP)), own["n"].to_numpy(), minlength=1 << GROUP).astype(np.int64))
    return out


def distances(histogram: np.ndarray) -> np.ndarray:
    """The chance that two counted values differ in 0, 1, ... RADIUS bits: a Walsh-Hadamard transform squares into all differences at once."""
    x = histogram / max(histogram.sum(), 1)
    n = len(x)

    def transformed(x):
        h = 1
        while h < n:
            x = x.reshape(-1, 2, h)
            x = np.stack((x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]), axis=1).ravel()
            h *= 2
        return x

    chance = transformed(transformed(x) ** 2) / n
    return np.bincount(np.bitwise_count(np.arange(n)), chance)[: RADIUS + 1]


def partings(items: tuple) -> list[list[tuple]]:
    """All ways to put ``items`` together in parts."""
    if not items:
        return [[]]
    out = []
    for rest in partings(items[1:]):
        out += [[(items[0],), *rest], *[[(items[0], *p) if p is q else q for q in rest] for p in rest]]
    return out


def thresholds(chances: list[np.ndarray], widths: list[int], n: int) -> tuple[float, list[int]]:
    """The least estimated work and each part's threshold (-1: the part is not looked at), by dynamic programming over parts."""

    def work(i: int, t: int) -> float:
        return 0.0 if t < 0 else n * (n - 1) / 2 * float(chances[i][: t + 1].sum()) + KEY_COST * n * comb(widths[i], t)

    @lru_cache(None)
    def best(i: int, left: int) -> tuple[float, tuple[int, ...]]:
        if i == len(widths):
            return (0.0 if left == 0 else float("inf")), ()
        options = []
        for t in range(-1, min(left, widths[i] + 1)):
            cost, rest = best(i + 1, left - t - 1)
            options.append((work(i, t) + cost, (t, *rest)))
        return min(options)

    cost, found = best(0, RADIUS + 1)
    return cost, list(found)


def plan(groups: list[list[int]], counts: list[np.ndarray]) -> list[tuple[list[int], int]]:
    """Parts (bits) and their thresholds with the least estimated work."""
    n, each, found = int(counts[0].sum()), [distances(c) for c in counts], []
    for parting in partings(tuple(range(len(groups)))):
        chances = []
        for part in parting:
            chance = np.eye(1, RADIUS + 1)[0]
            for g in part:
                chance = np.convolve(chance, each[g])[: RADIUS + 1]
            chances.append(chance)
        cost, limits = thresholds(chances, [GROUP * len(p) for p in parting], n)
        found.append((cost, [(sorted(b for g in p for b in groups[g]), t) for p, t in zip(parting, limits) if t >= 0]))
    return min(found)[1]


def _mask(bits) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def masks(parts: list[tuple[list[int], int]]) -> list[int]:
    """One mask for each part and choice of as many of its bits as its threshold: near nodes agree under one of them."""
    return [_mask(set(bits) - set(out)) for bits, t in parts for out in combinations(bits, t)]


# --- probing and verifying --------------------------------------------------------


def stars(near: np.ndarray) -> list[tuple[int, int]]:
    """Connected components of an adjacency matrix: ``(member, first member)`` for all but the first."""
    out, left = [], np.ones(len(near), bool)
    for i in range(len(near)):
        if left[i]:
            left[i], front = False, near[i] & left
            while front.any():
                at = np.flatnonzero(front)
                out += [(int(k), i) for k in at]
                left[at] = False
                front = near[at].any(axis=0) & left
    return out


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[:, None] ^ y[None, :]) <= RADIUS


def _links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
    """Links of whole buckets of nodes sorted by key: verified pairs of small ones, stars of the others."""
    a, b = [], []
    edges = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    sizes = np.diff(edges, append=len(keys))
    size = np.repeat(sizes, sizes)
    for d in range(1, FEW):
        i = np.flatnonzero((keys[:-d] == keys[d:]) & (size[:-d] <= FEW)) if d < len(keys) else np.zeros(0, np.int64)
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= RADIUS]
        a.append(fps[i])
        b.append(fps[i + d])
    for at, n in zip(edges[sizes > FEW], sizes[sizes > FEW]):
        own = fps[at : at + n]
        found = np.array(stars(_near(own, own)), np.int64).reshape(-1, 2)
        a.append(own[found[:, 0]])
        b.append(own[found[:, 1]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])


def _probe(batches):
    """Streams nodes sorted by key; a bucket that goes on in the next batch waits for it."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        keys = np.concatenate((keys, batch.column("key").to_numpy()))
        fps = np.concatenate((fps, batch.column("fp").to_numpy().view(np.uint64)))
        if len(keys):
            done = int(np.searchsorted(keys, keys[-1]))
            if done:
                yield _links(keys[:done], fps[:done])
            keys, fps = keys[done:], fps[done:]
    if len(keys):
        yield _links(keys, fps)


def _tiles(group: pa.Table) -> pa.Table:
    """Links between components of two tiles (or of one): one for each component joined to another."""
    fps, labels = group.column("fp").to_numpy().view(np.uint64), group.column("label").to_numpy()
    odd = group.column("odd").to_numpy(zero_copy_only=False)
    x, y = np.flatnonzero(odd), np.arange(len(fps))
    near = _near(fps[x], fps) & (labels[x][:, None] != labels[None, :])
    i, j = np.nonzero(near)
    pairs = np.unique(np.stack((labels[x[i]], labels[y[j]])), axis=1) if len(i) else np.zeros((2, 0), np.int64)
    names, where = np.unique(pairs, return_inverse=True)
    table = np.zeros((len(names), len(names)), bool)
    where = where.reshape(2, -1)
    table[where[0], where[1]] = table[where[1], where[0]] = True
    found = np.array(stars(table), np.int64).reshape(-1, 2)
    return pa.Table.from_arrays([pa.array(names[found[:, k]], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _differ(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def across(big: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between components that share a large bucket.

    Nodes of a bucket outside its most frequent component meet all of its
    nodes, in tiles of TILE nodes at most (about): rows grow with the nodes
    outside times the bucket over TILE.
    """
    named = big.join(labels, big["fp"] == labels["node"], "left").select("key", "fp", F.coalesce("label", "fp").alias("label"))
    named = settle(named, "named-buckets")
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("m"))
    leads = sizes.groupBy("key").agg(F.max_by("label", "m").alias("lead"), F.sum("m").alias("n"), F.max("m").alias("most"), F.count("*").alias("several"))
    open_ = settle(leads.where("several > 1").select("key", "lead", "n", "most"), "open-buckets")
    rows = lookup(named, open_, "key").where("lead is not null").withColumn("odd", F.col("label") != F.col("lead"))
    tiles = {odd: F.ceil(F.when(F.lit(odd), F.col("n") - F.col("most")).otherwise(F.col("most")) / (TILE // 2)) for odd in (True, False)}
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("odd"), tiles[True]).otherwise(tiles[False]))
    rows = rows.withColumns({"odds": tiles[True], "leads": tiles[False], "own": own})
    others = F.sequence(F.lit(0).cast("long"), F.col("odds") - 1)
    met = F.when(F.col("odd"), F.concat(
        F.transform(others, lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y"))),
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("leads") - 1), lambda m: F.struct(F.col("own").alias("x"), (F.col("odds") + m).alias("y"))),
    )).otherwise(F.transform(others, lambda o: F.struct(o.alias("x"), (F.col("odds") + F.col("own")).alias("y"))))
    dealt = rows.select("key", "fp", "label", "odd", F.explode(met).alias("t")).select("key", "t.x", "t.y", "fp", "label", "odd")
    return dealt.groupBy("key", "x", "y").applyInArrow(lambda t: _tiles(t), "a long, b long")


def links(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """Components of ``nodes`` (distinct ``fp``): ``node, label`` for those that are linked."""
    table = F.array(*[F.lit(m).cast("long") for m in masks(parts)])
    keys = nodes.select("fp", F.posexplode(F.transform(table, lambda m: F.col("fp").bitwiseAND(m)))).select("fp", F.xxhash64("pos", "col").alias("key"))
    counts = settle(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    shared = settle(lookup(keys, counts, "key").where("n is not null"), "buckets")
    small = shared.where(F.col("n") <= TILE).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    found = small.mapInArrow(_probe, "a long, b long")
    big = settle(shared.where(F.col("n") > TILE).select("key", "fp", "n"), "big-buckets")
    leaders = big.join(nodes.select("fp", "docs"), "fp").groupBy("key").agg(F.max_by("fp", F.struct("docs", "fp")).alias("leader"), F.count("*").alias("n"))
    led = lookup(big.select("key", "fp"), leaders, "key").where((F.col("fp") != F.col("leader")) & (_differ(F.col("fp"), F.col("leader")) <= RADIUS))
    first = settle(found.union(led.select("fp", "leader")).distinct(), "links")
    labels = components(first)
    if big.isEmpty():
        return labels
    # From here on components are nodes, named by their labels.
    more = settle(across(big.select("key", "fp"), labels).distinct(), "links")
    if more.isEmpty():
        return labels
    merged = components(more).select(F.col("node").alias("label"), F.col("label").alias("to"))
    known = labels.join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return known.union(merged.select("label", "to").join(labels.select(F.col("node").alias("label")), "label", "left_anti"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row: the fingerprint in hexadecimal, and the least id that links lead to."""
    rows = fingerprints(docs)
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("docs")), "nodes")
    groups = bit_groups(nodes)
    labels = links(nodes, plan(groups, histograms(nodes, groups)))
    named = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "least", "docs", F.coalesce("label", "fp").alias("label"))
    named = settle(named, "labelled-nodes")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n")).where("n > 1")
    known = lookup(named, least, "label").select("fp", F.col("docs").alias("n"), F.when(F.col("n").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    known = settle(known, "components")
    return lookup(rows, known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
