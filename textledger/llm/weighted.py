"""Near-duplicate removal by improved consistent weighted sampling over TF-IDF shingles.

A shingle's weight is its count in the text times its inverse document
frequency, and document frequencies are exact: texts are written in blocks,
each block deals its distinct 64-bit shingle hashes, with how many of its texts
have each, to ``cells`` by their first bits, all cells of the same bits are added
up together, and each cell gets back the sums in the order of its shingles. So
the most frequent shingle is one entry a block, however many texts have it. So every text has the frequencies of
its own shingles, and no table of all shingles is shared. A block's texts go
compressed, as a few MB at once in one row are much to an executor, and a
cell's shingles are summed in ranges, so that a task needs little beside them.

Nulls: a null text is in a class of its own; an empty text or one without
words is near none, and equal texts (empty ones too) are always one class.
Rows count by their texts, so rows of one id with different texts, and rows
without an id, are compared like all others. Repeated rows are one class.
Extra columns, of any name, are ignored (``dedup`` returns them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, give_back, mix64, pressed, runs, settle, shingles, slices, spare, unpressed
from .links import BAND_ROWS, BANDS, NO_ID, banded_batch, class_ids, classes_by_bands, keyed

#: Texts of a block have about so many code points together (a longer text is alone).
BLOCK_CHARS = 4_000_000
#: Blocks of a file: Spark's reader and writer hold a file's rows at once, whatever their size.
BLOCKS_FILE = 8
#: Shingles are counted in at least so many groups, and in more where a group's texts would pass GROUP_CHARS.
GROUPS = 256
GROUP_CHARS = 16_000_000
#: So many entries of a group are summed at once.
COUNT_ENTRIES = 1 << 18
SAMPLES = BAND_ROWS * BANDS
_DRAWS = 1 << 16
SEED = 20240602

_BLOCKS = "block long, doc_id array<long>, text_key array<string>, chars long, texts binary"
_CELLS = "block long, part long, data binary, n binary"
_REPLIES = "block long, part long, data binary"
_COUNTED = "doc_id long, text_key string, bands array<long>, dfs binary"


def _distinct(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct shingles (64-bit hashes, ascending) and how often it has them."""
    for i, j in runs(texts):
        hashes, bounds = shingles(texts[i:j])
        for a, b in zip(bounds, bounds[1:]):
            yield np.unique(hashes[a:b], return_counts=True)


def document_frequencies(docs: DataFrame) -> tuple[DataFrame, int]:
    """The written table ``shingle, n`` of the shingles that 2 or more texts have, and how many texts there are.

    Plain counting by shingle, to compare with: ``weighted_classes`` counts in cells.
    """

    def emit(batches):
        for batch in slices(batches):
            found = [h for h, _ in _distinct(column(batch, "text", ""))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["shingle"])

    pairs = docs.select("text").mapInArrow(emit, "shingle long")
    return settle(pairs.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "frequencies"), docs.count()


def idf(counts: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n + 1) / (counts + 1.0))


def idf_table(counts: DataFrame, n: int) -> tuple[dict[int, int], int]:
    """``document_frequencies`` of a small table as a dictionary."""
    return {r["shingle"]: r["n"] for r in counts.collect()}, n


def _vector(own: np.ndarray, tf: np.ndarray, df: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's weighted shingles: 32-bit hashes (ascending) and weights."""
    weights = tf * idf(df, n)
    short = (own >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.diff(short.astype(np.int64), prepend=-1))
    return short[first], (np.add.reduceat(weights, first) if len(first) else weights).astype(np.float32)


class TfIdf:
    """Turns texts into weighted shingle vectors by a dictionary of frequencies (see ``idf_table``)."""

    def __init__(self, table: tuple[dict[int, int], int]):
        self.counts, self.n = table

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [_vector(own, tf, np.array([self.counts.get(h, 1) for h in own.view(np.int64).tolist()], np.int64), self.n) for own, tf in _distinct(texts)]


def counted_vectors(texts: list[str], dfs: list[bytes], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weighted shingle vectors of texts whose shingles' frequencies are known, in the order of the hashes."""
    return [_vector(own, tf, np.frombuffer(df, "<u4"), n) for (own, tf), df in zip(_distinct(texts), dfs)]


def _fold(hashes: np.ndarray) -> bytes:
    """Ascending hashes as differences, byte by byte of all: their high bytes are zeros."""
    return np.diff(hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unfold(data) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _often(n: np.ndarray) -> bytes:
    """Which counts are more than one, and those counts."""
    at = np.flatnonzero(n > 1)
    return np.concatenate((at, n[at])).astype("<u4").tobytes()


def _times(data, out: np.ndarray) -> None:
    at, n = np.frombuffer(data, "<u4").reshape(2, -1)
    out[:] = 1
    out[at] = n


def _entries(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The texts' distinct shingles, and all of them laid end to end."""
    own = [h for h, _ in _distinct(texts)]
    return own, np.concatenate(own)


def _blocks(batches):
    from pyspark import TaskContext

    block, ids, keys, texts, size = TaskContext.get().partitionId() << 32, [], [], [], 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([keys], pa.list_(pa.string())), pa.array([size], pa.int64()), pa.array([pressed(texts)], pa.binary())], names=["block", "doc_id", "text_key", "chars", "texts"])

    for batch in slices(batches):
        for i, key, text in zip(column(batch, "doc_id"), column(batch, "text_key"), column(batch, "text", "")):
            if ids and size + len(text) > BLOCK_CHARS:
                yield row()
                block, ids, keys, texts, size = block + 1, [], [], [], 0
            ids.append(i)
            keys.append(key)
            texts.append(text)
            size += len(text)
    if ids:
        yield row()


def _cells(bits: int):
    def cells(batches):
        for batch in slices(batches, 1):
            block = batch.column("block")[0].as_py()
            hashes, n = np.unique(_entries(unpressed(batch.column("texts")[0].as_buffer()))[1], return_counts=True)
            parts = (hashes >> np.uint64(64 - bits)).astype(np.int64)
            at = np.flatnonzero(np.diff(parts, prepend=-1))
            for a, b in zip(at, np.append(at[1:], len(parts))):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([parts[a]], pa.int64()), pa.array([_fold(hashes[a:b])], pa.binary()), pa.array([_often(n[a:b])], pa.binary())], names=["block", "part", "data", "n"])

    return cells


def _count(cells: pa.Table) -> pa.Table:
    """For all cells of a part: in how many texts of all blocks each entry's shingle is.

    Entries are taken by the last bits of their hashes, COUNT_ENTRIES at once or
    so: sorting all of a part's takes ten times what they do.
    """
    data = [x.as_buffer() for x in cells.column("data")]
    ends = np.cumsum([0, *(x.size // 8 for x in data)])
    flat, times, counts = np.empty(ends[-1], np.uint64), np.empty(ends[-1], "<u4"), np.empty(ends[-1], "<u4")
    for a, b, x, n in zip(ends, ends[1:], data, cells.column("n")):
        flat[a:b] = _unfold(x)
        _times(n.as_buffer(), times[a:b])
    shares = min(256, 1 << (len(flat) // COUNT_ENTRIES).bit_length())
    share = flat.astype(np.uint8) & np.uint8(shares - 1)
    for k in range(shares):
        at = np.flatnonzero(share == k)
        _, which = np.unique(flat[at], return_inverse=True)
        counts[at] = np.bincount(which, times[at])[which]
    replies = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((ends * 4).astype("<i4")), pa.py_buffer(counts)])
    out = pa.Table.from_arrays([cells.column("block").combine_chunks(), cells.column("part").combine_chunks(), replies], names=["block", "part", "data"])
    del flat, times, share
    give_back()
    return out


def _banded(n: int):
    def banded_rows(block: pa.Table, counts: pa.Table) -> pa.Table:
        """Band hashes and frequencies of a block's texts, of which ``counts`` holds the cells."""
        texts = unpressed(block.column("texts")[0].as_buffer())
        own, hashes = _entries(texts)
        replies = sorted(zip(counts.column("part").to_pylist(), counts.column("data").to_pylist()))
        flat = np.frombuffer(b"".join(x for _, x in replies), "<u4")[np.unique(hashes, return_inverse=True)[1]]
        dfs = [x.tobytes() for x in np.split(flat, np.cumsum([len(x) for x in own])[:-1])]
        del own, hashes, replies, flat
        samples = np.concatenate([consistent_samples(counted_vectors(texts[i:j], dfs[i:j], n)) for i, j in runs(texts)])
        bare = np.flatnonzero(~samples.any(axis=1))  # no words: near nothing else
        first = np.uint64(((block.column("block")[0].as_py() + 1) << 24) % 2**64)
        samples[bare] = mix64(first + np.arange(1, len(bare) + 1, dtype=np.uint64))[:, None]
        rows = pa.RecordBatch.from_arrays([pa.array(block.column(c)[0].as_py(), kind) for c, kind in (("doc_id", pa.int64()), ("text_key", pa.string()))], names=["doc_id", "text_key"])
        return pa.Table.from_batches([banded_batch(rows, samples)]).append_column("dfs", pa.array(dfs, pa.binary()))

    def banded(block: pa.Table, counts: pa.Table) -> pa.Table:
        out = banded_rows(block, counts)
        give_back()
        return out

    return banded


def _draws():
    """Quantiles of Gamma(2,1), log Gamma(2,1) and uniform draws, and a salt for each sample.

    A hash of shingle and sample number addresses each table by 16 bits of its
    own, so two shingles share all three draws with a chance of 2**-48.
    """
    rng = np.random.default_rng(SEED)
    r, c, beta = rng.gamma(2, 1, _DRAWS), rng.gamma(2, 1, _DRAWS), rng.random(_DRAWS)
    salts = rng.integers(0, 2**63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
    return r.astype(np.float32), np.log(c).astype(np.float32), beta.astype(np.float32), salts


def consistent_samples(vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """ICWS: per vector SAMPLES pairs of a shingle and a level, folded to 64 bits each.

    Two vectors agree in a sample with their weighted Jaccard similarity as the probability.
    """
    r, lc, beta, salts = _draws()
    out = np.zeros((len(vectors), SAMPLES), np.uint64)
    sizes = np.array([len(v[0]) for v in vectors])
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    ids = mix64(np.concatenate([vectors[i][0] for i in some]).astype(np.uint64))
    logs = np.log(np.concatenate([vectors[i][1] for i in some]))
    starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
    owner = np.repeat(np.arange(len(some)), sizes[some])
    for k in range(SAMPLES):
        at = ids * salts[k]
        at ^= at >> np.uint64(32)
        at *= salts[k - 1]
        at = at.view(np.uint16).reshape(-1, 4)  # the low quarter is mixed least
        rk, bk = r[at[:, 3]], beta[at[:, 1]]
        level = np.floor(logs / rk + bk)
        score = lc[at[:, 2]] - rk * (level - bk + 1)
        hit = np.flatnonzero(score == np.minimum.reduceat(score, starts)[owner])
        hit = hit[np.lexsort((ids[hit], owner[hit]))]  # ties: the least hash
        hit = hit[np.unique(owner[hit], return_index=True)[1]]
        out[some, k] = mix64(ids[hit] + level[hit].astype(np.int64).view(np.uint64))
    return out


def counted_bands(rows: DataFrame) -> tuple[DataFrame, int]:
    """The settled ``doc_id, text_key, bands, dfs`` of all texts (``dfs``: exact frequencies of their shingles), and their number."""
    blocks = settle(rows.mapInArrow(_blocks, _BLOCKS), "blocks", most=BLOCKS_FILE)
    size = blocks.select(F.size("doc_id").alias("n"), "chars").agg(F.sum("n"), F.sum("chars")).first()
    n, chars = size[0] or 0, size[1] or 0
    bits = (max(GROUPS, chars // GROUP_CHARS) - 1).bit_length()
    counts = blocks.select("block", "texts").mapInArrow(_cells(bits), _CELLS).groupBy("part").applyInArrow(_count, _REPLIES)
    return settle(blocks.drop("chars").groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_banded(n), _COUNTED), "icws-bands"), n


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    rows = keyed(docs)
    banded, n = counted_bands(rows)
    dfs = banded.where("text_key is not null").select("doc_id", "text_key", "dfs")
    banded = banded.drop("dfs")
    return banded, classes_by_bands(rows, banded, threshold, lambda texts, known: counted_vectors(texts, known, n), dfs)


def weighted_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Near-duplicate classes, a row per document: ``doc_id, class_id``, the least id of its class (see ``links``)."""
    return class_ids(*_classes(docs, threshold)).select("doc_id", "class_id")


def dedup(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each class left: that of the least id, then of the least text digest.

    Of rows that are equal in id and text, any one stays. Rows without a text
    all stay.
    """
    at, key = spare(docs, "at"), spare(docs, "text_key")
    classes = _classes(docs, threshold)[1]
    lead = classes.where(F.col("text_key") == F.col("lead.text_key")).select(F.coalesce("least", F.lit(NO_ID)).alias(at), F.col("text_key").alias(key))
    rows = docs.where("text is not null").withColumns({at: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), key: F.md5("text")})
    kept = rows.join(lead, [at, key], "left_semi").dropDuplicates([at, key]).drop(at, key)
    return kept.unionByName(docs.where("text is null"))
