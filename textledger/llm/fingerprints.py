"""Document fingerprints: MinHash signatures, banded and verified.

Definitions: words are runs of letters and digits in lower case; a shingle is
five words. A null text counts as empty. A text with fewer than five words has
one shingle of all its words; texts without words have the same, maximal
signature (so their likeness is 1). Repeated rows and equal ids are kept, each
with a result; equal ids are ordered by their texts' digests. Very long texts are taken whole.
An empty table gives no rows. Other columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_cuts, column, in_bucket, runs, settle, shingles, slices, squeezed, unsqueezed
from .links import BANDED, banded_batch, class_ids, classes_by_bands, keyed, plain_vectors

PERMUTATIONS = 128
SEED = 20240601


def permutations(n: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of ``n`` universal (multiply-add-shift) hash functions on 64 bits."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def signatures(texts: list[str], n: int = PERMUTATIONS) -> np.ndarray:
    """Signatures (texts x n, 16 bits kept of each minimum)."""
    a, b = permutations(n)
    out = np.full((len(texts), n), 0xFFFF, np.uint16)
    for i, j in runs(texts):
        hashes, bounds = shingles(texts[i:j])
        some = np.flatnonzero(np.diff(bounds))
        if len(some):
            for k in range(n):
                least = np.minimum.reduceat((hashes * a[k] + b[k]) >> np.uint64(24), bounds[some])
                out[i + some, k] = (least & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity: the share of equal slots."""
    return (x == y).mean(axis=-1)


def text_hex(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long"


def _compare(batches):
    """Rows come ordered by id; each text is followed by the next document (at a bucket's end by a copy marked as ghost).

    Before the texts of an id come their classes: rows of digest and class.
    """
    held, at, classes = None, None, {}  # the last text: id, ghost, text, class, signature; the id whose classes are known
    for batch in slices(batches):
        new = []
        for i, ghost, key, text, named in zip(*[column(batch, c) for c in ("_id", "_ghost", "_key")], unsqueezed(column(batch, "_text")), column(batch, "_class")):
            if named is not None:
                if i != at:
                    at, classes = i, {}
                classes[key] = named
            else:
                new.append((i, ghost, text, classes.get(key, i) if i == at else i))
        if not new:
            continue
        sigs = signatures([r[2] for r in new])
        rows = ([held] if held else []) + [(*r, s) for r, s in zip(new, sigs)]
        held = rows[-1]
        pairs = [(r, s) for r, s in zip(rows, rows[1:]) if not r[1]]
        if not pairs:
            continue
        changed = [edited(r[2], s[2]) for r, s in pairs]
        other = signatures(changed)
        own, after = np.array([r[4] for r, _ in pairs]), np.array([s[4] for _, s in pairs])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r, _ in pairs], pa.int64()),
                pa.array([len(r[2]) for r, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed]),
                pa.array([text_hex(r[4]) for r, _ in pairs]),
                pa.array([text_hex(s) for s in other]),
                pa.array(likeness(own, other)),
                pa.array(likeness(own, after)),
                pa.array([r[3] for r, _ in pairs], pa.int64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"],
        )


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, its edited form, compare both with the next document by id, and name its near-duplicate class.

    Classes come from the banded signatures (``near_classes``). Texts are
    shuffled once, compressed, into buckets of rising ids, and the classes with them. Each
    bucket also gets a copy of the next bucket's first row, so no task needs
    another's rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    cuts = bucket_cuts(rows, "_id")
    rows = in_bucket(rows, "_id", cuts, "_bucket")
    key = F.coalesce(F.col("_id"), F.lit(-(2**63)))
    first = dict(rows.groupBy("_bucket").agg(F.min(key)).collect())  # one row per bucket
    if not first:
        return spark.createDataFrame([], _SCHEMA)
    order = sorted(first)
    lead = [(first[b], order[i - 1]) for i, b in enumerate(order)]  # a first key, and the bucket before it
    lead = F.broadcast(spark.createDataFrame(lead, "_first long, _before int"))  # one row per bucket
    named = near_classes(docs).where("class_id <> doc_id or (doc_id is null and class_id is not null)").distinct()
    named = named.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("class_id").alias("_class"))
    named = in_bucket(named, "_id", cuts, "_b").withColumns({"_ghost": F.lit(False), "_text": F.lit(None).cast("binary")})
    packed = squeezed(rows.select("_id", F.md5("_text").alias("_key"), "_text"), "_text")
    spread = (
        in_bucket(packed, "_id", cuts, "_bucket")
        .withColumn("_first", key)
        .join(lead, "_first", "left")
        .withColumn("_own", F.explode(F.when(F.col("_before").isNull(), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))))
        .select("_id", "_key", "_text", F.lit(None).cast("long").alias("_class"), F.when(F.col("_own"), F.col("_bucket")).otherwise(F.col("_before")).alias("_b"), (~F.col("_own")).alias("_ghost"))
    )
    spread = spread.unionByName(named.select(*spread.columns))
    dealt = spread.repartitionById(max(1, max(order) + 1), "_b").sortWithinPartitions("_b", "_ghost", F.col("_id").asc_nulls_first(), F.col("_class").isNull(), "_key")
    return dealt.select("_id", "_ghost", "_key", "_text", "_class").mapInArrow(_compare, _SCHEMA)


def _bands(batches):
    for batch in slices(batches):
        yield banded_batch(batch, signatures(column(batch, "text", "")))


def near_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Near-duplicate classes by banded MinHash and exact Jaccard over shingle sets.

    Returns ``doc_id, text_key, class_id`` for every row; the class is named by its least id.
    """
    rows = keyed(docs)
    banded = settle(rows.mapInArrow(_bands, BANDED), "minhash-bands")
    return class_ids(banded, classes_by_bands(rows, banded, threshold, plain_vectors))
