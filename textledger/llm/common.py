"""Shared helpers: settled tables, ordered buckets, vectorised words and shingles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text are handled in runs of about so many code points, which bounds a task's memory.
RUN_CHARS = 400_000
#: A worker is handed so many rows at a time at most, and so many bytes (a longer row is alone).
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session (as in tests) gets a folder of its own;
    on a cluster that would be a wrong path for executors, so it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands workers batches of bounded size.

    Spark's own limits are 10,000 rows or 64 MB, which executor and worker both
    hold. Where the session was given limits, these stay.
    """
    given = spark.conf.getAll
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if key not in given:
            spark.conf.set(key, most)


def settle(df: DataFrame, tag: str, codec: str = "zstd", most: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors. ``most``: rows of a file (0: all of a task's)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}-{tag}"
    df.write.option("compression", codec).option("maxRecordsPerFile", most).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_cuts(df: DataFrame, key: str, buckets: int | None = None) -> list[float]:
    """Points that cut the integer column ``key`` into ``buckets`` (the shuffle's partitions) of about equally many rows."""
    n = buckets or partitions(df.sparkSession)
    probs = [i / n for i in range(1, n)]
    return sorted(set(df.approxQuantile(key, probs, 1 / (4 * n)))) if probs else []


def in_bucket(df: DataFrame, key: str, cuts: list[float], out: str) -> DataFrame:
    """Add ``out``: the number of the bucket between ``cuts`` that ``key`` falls into (nulls: the first). Equal keys share a bucket."""
    from pyspark.ml.feature import Bucketizer

    if not cuts:
        return df.withColumn(out, F.lit(0))
    tmp, number = spare(df, f"{out}_key"), spare(df, f"{out}_number")
    keyed = df.withColumn(tmp, F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))))
    split = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=tmp, outputCol=number)
    return split.transform(keyed).withColumn(out, F.col(number).cast("int")).drop(tmp, number)


def order_buckets(df: DataFrame, key: str, out: str, buckets: int | None = None) -> DataFrame:
    """Add ``out``: a bucket number that rises with the integer column ``key`` (nulls first).

    Buckets hold about equally many rows. The cut points, one per bucket, are all
    that reaches the driver. Equal keys share a bucket.
    """
    return in_bucket(df, key, bucket_cuts(df, key, buckets), out)


def running_offsets(df: DataFrame, group: list[str], bucket: str, order: list[Column], size: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``size`` over the rows before each one, within ``group``, in ``bucket`` and ``order`` order.

    Two levels, so no group has to fit one task: rows are summed within a
    bucket, and the buckets' totals (a row per group and bucket) are summed apart.
    """
    from pyspark.sql import Window as W

    df = df.withColumn("_size", size.cast("long"))
    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(F.sum("_size").alias("_total"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    totals = totals.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_base")
    joined = df.join(totals, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]).drop(*[f"_of_{k}" for k in keys])
    rows = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum("_size").over(rows), F.lit(0))).drop("_base", "_size")


#: Fewer keys than this have more than one in so many of the rows.
HOT_KEYS = 256


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row per ``key`` and in ``n`` how many of the rows have it.

    Keys that one in HOT_KEYS of the rows or more have are at most HOT_KEYS, so
    these are broadcast and their rows stay where they are; only the others are
    shuffled. ``rows`` is read three times: settle it first.
    """
    least = F.lit(max(rows.count() // HOT_KEYS, 2))
    hot, cold = F.broadcast(table.where(F.col("n") >= least)), table.where(F.col("n") < least)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, "left"))


def runs(texts: list[str], chars: int = RUN_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` that hold about ``chars`` code points each (a longer text is alone)."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > chars:
            yield begin, i
            begin, total = i, 0
        total += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


_FOLD: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point to its lower case where it is a letter or digit, else 0."""
    global _FOLD
    if _FOLD is None:
        table = np.zeros(0x110000, np.uint32)
        for cp in range(0x110000):
            ch = chr(cp)
            if ch.isalnum():
                table[cp] = ord(ch.lower()[0])
        _FOLD = table
    return _FOLD


def codes_of(texts: list[str]) -> np.ndarray:
    """Code points of the texts, each followed by a line feed."""
    return np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's published constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def place_weights(offset: np.ndarray) -> np.ndarray:
    """An odd-looking factor for each place in a word or piece; none comes again, however long it is."""
    weights = _POWERS[offset & 1023]
    far = np.flatnonzero(offset > 1023)
    if len(far):
        weights[far] += mix64(offset[far].astype(np.uint64))
    return weights


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of letters and digits, lower case), and each text's bounds in them."""
    low = fold_table()[codes_of(texts)]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    at = np.flatnonzero(low)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(first, append=len(at))
    offset = np.arange(len(at)) - np.repeat(first, lengths)
    values = low[at].astype(np.uint64) * place_weights(offset)
    hashes = mix64(np.add.reduceat(values, first))
    bounds = np.concatenate(([0], np.searchsorted(at[first], ends)))
    return hashes, bounds


def shingles(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the texts' word shingles, and each text's bounds in them.

    A text of fewer than ``width`` words has one shingle of all its words; a text without words has none.
    """
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    out = np.zeros(len(words), np.uint64)
    n = len(words) - width + 1
    if n > 0:
        for k in range(width):
            out[:n] += words[k : n + k] * _POWERS[k + 7]
    keep = np.ones(len(words), bool)
    per = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    for k in range(1, width):  # the last width-1 words of a text begin no shingle
        last = bounds[1:] - k
        keep[last[(counts >= k) & (last >= bounds[:-1])]] = False
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        a, b = bounds[i], bounds[i + 1]
        out[a] = np.uint64(sum(int(w) * int(p) for w, p in zip(words[a:b], _POWERS[7:])) & (2**64 - 1)) + np.uint64(b - a)
        keep[a] = True
    return mix64(out[keep]), np.concatenate(([0], np.cumsum(per)))


def column(batch, name: str, default=None) -> list:
    """A column of an Arrow batch as a list, with nulls replaced."""
    values = batch.column(name).to_pylist()
    return [default if v is None else v for v in values] if default is not None else values


def slices(batches: Iterable, rows: int = 256) -> Iterator:
    """Arrow batches cut into small ones, so that what is made of one stays small.

    At the end, freed memory is given back.
    """
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    give_back()


def give_back() -> None:
    """Give what was freed back to the system: a worker stays after its task, beside the executor's others, with all it holds."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


#: Bits of a key filter: a fixed size, so it may go to every task. With ever more keys it lets ever more rows pass, but loses none.
FILTER_BITS = 1 << 26


def key_filter(keys: DataFrame, key: str) -> np.ndarray:
    """A Bloom filter of two bits a key, as words of 32 bits; see ``may_be_in``."""
    h = F.xxhash64(key)
    places = keys.select(F.explode(F.array(h, F.shiftright(h, 32))).alias("h")).select(F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at & 31 as int))")
    words = places.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()  # FILTER_BITS / 32 rows at most
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def may_be_in(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether keys of these ``xxhash64`` values may be in a filter (those that are, are)."""
    out = np.ones(len(hashes), bool)
    for h in (hashes, hashes >> 32):
        at = h & (FILTER_BITS - 1)
        out &= (filter_[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)
    return out


def likely(df: DataFrame, wanted: DataFrame, key: str = "text_key") -> DataFrame:
    """``df`` without most of its rows whose ``key`` is none of ``wanted``'s; all others stay."""
    names, shared = df.columns, df.sparkSession.sparkContext.broadcast(key_filter(wanted, key))  # FILTER_BITS

    def keep(batches):
        import pyarrow as pa

        for batch in slices(batches):
            yield batch.filter(pa.array(may_be_in(shared.value, batch.column("_hash").to_numpy()))).select(names)

    return df.withColumn("_hash", F.xxhash64(key)).mapInArrow(keep, df.schema)


def squeezed(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its column ``text`` as compressed bytes, for shuffles that texts make up most of; nulls stay."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    names = df.columns

    def pack(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            data = [None if t is None else press.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()) if c == text else batch.column(c) for c in names], names=names)

    return df.mapInArrow(pack, StructType([StructField(f.name, BinaryType()) if f.name == text else f for f in df.schema]))


def unsqueezed(data: list) -> list[str]:
    """The texts of a column made by ``squeezed``, nulls as empty texts."""
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    return ["" if x is None else open_.decompress(x).decode("utf-8", "surrogatepass") for x in data]


def pressed(texts: list[str]) -> bytes:
    """All texts as one run of compressed bytes, with their number and lengths before them."""
    import zstandard

    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(data), *map(len, data)], "<u4").tobytes() + b"".join(data))


def unpressed(data) -> list[str]:
    """The texts of ``pressed``."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    ends = 4 * (1 + int.from_bytes(data[:4], "little")) + np.cumsum([0, *np.frombuffer(data, "<u4", int.from_bytes(data[:4], "little"), 4).tolist()])
    return [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(ends, ends[1:])]


class keyed_sum:
    """Sum a numpy table of fixed size over all partitions: blocks of it are summed by Spark."""

    SCHEMA = "block int, at array<int>, n array<long>"

    @staticmethod
    def emit(table: np.ndarray, rows: int, block: int):
        import pyarrow as pa

        used = np.flatnonzero(table)
        blocks = np.append(used // block, -1).astype(np.int32)
        edges = np.flatnonzero(np.diff(blocks, prepend=-2))
        ids, ats, ns = [-1], [[0]], [[rows]]
        for a, b in zip(edges, edges[1:]):
            ids.append(int(blocks[a]))
            ats.append(used[a:b].astype(np.int32))
            ns.append(table[used[a:b]])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(ats, pa.list_(pa.int32())), pa.array(ns, pa.list_(pa.int64()))], names=["block", "at", "n"])

    @staticmethod
    def total(parts: DataFrame, size: int, block: int) -> tuple[np.ndarray, int]:
        """The summed table (its size is fixed, so it may come to the driver) and the number of rows."""
        import pandas as pd

        def add(key, pdf):
            at, n = np.concatenate(pdf["at"].to_list()), np.concatenate(pdf["n"].to_list())
            used, where = np.unique(at, return_inverse=True)
            return pd.DataFrame({"block": [key[0]], "at": [used], "n": [np.bincount(where, n).astype(np.int64)]})

        out, rows = np.zeros(size, np.int64), 0
        salted = parts.withColumn("salt", F.spark_partition_id() % 64)
        once = salted.groupBy("block", "salt").applyInPandas(lambda k, p: add(k, p), keyed_sum.SCHEMA)
        for row in once.groupBy("block").applyInPandas(lambda k, p: add(k, p), keyed_sum.SCHEMA).toLocalIterator():
            if row["block"] < 0:
                rows = row["n"][0]
            else:
                out[np.array(row["at"])] = row["n"]
        return out, rows
