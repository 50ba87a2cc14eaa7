"""Packing work into batches that are bounded by rows and characters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..streaming.live import shared_folder

#: Rows in a chunk of a category; chunks are packed apart and then put together.
CHUNK = 4096
#: Chunks, or maps of chunks, that one task puts together.
TOGETHER = 256


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, as more than one later step asks for it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batch_numbers(sizes: Iterable[int], rows: int, chars: int, alone: int, long: int = 120, long_rows: int = 8, long_chars: int = 5000) -> Iterator[int]:
    """Batch number of each item, in order: a batch closes when the next item would pass a limit; items over ``alone`` have their own.

    With any item over ``long``, the next one included, ``long_rows`` (``rows`` if that is less) and ``long_chars`` are the limits.
    """
    number, n, total, some = -1, 0, 0, False
    shut = True
    for size in sizes:
        some = some or size > long
        if shut or size > alone or n >= (min(rows, long_rows) if some else rows) or total + size > (long_chars if some else chars):
            number, n, total, some = number + 1, 0, 0, size > long
        n, total, shut = n + 1, total + size, size > alone
        yield number


def chunk_map(sizes: list[int], own: int, rows: int, chars: int, alone: int, **limits: int) -> tuple[list[int], list[int]]:
    """What a chunk does to packing, for each place of its first batch start from 0 to ``rows``.

    ``sizes`` are those of the chunk's ``own`` rows and the ``rows`` that follow
    (fewer at the end). Returns how far behind the chunk's end the next batch
    starts, and how many batches start in the chunk.
    """
    out, begun = [0] * own, [0] * own
    for i in range(own - 1, -1, -1):
        ahead = sizes[i : i + rows + 1]
        j = i + next((k for k, number in enumerate(batch_numbers(ahead, rows, chars, alone, **limits)) if number), len(ahead))
        out[i], begun[i] = (j - own, 1) if j >= own else (out[j], begun[j] + 1)
    first = range(rows + 1)
    return [out[i] if i < own else i - own for i in first], [begun[i] if i < own else 0 for i in first]


def pack_whole(work: DataFrame, category: str, key: str, text: str, rows: int = 32, chars: int = 3000, alone: int = 1400, size: Column | None = None, **limits: int) -> DataFrame:
    """``category, key, batch``: greedy batches in ascending order of the integer ``key``, each category packed from end to end.

    A row's size is its text's length, or ``size``; ``limits`` are those of ``batch_numbers``.

    A category is cut into chunks of ``CHUNK`` rows. Where a batch starts in a
    chunk decides all later starts in it, and the first start is at most
    ``rows`` behind the chunk's begin: so each chunk is packed from each of
    these, which makes it a map from the first start to the next chunk's.
    ``TOGETHER`` maps of neighbours are composed to one, and so on up to one a
    category; the starts come down the same tree. No task has more maps than that.
    Only keys and lengths are shuffled. A null text counts as empty; null keys
    come first.
    """
    sized = work.select(
        F.col(category).alias("category"),
        F.col(key).cast("long").alias("key"),
        F.coalesce(F.length(text) if size is None else size, F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.floor(F.col(key) / CHUNK).cast("long"), F.lit(-(2**63))).alias("span"),
    )
    spans = sized.groupBy("category", "span").agg(F.count("*").alias("n"))
    # Rows before a span: those of spans of the same far begin, and those of all earlier far begins (a row for TOGETHER spans).
    spans = spans.withColumn("far", F.expr(f"span div {TOGETHER}"))
    earlier = lambda *by: F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("span" if len(by) > 1 else "far").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fars = spans.groupBy("category", "far").agg(F.sum("n").alias("n")).select(F.col("category").alias("_category"), F.col("far").alias("_far"), earlier("category").alias("past"))
    spans = spans.withColumn("near", earlier("category", "far")).join(fars, F.col("category").eqNullSafe(F.col("_category")) & (F.col("far") == F.col("_far")))
    spans = spans.select(F.col("category").alias("_category"), F.col("span").alias("_span"), (F.col("past") + F.col("near")).alias("base"))
    order = W.partitionBy("category", "span").orderBy(F.col("key").asc_nulls_first(), "size")
    placed = sized.withColumn("at", F.row_number().over(order)).join(spans, F.col("category").eqNullSafe(F.col("_category")) & (F.col("span") == F.col("_span")))
    placed = placed.withColumn("at", F.col("base") + F.col("at") - 1).select("category", "key", "size", "at", F.expr(f"at div {CHUNK}").alias("chunk"))

    kind = placed.schema["category"].dataType.simpleString()

    def maps(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        own = int((frame["at"] // CHUNK == frame["chunk"]).sum())
        ends, begun = chunk_map(frame["size"].tolist(), own, rows, chars, alone, **limits)
        return pd.DataFrame({"category": [frame["category"].iloc[0]], "chunk": [frame["chunk"].iloc[0]], "ends": [ends], "begun": [begun]})

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        """The map of neighbouring chunks one after another."""
        ends, begun = np.arange(rows + 1), np.zeros(rows + 1, np.int64)
        frame = frame.sort_values("chunk")
        for e, b in zip(frame["ends"], frame["begun"]):
            begun, ends = begun + np.asarray(b)[ends], np.asarray(e)[ends]
        return pd.DataFrame({"category": [frame["category"].iloc[0]], "chunk": [frame["chunk"].iloc[0] // TOGETHER], "ends": [ends.tolist()], "begun": [begun.tolist()]})

    def begin(frame: pd.DataFrame) -> pd.DataFrame:
        """Each chunk's first start and batch number, from those of the chunks together."""
        frame, out = frame.sort_values("chunk"), []
        first, base = int(frame["first"].iloc[0]), int(frame["base"].iloc[0])
        for ends, begun in zip(frame["ends"], frame["begun"]):
            out.append((first, base))
            first, base = int(ends[first]), base + int(begun[first])
        return frame.assign(first=[x for x, _ in out], base=[x for _, x in out])[["category", "chunk", "first", "base"]]

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        first, base = int(frame["first"].iloc[0]), int(frame["base"].iloc[0])
        sizes = frame["size"].tolist()
        batch = [base - 1] * min(first, len(sizes)) + [base + x for x in batch_numbers(sizes[first:], rows, chars, alone, **limits)]
        return frame.assign(batch=batch)[["category", "key", "batch"]]

    halo = placed.where((F.col("at") % CHUNK <= rows) & (F.col("chunk") > 0)).withColumn("chunk", F.col("chunk") - 1)
    maps_kind = f"category {kind}, chunk long, ends array<long>, begun array<long>"
    done = placed.unionByName(halo).groupBy("category", "chunk").applyInPandas(maps, maps_kind)
    most = sized.groupBy("category").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    chunks, levels = -(-most // CHUNK), [done]
    if chunks > 1:  # else there is no map to look at
        levels = [kept(done)]
    while chunks > 1:
        levels.append(levels[-1].groupBy("category", F.expr(f"chunk div {TOGETHER}")).applyInPandas(compose, maps_kind))
        chunks = -(-chunks // TOGETHER)
    starts = levels.pop().select("category", "chunk", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("base"))  # one a category
    for level in reversed(levels):
        known = starts.withColumnsRenamed({"category": "_category", "chunk": "_chunk"})
        met = level.withColumn("_above", F.expr(f"chunk div {TOGETHER}")).join(known, F.col("category").eqNullSafe(F.col("_category")) & (F.col("_above") == F.col("_chunk")))
        starts = met.select("category", "chunk", "ends", "begun", "first", "base", "_above").groupBy("category", "_above").applyInPandas(lambda f: begin(f.drop(columns="_above")), f"category {kind}, chunk long, first long, base long")
    starts = starts.withColumnsRenamed({"category": "_category", "chunk": "_chunk"})
    joined = placed.join(starts, F.col("category").eqNullSafe(F.col("_category")) & (F.col("chunk") == F.col("_chunk"))).select("category", "key", "size", "at", "chunk", "first", "base")
    out = joined.groupBy("category", "chunk").applyInPandas(fill, f"category {kind}, key long, batch long")
    return out.select(F.col("category").alias(category), F.col("key").alias(key), "batch")


#: The limits of the two modes: fast, and with the quality model.
FAST = {"rows": 32, "chars": 3000, "alone": 1400, "long": 120, "long_rows": 8, "long_chars": 5000}
QUALITY = {"rows": 10, "chars": 2200, "alone": 1400, "long": 120, "long_rows": 4, "long_chars": 1800}


def pack_lines(work: DataFrame, category: str, key: str, text: str, rows: int = 20, chars: int = 1400) -> DataFrame:
    """Batches that travel as lines of one text: a text of several lines is alone, and each row costs its line feed."""
    cost = F.when(F.col(text).rlike("[\r\n]"), chars + 1).otherwise(F.length(text) + 1)
    return pack_whole(work, category, key, text, rows, chars, chars, size=cost, long=10**9)


def pack(work: DataFrame, category: str, key: str, text: str, rows: int = 32, chars: int = 3000, alone: int = 1400, span: int = 4096) -> DataFrame:
    """``category, key, span, batch``: greedy batches in ascending order of the integer ``key``, each of one category.

    Packing is sequential, so it is done within spans of ``span`` consecutive
    keys: a category of any size is spread over many tasks, at the price of one
    short batch at most for each span. Only keys and lengths are shuffled. A
    null text counts as empty; a row without a key is in the span -1.
    """
    schema = work.select(F.col(category).alias("category"), F.col(key).cast("long").alias("key")).schema
    sized = work.select(
        F.col(category).alias("category"),
        F.col(key).cast("long").alias("key"),
        F.coalesce(F.length(text), F.lit(0)).alias("size"),
        F.coalesce(F.floor(F.col(key) / span), F.lit(-1)).cast("long").alias("span"),
    )

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "size"], kind="stable")
        return frame.assign(batch=list(batch_numbers(frame["size"], rows, chars, alone)))[["category", "key", "span", "batch"]]

    out = schema.add("span", "long").add("batch", "long")
    return sized.groupBy("category", "span").applyInPandas(fill, out).select(F.col("category").alias(category), F.col("key").alias(key), "span", "batch")
