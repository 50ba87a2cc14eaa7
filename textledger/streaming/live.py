"""Streaming: live state of keys, texts seen before, log and chat lines, results as JSON lines.

Streams are Structured Streaming from source to sink. What is kept between
micro-batches is in Spark's state store, or in tables below
``spark.checkpoint.dir`` that a replayed batch writes again as they were.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of a level that become one run of the next.
FANOUT = 4


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, below ``spark.checkpoint.dir``. Where that is unset, a local session (as in tests) gets one of its own; on a cluster it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{uuid.uuid4().hex}"


def latest_rows(log: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return log.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in log.columns if c != key]), F.struct(*order)).alias("_r")).select(key, "_r.*")


class LiveState:
    """The last row of each key, as runs of rows in levels; an index per batch lists the runs that count.

    Batch ``n`` writes its own keys' last rows as a run of level 0. Where a
    level has ``FANOUT`` runs, they become one run of the next, so a row is
    written once a level, and levels grow with the logarithm of the state: what
    a batch writes is in proportion to it, on the average. Tombstones are kept,
    so late older rows cannot revive a key. Batch ``n`` reads index ``n - 1``
    and writes runs and an index that are named after it; run again it writes
    the same. Runs that no index lists any more may be deleted by the caller
    once no reader needs them.
    """

    def __init__(self, base: str, schema, key: str, order: list[Column]):
        self.base, self.schema, self.key, self.order = base, schema, key, order

    def index(self, spark: SparkSession, number: int) -> list[tuple[int, str]]:
        """Level and name of the runs that count after a batch (FANOUT a level at most)."""
        try:
            return sorted((r["level"], r["run"]) for r in spark.read.schema("level int, run string").parquet(f"{self.base}/index-{number}").collect())
        except AnalysisException:
            return []

    def rows(self, spark: SparkSession, runs: list[str]) -> DataFrame:
        paths = [f"{self.base}/{run}" for run in runs]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, run: str) -> str:
        latest_rows(rows, self.key, self.order).select(*self.schema.names).write.mode("overwrite").parquet(f"{self.base}/{run}")
        return run

    def merge(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        runs = [*self.index(spark, number - 1), (0, self._write(batch.select(*self.schema.names), f"run-{number}-0"))]
        level = 0
        while len(own := [run for n, run in runs if n == level]) >= FANOUT:
            merged = self._write(self.rows(spark, own), f"run-{number}-{level + 1}")
            runs = [x for x in runs if x[0] != level] + [(level + 1, merged)]
            level += 1
        spark.createDataFrame(runs, "level int, run string").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/index-{number}")

    def last(self, spark: SparkSession, number: int) -> DataFrame:
        return latest_rows(self.rows(spark, [run for _, run in self.index(spark, number)]), self.key, self.order).select(*self.schema.names)


def run_latest(stream: DataFrame, key: str, order: list[Column], status: str, live: list[str], tombstone: str) -> DataFrame:
    """Run ``stream`` over what is there now and return the state: the last state row of each key, tombstoned keys gone."""
    spark = stream.sparkSession
    base = shared_folder(spark)
    states = stream.where(F.col(status).isin(*live, tombstone))
    state = LiveState(base, states.schema, key, order)
    query = states.writeStream.foreachBatch(state.merge).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    numbers = [p["batchId"] for p in query.recentProgress]
    return state.last(spark, max(numbers, default=-1)).where(F.col(status) != tombstone)


def limited(spark: SparkSession, path: str, schema, files: int, pattern: str = "*.parquet") -> DataFrame:
    """A stream of a folder's Parquet files, at most ``files`` of them in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(path)


def unseen(stream: DataFrame, keys: list[str], time: str | None = None, keep: str = "1 hour") -> DataFrame:
    """Rows whose ``keys`` were not seen before: at all, or within ``keep`` of event time where ``time`` is given, which bounds the state."""
    if time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark(keys)


CHAT = r"^(\d{2}:\d{2}:\d{2}),\d{3} - \[([^\]]*)\] ([^:]*?) : (.*)$"


def chat_messages(lines: DataFrame) -> DataFrame:
    """``time, channel, sender, text`` of chat lines (``value``); other lines are dropped."""
    part = lambda i: F.regexp_extract("value", CHAT, i)
    return lines.where(F.col("value").rlike(CHAT)).select(part(1).alias("time"), part(2).alias("channel"), part(3).alias("sender"), part(4).alias("text"))


def run_json_lines(stream: DataFrame, path: str) -> None:
    """Append what is there now to JSON lines below ``path``; a run again goes on where the last one ended."""
    stream.writeStream.format("json").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
