"""Queries that run streams over the given tables until they have read all there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import catalogs as C
from ..streaming import cache as K
from ..streaming import live as S
from .registry import query, table


def _files(spark, sf_dir, name, where):
    """The table as several files, so that there are several micro-batches."""
    path = S.shared_folder(spark)
    table(spark, sf_dir, name).where(where).repartition(6).write.parquet(path)
    return path


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_unseen(spark, sf_dir):
    """Pairs that a stream, read two files at a time, sees for the first time, written as JSON lines and read again."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    path = _files(spark, sf_dir, "events", "true")
    stream = S.limited(spark, path, e.schema, 2)
    out = S.shared_folder(spark)
    S.run_json_lines(S.unseen(stream, ["user_id", "event_type"]), out)
    return C.read_jsonl(spark, f"{out}/rows", "user_id long, event_type string")


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id")
def stream_chat(spark, sf_dir):
    """Chat lines made from events, parsed by a stream of text; each sender's distinct texts, counted."""
    path = S.shared_folder(spark)
    line = F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(",000 - [trade] "), F.col("user_id").cast("string"), F.lit(" : "), "event_type")
    lines = table(spark, sf_dir, "events").select(F.explode(F.array(line, F.lit("no chat line"))).alias("value"))
    lines.repartition(4).write.text(path)
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(path)
    out = S.shared_folder(spark)
    S.run_json_lines(S.unseen(S.chat_messages(stream).select("sender", "text"), ["sender", "text"]), out)
    rows = C.read_jsonl(spark, f"{out}/rows", "sender string, text string")
    return rows.groupBy(F.col("sender").cast("long").alias("user_id")).agg(F.count("*").alias("n"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, count(DISTINCT event_type) AS asked, count(*) - count(DISTINCT event_type) AS known FROM events GROUP BY user_id")
def stream_cache(spark, sf_dir):
    """A cache of each user's texts over several micro-batches: asked for once, known from then on."""
    stream = S.limited(spark, _files(spark, sf_dir, "events", "true"), table(spark, sf_dir, "events").schema, 2)
    out = K.run_cached(stream, key="user_id", time="ts", text="event_type", late="10000 days", idle="10000 days")
    return out.groupBy("key").agg(F.count_if(F.col("action") == "ASK").alias("asked"), F.count_if(F.col("action") == "KNOWN").alias("known"))
