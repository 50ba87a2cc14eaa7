"""Files as rows: what to back up, to mirror, and which state a file is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def backed_up(files: DataFrame, directories: list[str], known: DataFrame) -> DataFrame:
    """``files`` (``path, length``) but those in listed directories, temporary ones, and tables that ``known`` has with the same name and length."""
    parts = F.split(F.lower("path"), "/")
    name = F.element_at(parts, -1)
    inside = F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(d.lower()) for d in directories]))
    have = known.select(F.lower(F.element_at(F.split("path", "/"), -1)).alias("_name"), F.col("length").alias("_length")).distinct()
    rest = files.withColumn("name", name).where(~inside & ~name.endswith(".tmp"))
    return rest.join(have, (F.col("name") == F.col("_name")) & (F.col("length") == F.col("_length")) & F.col("name").endswith(".tsv"), "left_anti").drop("name")


def totals(files: DataFrame, kept: DataFrame) -> DataFrame:
    """``files, skipped, bytes`` of a backup."""
    rows = files.select(F.lit(0).alias("kept"), F.lit(0).cast("long").alias("bytes")).union(kept.select(F.lit(1), F.col("length").cast("long")))
    sums = rows.agg(F.coalesce(F.sum("kept"), F.lit(0)).alias("files"), F.count_if(F.col("kept") == 0).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return sums.select("files", (F.col("n") - F.col("files")).alias("skipped"), "bytes")


def to_copy(source: DataFrame, mirror: DataFrame) -> DataFrame:
    """``name, reason`` of files that the mirror lacks or has with another hash (``name, sha``)."""
    there = mirror.select("name", F.col("sha").alias("_sha"))
    reason = F.when(F.col("_sha").isNull(), "ABSENT").when(F.col("_sha") != F.col("sha"), "CHANGED")
    return source.join(there, "name", "left").withColumn("reason", reason).where("reason is not null").select("name", "reason")


def file_states(live: DataFrame, output: DataFrame, source: DataFrame, patched: DataFrame) -> DataFrame:
    """``component, state``: whether a live file is our last output, the known source, a recorded patch, or a new source.

    All are ``component, sha``; a component without a live file is MISSING.
    """
    out = live.select("component", F.col("sha").alias("live"))
    for name, other in (("output", output), ("source", source), ("patched", patched)):
        out = out.join(other.select("component", F.col("sha").alias(name)), "component", "full_outer")
    state = F.when(F.col("live").isNull(), "MISSING").when(F.col("live") == F.col("output"), "OUR_OUTPUT").when(F.col("live") == F.col("source"), "KNOWN_SOURCE").when(F.col("live") == F.col("patched"), "PATCHED").otherwise("NEW_SOURCE")
    return out.select("component", state.alias("state"))


def quick_fingerprint(data: Column, whole: int = 32 << 20, edge: int = 1 << 20) -> Column:
    """SHA-256 of small contents; of large ones of their length, first and last ``edge`` bytes."""
    n = F.octet_length(data)
    ends = F.concat(n.cast("string").cast("binary"), F.substring(data, 1, edge), F.substring(data, n - edge + 1, F.lit(edge)))
    return F.when(n <= whole, F.sha2(data, 256)).otherwise(F.sha2(ends, 256))
