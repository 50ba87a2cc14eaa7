"""Writers: lossless rewrites of packages, and reports as escaped TSV, JSON lines and text.

Writers go through Spark's file sinks, which commit a whole directory or
nothing. Order, where a report has one, is a range partitioning by Spark, so no
report passes one task; a reader that reads its files by name has it in order.
"""

from __future__ import annotations

import io
import zipfile
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_field
from ..operators.ladder import three_way
from ..operators.versions import with_identity


def rewrite(lines: DataFrame, proposals: DataFrame) -> DataFrame:
    """Lines (see ``read_lines``) with the values of ``proposals`` (``identity, value``); all else stays as it is.

    Line feeds in a value are written as two characters. Comments, order, line
    ends and byte order marks are kept. ``changed`` tells the lines written anew.
    """
    records = with_identity(lines.where("key is not null"), scope=("package",)).select("package", "entry", "line_no", "identity")
    given = records.join(proposals.select("identity", F.col("value").alias("_new")), "identity").select("package", "entry", "line_no", "_new")
    out = lines.join(given, ["package", "entry", "line_no"], "left")
    new = F.concat(F.substring_index("raw", "=", 1), F.lit("="), F.regexp_replace("_new", "\r\n|\r|\n", r"\\n"))
    return out.select("package", "entry", "line_no", F.coalesce(new, "raw").alias("raw"), "newline", F.col("_new").isNotNull().alias("changed"))


def pack(lines: DataFrame) -> DataFrame:
    """``package, content``: each package's entries zipped; one package, which is one file, is one task's work, through which its lines go as a stream."""

    def build(batches):
        lines_ = (row for b in batches for i in range(0, b.num_rows, 1024) for row in zip(*b.slice(i, 1024).to_pydict().values()))
        for package, own in groupby(lines_, key=lambda r: r[0]):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                for entry, rows in groupby(own, key=lambda r: r[1]):
                    info = zipfile.ZipInfo(entry, (1980, 1, 1, 0, 0, 0))  # the same lines give the same bytes
                    info.compress_type = zipfile.ZIP_DEFLATED
                    with z.open(info, "w", force_zip64=True) as file:
                        for _, _, raw, newline in rows:
                            file.write((raw + newline).encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array([package], pa.string()), pa.array([out.getvalue()], pa.binary())], names=["package", "content"])

    ordered = lines.repartition("package").sortWithinPartitions("package", "entry", "line_no")
    return ordered.select("package", "entry", "raw", "newline").mapInArrow(build, "package string, content binary")


def rewrite_by_policy(lines: DataFrame, resolved: DataFrame, form_ok) -> tuple[DataFrame, DataFrame]:
    """Rewrite with what a ladder resolved (``identity, key, source, value, origin, stale``), and report what was left out.

    A value that is stale (there, but not approved), blank, equal to its source
    or of another form (``form_ok(source, value)``) is not written. The report
    has one row a key, that of the first identity: ``key, identity, reason``.
    """
    reason = (
        F.when(F.col("stale"), "STALE_SOURCE")
        .when(F.col("value").isNull() | (F.trim("value") == ""), "NO_VALUE")
        .when(F.col("value") == F.col("source"), "SAME_AS_SOURCE")
        .when(~form_ok(F.col("source"), F.col("value")), "FORM")
    )
    judged = resolved.withColumn("reason", reason)
    skipped = judged.where("reason is not null").groupBy("key").agg(F.min_by(F.struct("identity", "reason"), "identity").alias("r"))
    return rewrite(lines, judged.where("reason is null").select("identity", "value")), skipped.select("key", "r.identity", "r.reason")


def rewrite_adaptively(lines: DataFrame, baseline: DataFrame, prepared: DataFrame, memory: DataFrame, **more) -> DataFrame:
    """Rewrite lines by a three-way merge on keys (see ``ladder.three_way``); lines whose value stays are not touched.

    A key that repeats in the lines is merged by its last value, as readers see it, and written so in all its places.
    """
    records = with_identity(lines.where("key is not null"), scope=("package",)).select("package", "identity", "key", "value", "entry", "line_no")
    now = records.groupBy("key").agg(F.max_by("value", F.struct("entry", "line_no")).alias("value"))
    merged = three_way(now, baseline, prepared, memory, **more).where("choice <> 'SOURCE'").select("key", F.col("merged").alias("_new"))
    new = records.join(merged, "key").where(~F.col("value").eqNullSafe(F.col("_new"))).select("identity", F.col("_new").alias("value")).distinct()
    return rewrite(lines, new)


def tsv(rows: DataFrame, columns: list[str]) -> Column:
    """One escaped line a row; nulls are empty."""
    return F.array_join(F.array(*[escape_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]), "\t")


def write_tsv(rows: DataFrame, path: str, columns: list[str], order: list | None = None, header: bool = True) -> None:
    """A report of escaped lines, sorted by ``order`` over its files; the first line of every file is the header.

    Each part file begins with the header (as Spark's CSV files do), so parts can be read alone.
    """
    lines = rows.select(*(order or []), tsv(rows, columns).alias("value")) if not order else rows.orderBy(*order).select(tsv(rows, columns).alias("value"))
    if not header:
        lines.select("value").write.mode("overwrite").text(path)
        return
    first = "\t".join(columns)

    def with_header(frames):
        yield pd.DataFrame({"value": [first]})
        yield from frames

    lines.select("value").mapInPandas(with_header, "value string").write.mode("overwrite").text(path)


def write_status(rows: DataFrame, path: str, columns: list[str], issue: Column) -> None:
    """Two reports below ``path``: ``status`` with all rows, ``issues`` with those that are issues."""
    write_tsv(rows, f"{path}/status", columns, [columns[0]])
    write_tsv(rows.where(issue), f"{path}/issues", columns, [columns[0]])


def counts_text(rows: DataFrame, status: str, issue: Column) -> DataFrame:
    """A summary as lines ``value``: each status with its count, then the total and the issues."""
    sums = rows.rollup(status).agg(F.count("*").alias("n"), F.count_if(issue).alias("issues"), F.grouping(status).alias("_all"))
    counts = sums.select(F.col("_all").alias("at"), F.coalesce(F.col(status), F.lit("TOTAL")).alias("name"), "n", "issues")
    lines = F.when(F.col("at") == 1, F.array(F.concat(F.lit("TOTAL: "), F.col("n").cast("string")), F.concat(F.lit("ISSUES: "), F.col("issues").cast("string")))).otherwise(F.array(F.concat("name", F.lit(": "), F.col("n").cast("string"))))
    return counts.orderBy("at", "name").select(F.explode(lines).alias("value"))


def write_findings(findings: DataFrame, path: str, order: list) -> None:
    """Findings as JSON lines, as TSV, and counted by severity, each below ``path`` and the first two in ``order``."""
    columns = [c for c in findings.columns if c != "rank"]
    findings.orderBy(*order).select(F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").text(f"{path}/json")
    write_tsv(findings, f"{path}/tsv", columns, order)
    findings.groupBy("severity").agg(F.count("*").alias("n")).select(F.concat("severity", F.lit(": "), F.col("n").cast("string")).alias("value")).write.mode("overwrite").text(f"{path}/summary")


def append_log(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Append events to a log as escaped lines; what is there is never rewritten."""
    rows.select(tsv(rows, columns).alias("value")).write.mode("append").text(path)


def stop_report(rows: DataFrame, identity: str, reason: str, most: int = 100) -> DataFrame:
    """``reason, n, identities``: what stopped a run, without any text: counts and the first ``most`` identities."""
    from ..plans.audit import first_k

    return first_k(rows.select(F.col(reason).alias("reason"), F.col(identity).alias("identity")), "reason", "identity", most).withColumnRenamed("first", "identities")
