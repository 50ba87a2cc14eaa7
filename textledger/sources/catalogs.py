"""Readers for catalogs, stores and logs.

All read through Spark's own file sources, so they work on any store Spark can
reach, and every reader has a fixed schema. A zipped catalog is opened in the
task that has its bytes; lines leave it in batches.
"""

from __future__ import annotations

import codecs
import io
import json
import re
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.rowwise import of_one
from ..operators.versions import with_identity

LINES = "package string, entry string, line_no long, raw string, newline string, key string, value string, problem string"
#: Lines that leave a package at once.
BATCH = 20_000
#: Bytes of an entry that are read at once.
PIECE = 1 << 20
#: Where lines end: at any line boundary of Unicode, or at line feeds only.
LINE_ENDS = {"unicode": re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), "feed": re.compile("\r\n|\n")}


def _cut(pieces: Iterable[str], ends: re.Pattern) -> Iterator[tuple[str, str]]:
    """Each line and its end, of a text that comes in pieces."""
    rest = ""
    for piece in pieces:
        rest, at = rest + piece, 0
        for m in ends.finditer(rest):
            if m.end() == len(rest) and m[0] == "\r":
                break  # it may be half of a line end
            yield rest[at : m.start()], m[0]
            at = m.end()
        rest = rest[at:]
    if rest[-1:] == "\r" and ends.fullmatch("\r"):
        yield rest[:-1], "\r"
    elif rest:
        yield rest, ""


def entry_lines(text: str | Iterable[str], ends: re.Pattern) -> Iterator[tuple]:
    """``line_no, raw, newline, key, value, problem`` of every line: raw and newline together are the text.

    Blank lines and comments (``#`` or ``!`` in the first column) have no key;
    the key is what stands before the first equals sign, the value all behind it.
    """
    for n, (raw, newline) in enumerate(_cut([text] if isinstance(text, str) else text, ends), 1):
        key, eq, value = raw.partition("=")
        if not raw.strip() or raw[0] in "#!":
            yield n, raw, newline, None, None, None
        elif not eq:
            yield n, raw, newline, None, None, "NO_EQUALS"
        else:
            yield n, raw, newline, key, value, None if key else "EMPTY_KEY"


def _decoded(file, errors: str) -> Iterator[str]:
    """UTF-8 text in pieces, without its byte order mark, after a first one that is that mark or empty."""
    decoder, first = codecs.getincrementaldecoder("utf-8")(errors), True
    while data := file.read(PIECE):
        if text := decoder.decode(data):
            if first:
                yield text[: text[0] == "\ufeff"]
                text, first = text[text[0] == "\ufeff" :], False
            yield text
    if first:
        yield ""
    yield decoder.decode(b"", True)


def package_lines(data: bytes, package: str, entries: list[str], fallback: bool = False, strict: bool = False, ends: str = "unicode") -> Iterator[tuple]:
    """Lines of the named entries of one package. Other entries are not looked at.

    ``fallback`` takes only the first of the entries that is there. An entry
    that is not there, is there twice, or is no UTF-8 is an error if ``strict``;
    else it gives nothing, its last copy, or replacement characters.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        have = z.namelist()
        wanted = [e for e in entries if e in have]
        if strict and (len(wanted) < len(entries) and not (fallback and wanted)):
            raise ValueError(f"{package}: no entry {sorted(set(entries) - set(wanted))}")
        for entry in wanted[:1] if fallback else wanted:
            if strict and have.count(entry) > 1:
                raise ValueError(f"{package}: entry {entry} is there {have.count(entry)} times")
            with z.open(entry) as file:
                pieces = _decoded(file, "strict" if strict else "replace")
                bom = next(pieces)
                for n, raw, *rest in entry_lines(pieces, LINE_ENDS[ends]):
                    yield package, entry, n, (bom if n == 1 else "") + raw, *rest


def read_lines(spark: SparkSession, path: str, entries: list[str], fallback: bool = False, mode: str = "PERMISSIVE", ends: str = "unicode", keyed_by: str | None = None) -> DataFrame:
    """Every line of the named entries with its number, text and line end, which is what a lossless rewrite needs.

    ``FAILFAST`` makes any malformed line, empty key or faulty entry an error
    when read. ``keyed_by`` reads packages from a table's columns instead of
    files: its name, with ``package`` and ``content``.
    """
    names = [c.split()[0] for c in LINES.split(", ")]

    def expand(frames):
        for frame in frames:
            for name, data in zip(frame["package"], frame["content"]):
                rows = []
                for row in package_lines(bytes(data), name, entries, fallback, mode == "FAILFAST", ends):
                    if mode == "FAILFAST" and row[-1]:
                        raise ValueError(f"{name}: {row[1]} line {row[2]}: {row[-1]}")
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    if keyed_by:
        files = spark.read.parquet(path) if keyed_by == "parquet" else spark.table(keyed_by)
    else:
        files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("package"), "content")
    return files.select("package", "content").mapInPandas(expand, LINES)


def read_packages(spark: SparkSession, path: str, entries: list[str], mode: str = "PERMISSIVE", **options) -> DataFrame:
    """Records of zipped catalogs: ``package, entry, line_no, key, value, occurrence, identity``, numbered by package.

    ``PERMISSIVE`` skips lines without ``=`` and keeps empty keys, ``DROPMALFORMED`` skips those too, ``FAILFAST`` fails.
    """
    rows = read_lines(spark, path, entries, mode=mode, **options)
    rows = rows.where("key is not null" if mode != "DROPMALFORMED" else "key <> ''")
    return with_identity(rows.drop("problem", "raw", "newline"), scope=("package",))


def last_values(records: DataFrame) -> DataFrame:
    """``package, key, value``: of repeated keys the value of the last line (entries in order of name)."""
    return records.groupBy("package", "key").agg(F.max_by("value", F.struct("entry", "line_no")).alias("value"))


def keys_of(records: DataFrame) -> DataFrame:
    return records.select("key").distinct()


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """A flat JSON object as ``key, value`` rows; a byte order mark is ignored."""
    text = F.regexp_replace("value", "^\ufeff", "")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json(text, "map<string,string>")).alias("key", "value"))


GLOSSARY = "keys map<string,string>, values map<string,string>, phrases map<string,string>"


def read_glossary(spark: SparkSession, path: str, overrides: DataFrame | None = None) -> DataFrame:
    """A glossary of three maps as rows ``kind, term, value`` (kinds keys, values, phrases); ``overrides`` of the same form win."""
    text = F.regexp_replace("value", "^\ufeff", "")
    whole = spark.read.text(path, wholetext=True).select(F.from_json(text, GLOSSARY).alias("g"))
    rows = None
    for kind in ("keys", "values", "phrases"):
        part = whole.select(F.lit(kind).alias("kind"), F.explode(f"g.{kind}").alias("term", "value"))
        rows = part if rows is None else rows.union(part)
    if overrides is None:
        return rows
    kept = rows.join(overrides.select("kind", "term"), ["kind", "term"], "left_anti").select("kind", "term", "value")
    return kept.unionByName(overrides.select("kind", "term", "value"))


def read_status(spark: SparkSession, path: str, columns: list[str], strict: bool = False) -> DataFrame:
    """An escaped TSV report without quoting; rows of another width are dropped, or are an error if ``strict``."""
    from ..functions.text import unescape_field

    line = F.regexp_replace("value", "^\ufeff", "")
    rows = spark.read.text(path).select(line.alias("line")).where(~F.col("line").startswith(columns[0] + "\t"))
    rows = rows.select(F.split("line", "\t", -1).alias("f"))
    wide = F.size("f") == len(columns)
    if strict:
        rows = rows.withColumn("f", F.when(wide, F.col("f")).otherwise(F.raise_error(F.lit("wrong number of fields")).cast("array<string>")))
    else:
        rows = rows.where(wide)
    return rows.select(*[unescape_field(F.col("f")[i]).alias(c) for i, c in enumerate(columns)])


LOG = ["ts", "method", "key", "category", "status", "source", "target", "detail"]


def parse_log(lines: DataFrame, keep_malformed: bool = False) -> DataFrame:
    """Live-log lines (``value``): eight fields at least, beginning with a date.

    Others are dropped, or come with ``malformed`` true and no fields if ``keep_malformed``.
    """
    f = F.split("value", "\t", len(LOG))
    rest = [c for c in lines.columns if c != "value"]
    ok = F.coalesce(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2} ") & (F.size(f) == len(LOG)), F.lit(False))
    rows = lines.select(F.when(ok, f).alias("f"), (~ok).alias("malformed"), *rest)
    fields = [F.col("f")[i].alias(c) for i, c in enumerate(LOG)]
    return rows.select(*fields, "malformed", *rest) if keep_malformed else rows.where("not malformed").select(*fields, *rest)


def latest_methods(log: DataFrame, order: list, saved: str) -> DataFrame:
    """``key, method, ts`` of the last line of each key with the status ``saved``."""
    return log.where(F.col("status") == saved).groupBy("key").agg(F.max_by(F.struct("method", "ts"), F.struct(*order)).alias("r")).select("key", "r.method", "r.ts")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a fixed schema; lines that are no JSON are skipped."""
    lines = spark.read.text(path).where(F.try_parse_json("value").isNotNull())
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def _twice(text: str) -> list[str] | None:
    twice = set()

    def pairs(items):
        seen = set()
        for k, _ in items:
            if k in seen:
                twice.add(k)
            seen.add(k)
        return dict(items)

    try:
        json.loads(text.lstrip("\ufeff"), object_pairs_hook=pairs)
    except ValueError:
        return None
    return sorted(twice)


#: Keys that an object of a JSON text has twice, sorted; null where the text is no JSON.
repeated_json_keys = of_one(_twice, ArrayType(StringType()))
