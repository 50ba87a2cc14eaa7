"""Queries of readers and reports over files that are made of the given tables, each with SQL for what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language as G
from ..functions import text as X
from ..functions import tokens as T
from ..operators import stats as O
from ..plans import rules as R
from ..sources import catalogs as C
from ..sources import reports as W
from ..streaming.live import shared_folder
from .registry import query, table

# A package a language, with lines of two entries: keys repeat, and every eleventh line has no equals sign.
_LINES = "(SELECT lang AS package, CASE WHEN doc_id % 4 = 0 THEN 'extra' ELSE 'main' END AS entry, doc_id, CAST(doc_id % 37 AS VARCHAR) AS key, source || '=' || doc_id AS value FROM documents WHERE doc_id % 11 <> 0)"


def _packages(spark, sf_dir) -> str:
    d = table(spark, sf_dir, "documents")
    line = F.when(F.col("doc_id") % 11 == 0, "no sign").otherwise(F.concat((F.col("doc_id") % 37).cast("string"), F.lit("="), "source", F.lit("="), F.col("doc_id").cast("string")))
    parts = d.select(F.col("lang").alias("package"), F.when(F.col("doc_id") % 4 == 0, "extra").otherwise("main").alias("entry"), F.col("doc_id").alias("line_no"), line.alias("raw"), F.lit("\n").alias("newline"))
    path = shared_folder(spark)
    W.pack(parts).write.parquet(path)
    return path


@query(f"SELECT package, entry || ':' || key || '#' || row_number() OVER (PARTITION BY package, entry, key ORDER BY doc_id) AS identity, value FROM {_LINES}")
def identity_values(spark, sf_dir):
    """Both entries of all packages as identities and values."""
    return C.read_packages(spark, _packages(spark, sf_dir), ["main", "extra"], keyed_by="parquet").select("package", "identity", "value")


@query(f"SELECT package, key, max_by(value, doc_id) AS value FROM {_LINES} WHERE entry = 'main' GROUP BY ALL")
def last_values(spark, sf_dir):
    """Of repeated keys the value of the last line."""
    return C.last_values(C.read_packages(spark, _packages(spark, sf_dir), ["main"], keyed_by="parquet"))


@query(f"SELECT DISTINCT key FROM {_LINES} WHERE entry = 'extra'")
def entry_keys(spark, sf_dir):
    """The keys of one entry."""
    return C.keys_of(C.read_packages(spark, _packages(spark, sf_dir), ["extra"], keyed_by="parquet"))


@query(f"SELECT package, count(*) AS lines, count(DISTINCT key) AS keys FROM {_LINES} WHERE entry = 'extra' GROUP BY package")
def fallback_entries(spark, sf_dir):
    """The first of three entries that a package has."""
    rows = C.read_packages(spark, _packages(spark, sf_dir), ["absent", "extra", "main"], keyed_by="parquet", fallback=True)
    return rows.groupBy("package").agg(F.count("*").alias("lines"), F.count_distinct("key").alias("keys"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name || chr(10) || 'é\"' AS value FROM supplier")
def json_map(spark, sf_dir):
    """A flat JSON map of all suppliers, written with a byte order mark and read again."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), F.concat("s_name", F.lit('\né"')).alias("v"))
    path = shared_folder(spark)  # one file is one object, as the format has it
    rows.agg(F.concat(F.lit("﻿"), F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v"))))).alias("value")).write.text(path)
    return C.read_map(spark, path)


@query("""SELECT 'keys' AS kind, CAST(n_nationkey AS VARCHAR) AS term, CASE WHEN n_nationkey % 5 = 0 THEN 'over' ELSE n_name END AS value FROM nation
 UNION ALL SELECT 'values', r_name, lower(r_name) FROM region UNION ALL SELECT 'phrases', p_type, min(p_name) FROM part GROUP BY p_type""")
def glossary_maps(spark, sf_dir):
    """A glossary of three maps, with overrides for every fifth key."""
    entries = lambda rows, k, v: rows.select(F.lit(0).alias("g"), k.alias("k"), v.alias("v")).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    nation, region, part = (table(spark, sf_dir, n) for n in ("nation", "region", "part"))
    keys = entries(nation, F.col("n_nationkey").cast("string"), F.col("n_name")).withColumnRenamed("m", "keys")
    values = entries(region, F.col("r_name"), F.lower("r_name")).withColumnRenamed("m", "values")
    phrases = entries(part.groupBy("p_type").agg(F.min("p_name").alias("p_name")), F.col("p_type"), F.col("p_name")).withColumnRenamed("m", "phrases")
    path = shared_folder(spark)
    keys.join(values, "g").join(phrases, "g").select(F.to_json(F.struct("keys", "values", "phrases")).alias("value")).write.text(path)
    over = nation.where("n_nationkey % 5 = 0").select(F.lit("keys").alias("kind"), F.col("n_nationkey").cast("string").alias("term"), F.lit("over").alias("value"))
    return C.read_glossary(spark, path, over)


@query("SELECT event_id, event_type || chr(9) || chr(92) AS text FROM events WHERE event_id % 3 <> 0")
def lenient_rows(spark, sf_dir):
    """An escaped report in which every third line has a field too few: these are dropped."""
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.col("event_id").cast("string"), F.lit("\t"), X.escape_field(F.concat("event_type", F.lit("\t\\")))))
    path = shared_folder(spark)
    e.select(line.alias("value")).write.text(path)
    return C.read_status(spark, path, ["id", "text"]).select(F.col("id").cast("long").alias("event_id"), "text")


def _policy(spark, sf_dir):
    lines = C.read_lines(spark, _packages(spark, sf_dir), ["main"], keyed_by="parquet")
    rows = C.read_packages(spark, _packages(spark, sf_dir), ["main"], keyed_by="parquet").where("package = 'en'")
    n = F.element_at(F.split("value", "="), -1).cast("long")
    value = F.when(n % 5 == 1, F.lit(None)).when(n % 5 == 2, F.col("value")).when(n % 5 == 3, "<b>new").otherwise(F.concat(F.lit("new "), n.cast("string")))
    resolved = rows.select("identity", "key", F.col("value").alias("source"), value.alias("value"), F.lit("m").alias("origin"), (n % 7 == 0).alias("stale"))
    return W.rewrite_by_policy(lines.where("package = 'en'"), resolved, T.format_ok)


_REASON = "CASE WHEN doc_id % 7 = 0 THEN 'STALE_SOURCE' WHEN doc_id % 5 = 1 THEN 'NO_VALUE' WHEN doc_id % 5 = 2 THEN 'SAME_AS_SOURCE' WHEN doc_id % 5 = 3 THEN 'FORM' END"
_ENGLISH = f"(SELECT *, {_REASON} AS reason, 'main:' || key || '#' || row_number() OVER (PARTITION BY key ORDER BY doc_id) AS identity FROM {_LINES} WHERE package = 'en' AND entry = 'main')"


@query(f"SELECT key || '=' || CASE WHEN reason IS NULL THEN 'new ' || doc_id ELSE value END AS line, reason IS NULL AS changed FROM {_ENGLISH} UNION ALL SELECT 'no sign', false FROM documents WHERE lang = 'en' AND doc_id % 4 <> 0 AND doc_id % 11 = 0")
def policy_rewrite(spark, sf_dir):
    """A package rewritten with what its ladder resolved, where the policy lets it."""
    return _policy(spark, sf_dir)[0].select(F.col("raw").alias("line"), "changed")


@query(f"SELECT key, min(identity) AS identity, min_by(reason, identity) AS reason FROM {_ENGLISH} WHERE reason IS NOT NULL GROUP BY key")
def skipped_rows(spark, sf_dir):
    """What the policy left out, written as a report and read again: a row a key."""
    path, columns = shared_folder(spark), ["key", "identity", "reason"]
    W.write_tsv(_policy(spark, sf_dir)[1], path, columns, [F.col("key")])
    return C.read_status(spark, path, columns, strict=True)


@query("SELECT * FROM (SELECT o_orderstatus || ': ' || count(*) AS line FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'TOTAL: ' || count(*) FROM orders UNION ALL SELECT 'ISSUES: ' || count(*) FILTER (o_orderstatus <> 'F') FROM orders)")
def counts_summary(spark, sf_dir):
    """A summary of statuses as lines of text."""
    return W.counts_text(table(spark, sf_dir, "orders"), "o_orderstatus", F.col("o_orderstatus") != "F").select(F.col("value").alias("line"))


_CODES = "(SELECT CAST(p_partkey AS VARCHAR) AS key, unnest(list_filter([CASE WHEN contains(p_name, 'red') THEN 'RED' END, CASE WHEN p_size > 25 THEN 'LARGE' END], lambda x: x IS NOT NULL)) AS code FROM part)"


@query(f"SELECT 'json' AS report, code, count(*) AS n FROM {_CODES} GROUP BY code UNION ALL SELECT 'tsv', code, count(*) FROM {_CODES} GROUP BY code UNION ALL SELECT 'summary', CASE code WHEN 'RED' THEN 'high' ELSE 'review' END, count(*) FROM {_CODES} GROUP BY code")
def finding_reports(spark, sf_dir):
    """Findings written as JSON lines, as a table and as a summary, and each read again."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_name").alias("s"), F.lit("x").alias("t"), "p_size")
    rules = [R.Rule("RED", "high", source="red"), R.Rule("LARGE", "review", test=F.col("p_size") > 25)]
    path = shared_folder(spark)
    W.write_findings(R.findings(part, rules, "k", "s", "t"), path, [F.col("severity"), F.col("key")])
    json = C.read_jsonl(spark, f"{path}/json", "key string, code string, severity string").groupBy("code").agg(F.count("*").alias("n"))
    rows = C.read_status(spark, f"{path}/tsv", ["key", "code", "severity"], strict=True).groupBy("code").agg(F.count("*").alias("n"))
    lines = spark.read.text(f"{path}/summary").select(F.split("value", ": ").alias("f")).select(F.col("f")[0].alias("code"), F.col("f")[1].cast("long").alias("n"))
    named = lambda name, d: d.select(F.lit(name).alias("report"), "code", "n")
    return named("json", json).union(named("tsv", rows)).union(named("summary", lines))


@query("SELECT event_type AS reason, count(DISTINCT event_id) AS n, list_sort(list(DISTINCT event_id))[1:20] AS identities FROM events GROUP BY event_type")
def stop_reports(spark, sf_dir):
    """What stopped a run: reasons with counts and first identities, and no texts."""
    return W.stop_report(table(spark, sf_dir, "events"), "event_id", "event_type", 20)


@query("SELECT page_id, page_id % 3 <> 0 OR NOT regexp_matches(html, '<[a-z]') AS strict, true AS loose FROM pages")
def strict_forms(spark, sf_dir):
    """Tags in another case are the same form to one dialect, and not to the strict one."""
    pages = table(spark, sf_dir, "pages")
    upper = F.when(F.col("page_id") % 3 == 0, F.upper("html")).otherwise(F.col("html"))
    tags = lambda c: F.array_join(F.regexp_extract_all(c, F.lit("<[^>]*>"), F.lit(0)), "x")
    pages = pages.select("page_id", tags("html").alias("a"), tags(upper).alias("b"))
    return pages.select("page_id", T.format_ok(F.col("a"), F.col("b"), "strict").alias("strict"), T.format_ok(F.col("a"), F.col("b")).alias("loose"))


@query("SELECT doc_id, sha256(replace(text, '’', '''') || 'fi1''K') AS form_sha256, sha256(replace(lower(text), 'ß', 'ss') || 'ssfi') AS folded_sha256 FROM documents")
def normal_forms(spark, sf_dir):
    """Compatibility forms and full case folding of whole texts."""
    d = table(spark, sf_dir, "documents")
    form, fold = G.nfkc(F.concat("text", F.lit("ﬁ①’K"))), G.casefold(F.concat("text", F.lit("ẞﬁ")))
    return d.select("doc_id", F.sha2(form, 256).alias("form_sha256"), F.sha2(fold, 256).alias("folded_sha256"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name || chr(10) || p_type || chr(10) || p_brand), 'red') AND contains(lower(p_name || chr(10) || p_type || chr(10) || p_brand), 'small') AND contains(lower(p_name || chr(10) || p_type || chr(10) || p_brand), '#1')")
def searched_columns(spark, sf_dir):
    """Rows in which every term occurs in some of three columns."""
    return table(spark, sf_dir, "part").where(X.all_terms(F.concat_ws("\n", "p_name", "p_type", "p_brand"), ["RED", "Small", "#1"])).select("p_partkey")


@query("""SELECT kind, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (
 SELECT 'union' AS kind, doc_id FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION SELECT doc_id FROM labels)
 UNION ALL SELECT 'intersection', doc_id FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT doc_id FROM labels)
 UNION ALL SELECT 'difference', doc_id FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT doc_id FROM labels)) GROUP BY kind""")
def identity_sets(spark, sf_dir):
    """Union, intersection and difference of two sets of identities."""
    left, right = table(spark, sf_dir, "documents").where("doc_id % 2 = 0"), table(spark, sf_dir, "labels")
    parts = [O.set_operation(left, right, ["doc_id"], kind).groupBy(F.lit(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids")) for kind in ("union", "intersection", "difference")]
    return parts[0].union(parts[1]).union(parts[2])
