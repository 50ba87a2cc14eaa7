"""Registered queries of the catalog engine and their DuckDB equivalents.

The catalog's parts are played by the given tables: versions A and B of a
catalog are ``documents`` with a tenth of the rows missing from each and a
tenth changed in B; logs are ``events``; stores and reports are the others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.tokens import format_ok, format_signature
from ..operators import chunks as C
from ..operators import ladder as L
from ..operators import packing as P
from ..operators import stats as S
from ..operators import versions as V
from ..plans import names as N
from ..streaming import live
from .registry import query, table

# --- versions ---------------------------------------------------------------

_OLD = "SELECT CAST(doc_id AS VARCHAR) AS identity, text AS source FROM documents WHERE doc_id % 10 <> 1"
_NEW = "SELECT CAST(doc_id AS VARCHAR) AS identity, CASE WHEN doc_id % 10 = 3 THEN text || ' v2' ELSE text END AS source FROM documents WHERE doc_id % 10 <> 2"
_DIFF = f"""SELECT coalesce(a.identity, b.identity) AS identity,
  CASE WHEN a.identity IS NULL THEN 'NEW' WHEN b.identity IS NULL THEN 'REMOVED' WHEN a.source = b.source THEN 'UNCHANGED' ELSE 'MODIFIED' END AS kind
  FROM ({_OLD}) a FULL JOIN ({_NEW}) b ON a.identity = b.identity"""


def _versions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("identity"), F.col("doc_id"), F.col("text"))
    old = docs.where("doc_id % 10 <> 1").select("identity", F.col("text").alias("source"))
    new = docs.where("doc_id % 10 <> 2").select("identity", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit(" v2"))).otherwise(F.col("text")).alias("source"))
    return old, new


def _changes(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return V.diff(V.snapshot(old, "source"), V.snapshot(new, "source"))


@query(_DIFF)
def diff_versions(spark, sf_dir):
    return _changes(spark, sf_dir)


@query(f"SELECT identity, kind FROM ({_DIFF}) WHERE kind <> 'UNCHANGED'")
def changed_hashes(spark, sf_dir):
    return V.changed_hashes(*(V.snapshot(v, "source") for v in _versions(spark, sf_dir)))


@query(f"SELECT k.kind, count(d.identity) AS n FROM (VALUES ('NEW'), ('MODIFIED'), ('REMOVED'), ('UNCHANGED')) k(kind) LEFT JOIN ({_DIFF}) d ON d.kind = k.kind GROUP BY k.kind")
def diff_counts(spark, sf_dir):
    return V.kind_counts(_changes(spark, sf_dir))


@query("SELECT identity, sha256(source) AS value_sha256 FROM (" + _NEW + ")")
def snapshot_hashes(spark, sf_dir):
    return V.snapshot(_versions(spark, sf_dir)[1], "source")


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS occurrence, lang || ':' || source || '#' || CAST(row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS VARCHAR) AS identity FROM documents")
def occurrences(spark, sf_dir):
    return V.with_wide_identity(table(spark, sf_dir, "documents").select("lang", "source", "doc_id"), "lang", "source", "doc_id").select("doc_id", F.col("occurrence").cast("long").alias("occurrence"), "identity")


@query("SELECT lang, CAST(sum(c) AS BIGINT) AS records, count(*) FILTER (c > 1) AS duplicate_keys, CAST(sum(c - 1) AS BIGINT) AS duplicate_occurrences FROM (SELECT lang, source, count(*) c FROM documents GROUP BY ALL) GROUP BY lang")
def duplicate_stats(spark, sf_dir):
    return V.duplicate_stats(table(spark, sf_dir, "documents"), "lang", "source")


@query(f"SELECT a.identity, sha256(a.source) AS old_value, sha256(b.source) AS new_value FROM ({_OLD}) a JOIN ({_NEW}) b ON a.identity = b.identity WHERE a.source <> b.source")
def version_conflicts(spark, sf_dir):
    old, new = (V.snapshot(v, "source") for v in _versions(spark, sf_dir))
    return V.conflicts(old, new, "identity", "value_sha256")


@query("""WITH o AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), b AS (SELECT DISTINCT o_orderkey AS k FROM orders), c AS (SELECT DISTINCT c_custkey AS k FROM customer)
SELECT 'lineitem' AS store, (SELECT count(*) FROM o WHERE k NOT IN (SELECT k FROM b)) AS only_here, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM o)) AS missing_here
UNION ALL SELECT 'customer', (SELECT count(*) FROM c WHERE k NOT IN (SELECT k FROM b)), (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM c))""")
def reconcile_keys(spark, sf_dir):
    t = lambda name, col: table(spark, sf_dir, name).select(F.col(col).alias("k"))
    return V.reconcile({"orders": t("orders", "o_orderkey"), "lineitem": t("lineitem", "l_orderkey"), "customer": t("customer", "c_custkey")}, "orders", "k")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn FROM orders) WHERE rn <= 3")
def retain_newest(spark, sf_dir):
    return V.newest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT o_orderstatus, max([CAST(year(o_orderdate) AS INT), CAST(month(o_orderdate) AS INT), CAST(day(o_orderdate) AS INT), CAST(o_orderkey % 20 AS INT)]) AS version FROM orders GROUP BY o_orderstatus")
def version_max(spark, sf_dir):
    text = F.concat_ws(".", F.date_format("o_orderdate", "yyyy.MM.dd"), (F.col("o_orderkey") % 20).cast("string"))
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.max(V.version_array(text)).alias("version"))


# --- ladder -----------------------------------------------------------------

_CHANGED = f"SELECT d.identity, d.kind, n.source FROM ({_DIFF}) d JOIN ({_NEW}) n ON n.identity = d.identity WHERE d.kind IN ('NEW', 'MODIFIED')"
_RESOLVED = f"""
WITH changed AS ({_CHANGED}), texts AS (SELECT CAST(doc_id AS VARCHAR) AS key, text AS value FROM documents),
manual AS (SELECT CAST(doc_id AS VARCHAR) AS key, 'manual ' || CAST(doc_id AS VARCHAR) AS value FROM labels WHERE quality = 1 AND doc_id % 2 = 0),
approved AS (SELECT key, sha256(value) AS sha FROM texts)
SELECT c.identity, c.kind,
  CASE WHEN m.key IS NOT NULL AND a.key IS NOT NULL THEN 'manual' WHEN a.key IS NOT NULL AND trim(t.value) <> '' AND c.identity NOT LIKE '%1' THEN 'memory' WHEN g.source IS NOT NULL THEN 'glossary-value' END AS origin,
  sha256(CASE WHEN m.key IS NOT NULL AND a.key IS NOT NULL THEN m.value WHEN a.key IS NOT NULL AND trim(t.value) <> '' AND c.identity NOT LIKE '%1' THEN t.value WHEN g.source IS NOT NULL THEN g.value END) AS value_sha256
FROM changed c LEFT JOIN approved a ON a.key = c.identity AND a.sha = sha256(c.source)
LEFT JOIN manual m ON m.key = c.identity LEFT JOIN texts t ON t.key = c.identity
LEFT JOIN (SELECT source, min(value) AS value FROM (SELECT text || ' v2' AS source, 'glossary ' || CAST(doc_id AS VARCHAR) AS value FROM documents WHERE doc_id % 20 = 3) GROUP BY source) g ON g.source = c.source"""


def _changed(spark, sf_dir):
    new = _versions(spark, sf_dir)[1]
    return _changes(spark, sf_dir).where(F.col("kind").isin("NEW", "MODIFIED")).join(new, "identity").withColumn("key", F.col("identity"))


def _stores(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    key = F.col("doc_id").cast("string").alias("key")
    approvals = docs.select(key, F.sha2("text", 256).alias("source_sha256"))
    manual = labels.where("quality = 1 and doc_id % 2 = 0").select(key, F.concat(F.lit("manual "), F.col("doc_id").cast("string")).alias("value"))
    memory = docs.where("doc_id % 10 <> 1").select(key, F.col("text").alias("value"))
    glossary = docs.where("doc_id % 20 = 3").select(F.concat("text", F.lit(" v2")).alias("key"), F.concat(F.lit("glossary "), F.col("doc_id").cast("string")).alias("value")).groupBy("key").agg(F.min("value").alias("value"))
    return [L.Store("manual", manual, approvals=approvals), L.Store("memory", memory, approvals=approvals, skip_blank=True), L.Store("glossary-value", glossary, on="source")]


@query(f"SELECT kind, coalesce(origin, 'UNRESOLVED') AS origin, count(*) AS n FROM ({_RESOLVED}) GROUP BY ALL")
def ladder_origins(spark, sf_dir):
    out = L.resolve(_changed(spark, sf_dir), _stores(spark, sf_dir))
    return out.groupBy("kind", F.coalesce("origin", F.lit("UNRESOLVED")).alias("origin")).agg(F.count("*").alias("n"))


@query(f"SELECT identity, origin, value_sha256 FROM ({_RESOLVED})")
def ladder_values(spark, sf_dir):
    return L.resolve(_changed(spark, sf_dir), _stores(spark, sf_dir)).select("identity", "origin", F.sha2("value", 256).alias("value_sha256"))


@query(f"SELECT r.identity, coalesce(r.value_sha256, sha256(c.source)) AS value_sha256 FROM ({_RESOLVED}) r JOIN ({_CHANGED}) c ON c.identity = r.identity")
def effective_values(spark, sf_dir):
    return L.effective(L.resolve(_changed(spark, sf_dir), _stores(spark, sf_dir))).select("identity", F.sha2("value", 256).alias("value_sha256"))


@query(f"SELECT identity FROM ({_RESOLVED}) WHERE origin IS NULL")
def ladder_unresolved(spark, sf_dir):
    return L.unresolved(_changed(spark, sf_dir), _stores(spark, sf_dir)).select("identity")


@query(f"SELECT kind, count(*) FILTER (origin = 'manual') AS manual, count(*) FILTER (origin = 'memory') AS memory, count(*) FILTER (origin = 'glossary-value') AS glossary_value, CAST(0 AS BIGINT) AS provider FROM ({_RESOLVED}) GROUP BY kind")
def ladder_pivot(spark, sf_dir):
    out = L.origin_pivot(L.resolve(_changed(spark, sf_dir), _stores(spark, sf_dir)), "kind", ["manual", "memory", "glossary-value", "provider"])
    return out.withColumnRenamed("glossary-value", "glossary_value")


@query(f"""SELECT p.identity, CASE WHEN d.kind IS NULL THEN 'UNKNOWN' WHEN d.kind NOT IN ('NEW', 'MODIFIED') THEN 'NOT_CHANGED' WHEN trim(p.value) = '' THEN 'BLANK' ELSE 'FORM' END AS reason
FROM (SELECT CAST(doc_id * 2 AS VARCHAR) AS identity, CASE WHEN doc_id % 7 = 0 THEN ' ' WHEN doc_id % 5 = 0 THEN '<b>x' ELSE 'x' END AS value FROM documents) p LEFT JOIN ({_DIFF}) d ON d.identity = p.identity
WHERE d.kind IS NULL OR d.kind NOT IN ('NEW', 'MODIFIED') OR trim(p.value) = '' OR p.value = '<b>x'""")
def proposal_violations(spark, sf_dir):
    """Proposals for unknown or unchanged records, blank ones, and ones with a tag that their source has not."""
    value = F.when(F.col("doc_id") % 7 == 0, " ").when(F.col("doc_id") % 5 == 0, "<b>x").otherwise("x")
    proposals = table(spark, sf_dir, "documents").select((F.col("doc_id") * 2).cast("string").alias("identity"), value.alias("value"))
    return L.violations(proposals, _changes(spark, sf_dir), _changed(spark, sf_dir).select("identity", "source"), format_ok)


@query("""SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 10 <> 3 AND doc_id % 10 <> 1 THEN 'PREPARED' WHEN doc_id % 4 = 0 OR doc_id % 10 = 1 THEN 'MEMORY' ELSE 'SOURCE' END AS choice,
sha256(CASE WHEN doc_id % 10 <> 3 AND doc_id % 10 <> 1 THEN 'P' || text WHEN doc_id % 4 = 0 OR doc_id % 10 = 1 THEN 'M' || text WHEN doc_id % 10 = 3 THEN text || ' v2' ELSE text END) AS merged FROM documents WHERE doc_id % 10 <> 2""")
def three_way_merge(spark, sf_dir):
    old, new = (v.select(F.col("identity").alias("key"), F.col("source").alias("value")) for v in _versions(spark, sf_dir))
    docs = table(spark, sf_dir, "documents")
    memory = docs.where("doc_id % 4 = 0 or doc_id % 10 = 1").select(F.col("doc_id").cast("string").alias("key"), F.concat(F.lit("M"), "text").alias("value"))
    ready = docs.select(F.col("doc_id").cast("string").alias("key"), F.concat(F.lit("P"), "text").alias("value"))
    return L.three_way(new, old, ready, memory).select("key", "choice", F.sha2("merged", 256).alias("merged"))


@query("""SELECT m.doc_id, k.reused FROM documents m JOIN (SELECT text, min(source) AS reused FROM documents WHERE doc_id % 5 <> 0 GROUP BY text HAVING count(DISTINCT source) = 1) k ON k.text = m.text WHERE m.doc_id % 5 = 0""")
def reuse_targets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return L.reuse(docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0").select("doc_id", "text"), "text", "source").select("doc_id", "reused")


@query("""SELECT c_name, replacement FROM (SELECT c.c_name, s.replacement, row_number() OVER (PARTITION BY c.c_name ORDER BY s.ord) rn FROM customer c
JOIN (SELECT n_nationkey AS ord, 'Customer#0000000' || CAST(n_nationkey % 10 AS VARCHAR) AS prefix, CASE n_nationkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS source, n_name AS replacement FROM nation) s
ON s.source = c.c_mktsegment AND starts_with(c.c_name, s.prefix)) WHERE rn = 1""")
def scoped_repairs(spark, sf_dir):
    segment = F.element_at(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    scopes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("Customer#0000000"), (F.col("n_nationkey") % 10).cast("string")).alias("prefix"), segment.alias("source"), F.col("n_name").alias("replacement"))
    return L.scoped(table(spark, sf_dir, "customer"), scopes, "c_name", "c_mktsegment").select("c_name", "replacement")


@query("""SELECT d.doc_id, s.replacement FROM documents d JOIN (SELECT text, min_by(r, doc_id) AS replacement FROM (SELECT doc_id, text, 'seed ' || CAST(doc_id AS VARCHAR) AS r FROM documents WHERE doc_id % 3 = 0) GROUP BY text) s ON s.text = d.text""")
def seeded_repairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seeds = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("seed_key"), F.concat(F.lit("seed "), F.col("doc_id").cast("string")).alias("replacement"))
    return L.seeded(docs, seeds, "doc_id", "text").select("doc_id", "replacement")


@query("""SELECT coalesce(o.k, n.k) AS k, coalesce(n.v, o.v) AS v, CASE WHEN n.v IS NULL THEN 'KEPT' WHEN o.v IS NULL THEN 'ADDED' ELSE 'REPLACED' END AS action
FROM (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT o_custkey AS k, max(o_orderpriority) AS v FROM orders GROUP BY 1) n ON o.k = n.k""")
def overlay_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("v"))
    return L.upsert(old, new, "k", "v")


# --- counts and state -------------------------------------------------------


@query("SELECT coalesce(event_type, 'TOTAL') AS event_type, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def status_counts(spark, sf_dir):
    return S.counts_with_total(table(spark, sf_dir, "events"), "event_type")


@query("SELECT severity, code, count(*) AS n FROM (SELECT event_type AS code, CASE WHEN value < 10 THEN 'LOW' WHEN value < 50 THEN 'MEDIUM' ELSE 'HIGH' END AS severity FROM events) GROUP BY GROUPING SETS ((severity), (code), ())")
def severity_and_code(spark, sf_dir):
    severity = F.when(F.col("value") < 10, "LOW").when(F.col("value") < 50, "MEDIUM").otherwise("HIGH")
    return S.grouping_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("code"), severity.alias("severity")), "severity", "code")


_LATEST = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events WHERE event_type IN ('signup', 'purchase', 'view', 'click')) WHERE rn = 1 AND event_type <> 'click'"


def _live_args() -> dict:
    return {"key": "user_id", "order": [F.col("ts"), F.col("event_id")], "status": "event_type", "live": ["signup", "purchase", "view"], "tombstone": "click"}


@query(_LATEST)
def latest_state(spark, sf_dir):
    return S.latest_state(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), **_live_args()).select("user_id", "event_id", "event_type")


@query(_LATEST)
def latest_state_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "*.parquet").load(f"{sf_dir}/events.parque[t]")
    return live.run_latest(stream.select("user_id", "ts", "event_id", "event_type"), **_live_args()).select("user_id", "event_id", "event_type")


@query("SELECT sha256(text) AS text_sha256, lang, min(doc_id) AS first_member, count(*) AS members, list_sort(list(doc_id))[1:10] AS listed FROM documents GROUP BY text, lang")
def work_units(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_sha256"), "lang", "doc_id")
    return S.units(rows, ["text_sha256", "lang"], "doc_id", 10)


@query("""SELECT sha256(text) AS text_sha256, count(*) AS variants, string_agg(source || ' (' || CAST(n AS VARCHAR) || ')', '; ' ORDER BY source) AS listing
FROM (SELECT trim(text) AS text, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY text HAVING count(*) > 1""")
def inconsistent_targets(spark, sf_dir):
    return S.inconsistent(table(spark, sf_dir, "documents"), "text", "source").select(F.sha2("text", 256).alias("text_sha256"), "variants", "listing")


@query("""SELECT p_type, count(*) AS variants, array_to_string(list_transform(list_sort(list(p_name || ' (' || n || ')'))[1:5], lambda x: x), '; ') AS listing
 FROM (SELECT p_type, p_name, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_type HAVING count(*) > 1""")
def first_variants(spark, sf_dir):
    """Types with several names: how many, and the first five."""
    return S.inconsistent(table(spark, sf_dir, "part"), "p_type", "p_name", 5)


@query("SELECT event_type, user_id, n, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS rank FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE rank <= 5")
def profile_top(spark, sf_dir):
    return S.top_by_count(table(spark, sf_dir, "events"), "event_type", "user_id", 5).select("event_type", "user_id", "n", F.col("rank").cast("long").alias("rank"))


@query("SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS users, min_by(event_id, ts) AS first_event FROM events GROUP BY event_type")
def profile_status(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("users"), F.min_by("event_id", "ts").alias("first_event"))


@query("SELECT count(*) FILTER (event_type = 'signup') AS saved, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type NOT IN ('signup', 'error')) AS others FROM events")
def outcome_counts(spark, sf_dir):
    t = F.col("event_type")
    return table(spark, sf_dir, "events").agg(F.count_if(t == "signup").alias("saved"), F.count_if(t == "error").alias("errors"), F.count_if(~t.isin("signup", "error")).alias("others"))


@query("SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{L}+')) AS word FROM documents) GROUP BY ALL HAVING count(*) >= 4")
def repeated_words(spark, sf_dir):
    return S.repeated_words(table(spark, sf_dir, "documents"), "doc_id", X.words(F.col("text")), 4)


@query("""WITH p AS (SELECT u.conv_id, u.turn, u.text AS a, v.text AS b FROM conversations u JOIN conversations v ON v.conv_id = u.conv_id AND v.turn = u.turn + 1),
x AS (SELECT conv_id * 1000 + turn AS pair, unnest(regexp_extract_all(a, '\\p{L}+')) AS item, 1 AS d FROM p UNION ALL SELECT conv_id * 1000 + turn, unnest(regexp_extract_all(b, '\\p{L}+')), -1 FROM p)
SELECT pair, item, CAST(sum(d) AS BIGINT) AS more FROM x GROUP BY ALL HAVING sum(d) > 0""")
def lost_words(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("pair", F.col("conv_id") * 1000 + F.col("turn"))
    return S.multiset_difference(p, "pair", X.words(F.col("source")), X.words(F.col("target")))


# --- texts ------------------------------------------------------------------


def _pairs(spark, sf_dir):
    """Each turn with the one after it, as a source and its target."""
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return c.select("conv_id", "turn", "role", F.col("text").alias("source")).join(after, ["conv_id", "turn"])


@query("SELECT lang, count(*) AS words, count(DISTINCT word) AS distinct_words FROM (SELECT lang, unnest(regexp_extract_all(text, '\\p{L}+')) AS word FROM documents) GROUP BY lang")
def word_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", F.explode(X.words(F.col("text"))).alias("word")).groupBy("lang").agg(F.count("*").alias("words"), F.count_distinct("word").alias("distinct_words"))


_GUESS = f"CASE WHEN regexp_matches(text, '{X.CYRILLIC}') THEN 'ru' " + " ".join(f"WHEN regexp_matches(text, '(?i)(^|[^\\p{{L}}])({w})([^\\p{{L}}]|$)') THEN '{lang}'" for lang, w in X.LANGUAGE_WORDS) + " ELSE 'en' END"


@query(f"SELECT lang, {_GUESS} AS guess, count(*) AS n FROM documents GROUP BY ALL")
def language_guesses(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", X.language_guess(F.col("text")).alias("guess")).agg(F.count("*").alias("n"))


@query("SELECT page_id, len(regexp_extract_all(html, '<[^>]*>')) AS tags, sha256(array_to_string(regexp_extract_all(html, '<[^>]*>'), chr(10))) AS tags_sha256, sha256(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS visible_sha256 FROM pages")
def markup_tokens(spark, sf_dir):
    t = X.tags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(t).cast("long").alias("tags"), F.sha2(F.array_join(t, "\n"), 256).alias("tags_sha256"), F.sha2(X.visible(F.col("html")), 256).alias("visible_sha256"))


@query(f"""SELECT page_id, CASE WHEN host IN {X.SHORTENERS} THEN 'SHORTENER' WHEN regexp_matches(path, '({'|'.join(s.replace('.', '[.]') for s in X.BINARY_SUFFIXES)})$') AND NOT (host = 'example.org' OR host LIKE '%.example.org') THEN 'BINARY' ELSE 'OK' END AS verdict
FROM (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 't.co' ELSE lower(regexp_extract(url, '://([^/?#]*)', 1)) END AS host, lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)) || CASE WHEN page_id % 4 = 0 THEN '.tar.gz' ELSE '' END AS path FROM pages)""")
def url_policy(spark, sf_dir):
    """Page addresses, some of them made shorteners or binaries."""
    host = F.when(F.col("page_id") % 9 == 0, "T.co").otherwise(F.regexp_extract("url", "://([^/?#]*)", 1))
    path = F.concat(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), F.when(F.col("page_id") % 4 == 0, ".TAR.gz").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", X.url_verdict(host, path, ["Example.org"]).alias("verdict"))


@query("SELECT p_partkey, p_name, CASE WHEN p_name = 'red widget' THEN 0 WHEN contains(p_name, 'red widget') THEN 1 ELSE 2 END AS rank FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'widget') ORDER BY rank, length(p_name), p_partkey LIMIT 1000")
def search_ranked(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where(X.all_terms(F.col("p_name"), ["Red", "widget"]))
    return rows.select("p_partkey", "p_name", X.search_rank(F.col("p_name"), "red widget").alias("rank")).orderBy("rank", F.length("p_name"), "p_partkey").limit(1000)


@query("SELECT doc_id, source FROM documents WHERE lang = 'de' ORDER BY source, doc_id LIMIT 50 OFFSET 20")
def paging(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id", "source").orderBy("source", "doc_id").offset(20).limit(50)


@query("SELECT p_partkey, trim(regexp_replace(p_name || ' / ' || p_brand, '[^A-Za-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


@query("SELECT doc_id, sha256(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't'), chr(13), chr(92) || 'r'), chr(10), chr(92) || 'n')) AS field_sha256, true AS restored FROM documents")
def escaped_fields(spark, sf_dir):
    field = X.escape_field(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(field, 256).alias("field_sha256"), (X.unescape_field(field) == F.col("text")).alias("restored"))


@query("""SELECT conv_id, turn, NOT ((sw >= 8 AND tw < ceil(sw * 25 / 100)) OR (sl >= 45 AND tl < ceil(sl * 35 / 100))) AS complete FROM (
SELECT u.conv_id, u.turn, len(regexp_extract_all(u.text, '\\p{L}+')) AS sw, len(regexp_extract_all(v.text, '\\p{L}+')) AS tw, length(u.text) AS sl, length(v.text) AS tl FROM conversations u JOIN conversations v ON v.conv_id = u.conv_id AND v.turn = u.turn + 1)""")
def completeness(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", X.complete(F.col("source"), F.col("target")).alias("complete"))


@query("SELECT p_partkey, replace(replace(replace(p_name || ' ' || p_type, 'red widget', 'crimson gadget'), 'widget', 'gadget'), 'red', 'ruby') AS replaced FROM part")
def phrase_cascade(spark, sf_dir):
    rules = [("red", "ruby"), ("widget", "gadget"), ("red widget", "crimson gadget")]
    return table(spark, sf_dir, "part").select("p_partkey", X.cascade(F.concat("p_name", F.lit(" "), "p_type"), rules).alias("replaced"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def name_scan(spark, sf_dir):
    return N.contained(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


_JOINED = "regexp_extract_all({0}, '\\p{{L}}+(?:[''’-]\\p{{L}}+)*')"


@query(f"""WITH RECURSIVE said AS (SELECT regexp_extract_all(text, '{X.WORDS.replace("'", "''")}') AS w FROM conversations WHERE turn = 1),
listed AS (SELECT array_to_string(w[1:8], ' ') AS name FROM said UNION SELECT array_to_string(w[2:3], ' ') FROM said UNION SELECT p_name FROM part),
known AS (SELECT DISTINCT array_to_string({_JOINED.format('name')}, ' ') AS name FROM listed),
turns AS (SELECT conv_id || '/' || turn AS k, {_JOINED.format('text')} AS w FROM conversations),
spans AS (SELECT k, i, n, w[i:i + n - 1] AS s FROM (SELECT *, unnest(range(1, least(8, len(w) - i + 1) + 1)) AS n FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM turns))),
windows AS (SELECT k, i, n, array_to_string(s, ' ') AS name, 1 AS whole FROM spans UNION ALL SELECT k, i, n, regexp_replace(array_to_string(s, ' '), '[''’]\\p{{L}}+$', ''), 0 FROM spans),
best AS (SELECT k, i, max_by({{'n': n, 'name': name}}, 2 * n + whole) AS m FROM windows JOIN known USING (name) WHERE name <> '' GROUP BY k, i),
walk AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS free, CAST([] AS VARCHAR[]) AS names FROM best
 UNION ALL SELECT walk.k, min_by(i + m.n, i), list_append(any_value(names), min_by(m.name, i)) FROM walk JOIN best ON best.k = walk.k AND i >= free GROUP BY walk.k)
SELECT k, max_by(names, len(names)) AS names FROM walk GROUP BY k""")
def longest_names(spark, sf_dir):
    """Leftmost-longest matches, of up to eight words, of whole user turns' first eight words and of part names, in all conversations."""
    turns = table(spark, sf_dir, "conversations")
    starts = turns.where("turn = 1").select(F.array_join(F.slice(X.words(F.col("text")), 1, 8), " ").alias("name"))
    pairs = turns.where("turn = 1").select(F.array_join(F.slice(X.words(F.col("text")), 2, 2), " ").alias("name"))
    terms = starts.union(pairs).union(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))).distinct()
    rows = turns.select(F.concat_ws("/", "conv_id", "turn").alias("k"), "text")
    return N.longest_matches(rows, "k", "text", terms, "name")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, CASE WHEN open_now > 0 AND same > 0 THEN 'EXISTING_PR_REUSED' WHEN open_now = 0 AND done > 0 THEN 'NO_CHANGES' ELSE 'PREPARE_NEW_PR' END AS decision, outdated FROM (
SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS open_now, count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS same, count(*) FILTER (o_orderstatus = 'F') AS done,
coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT'), []) AS outdated FROM orders GROUP BY o_custkey)""")
def gate_decisions(spark, sf_dir):
    open_, same = F.col("o_orderstatus") == "O", F.col("o_orderpriority") == "1-URGENT"
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(open_).alias("o"), F.count_if(open_ & same).alias("s"), F.count_if(F.col("o_orderstatus") == "F").alias("d"), F.array_sort(F.collect_list(F.when(open_ & ~same, F.col("o_orderkey")))).alias("outdated"))
    return g.select("o_custkey", F.when((F.col("o") > 0) & (F.col("s") > 0), "EXISTING_PR_REUSED").when((F.col("o") == 0) & (F.col("d") > 0), "NO_CHANGES").otherwise("PREPARE_NEW_PR").alias("decision"), "outdated")


@query("SELECT page_id, page_id % 2 = 1 OR NOT regexp_matches(html, '<[^>]*>[^<]*$') AS format_ok FROM pages")
def format_signatures(spark, sf_dir):
    """Pages whose markup structure changes when every other page's last tag is dropped."""
    pages = table(spark, sf_dir, "pages").withColumn("target", F.when(F.col("page_id") % 2 == 0, F.regexp_replace("html", "<[^>]*>(?=[^<]*$)", "")).otherwise(F.col("html")))
    return pages.select("page_id", (format_signature("html") == format_signature("target")).alias("format_ok"))


@query("SELECT doc_id, CAST(greatest(ceil(strlen(text) / 1024.0), 1) AS BIGINT) AS pieces, sha256(text) AS data_sha256, true AS ok FROM documents WHERE text IS NOT NULL")
def chunk_reassembly(spark, sf_dir):
    """Documents cut to chunks of 1 KiB, each distinct chunk stored once, and put together again from the store."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    chunks = C.cut(files, "doc_id", "data", 1024)
    names = files.select("doc_id", F.sha2("data", 256).alias("file_sha256"))
    manifest = chunks.select("doc_id", "seq", "sha").join(names, "doc_id")
    whole = C.reassemble(manifest, C.store(chunks), "doc_id")
    return whole.select("doc_id", "pieces", F.sha2("data", 256).alias("data_sha256"), F.col("problem").isNull().alias("ok"))


# A document of a lost bundle is whole where every chunk of it stands in some other bundle, be it as another document's last bytes.
@query("""WITH p AS (SELECT doc_id, sha256(text) AS data_sha256, list_transform(range(CAST(greatest(ceil(strlen(text) / 1024.0), 1) AS BIGINT)), lambda i: sha1(substring(h, i * 2048 + 1, 2048))) AS shas FROM (SELECT doc_id, text, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL)),
kept AS (SELECT DISTINCT unnest(shas) AS sha FROM p WHERE doc_id % 7 <> 0), lost AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(shas) AS sha FROM p WHERE doc_id % 7 = 0) WHERE sha NOT IN (SELECT sha FROM kept))
SELECT CAST(p.doc_id AS VARCHAR) AS name, CASE WHEN lost.doc_id IS NOT NULL THEN 'MISSING_CHUNK' END AS problem, CASE WHEN lost.doc_id IS NULL THEN data_sha256 END AS data_sha256 FROM p LEFT JOIN lost ON lost.doc_id = p.doc_id""")
def bundle_reassembly(spark, sf_dir):
    """Documents cut to chunks, chunks laid into bundles, found again by bundle and byte range; bundles of every seventh document are lost.

    A lost chunk that another document has too is taken from that one's bundle. Null texts are no files.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), F.encode("text", "UTF-8").alias("data"))
    cut = C.cut(docs, "name", "data", 1024).withColumn("size", F.octet_length("piece"))
    bundles = docs.where("doc_id % 7 <> 0").select(F.concat(F.lit("b"), "name").alias("bundle"), F.concat(F.lit("head").cast("binary"), "data").alias("data"), "name")
    listed = cut.where("cast(name as long) % 7 <> 0").select(F.concat(F.lit("b"), "name").alias("bundle"), (F.col("seq") * 1024 + 4).alias("offset"), "sha", "size")
    located = C.locate(cut.select("name", "seq", "sha", "size"), listed)
    files = docs.select("name", F.sha2("data", 256).alias("file_sha256"))
    whole = C.reassemble(cut.select("name", "seq", "sha").join(files, "name"), C.fetch(located, bundles), "name")
    return whole.select("name", "problem", F.sha2("data", 256).alias("data_sha256"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 5 = 0 THEN 'MISSING' WHEN doc_id % 5 = 1 THEN 'UNLISTED' ELSE 'CHANGED' END AS problem FROM documents WHERE doc_id % 5 < 3")
def manifest_problems(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha"))
    manifest = docs.where("doc_id % 5 <> 1").select("path", F.when(F.col("doc_id") % 5 == 2, "other").otherwise(F.upper("sha")).alias("sha"))
    return C.file_problems(manifest, docs.where("doc_id % 5 <> 0").select("path", "sha"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT (starts_with(c_name, 'Customer#0000000') OR c_name LIKE 'Customer#00000012%') OR c_name IN (SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING')")
def prefix_deletes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return L.drop_prefixes(c, "c_name", ["Customer#0000000", "Customer#00000012"], c.where("c_mktsegment = 'BUILDING'")).select("c_custkey", "c_name")


def _batches_sql(size: str, rows: int, chars: int, alone: int, long: int, long_rows: int, long_chars: int) -> str:
    return f"""WITH RECURSIVE s AS (SELECT lang, doc_id, {size} AS size, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents),
p AS (SELECT lang, doc_id, rn, CAST(0 AS BIGINT) AS batch, 1 AS n, CAST(size AS BIGINT) AS total, size > {long} AS some, size > {alone} AS shut FROM s WHERE rn = 1
UNION ALL SELECT lang, d, rn + 1, CASE WHEN cut THEN batch + 1 ELSE batch END, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN size ELSE total + size END, CASE WHEN cut THEN size > {long} ELSE more END, size > {alone}
FROM (SELECT *, shut OR size > {alone} OR n >= CASE WHEN more THEN {min(rows, long_rows)} ELSE {rows} END OR total + size > CASE WHEN more THEN {long_chars} ELSE {chars} END AS cut
FROM (SELECT p.*, s.doc_id AS d, s.size, p.some OR s.size > {long} AS more FROM p JOIN s ON s.lang = p.lang AND s.rn = p.rn + 1)))
SELECT lang, doc_id, batch FROM p"""


@query(_batches_sql("length(text)", **P.FAST))
def work_batches(spark, sf_dir):
    """Documents in batches of 32 rows and 3,000 characters of one language (8 and 5,000 with any text over 120 characters); texts over 1,400 characters are alone."""
    return P.pack_whole(table(spark, sf_dir, "documents"), "lang", "doc_id", "text", **P.FAST)


@query(_batches_sql("length(text)", **P.QUALITY))
def quality_batches(spark, sf_dir):
    """The same with the quality model's limits."""
    return P.pack_whole(table(spark, sf_dir, "documents"), "lang", "doc_id", "text", **P.QUALITY)


@query(_batches_sql("CASE WHEN regexp_matches(text, '[\\r\\n]') THEN 1401 ELSE length(text) + 1 END", 20, 1400, 1400, 10**9, 8, 5000))
def line_batches(spark, sf_dir):
    """Batches of single lines, 20 rows and 1,400 characters; texts of several lines are alone."""
    return P.pack_lines(table(spark, sf_dir, "documents"), "lang", "doc_id", "text")
