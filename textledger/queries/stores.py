"""Queries of approvals, ladder variants, repairs, files, readers and writers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import approvals as V
from ..operators import files as Z
from ..operators import ladder as L
from ..operators import repairs as E
from ..operators import stats as O
from ..sources import catalogs as C
from ..sources import reports as W
from ..streaming.live import shared_folder
from .audit import _FAULTY, _STATUS, statuses_of
from .catalog import _CHANGED, _changed
from .registry import query, table

# --- approvals --------------------------------------------------------------


def _approvals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sha = F.sha2("text", 256)
    given = F.when(F.col("doc_id") % 4 == 0, F.upper(sha)).when(F.col("doc_id") % 4 == 1, sha).when(F.col("doc_id") % 4 == 2, "no hash").otherwise(F.sha2(F.concat("text", F.lit("old")), 256))
    space = F.when(F.col("doc_id") % 3 == 0, "manual").when(F.col("doc_id") % 3 == 1, F.lit(None)).otherwise("unknown")
    return docs.select(space.alias("namespace"), F.col("doc_id").cast("string").alias("key"), given.alias("source_sha256"))


@query("SELECT doc_id, doc_id % 3 = 1 AND doc_id % 4 < 2 AS approved, (doc_id % 3 = 1 AND doc_id % 4 < 2) OR doc_id % 5 <> 0 AS migrated FROM documents")
def approval_matches(spark, sf_dir):
    """Memory approvals by hash (malformed ones and other namespaces count for nothing), and with the whole package approved but for invalidated keys."""
    approvals = V.normal_approvals(_approvals(spark, sf_dir), listed=False)
    records = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.col("text").alias("source"))
    off = records.where("doc_id % 5 = 0").select(F.lit("memory").alias("namespace"), "key")
    own = V.admitted(records, approvals, "memory")
    return V.admitted(own.withColumnRenamed("approved", "own"), approvals, "memory", "AB12", "ab12", off).select("doc_id", F.col("own").alias("approved"), F.col("approved").alias("migrated"))


@query("SELECT namespace, CAST(o_custkey AS VARCHAR) AS key, list_sort(list(DISTINCT sha256(o_orderpriority))) AS hashes FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'manual' ELSE 'memory' END AS namespace, * FROM orders) GROUP BY ALL")
def approval_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "manual").otherwise("memory").alias("namespace"), F.col("o_custkey").cast("string").alias("key"), F.sha2("o_orderpriority", 256).alias("source_sha256"), "o_orderkey")
    old, new = (o.where(c).drop("o_orderkey") for c in ("o_orderkey % 3 = 0", "o_orderkey % 3 <> 0"))
    return V.hash_sets(old, new)


@query("SELECT DISTINCT CASE WHEN c_nationkey % 2 = 0 THEN 'manual' ELSE 'memory' END AS namespace, c_mktsegment AS key FROM customer")
def invalidated_sets(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") % 2 == 0, "manual").otherwise("memory").alias("namespace"), F.col("c_mktsegment").alias("key"))
    return V.invalidated_keys(c, c.limit(0))


@query("SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 4 = 1 THEN 'edited' ELSE 'stored' END AS value, CASE WHEN doc_id % 4 = 1 OR doc_id % 2 = 0 THEN 1 ELSE 0 END AS approvals FROM documents WHERE doc_id % 4 = 1 OR (doc_id % 3 = 0 AND doc_id % 4 <> 3)")
def applied_edits(spark, sf_dir):
    """Edits put into a store: approved for their present source alone; an edit without a value takes the entry away."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), "text")
    store = docs.where("doc_id % 3 = 0").select("key", F.lit("stored").alias("value"))
    approvals = docs.where("doc_id % 2 = 0 or doc_id % 8 = 1").select(F.lit("manual").alias("namespace"), "key", F.sha2(F.concat("text", F.lit("old")), 256).alias("source_sha256"))
    edits = docs.where("doc_id % 4 in (1, 3)").select("key", F.col("text").alias("source"), F.when(F.col("doc_id") % 4 == 1, "edited").alias("value"))
    off = docs.where("doc_id % 5 = 0").select(F.lit("manual").alias("namespace"), "key")
    values, granted, _ = V.edit(store, approvals, off, edits, "manual")
    counts = granted.groupBy("key").agg(F.count("*").alias("n"))
    return values.join(counts, "key", "left").select("key", "value", F.coalesce("n", F.lit(0)).cast("int").alias("approvals"))


# --- ladder variants --------------------------------------------------------

_BUILD = f"""SELECT c.identity, CASE WHEN CAST(c.identity AS BIGINT) % 17 = 0 THEN 'protected' WHEN l.quality = 1 AND l.doc_id % 2 = 0 THEN 'manual' WHEN CAST(c.identity AS BIGINT) % 2 = 0 AND f.source IS NOT NULL THEN 'forced' WHEN CAST(c.identity AS BIGINT) % 10 <> 1 THEN 'memory' WHEN f.source IS NOT NULL THEN 'glossary-value' END AS origin
FROM ({_CHANGED}) c LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = c.identity LEFT JOIN (SELECT DISTINCT text || ' v2' AS source FROM documents WHERE doc_id % 20 = 3 UNION SELECT DISTINCT text FROM documents WHERE doc_id % 6 = 0) f ON f.source = c.source"""


def _variant(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    key = F.col("doc_id").cast("string").alias("key")
    manual = labels.where("quality = 1 and doc_id % 2 = 0").select(key, F.lit("by hand").alias("value"))
    memory = docs.where("doc_id % 10 <> 1").select(key, F.col("text").alias("value"))
    glossary = docs.where("doc_id % 20 = 3").select(F.concat("text", F.lit(" v2")).alias("key"), F.lit("term").alias("value")).union(docs.where("doc_id % 6 = 0").select(F.col("text").alias("key"), F.lit("term").alias("value")))
    return manual, memory, glossary, F.col("identity").cast("long")


@query(_BUILD)
def build_ladder(spark, sf_dir):
    """The build's order: protected first, then manual, forced terms of some keys, memory, glossary."""
    manual, memory, glossary, n = _variant(spark, sf_dir)
    stores = [L.Store("manual", manual), L.Store("forced", glossary, on="source", only=n % 2 == 0), L.Store("memory", memory, skip_blank=True), L.Store("glossary-value", glossary, on="source")]
    return L.protect(_changed(spark, sf_dir), stores, n % 17 == 0, 0).select("identity", "origin")


@query(f"""SELECT c.identity, CASE WHEN CAST(c.identity AS BIGINT) % 2 = 0 AND f.source IS NOT NULL THEN 'forced' WHEN l.quality = 1 AND l.doc_id % 2 = 0 THEN 'manual' WHEN CAST(c.identity AS BIGINT) % 10 <> 1 AND CAST(c.identity AS BIGINT) % 3 <> 0 THEN 'memory' WHEN CAST(c.identity AS BIGINT) % 17 = 0 THEN 'protected' WHEN f.source IS NOT NULL THEN 'glossary-value' END AS origin
FROM ({_CHANGED}) c LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = c.identity LEFT JOIN (SELECT DISTINCT text || ' v2' AS source FROM documents WHERE doc_id % 20 = 3 UNION SELECT DISTINCT text FROM documents WHERE doc_id % 6 = 0) f ON f.source = c.source""")
def audit_ladder(spark, sf_dir):
    """The audit's order: forced terms, manual, memory (approved by package but for invalidated keys), protected, glossary."""
    manual, memory, glossary, n = _variant(spark, sf_dir)
    none = memory.limit(0).select("key", F.sha2("value", 256).alias("source_sha256"))
    off = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("key"))
    stores = [L.Store("forced", glossary, on="source", only=n % 2 == 0), L.Store("manual", manual), L.Store("memory", memory, approvals=none, package=True, invalidated=off), L.Store("glossary-value", glossary, on="source")]
    return L.protect(_changed(spark, sf_dir), stores, n % 17 == 0, 3).select("identity", "origin")


@query("SELECT CAST(doc_id AS VARCHAR) AS key, sha256(CASE WHEN doc_id % 10 = 3 AND doc_id % 4 = 0 THEN 'M' || doc_id WHEN doc_id % 10 = 3 THEN text || ' v2' ELSE 'P' || doc_id END) AS value_sha256 FROM (SELECT doc_id, replace(replace(text, chr(13), ' '), chr(10), ' ') AS text FROM documents) WHERE doc_id % 10 NOT IN (1, 2)")
def adaptive_rewrite(spark, sf_dir):
    """A catalog rewritten by a three-way merge: prepared values where the source is still the baseline's, else memory, else as it was."""
    flat = F.regexp_replace("text", "[\\r\\n]", " ")
    docs = table(spark, sf_dir, "documents").where("doc_id % 10 not in (1, 2)").select("doc_id", F.col("doc_id").cast("string").alias("key"), flat.alias("value"))
    now = docs.withColumn("value", F.when(F.col("doc_id") % 10 == 3, F.concat("value", F.lit(" v2"))).otherwise(F.col("value")))
    own = F.concat("key", F.lit("="), "value")
    lines = now.select(F.lit("p").alias("package"), F.lit("main").alias("entry"), F.col("doc_id").alias("line_no"), own.alias("raw"), F.lit("\n").alias("newline"), "key", "value", F.lit(None).cast("string").alias("problem"))
    ready, memory = docs.select("key", F.concat(F.lit("P"), "key").alias("value")), docs.where("doc_id % 4 = 0").select("key", F.concat(F.lit("M"), "key").alias("value"))
    out = W.rewrite_adaptively(lines, docs.select("key", "value"), ready, memory)
    return out.select(F.substring_index("raw", "=", 1).alias("key"), F.sha2(F.expr("substring(raw, locate('=', raw) + 1)"), 256).alias("value_sha256"))


# --- repairs ----------------------------------------------------------------


@query("""SELECT CAST(m.doc_id AS VARCHAR) AS key, k.value FROM documents m JOIN (SELECT text, min(source) AS value FROM documents WHERE doc_id % 5 <> 0 GROUP BY text HAVING count(DISTINCT source) = 1) k ON k.text = m.text WHERE m.doc_id % 5 = 0 AND length(k.value) % 2 = length(m.text) % 2""")
def checked_reuse(spark, sf_dir):
    """Unambiguous reuse from memory where the value's form fits."""
    docs = table(spark, sf_dir, "documents")
    memory = docs.where("doc_id % 5 <> 0").select(F.col("text").alias("source"), F.col("source").alias("value"))
    missing = docs.where("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("source"))
    return E.reuse_checked(memory, missing, lambda s, v: F.length(v) % 2 == F.length(s) % 2).select("key", "value")


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, c.c_custkey IS NOT NULL AS known, max(o_orderpriority) AS value FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) c ON c.c_custkey = o_custkey GROUP BY ALL")
def taken_results(spark, sf_dir):
    """Results for known entries, and those for unknown keys."""
    results = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value"))
    entries = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("key"))
    taken, unknown = E.take_results(results, entries)
    return taken.select("key", F.lit(True).alias("known"), "value").union(unknown.select("key", F.lit(False), "value"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, ' (ring|bolt)') THEN 2 ELSE 1 END AS pairs, CASE WHEN regexp_matches(p_name, ' (ring|bolt)') THEN regexp_extract(p_name, ' (.*)', 1) END AS was FROM part")
def zipped_tokens(spark, sf_dir):
    """Words of two texts paired by position, where they differ."""
    words = F.split("p_name", " ")
    other = F.split(F.concat(F.regexp_replace("p_name", " (ring|bolt)", " new"), F.lit(" end")), " ")
    pairs = E.zip_tokens(words, other)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(pairs).alias("pairs"), F.get(F.filter(pairs, lambda p: p["ours"].isNotNull()), F.lit(0))["ours"].alias("was"))


@query("SELECT CAST(doc_id * 3 AS VARCHAR) AS key, CASE WHEN doc_id * 3 NOT IN (SELECT doc_id FROM documents) THEN 'UNKNOWN_KEY' ELSE 'SOURCE_CHANGED' END AS reason FROM documents d WHERE doc_id * 3 NOT IN (SELECT doc_id FROM documents) OR doc_id % 4 = 0")
def missing_rules(spark, sf_dir):
    """Repair rules whose key is gone or whose source has changed."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.sha2("text", 256).alias("source"), "doc_id")
    own = docs.select(F.col("key").alias("_k"), F.col("source").alias("_s"))
    rules = docs.select((F.col("doc_id") * 3).cast("string").alias("key"), "doc_id").join(own, F.col("key") == F.col("_k"), "left")
    rules = rules.select("key", F.when(F.col("doc_id") % 4 == 0, "other").otherwise(F.col("_s")).alias("source"))
    return E.missing_rules(rules, docs, "key", "source")


@query("""SELECT key, CASE WHEN p_partkey % 5 = 0 THEN 'key' WHEN p_name LIKE 'red %' THEN 'source' WHEN regexp_matches(p_type, '  ') OR contains(t, '  ') THEN 'space' END AS stage, CASE WHEN p_partkey % 5 = 0 THEN 'given' WHEN p_name LIKE 'red %' THEN 'kırmızı' ELSE replace(t, '  ', ' ') END AS repaired
FROM (SELECT *, CAST(p_partkey AS VARCHAR) AS key, p_type || CASE WHEN p_size % 2 = 0 THEN '  x' ELSE ' x' END AS t FROM part) WHERE p_partkey % 5 = 0 OR p_name LIKE 'red %' OR contains(t, '  ')""")
def staged_repairs(spark, sf_dir):
    """By key, by source, then by white space: the first stage that changes a target."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("source"), F.concat("p_type", F.when(F.col("p_size") % 2 == 0, "  x").otherwise(" x")).alias("target"))
    stages = [("key", F.when(F.col("key").cast("long") % 5 == 0, "given")), ("source", F.when(F.col("source").like("red %"), "kırmızı")), ("space", E.staged(F.col("target"), []))]
    return E.repair(rows, stages, lambda s, v: F.length(s) > 0)


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS key, CASE WHEN l.quality = 1 THEN 'manual' WHEN d.doc_id % 3 = 0 OR c.text IS NOT NULL THEN 'cache' ELSE 'memory' END AS origin FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
LEFT JOIN (SELECT DISTINCT text FROM documents WHERE doc_id % 3 = 0) c ON c.text = d.text LEFT JOIN (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0) m ON m.text = d.text WHERE l.quality = 1 OR c.text IS NOT NULL OR m.text IS NOT NULL""")
def proposals(spark, sf_dir):
    """Proposals from manual overrides, a cache and memory."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.col("text").alias("source"))
    manual = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("key"), F.lit("m").alias("value"))
    cache, memory = (docs.where(c).select("source", F.lit(v).alias("value")) for c, v in (("doc_id % 3 = 0", "c"), ("doc_id % 2 = 0", "r")))
    return E.propose(docs.select("key", "source"), manual, cache, memory).select("key", "origin")


@query("SELECT p_partkey, replace(replace(p_name, 'red widget', 'ruby gadget'), 'ring', 'hoop') AS p_name FROM part WHERE (contains(p_name, 'red widget') OR contains(p_name, 'ring')) AND p_size % 4 <> 0")
def propagated_edits(spark, sf_dir):
    """One edit's rules applied to all unprotected values that hold them."""
    return E.propagate(table(spark, sf_dir, "part"), "p_partkey", "p_name", [("ring", "hoop"), ("red widget", "ruby gadget")], F.col("p_size") % 4 == 0)


_PASS = """(SELECT CAST(p_partkey AS VARCHAR) AS key, p_partkey AS n, p_name AS source, CASE WHEN p_partkey % 4 <> 0 THEN p_type || '  ' || p_name END AS was FROM part)"""


@query(f"""SELECT key, CASE WHEN n % 11 = 0 THEN NULL ELSE v END AS value, CASE WHEN n % 11 = 0 THEN 'REMOVED' WHEN v IS NOT DISTINCT FROM was THEN NULL WHEN v <> varied THEN 'TYPOGRAPHY' WHEN varied IS DISTINCT FROM given THEN 'VARIANT' WHEN n % 5 = 0 THEN 'KEY' WHEN starts_with(source, 'blue') THEN 'SOURCE' ELSE 'PATTERN' END AS change FROM (
 SELECT *, trim(regexp_replace(varied, '  +', ' ', 'g')) AS v FROM (
 SELECT *, CASE WHEN n % 7 = 0 THEN replace(replace(named, 'gadget', 'thing'), 'thing', 'object') ELSE named END AS varied FROM (
 SELECT *, CASE WHEN contains(source, 'ring') THEN replace(given, 'ring', 'hoop') ELSE given END AS named FROM (
 SELECT *, CASE WHEN n % 5 = 0 THEN 'key ' || source WHEN starts_with(source, 'blue') THEN 'mavi' WHEN regexp_full_match(source, 'red [a-z]+') THEN 'kırmızı ' || source[5:] ELSE was END AS given FROM {_PASS}))))
 WHERE v IS NOT NULL AND n % 11 <> 0 OR was IS NOT NULL""")
def repair_passes(spark, sf_dir):
    """A pass of repairs over a store: own values, values of sources, patterns, variants, typography and protected entries."""
    part = table(spark, sf_dir, "part").withColumn("key", F.col("p_partkey").cast("string"))
    store = part.where("p_partkey % 4 <> 0").select("key", F.concat("p_type", F.lit("  "), "p_name").alias("value"))
    by_key = part.where("p_partkey % 5 = 0").select("key", F.concat(F.lit("key "), "p_name").alias("value"))
    by_source = part.where(F.col("p_name").startswith("blue")).select(F.col("p_name").alias("source"), F.lit("mavi").alias("value")).distinct()
    words = part.where("p_partkey % 7 = 0").select("key", F.expr("inline(array(named_struct('at', 1, 'old', 'gadget', 'new', 'thing'), named_struct('at', 2, 'old', 'thing', 'new', 'object')))"))
    return E.repair_pass(store, part.select("key", F.col("p_name").alias("source")), by_key, by_source, [("red ([a-z]+)", "kırmızı $1")], [("ring", "ring", "hoop")], words, F.col("key").cast("long") % 11 == 0)


# What two edits ask for: Varna's cases by those of Kıyı, and widget by parça, each text's case by the remainder of its key.
_ENDS = ["", "'a", "'da", "'dan", "'ın", "'ı", "'ta", "lar"]
_FORMS = ["", "ya", "da", "dan", "nın", "yı", "da", "lar"]


def _cased(stem: str, ends: list[str]) -> str:
    return "CASE p_partkey % 8 " + " ".join(f"WHEN {n} THEN '{stem}" + end.replace("'", "''") + "'" for n, end in enumerate(ends)) + " END"


@query(f"SELECT p_partkey, {_cased('Kıyı', [f.replace('a', 'a') for f in ['', 'ya', 'da', 'dan', 'nın', 'yı', 'da', 'lar']])} || ' ' || replace(p_name, 'widget', 'parça') AS text FROM part WHERE p_size % 4 <> 0 AND p_partkey <> 8")
def inflected_edits(spark, sf_dir):
    """Two edits and all cases of what they changed, carried to every unprotected value."""
    part = table(spark, sf_dir, "part")
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    rows = part.select("p_partkey", "p_size", F.concat(F.lit("Varna"), end, F.lit(" "), "p_name").alias("text"))
    edits = spark.createDataFrame([(1, 8, "Eski Varna'ya git", "Eski Kıyı'ya git"), (2, 8, "bir widget al", "bir parça al"), (3, 8, "x", "y"), (4, 8, "a [#1] b", "a [#2] b")], "edit int, key long, old string, new string")
    return E.propagate_edits(rows, "p_partkey", "text", E.edit_rules(edits, "edit", "key", "old", "new"), F.col("p_size") % 4 == 0)


@query("""WITH r AS (SELECT p_brand AS key, p_partkey, p_size % 2 = 0 AS main, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN p_type ELSE CASE WHEN p_size % 3 = 0 THEN ' Text' ELSE 'text' END END AS source, CASE WHEN p_brand = 'Brand#3' THEN 'one' WHEN p_brand = 'Brand#4' THEN NULL WHEN p_brand = 'Brand#5' THEN 'no' || p_name ELSE p_name END AS value FROM part),
b AS (SELECT key, value, min(CASE WHEN main THEN 0 ELSE 1 END * 10000000 + p_partkey) AS rank FROM r WHERE value IS NOT NULL GROUP BY ALL),
g AS (SELECT key, count(*) AS n, min_by(value, rank) AS first, min_by(value, rank) FILTER (NOT starts_with(value, 'no') AND length(value) > 6) AS safe FROM b GROUP BY key),
k AS (SELECT key, count(DISTINCT lower(trim(source))) AS texts FROM r GROUP BY key)
SELECT k.key, CASE WHEN n = 1 THEN first WHEN n > 1 AND texts = 1 THEN safe END AS value, CASE WHEN n IS NULL THEN 'NO_VALUE' WHEN n > 1 AND texts > 1 THEN 'SOURCES_DIFFER' WHEN n > 1 AND safe IS NULL THEN 'NOT_VALID' END AS problem FROM k LEFT JOIN g ON g.key = k.key""")
def safe_values(spark, sf_dir):
    """Values of a repeated key brought to one, where one is safe for all."""
    b = F.col("p_brand")
    source = F.when(b.isin("Brand#1", "Brand#2"), F.col("p_type")).when(F.col("p_size") % 3 == 0, " Text").otherwise("text")
    value = F.when(b == "Brand#3", "one").when(b == "Brand#4", F.lit(None)).when(b == "Brand#5", F.concat(F.lit("no"), "p_name")).otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select(b.alias("key"), F.col("p_partkey").alias("identity"), (F.col("p_size") % 2 == 0).alias("main"), source.alias("source"), value.alias("value"))
    return E.one_safe_value(rows, lambda s, v: ~v.startswith("no") & (F.length(v) > 6))


@query("SELECT word, unnest(list_sort(list(p_partkey))[1:30]) AS key FROM (SELECT p_partkey, p_name AS word FROM part WHERE p_name IN ('red widget', 'small ring')) GROUP BY word")
def composed_phrases(spark, sf_dir):
    """Rows whose whole value is one of the parts a query was cut into, at most 30 a part."""
    return E.phrase_parts(table(spark, sf_dir, "part"), "p_partkey", F.col("p_name"), ["red widget", "small ring"])


@query("SELECT o_custkey, min_by(o_orderpriority, o_orderkey) AS first, max_by(o_orderpriority, o_orderkey) AS last, list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS states FROM orders GROUP BY o_custkey")
def first_and_last(spark, sf_dir):
    """First wins, last wins, and the distinct states of each customer."""
    o = table(spark, sf_dir, "orders")
    ends = O.first_and_last(o, ["o_custkey"], [F.col("o_orderkey")], ["o_orderpriority"]).withColumnsRenamed({"first_o_orderpriority": "first", "last_o_orderpriority": "last"})
    return ends.join(o.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("states")), "o_custkey")


@query("SELECT o_custkey, list_filter(l, lambda x, i: list_position(l, x) = i) AS states FROM (SELECT o_custkey, list(o_orderstatus ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey)")
def ordered_distinct(spark, sf_dir):
    """Each customer's states in order of first appearance."""
    return O.distinct_in_order(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", F.col("o_orderkey"), "states")


# --- files ------------------------------------------------------------------

_PATHS = "(SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'a/Cache/' ELSE 'a/b/' END || page_id || CASE WHEN page_id % 7 = 0 THEN '.tmp' WHEN page_id % 3 = 0 THEN '.tsv' ELSE '.txt' END AS path, length(html) AS length FROM pages)"


def _paths(spark, sf_dir):
    i = F.col("page_id")
    path = F.concat(F.when(i % 5 == 0, "a/Cache/").otherwise("a/b/"), i.cast("string"), F.when(i % 7 == 0, ".tmp").when(i % 3 == 0, ".tsv").otherwise(".txt"))
    return table(spark, sf_dir, "pages").select(i, path.alias("path"), F.length("html").cast("long").alias("length"))


@query(f"SELECT path FROM {_PATHS} WHERE page_id % 5 <> 0 AND page_id % 7 <> 0 AND NOT (page_id % 3 = 0 AND page_id % 2 = 0)")
def backup_files(spark, sf_dir):
    """What a backup takes: not listed directories, not temporary files, not tables it has already."""
    files = _paths(spark, sf_dir)
    return Z.backed_up(files, ["cache"], files.where("page_id % 2 = 0").withColumn("path", F.upper("path"))).select("path")


@query(f"SELECT count(*) FILTER (keep) AS files, count(*) FILTER (NOT keep) AS skipped, CAST(sum(length) FILTER (keep) AS BIGINT) AS bytes FROM (SELECT *, page_id % 5 <> 0 AND page_id % 7 <> 0 AND NOT (page_id % 3 = 0 AND page_id % 2 = 0) AS keep FROM {_PATHS})")
def backup_totals(spark, sf_dir):
    files = _paths(spark, sf_dir)
    return Z.totals(files, Z.backed_up(files, ["cache"], files.where("page_id % 2 = 0")))


@query("SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 4 = 0 THEN 'ABSENT' ELSE 'CHANGED' END AS reason FROM documents WHERE doc_id % 4 = 0 OR doc_id % 6 = 1")
def mirror_copies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("sha"))
    mirror = docs.where("doc_id % 4 <> 0").select("name", F.when(F.col("doc_id") % 6 == 1, "other").otherwise(F.col("sha")).alias("sha"))
    return Z.to_copy(docs, mirror)


@query("SELECT CAST(doc_id AS VARCHAR) AS component, CASE WHEN doc_id % 9 = 8 THEN 'MISSING' WHEN doc_id % 5 = 0 THEN 'OUR_OUTPUT' WHEN doc_id % 5 = 1 THEN 'KNOWN_SOURCE' WHEN doc_id % 5 = 2 THEN 'PATCHED' ELSE 'NEW_SOURCE' END AS state FROM documents")
def file_states(spark, sf_dir):
    """Live files by the hashes of the last output, the known source and recorded patches."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("component"), F.sha2("text", 256).alias("sha"))
    same = lambda r: docs.select("component", F.when(F.col("doc_id") % 5 == r, F.col("sha")).otherwise("x").alias("sha"))
    return Z.file_states(docs.where("doc_id % 9 <> 8").select("component", "sha"), same(0), same(1), same(2))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 2000 THEN sha256(text) ELSE sha256(encode(CAST(strlen(text) AS VARCHAR)) || unhex(left(hex(encode(text)), 200)) || unhex(right(hex(encode(text)), 200))) END AS fingerprint FROM documents")
def quick_fingerprints(spark, sf_dir):
    """Fingerprints of large contents from their length and the bytes of their ends."""
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", Z.quick_fingerprint(F.col("text").cast("binary"), 2000, 100).alias("fingerprint"))


@query("SELECT event_id, event_id % 3 = 0 AS repeated FROM events")
def repeated_json_keys(spark, sf_dir):
    twice = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"a": 1, "k": 2, "p": '), "props", F.lit(', "a": 3}'))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", (F.size(C.repeated_json_keys(twice)) > 0).alias("repeated"))


# --- readers and writers ----------------------------------------------------


@query("""SELECT k, status, reason, issue, a AS source, coalesce(b, '') AS target FROM (SELECT s.k, s.status, '' AS reason, s.issue, f.a, f.b FROM (SELECT k, status, status NOT IN ('DONE', 'PROTECTED') AS issue FROM {S}) s JOIN {F} f ON f.k = s.k)""".replace("{S}", _STATUS).replace("{F}", _FAULTY))
def status_report(spark, sf_dir):
    """The audit's status report written as escaped TSV and read again: what is read is what was written."""
    rows = statuses_of(spark, sf_dir).select("k", "status", F.lit("").alias("reason"), "issue", F.col("a").alias("source"), F.col("b").alias("target"))
    where, columns = shared_folder(spark), ["k", "status", "reason", "issue", "source", "target"]
    W.write_status(rows, where, columns, F.col("issue"))
    read = C.read_status(spark, f"{where}/status", columns, strict=True)
    return read.select(F.col("k").cast("long").alias("k"), "status", "reason", F.col("issue").cast("boolean").alias("issue"), "source", "target")


@query("SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 3 = 0 THEN 'new ' || doc_id ELSE source || '=' || lang END AS value, doc_id % 3 = 0 AS changed FROM documents")
def lossless_rewrite(spark, sf_dir):
    """Catalog packages written from documents (one a language, with comments and two kinds of line ends), read, rewritten by identity, written and read again."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", F.concat_ws("=", "source", "lang").alias("value"))
    one = F.concat(F.lit("# note\r\n"), F.col("doc_id").cast("string"), F.lit("="), "value", F.when(F.col("doc_id") % 2 == 0, "\n").otherwise("\r\n"))
    parts = docs.select(F.concat("lang", F.lit("-"), (F.col("doc_id") % 16).cast("string")).alias("package"), F.lit("main").alias("entry"), F.col("doc_id").alias("line_no"), one.alias("raw"), F.lit("").alias("newline"))
    first, second = f"{shared_folder(spark)}/first", f"{shared_folder(spark)}/second"
    W.pack(parts).write.parquet(first)
    lines = C.read_lines(spark, first, ["main"], keyed_by="parquet")
    proposals = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("main:"), F.col("doc_id").cast("string"), F.lit("#1")).alias("identity"), F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("value"))
    again = W.rewrite(lines, proposals)
    W.pack(again).write.parquet(second)
    read = C.read_packages(spark, second, ["main"], mode="FAILFAST", keyed_by="parquet")
    return read.select("key", "value", F.col("value").startswith("new ").alias("changed"))


@query("SELECT user_id, arg_max(event_type, event_id) AS method FROM events WHERE event_type IN ('signup', 'view') GROUP BY user_id")
def latest_methods(spark, sf_dir):
    """A live log appended to in two parts, read again, and the method of each key's last saved line."""
    e = table(spark, sf_dir, "events")
    saved = F.when(F.col("event_type").isin("signup", "view"), "SAVED").otherwise("REJECTED")
    text = lambda c: F.col(c).cast("string")
    log = e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_type").alias("method"), text("user_id").alias("key"), F.lit("c").alias("category"), saved.alias("status"), F.lit("a\tb").alias("source"), F.lit("t").alias("target"), text("event_id").alias("detail"), "event_id")
    where = shared_folder(spark)
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        W.append_log(log.where(part), where, C.LOG)
    rows = C.parse_log(spark.read.text(where))
    return C.latest_methods(rows, [F.col("detail").cast("long")], "SAVED").select(F.col("key").cast("long").alias("user_id"), "method")
