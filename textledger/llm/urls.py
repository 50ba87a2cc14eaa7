"""URL filter: rules first, then gradient-boosted trees on lexical features.

Rules name a host (and all its subdomains) and the beginning of a path; the
longest that fits decides. The URLs that rules decide are the labelled ones:
trees are trained on them and judge the rest. Features are native column
expressions: lengths, depth, digit ratio, entropy of characters, parameter
counts and smoothed block rates of suffixes: the host's last one, two and three labels and the
file ending of the path. How a path begins is no feature, as rules are told by it. A labelled URL's rates are
those of the labelled URLs outside its fold, so the trees never see a rate that
holds the label they are to learn.

Equal rules: the longest decides, of equally long ones the last. Very long urls
are measured whole. A null url, or one without ``://``, has an empty host and path and fits no
rule. If the labelled URLs are none or of one kind, all others get that kind
(allow, if there are none). Repeated rows are kept. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TREES, DEPTH, SEED = 20, 4, 20240604
SMOOTH = 10.0
#: Folds of the labelled URLs, by checksum.
FOLDS = 5


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.translate(host, UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (or null) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digits", "digit_ratio", "hyphens", "entropy", "parameters", "query_length", "fragment", "secure", "tld_rate", "domain_rate", "host_rate", "ending_rate"]


def lexical(url: Column) -> dict[str, Column]:
    """Lexical features of a URL as column expressions."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    chars = F.split(F.substring(u, 1, 2**31 - 1), "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.length(u) - F.length(F.replace(u, c, F.lit(""))))
    entropy = F.aggregate(counts, F.lit(0.0), lambda a, k: a - F.when(k > 0, k / n * F.log2(k / n)).otherwise(0.0))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    host, path = host_of(url), path_of(url)
    return {
        "length": F.length(u),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.regexp_count(path, F.lit("/[^/]")),
        "labels": F.regexp_count(host, F.lit(r"\.")),
        "digits": F.regexp_count(u, F.lit("[0-9]")),
        "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / n,
        "hyphens": F.regexp_count(u, F.lit("-")),
        "entropy": entropy,
        "parameters": F.regexp_count(query, F.lit("[^&;]+")),
        "query_length": F.length(query),
        "fragment": F.locate("#", u) > 0,
        "secure": u.startswith("https:"),
    }


def features_of(rows: DataFrame) -> DataFrame:
    """Add the features to rows of ``url, host, path`` and ``label`` (1.0 block, 0.0 allow, null unknown); ``fold`` tells the parts of the labelled rows."""
    suffixes = {n: F.substring_index("host", ".", -k) for n, k in (("tld", 1), ("domain", 2), ("host", 3))}
    suffixes = {f"{n}_suffix": c for n, c in suffixes.items()} | {"ending_suffix": F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1)}
    measured = {n: v.cast("double") for n, v in lexical(F.col("url")).items()}
    fold = F.crc32(F.coalesce("url", F.lit(""))) % FOLDS
    rows = settle(rows.withColumns(measured | suffixes | {"fold": fold}).drop("url"), "urls")
    labelled = rows.where("label is not null")
    seen = labelled.agg(F.avg("label").alias("rate")).first()["rate"]
    for name in suffixes:
        parts = labelled.groupBy(name, "fold").agg(F.sum("label").alias("b"), F.count("*").alias("n"))
        whole = parts.groupBy(name).agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("b", "n").alias("x")))).alias("own"))  # FOLDS entries
        rows = rows.join(whole, name, "left")
        own = F.when(F.col("label").isNotNull(), F.col("own")[F.col("fold")])
        b, n = (F.coalesce(F.col(c), F.lit(0)) - F.coalesce(own[c], F.lit(0)) for c in ("b", "n"))
        rows = rows.withColumn(f"{name.removesuffix('_suffix')}_rate", (b + SMOOTH * (seen or 0.0)) / (n + SMOOTH)).drop("b", "n", "own")
    return settle(rows.drop(*suffixes), "url-features")


def trees_of(train: DataFrame):
    """Boosted trees over the features of labelled rows."""
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, featuresCol="x", predictionCol="guess")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="x"), trees]).fit(train)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every page; ``score`` is the trees' probability of block."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    base = base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    rows = features_of(base.withColumns({"rule": rule, "ruled": ruled, "label": (ruled == "block").cast("double")}))
    train = rows.where("label is not null")
    seen = train.agg(F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if seen["lo"] == seen["hi"]:
        fixed = "block" if seen["hi"] else "allow"
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(fixed)).alias("verdict"), F.lit(float(seen["hi"] or 0)).alias("score"))
    scored = trees_of(train).transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("guess") == 1, "block").otherwise("allow")).alias("verdict"), "score")
