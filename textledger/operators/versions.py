"""Record identities, snapshots and version diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("NEW", "MODIFIED", "REMOVED", "UNCHANGED")


def with_identity(records: DataFrame, entry: str = "entry", key: str = "key", line: str = "line_no", scope: tuple[str, ...] = ()) -> DataFrame:
    """Add ``occurrence`` (1-based per entry and key, in line order) and ``identity`` = ``entry:key#occurrence``.

    ``scope`` are columns that tell packages apart, each numbered for itself. A
    group is the repeats of one key; see ``with_wide_identity`` for keys of very many.
    """
    group = [*scope, entry, key]
    nth = F.row_number().over(W.partitionBy(*group).orderBy(line))
    return records.withColumn("occurrence", nth).withColumn("identity", F.concat(F.col(entry), F.lit(":"), F.col(key), F.lit("#"), F.col("occurrence").cast("string")))


def with_wide_identity(records: DataFrame, entry: str, key: str, line: str, parts: int = 64) -> DataFrame:
    """``with_identity`` where a few keys have very many rows: numbers within ranges of ``line``, then the ranges' counts before them.

    ``line`` is an integer column; it is cut into ``parts`` ranges of about
    equally many rows, so no task sorts more than one range of a key.
    """
    probs = [i / parts for i in range(1, parts)]
    cuts = sorted(set(records.approxQuantile(line, probs, 1 / (4 * parts))))
    part = F.lit(0)
    if cuts:
        part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(line)))
    rows = records.withColumn("_part", part)
    sizes = rows.groupBy(entry, key, "_part").agg(F.count("*").alias("_n"))  # a row per key and range
    before = W.partitionBy(entry, key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select(entry, key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    nth = F.row_number().over(W.partitionBy(entry, key, "_part").orderBy(line))
    out = rows.withColumn("_nth", nth).join(bases, [entry, key, "_part"]).withColumn("occurrence", F.col("_base") + F.col("_nth"))
    return out.select(*records.columns, "occurrence", F.concat(F.col(entry), F.lit(":"), F.col(key), F.lit("#"), F.col("occurrence").cast("string")).alias("identity"))


def snapshot(records: DataFrame, value: str = "value") -> DataFrame:
    """``identity, value_sha256``: what a later diff needs of a version."""
    return records.select("identity", F.sha2(value, 256).alias("value_sha256"))


def _kind(old: Column, new: Column) -> Column:
    return F.when(old.isNull(), "NEW").when(new.isNull(), "REMOVED").when(old == new, "UNCHANGED").otherwise("MODIFIED")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer diff of two snapshots: ``identity, kind``. Only hashes are shuffled."""
    o, n = old.withColumnRenamed("value_sha256", "_old"), new.withColumnRenamed("value_sha256", "_new")
    return o.join(n, "identity", "full_outer").select("identity", _kind(F.col("_old"), F.col("_new")).alias("kind"))


def changed_hashes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The three-class form: ``identity, kind`` of what is new, modified or removed; the same hashes on both sides give no row."""
    return diff(old, new).where("kind <> 'UNCHANGED'")


def kind_counts(changes: DataFrame) -> DataFrame:
    """Counts of all four kinds, zeros kept."""
    spark = changes.sparkSession
    kinds = spark.createDataFrame([(k,) for k in KINDS], "kind string")
    return kinds.join(changes.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def duplicate_stats(records: DataFrame, entry: str = "entry", key: str = "key") -> DataFrame:
    """Per entry: records, keys that repeat, and occurrences beyond the first."""
    per_key = records.groupBy(entry, key).agg(F.count("*").alias("c"))
    return per_key.groupBy(entry).agg(
        F.sum("c").alias("records"),
        F.count_if(F.col("c") > 1).alias("duplicate_keys"),
        F.sum(F.col("c") - 1).alias("duplicate_occurrences"),
    )


def conflicts(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that both sides have with different values."""
    x, y = a.select(key, F.col(value).alias("old_value")), b.select(key, F.col(value).alias("new_value"))
    return x.join(y, key).where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def reconcile(stores: dict[str, DataFrame], against: str, key: str) -> DataFrame:
    """For each store other than ``against``: how many keys only it has and how many it lacks."""
    base = stores[against].select(key).distinct()
    parts = []
    for name, df in stores.items():
        if name != against:
            own = df.select(key).distinct().withColumn("_own", F.lit(1))
            both = own.join(base.withColumn("_base", F.lit(1)), key, "full_outer")
            parts.append(both.agg(F.count_if(F.col("_base").isNull()).alias("only_here"), F.count_if(F.col("_own").isNull()).alias("missing_here")).select(F.lit(name).alias("store"), "only_here", "missing_here"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def newest(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``order`` (retention)."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def version_array(version: Column) -> Column:
    """``a.b.c.d`` as numbers; arrays compare element by element."""
    return F.transform(F.split(version, r"\."), lambda x: x.cast("int"))
