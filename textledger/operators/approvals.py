"""Approvals that bind a value to the source text it was made for.

An approval is a row ``namespace, key, source_sha256``. Malformed hashes count
for nothing and case does not matter. A package may be approved as a whole for
records that came before approvals: that admits every key of a namespace that
is not invalidated, where the package at hand is the approved one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMESPACES = ("memory", "manual", "glossary_keys")


def normal_approvals(raw: DataFrame, listed: bool) -> DataFrame:
    """Rows ``namespace, key, source_sha256`` as approvals: hashes in lower case, malformed ones gone, each once.

    ``listed`` says whether ``source_sha256`` is an array. A null namespace is
    the old flat form, which speaks of the memory only.
    """
    sha = F.explode("source_sha256") if listed else F.col("source_sha256")
    rows = raw.select(F.coalesce("namespace", F.lit("memory")).alias("namespace"), "key", sha.alias("source_sha256"))
    rows = rows.where(F.col("namespace").isin(*NAMESPACES) & F.col("source_sha256").rlike("^[0-9a-fA-F]{64}$"))
    return rows.select("namespace", "key", F.lower("source_sha256").alias("source_sha256")).distinct()


def admitted(records: DataFrame, approvals: DataFrame, namespace: str, package: str | None = None, approved_package: str | None = None, invalidated: DataFrame | None = None) -> DataFrame:
    """``records`` (``key, source``) with ``approved``: by the hash of their source, or by their package.

    ``package`` and ``approved_package`` are the SHA-1 of the package at hand
    and of the one approved as a whole; ``invalidated`` has ``namespace, key``.
    Without them there is no such fallback.
    """
    own = approvals.where(F.col("namespace") == namespace).select(F.col("key").alias("_k"), F.col("source_sha256").alias("_sha"), F.lit(True).alias("_own")).distinct()
    out = records.join(own, (F.col("key") == F.col("_k")) & (F.sha2("source", 256) == F.col("_sha")), "left").drop("_k", "_sha")
    whole = F.lit(False)
    if package and approved_package and package.lower() == approved_package.lower() and invalidated is not None:
        off = invalidated.where(F.col("namespace") == namespace).select(F.col("key").alias("_k"), F.lit(True).alias("_off")).distinct()
        out = out.join(off, F.col("key") == F.col("_k"), "left").drop("_k")
        whole = F.col("_off").isNull()
    return out.withColumn("approved", F.coalesce("_own", F.lit(False)) | whole).drop("_own", "_off")


def hash_sets(approvals: DataFrame, more: DataFrame) -> DataFrame:
    """``namespace, key, hashes``: all hashes approved for a key, sorted, each once."""
    return approvals.unionByName(more).groupBy("namespace", "key").agg(F.array_sort(F.collect_set("source_sha256")).alias("hashes"))


def invalidated_keys(old: DataFrame, new: DataFrame) -> DataFrame:
    """``namespace, key``: the union of what is invalidated, each once (a row each: a namespace may have any number)."""
    return old.unionByName(new).where("key is not null").distinct()


def edit(store: DataFrame, approvals: DataFrame, invalidated: DataFrame, edits: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply edits (``key, source, value``, one a key) to a store ``key, value``: the new store, approvals and invalidations.

    An edited key is approved for its present source alone, and is no longer
    invalidated. An edit without a value takes value and approvals away.
    """
    keys = edits.select("key")
    kept = store.join(keys, "key", "left_anti").select("key", "value")
    filled = edits.where(F.trim(F.coalesce("value", F.lit(""))) != "")
    mine = F.col("namespace") == namespace
    others = approvals.where(~mine).unionByName(approvals.where(mine).join(keys, "key", "left_anti").select(*approvals.columns))
    fresh = filled.select(F.lit(namespace).alias("namespace"), "key", F.sha2("source", 256).alias("source_sha256"))
    off = invalidated.where(~mine).unionByName(invalidated.where(mine).join(keys, "key", "left_anti").select(*invalidated.columns))
    return kept.unionByName(filled.select("key", "value")), others.unionByName(fresh), off
