"""Counts, profiles, consistency and ordered state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts of a group, by hash, where a group may be very large.
PARTS = 64


def counts_with_total(rows: DataFrame, by: str) -> DataFrame:
    """Counts by a column and their sum as ``TOTAL``, in one aggregation."""
    out = rows.rollup(by).agg(F.count("*").alias("n"), F.grouping(by).alias("_all"))
    return out.select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(by)).alias(by), "n")


def grouping_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by ``a``, by ``b`` and in all, in one pass."""
    return rows.groupingSets([[a], [b], []], a, b).agg(F.count("*").alias("n"))


def latest_state(log: DataFrame, key: str, order: list[Column], status: str, live: list[str], tombstone: str) -> DataFrame:
    """The last state of each key, where states are ``live`` or ``tombstone`` rows; other rows change nothing, tombstoned keys go."""
    states = log.where(F.col(status).isin(*live, tombstone))
    last = states.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in log.columns if c != key]), F.struct(*order)).alias("_row"))
    return last.where(F.col(f"_row.{status}") != tombstone).select(key, "_row.*")


def first_and_last(rows: DataFrame, by: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """``by`` and, for each column, ``first_`` and ``last_`` of it: the rows that win where the first, or the last, of equal keys does."""
    row, at = F.struct(*columns), F.struct(*order)
    ends = rows.groupBy(*by).agg(F.min_by(row, at).alias("_first"), F.max_by(row, at).alias("_last"))
    return ends.select(*by, *[F.col(f"_{end}.{c}").alias(f"{end}_{c}") for end in ("first", "last") for c in columns])


def distinct_in_order(rows: DataFrame, by: list[str], item: str, order: Column, out: str) -> DataFrame:
    """``by, out``: each group's distinct items in order of their first appearance (a list as long as a group has distinct items)."""
    each = rows.groupBy(*by, item).agg(F.min(order).alias("_at"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", item))), lambda x: x[item]).alias(out))


def set_operation(left: DataFrame, right: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """The distinct ``keys`` of both tables together (``union``), of both (``intersection``) or of the left alone (``difference``); null keys equal each other."""
    x, y = left.select(*keys), right.select(*keys)
    return {"union": x.union(y).distinct, "intersection": lambda: x.intersect(y), "difference": lambda: x.subtract(y)}[kind]()


def gate_matches(requests: DataFrame, manifests: DataFrame, version: str = "version", sha: str = "sha") -> DataFrame:
    """Requests with the manifests of the same version and hash; blanks around them and the case of hashes do not matter, nulls match nothing."""
    same = lambda d: d.withColumns({version: F.trim(version), sha: F.lower(F.trim(sha))})
    return same(requests).join(same(manifests), [version, sha])


def first_members(rows: DataFrame, by: list[str], member: str, k: int, out: str = "first") -> DataFrame:
    """``by, out``: the first ``k`` distinct members of each group, in order.

    Two steps, so a group of any size is never gathered: the first ``k`` within
    parts of a group by hash, then the first ``k`` of those.
    """
    part = F.pmod(F.xxhash64(member), F.lit(PARTS)).alias("_part")
    each = rows.where(F.col(member).isNotNull()).select(*by, F.col(member).alias("_member"), part).distinct()
    rank = F.row_number().over(W.partitionBy(*by, "_part").orderBy("_member"))
    few = each.withColumn("_rank", rank).where(F.col("_rank") <= k)
    return few.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list("_member")), 1, k).alias(out))


def units(rows: DataFrame, by: list[str], member: str, members: int = 0) -> DataFrame:
    """Distinct groups to be worked on once: first member and how many rows share each.

    With ``members``, also the first so many members in order, as ``listed``; the rest is found by joining on ``by``.
    """
    counts = rows.groupBy(*by).agg(F.min(member).alias("first_member"), F.count("*").alias("members"))
    return counts.join(first_members(rows, by, member, members, "listed"), by) if members else counts


def variants(rows: DataFrame, source: str, target: str) -> DataFrame:
    """``source, target, n``: trimmed sources with more than one target, a row a target; nothing is gathered."""
    per = rows.where(F.trim(target) != "").groupBy(F.trim(source).alias(source), target).agg(F.count("*").alias("n"))
    several = per.groupBy(source).agg(F.count("*").alias("variants")).where("variants > 1")
    return per.join(several, source)


def inconsistent(rows: DataFrame, source: str, target: str, most: int | None = None) -> DataFrame:
    """Trimmed sources with more than one target, and the targets with their counts as one text, sorted by target.

    With ``most``, only the first so many are listed, found in two steps, so a
    source of any number of targets is never gathered (``variants`` has them all).
    """
    per = variants(rows, source, target)
    if most is not None:
        part = F.pmod(F.xxhash64(target), F.lit(PARTS))
        rank = F.row_number().over(W.partitionBy(source, "_part").orderBy(target))
        per = per.withColumn("_part", part).withColumn("_rank", rank).where(F.col("_rank") <= most)
    listed = per.groupBy(source).agg(F.first("variants").alias("variants"), F.array_sort(F.collect_list(F.struct(target, "n"))).alias("v"))
    shown = F.col("v") if most is None else F.slice("v", 1, most)
    return listed.select(source, "variants", F.array_join(F.transform(shown, lambda x: F.concat(x[target], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), "; ").alias("listing"))


def top_by_count(rows: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """The ``n`` most frequent items of each group, ties by item; a group's items are ranked in parts first, so few reach one task."""
    per = rows.groupBy(group, item).agg(F.count("*").alias("n")).withColumn("_part", F.pmod(F.xxhash64(item), F.lit(PARTS)))
    order = (F.desc("n"), F.col(item))
    few = per.withColumn("rank", F.row_number().over(W.partitionBy(group, "_part").orderBy(*order))).where(F.col("rank") <= n)
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return few.drop("_part").withColumn("rank", rank).where(F.col("rank") <= n)


def repeated_words(rows: DataFrame, key: str, words: Column, least: int) -> DataFrame:
    """Words that occur ``least`` times or more in a row, with their counts."""
    return rows.select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def multiset_difference(rows: DataFrame, key: str, left: Column, right: Column) -> DataFrame:
    """What ``left`` has more of than ``right``, counting repeats, item by item."""
    both = rows.select(key, F.explode(left).alias("item"), F.lit(1).alias("d")).union(rows.select(key, F.explode(right).alias("item"), F.lit(-1).alias("d")))
    return both.groupBy(key, "item").agg(F.sum("d").alias("more")).where("more > 0")
