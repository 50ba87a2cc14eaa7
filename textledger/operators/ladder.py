"""The resolution ladder: where each changed record's value comes from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Store:
    """One rung: ``rows`` of ``key, value``, matched by ``on``.

    ``approvals`` (``key, source_sha256``) gate it when given. A key that
    repeats has its last value by the column ``order`` (the greatest value
    without one), as in a map, so no rung multiplies records. ``only`` is a
    further condition on the record; ``package`` admits keys without a hash of
    their own but those in ``invalidated`` (see ``approvals.admitted``).
    """

    name: str
    rows: DataFrame
    on: str = "key"
    approvals: DataFrame | None = None
    skip_blank: bool = False
    order: str | None = None
    only: Column | None = None
    package: bool = False
    invalidated: DataFrame | None = None


def resolve(changed: DataFrame, stores: list[Store]) -> DataFrame:
    """Left-join every store and take the first that has an admitted value, in the order given.

    ``changed`` has ``identity, key, source``. Returns it with ``value`` and
    ``origin``, both null where no store serves. Priority is the order of
    ``stores``: it is data, so each ladder variant is a list.
    """
    out = changed.withColumn("_sha", F.sha2("source", 256))
    values, origins = [], []
    for i, s in enumerate(stores):
        last = F.max_by("value", s.order) if s.order else F.max("value")
        rung = s.rows.where("value is not null").groupBy(F.col("key").alias(f"_k{i}")).agg(last.alias(f"_v{i}"))
        if s.skip_blank:
            rung = rung.where(F.trim(f"_v{i}") != "")
        out = out.join(rung, F.col(s.on) == F.col(f"_k{i}"), "left")
        usable = F.col(f"_v{i}").isNotNull()
        if s.only is not None:
            usable &= F.coalesce(s.only, F.lit(False))
        if s.approvals is not None:
            ok = s.approvals.select(F.col("key").alias(f"_a{i}"), F.lower("source_sha256").alias(f"_s{i}"), F.lit(True).alias(f"_ok{i}")).distinct()
            out = out.join(ok, (F.col(s.on) == F.col(f"_a{i}")) & (F.col("_sha") == F.col(f"_s{i}")), "left")
            approved = F.col(f"_ok{i}").isNotNull()
            if s.package:
                off = s.invalidated.select(F.col("key").alias(f"_o{i}"), F.lit(True).alias(f"_off{i}")).distinct()
                out = out.join(off, F.col(s.on) == F.col(f"_o{i}"), "left")
                approved |= F.col(f"_off{i}").isNull()
            usable &= approved
        values.append(F.when(usable, F.col(f"_v{i}")))
        origins.append(F.when(usable, F.lit(s.name)))
    return out.select(*changed.columns, F.coalesce(*values).alias("value"), F.coalesce(*origins).alias("origin"))


def protect(changed: DataFrame, stores: list[Store], protected: Column, at: int, name: str = "protected") -> DataFrame:
    """``resolve`` with a rung at place ``at`` that keeps the record's own text where ``protected`` holds.

    The build ladder has it first; the audit ladder has it behind its forced
    and remembered values.
    """
    above, below = resolve(changed, stores[:at]) if at else changed.withColumns({"value": F.lit(None).cast("string"), "origin": F.lit(None).cast("string")}), stores[at:]
    kept = F.col("origin").isNull() & F.coalesce(protected, F.lit(False))
    above = above.withColumns({"value": F.when(kept, F.col("source")).otherwise(F.col("value")), "origin": F.when(kept, name).otherwise(F.col("origin"))})
    if not below:
        return above
    rest = resolve(above.withColumnsRenamed({"value": "_first", "origin": "_from"}), below)
    return rest.select(*changed.columns, F.coalesce("_first", "value").alias("value"), F.coalesce("_from", "origin").alias("origin"))


def effective(resolved: DataFrame) -> DataFrame:
    """``identity, value``: what a reader sees, the resolved value or else the source itself."""
    return resolved.select("identity", F.coalesce("value", "source").alias("value"))


def unresolved(changed: DataFrame, stores: list[Store]) -> DataFrame:
    """The changed records that no rung serves (nothing is sent to a provider before this is known)."""
    return resolve(changed, stores).where("origin is null").select(*changed.columns)


def origin_pivot(resolved: DataFrame, group: str, names: list[str]) -> DataFrame:
    """Counts per group over a fixed list of origins, zeros kept."""
    return resolved.groupBy(group).pivot("origin", names).agg(F.count(F.lit(1))).na.fill(0, names)


def violations(proposals: DataFrame, changes: DataFrame, sources: DataFrame | None = None, form_ok=None) -> DataFrame:
    """Proposals that must not be applied: unknown identity, unchanged or removed record, blank value, or a value of another form.

    Forms are compared by ``form_ok(source, value)``, a condition on columns,
    with the texts of ``sources`` (``identity, source``).
    """
    joined = proposals.join(changes.select("identity", "kind"), "identity", "left")
    if sources is not None:
        joined = joined.join(sources.select("identity", F.col("source").alias("_source")), "identity", "left")
    reason = (
        F.when(F.col("kind").isNull(), "UNKNOWN")
        .when(~F.col("kind").isin("NEW", "MODIFIED"), "NOT_CHANGED")
        .when(F.trim(F.coalesce("value", F.lit(""))) == "", "BLANK")
    )
    if sources is not None:
        reason = reason.when(~form_ok(F.col("_source"), F.col("value")), "FORM")
    return joined.withColumn("reason", reason).where("reason is not null").select("identity", "reason")


def three_way(source: DataFrame, baseline: DataFrame, prepared: DataFrame, memory: DataFrame, manual: DataFrame | None = None, terms: DataFrame | None = None, valid=None) -> DataFrame:
    """Use the prepared value where the source is still the baseline's, else the first of manual (by key), term (by source) and memory (by key), else keep the source.

    All are ``key, value`` (``terms``: ``key`` is a source text), one value a
    key. ``valid(source, value)`` is a condition on columns that values other
    than the source's must meet; those that do not are passed over.
    """
    one = lambda d, n: d.groupBy("key").agg(F.max("value").alias(n))
    out = source
    for d, n in ((baseline, "_base"), (prepared, "_ready"), (manual, "_manual"), (memory, "_memory")):
        out = out.join(one(d, n), "key", "left") if d is not None else out.withColumn(n, F.lit(None).cast("string"))
    out = out.join(one(terms, "_term").withColumnRenamed("key", "_tk"), F.col("value") == F.col("_tk"), "left") if terms is not None else out.withColumn("_term", F.lit(None).cast("string"))
    fits = lambda c: F.col(c).isNotNull() & (valid(F.col("value"), F.col(c)) if valid else F.lit(True))
    same = F.col("value").eqNullSafe(F.col("_base")) & fits("_ready")
    rungs = [("PREPARED", same, "_ready"), *[(n, fits(c), c) for n, c in (("MANUAL", "_manual"), ("TERM", "_term"), ("MEMORY", "_memory"))]]
    choice = F.coalesce(*[F.when(ok, F.lit(n)) for n, ok, _ in rungs], F.lit("SOURCE"))
    merged = F.coalesce(*[F.when(ok, F.col(c)) for _, ok, c in rungs], F.col("value"))
    return out.select("key", choice.alias("choice"), merged.alias("merged"))


def reuse(done: DataFrame, missing: DataFrame, source: str, target: str) -> DataFrame:
    """Give rows without a target the one target their source text always has elsewhere."""
    known = done.groupBy(source).agg(F.min(target).alias("reused"), F.max(target).alias("_other")).where("reused = _other").drop("_other")
    return missing.join(known, source)


def scoped(rows: DataFrame, scopes: DataFrame, key: str, source: str) -> DataFrame:
    """First scope (by ``ord``) whose ``source`` equals the row's and whose ``prefix`` begins its key."""
    s = scopes.withColumnRenamed("source", "_source")
    hit = rows.join(s, (F.col(source) == F.col("_source")) & F.col(key).startswith(F.col("prefix")))
    best = hit.groupBy(key).agg(F.min_by("replacement", "ord").alias("replacement"))
    return rows.join(best, key)


def upsert(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Overlay ``new`` on ``old`` by key; says which side each value came from."""
    o, n = old.select(key, F.col(value).alias("_old")), new.select(key, F.col(value).alias("_new"))
    return o.join(n, key, "full_outer").select(key, F.coalesce("_new", "_old").alias(value), F.when(F.col("_new").isNull(), "KEPT").when(F.col("_old").isNull(), "ADDED").otherwise("REPLACED").alias("action"))


def seeded(rows: DataFrame, seeds: DataFrame, key: str, source: str) -> DataFrame:
    """A correction given for one key goes to all rows with that key's source text; ``seeds`` has ``seed_key, replacement``.

    A seed whose key no row has is an error when read: a batch made for other rows must not be half applied.
    """
    found = seeds.join(rows.select(F.col(key).alias("seed_key"), F.col(source).alias("_text"), F.lit(True).alias("_there")), "seed_key", "left")
    lost = F.raise_error(F.concat(F.lit("no row has the seed key "), F.col("seed_key").cast("string"))).cast("string")
    found = found.select("seed_key", "replacement", F.when(F.col("_there"), F.col("_text")).otherwise(lost).alias("_text"))
    texts = found.groupBy("_text").agg(F.min_by("replacement", "seed_key").alias("replacement"))
    return rows.join(texts, F.col(source) == F.col("_text")).drop("_text")


def drop_prefixes(rows: DataFrame, key: str, prefixes: list[str], keep: DataFrame | None = None) -> DataFrame:
    """``rows`` without those whose key starts with a prefix, unless ``keep`` lists the key. Rows without a key stay."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.coalesce(F.col(key).startswith(p), F.lit(False))
    if keep is None:
        return rows.where(~hit)
    listed = keep.select(F.col(key).alias("_kept")).distinct()
    return rows.join(listed, F.col(key) == F.col("_kept"), "left").where(~hit | F.col("_kept").isNotNull()).drop("_kept")
