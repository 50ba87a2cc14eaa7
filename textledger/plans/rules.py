"""Rule tables compiled to column expressions: order is priority."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """All patterns given must match (or, for ``not_``, fail); ``test`` is any further condition."""

    code: str
    severity: str = "ERROR"
    key: str | None = None
    source: str | None = None
    target: str | None = None
    not_source: str | None = None
    not_target: str | None = None
    test: Column | None = None
    reason: str = ""


def condition(rule: Rule, key: Column, source: Column, target: Column) -> Column:
    out = F.lit(True) if rule.test is None else rule.test
    for col, pattern, want in ((key, rule.key, True), (source, rule.source, True), (target, rule.target, True), (source, rule.not_source, False), (target, rule.not_target, False)):
        if pattern:
            hit = F.coalesce(col.rlike(pattern), F.lit(False))
            out = out & (hit if want else ~hit)
    return F.coalesce(out, F.lit(False))


def first_problem(rules: list[Rule], key: Column, source: Column, target: Column) -> Column:
    """The code of the first rule that fires, or null."""
    return F.coalesce(*[F.when(condition(r, key, source, target), F.lit(r.code)) for r in rules])


def findings(rows: DataFrame, rules: list[Rule], key: str, source: str, target: str, empty_severity: str = "ERROR") -> DataFrame:
    """One row per rule that fires: ``key, code, severity``. An empty target is found alone."""
    k, s, t = F.col(key), F.col(source), F.col(target)
    empty = F.trim(F.coalesce(t, F.lit(""))) == ""
    hit = lambda code, severity: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    many = F.array_compact(F.array(*[F.when(condition(r, k, s, t), hit(r.code, r.severity)) for r in rules]))
    found = F.when(empty, F.array(hit("EMPTY_TARGET", empty_severity))).otherwise(many)
    return rows.select(k.alias("key"), F.explode(found).alias("f")).select("key", "f.code", "f.severity")
