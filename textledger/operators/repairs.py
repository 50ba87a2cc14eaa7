"""Repairs: reuse, staged rules, propagation of edits, results taken in, duplicates brought to one value."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import language as X
from ..functions.language import inflected_rules, span_of_change
from ..plans.names import BLOCK_CHARS
from .stats import first_members


def reuse_checked(memory: DataFrame, missing: DataFrame, same_form) -> DataFrame:
    """Give rows (``key, source``) the one value their source always has in ``memory`` (``source, value``), where its form fits.

    ``same_form(source, value)`` is a condition on columns.
    """
    known = memory.groupBy("source").agg(F.min("value").alias("value"), F.max("value").alias("_other")).where("value = _other").drop("_other")
    return missing.join(known, "source").where(same_form(F.col("source"), F.col("value"))).select("key", "source", "value")


def take_results(results: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results (``key, value``; of several for a key the greatest value) for known entries, and those for unknown keys."""
    one = results.groupBy("key").agg(F.max("value").alias("value"))
    return entries.join(one, "key"), one.join(entries.select("key"), "key", "left_anti")


def zip_tokens(ours: Column, theirs: Column) -> Column:
    """Pairs of tokens by position, the shorter list filled with nulls, where they differ: ``{at, ours, theirs}``."""
    n = F.greatest(F.size(ours), F.size(theirs))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(at, lambda i: F.struct(i.alias("at"), F.get(ours, i).alias("ours"), F.get(theirs, i).alias("theirs")))
    return F.filter(pairs, lambda p: ~p["ours"].eqNullSafe(p["theirs"]))


def missing_rules(rules: DataFrame, rows: DataFrame, key: str, source: str) -> DataFrame:
    """Rules (``key, source``) whose key is unknown or has another source by now: no repair may run while there are any."""
    have = rows.select(F.col(key).alias("_k"), F.col(source).alias("_s"))
    joined = rules.join(have, F.col("key") == F.col("_k"), "left")
    reason = F.when(F.col("_k").isNull(), "UNKNOWN_KEY").when(~F.col("source").eqNullSafe(F.col("_s")), "SOURCE_CHANGED")
    return joined.withColumn("reason", reason).where("reason is not null").select("key", "reason")


def repair(rows: DataFrame, stages: list[tuple[str, Column]], same_form) -> DataFrame:
    """``rows`` (``key, source, target``) that a stage repairs: ``key, stage, repaired``.

    Stages are values in order of priority (null: none); the first one whose
    value differs from the target, is not blank and keeps the source's form wins.
    """
    fits = [v.isNotNull() & (F.trim(v) != "") & ~v.eqNullSafe(F.col("target")) & same_form(F.col("source"), v) for _, v in stages]
    stage = F.coalesce(*[F.when(f, F.lit(name)) for (name, _), f in zip(stages, fits)])
    value = F.coalesce(*[F.when(f, v) for (_, v), f in zip(stages, fits)])
    return rows.select("key", stage.alias("stage"), value.alias("repaired")).where("stage is not null")


def staged(text: Column, replacements: list[tuple[str, str]]) -> Column:
    """Literal variants, then typography: each stage reads what the one before wrote."""
    for old, new in replacements:
        text = F.replace(text, F.lit(old), F.lit(new))
    return X.typography(text)


def repair_pass(
    store: DataFrame,
    sources: DataFrame,
    by_key: DataFrame,
    by_source: DataFrame,
    patterns: list[tuple[str, str]],
    name_variants: list[tuple[str, str, str]],
    key_variants: DataFrame,
    protected: Column,
) -> DataFrame:
    """The store (``key, value``) after a pass of repairs: ``key, value, change`` (null: as it was; ``REMOVED``: no entry any more).

    For each key of ``sources`` (``key, source``): its own value, else that of
    its source, else what the first pattern makes of the source, else what the
    store has. Then what names in the source are wrongly called in it
    (``name, old, new``), then a key's own wordings (``key, old, new, at`` in
    the order of ``at``) are replaced. Typography is mended in all entries, in
    the store alone too, and entries of protected keys go, whatever put them
    there. A second pass changes nothing more where replacements do not feed
    each other.
    """
    one = lambda d, k, n: d.groupBy(F.col(k).alias(f"_{n}k")).agg(F.max("value").alias(f"_{n}"))
    own = key_variants.groupBy(F.col("key").alias("_wk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "old", "new"))), lambda x: F.struct(x["old"], x["new"])).alias("_w"))  # a key's wordings
    rows = store.select("key", F.col("value").alias("_was")).join(sources.select("key", "source"), "key", "full_outer")
    rows = rows.join(one(by_key, "key", "k"), F.col("key") == F.col("_kk"), "left").join(one(by_source, "source", "s"), F.col("source") == F.col("_sk"), "left").join(own, F.col("key") == F.col("_wk"), "left")
    made = X.first_template(F.col("source"), patterns) if patterns else F.lit(None).cast("string")
    rows = rows.withColumn("_p", made)
    given = F.coalesce("_k", "_s", "_p", F.when(F.col("source").isNotNull(), F.col("_was")))
    text = given
    for name, old, new in name_variants:
        text = F.when(F.col("source").contains(name), F.replace(text, F.lit(old), F.lit(new))).otherwise(text)
    text = F.when(F.col("_w").isNull(), text).otherwise(F.aggregate("_w", text, lambda t, w: F.replace(t, w["old"], w["new"])))
    rows = rows.withColumns({"_given": given, "_varied": F.when(F.col("source").isNotNull(), text).otherwise(F.col("_was"))})
    rows = rows.withColumn("value", X.typography(F.col("_varied"))).where("value is not null or _was is not null")
    stage = (
        F.when(protected, "REMOVED")
        .when(F.col("value").eqNullSafe(F.col("_was")), F.lit(None))
        .when(F.col("value") != F.col("_varied"), "TYPOGRAPHY")
        .when(~F.col("_varied").eqNullSafe(F.coalesce("_given", "_was")), "VARIANT")
        .when(F.col("_k").isNotNull(), "KEY")
        .when(F.col("_s").isNotNull(), "SOURCE")
        .otherwise("PATTERN")
    )
    out = rows.withColumn("change", stage).where(~protected | F.col("_was").isNotNull())
    return out.select("key", F.when(~protected, F.col("value")).alias("value"), "change")


def propose(rows: DataFrame, manual: DataFrame, cache: DataFrame, memory: DataFrame) -> DataFrame:
    """``key, value, origin`` for rows ``key, source``: manual by key over cache by source over memory by source; others are left out."""
    one = lambda d, by, n: d.groupBy(F.col(by).alias(f"_{n}k")).agg(F.max("value").alias(f"_{n}"))
    out = rows.join(one(manual, "key", "m"), F.col("key") == F.col("_mk"), "left")
    out = out.join(one(cache, "source", "c"), F.col("source") == F.col("_ck"), "left").join(one(memory, "source", "r"), F.col("source") == F.col("_rk"), "left")
    origin = F.when(F.col("_m").isNotNull(), "manual").when(F.col("_c").isNotNull(), "cache").when(F.col("_r").isNotNull(), "memory")
    return out.select("key", F.coalesce("_m", "_c", "_r").alias("value"), origin.alias("origin")).where("origin is not null")


def propagate(rows: DataFrame, key: str, value: str, rules: list[tuple[str, str]], protected: Column) -> DataFrame:
    """``key, value``: unprotected values that hold any rule's text, with all rules applied literally, the longest first."""
    hit = X.any_of([F.col(value).contains(old) for old, _ in rules])
    text = F.col(value)
    for old, new in sorted(rules, key=lambda r: -len(r[0])):
        text = F.replace(text, F.lit(old), F.lit(new))
    return rows.where(hit & ~protected).select(key, text.alias(value))


# Characters of structure, which no propagated change may hold.
STRUCTURE = re.compile(r"[\[\]{}<>%\\]")


def edit_rules(edits: DataFrame, edit: str, key: str, old: str, new: str) -> DataFrame:
    """``edit, key, was, now``: what each edit (in the order of ``edit``) asks for elsewhere.

    The part that changed, its stem, and the stem's every case, each with its
    new form. Edits of a single letter, to nothing, or of structure ask for nothing.
    """
    kind, key_kind = (edits.schema[c].dataType.simpleString() for c in (edit, key))

    def make(frames):
        for frame in frames:
            out = []
            for e, k, a, b in zip(frame[edit], frame[key], frame[old], frame[new]):
                if not (a or "").strip() or not (b or "").strip() or a == b:
                    continue
                _, _, was, now = span_of_change(a, b)
                if len(was) >= 2 and now and not STRUCTURE.search(was + now):
                    out += [(e, k, x, y) for x, y in inflected_rules(was, now).items()]
            yield pd.DataFrame(out, columns=["edit", "key", "was", "now"])

    return edits.select(edit, key, old, new).mapInPandas(make, f"edit {kind}, key {key_kind}, was string, now string")


def propagate_edits(rows: DataFrame, key: str, value: str, rules: DataFrame, protected: Column) -> DataFrame:
    """``key, value``: unprotected values that the rules of ``edit_rules`` change, with all of them applied.

    Edits apply one after another, each with its longest rules first, and never
    to the key that was edited. The rules are an edit session's, and so a
    broadcast of bounded size (``BLOCK_CHARS`` of text, else an error); values
    are searched for all of them at once by one automaton where they lie.
    """
    listed = rules.select("edit", F.col("key").cast("string").alias("key"), "was", "now").orderBy("edit").toLocalIterator()
    by_edit: dict = {}
    size = 0
    for r in listed:
        by_edit.setdefault((r["edit"], r["key"]), []).append((r["was"], r["now"]))
        size += len(r["was"]) + len(r["now"])
        if size > BLOCK_CHARS:
            raise ValueError("too many rules for one session of edits")
    edits = [(k, sorted(pairs, key=lambda p: (-len(p[0]), p[0]))) for (_, k), pairs in by_edit.items()]
    kind = rows.schema[key].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(edits)

    def apply(frames):
        import ahocorasick

        auto, asked = ahocorasick.Automaton(), {}
        for n, (_, pairs) in enumerate(shared.value):
            for was, _ in pairs:
                asked.setdefault(was, []).append(n)
        for was, numbers in asked.items():
            auto.add_word(was, numbers)
        if asked:
            auto.make_automaton()
        for frame in frames:
            out = []
            for k, text in zip(frame[key], frame[value]):
                now, after = text or "", 0
                while asked:
                    todo = [n for _, numbers in auto.iter(now) for n in numbers if n >= after and shared.value[n][0] != str(k)]
                    if not todo:
                        break
                    after = min(todo) + 1
                    for was, new in shared.value[after - 1][1]:
                        now = now.replace(was, new)
                if after:
                    out.append((k, now))
            yield pd.DataFrame(out, columns=[key, value])

    return rows.where(~protected).select(key, value).mapInPandas(apply, f"`{key}` {kind}, `{value}` string")


def one_safe_value(rows: DataFrame, valid) -> DataFrame:
    """``key, value, problem`` for rows ``key, identity, main, source, value`` that share keys.

    Candidates are a key's distinct values, those of main entries first, then by
    identity. A single one is taken. Of several, the first that is valid for
    every source of the key is, if the sources are equal but for case and outer
    blanks. ``valid(source, value)`` is a condition on columns.
    """
    rank = F.struct((~F.col("main")).alias("later"), "identity")
    best = rows.where("value is not null").groupBy("key", "value").agg(F.min(rank).alias("rank"))
    sources = rows.select("key", "source").distinct()
    checked = best.join(sources, "key").groupBy("key", "value").agg(F.min("rank").alias("rank"), F.every(valid(F.col("source"), F.col("value"))).alias("ok"))
    picked = checked.groupBy("key").agg(F.count("*").alias("n"), F.min_by("value", "rank").alias("first"), F.min_by(F.when(F.col("ok"), F.col("value")), F.when(F.col("ok"), F.col("rank"))).alias("safe"))
    folded = rows.groupBy("key").agg(F.count_distinct(F.lower(F.trim("source"))).alias("texts"))
    out = folded.join(picked, "key", "left")
    value = F.when(F.col("n") == 1, F.col("first")).when((F.col("n") > 1) & (F.col("texts") == 1), F.col("safe"))
    problem = F.when(F.col("n").isNull(), "NO_VALUE").when((F.col("n") > 1) & (F.col("texts") > 1), "SOURCES_DIFFER").when(value.isNull(), "NOT_VALID")
    return out.select("key", value.alias("value"), problem.alias("problem"))


def phrase_parts(rows: DataFrame, key: str, value: str, query: list[str], per_word: int = 30) -> DataFrame:
    """Rows whose whole value is one of the query's words, where every distinct word has one and there are two or more; at most ``per_word`` keys a word."""
    words = sorted(set(query))
    spark = rows.sparkSession
    asked = spark.createDataFrame([(w,) for w in words], "word string")
    hits = rows.select(F.col(key).alias("key"), F.lower(F.trim(value)).alias("word")).join(F.broadcast(asked), "word")
    found = first_members(hits, ["word"], "key", per_word, "keys").select("word", F.explode("keys").alias("key"))
    gate = found.agg((F.count_distinct("word") == len(words)) & (F.count("*") >= 2)).first()[0]
    return found if gate else found.where("false")
