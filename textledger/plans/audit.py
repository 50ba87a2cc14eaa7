"""The audit: categories of keys, a status and a reason for every row, terms that must be used, gates and reports' order.

Rule tables are data: order is priority, and every engine here is one CASE
expression that Catalyst compiles, whatever the number of rules.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.numbers import percentages
from ..functions.rowwise import of_two
from ..operators.stats import first_members
from . import names
from .rules import Rule, condition

_WORD = re.compile(r"[^\W\d_]+")
#: Words may hold apostrophes and hyphens.
_JOINED = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def classify(key: Column, prefixes: list[tuple[str, str]], patterns: list[tuple[str, str]], default: str) -> Column:
    """The category of the first prefix that a key begins with, else of the first pattern it matches, else the default."""
    out = F.lit(default)
    for pattern, category in reversed(patterns):
        out = F.when(key.rlike(pattern), category).otherwise(out)
    for prefix, category in reversed(prefixes):
        out = F.when(key.startswith(prefix), category).otherwise(out)
    return out


def analyze(rules: list[Rule], key: Column, source: Column, target: Column, done: str = "DONE") -> Column:
    """``{status, reason, issue}`` of the first rule that fires; a row that none finds fault with is ``done``.

    A rule's severity says whether its status is an issue: ``OK`` ones are not.
    """
    out = F.struct(F.lit(done).alias("status"), F.lit("").alias("reason"), F.lit(False).alias("issue"))
    for r in reversed(rules):
        hit = F.struct(F.lit(r.code).alias("status"), F.lit(r.reason).alias("reason"), F.lit(r.severity != "OK").alias("issue"))
        out = F.when(condition(r, key, source, target), hit).otherwise(out)
    return out


@dataclass(frozen=True)
class Gate:
    """Limits and word lists of the quality gate (Q1) and of the gate for generated values (Q5)."""

    residue: tuple[str, ...] = ()
    bad_pairs: tuple[tuple[str, str], ...] = ()
    repeats: int = 4
    exempt: tuple[str, ...] = ()
    least_words: float = 0.35
    artifacts: str = r"<think>|</think>|(?i)^(?:translation|output)\s*:"
    extra: tuple[Rule, ...] = field(default=())


def repeated_word(source: Column, target: Column, times: int, exempt: tuple[str, ...] = ()) -> Column:
    """The first word that the target has ``times`` times or more, and more often than the source, or null. Every text's words are counted once."""

    def find(s: str, t: str) -> str | None:
        theirs = Counter(_WORD.findall(t.lower()))
        often = [w for w, n in theirs.items() if n >= times and w not in exempt]
        ours = Counter(_WORD.findall(s.lower())) if often else {}
        return next((w for w in often if theirs[w] > ours.get(w, 0)), None)

    return of_two(find, StringType())(source, target)


def gate_problem(gate: Gate, source: Column, target: Column) -> Column:
    """The first problem of a pair, or null: empty, a repeated word, a copy of two words or more, a residue word, a bad pair."""
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"\p{L}+"), F.lit(0))
    residue = F.array(*map(F.lit, gate.residue)).cast("array<string>")
    checks = [
        F.when(F.trim(F.coalesce(target, F.lit(""))) == "", "EMPTY"),
        F.when(repeated_word(source, target, gate.repeats, gate.exempt).isNotNull(), "REPEATED_WORD"),
        F.when((source == target) & (F.size(words(source)) >= 2), "COPY"),
        F.when(F.arrays_overlap(words(target), residue), "RESIDUE"),
        *[F.when(source.rlike(a) & target.rlike(b), "BAD_PAIR") for a, b in gate.bad_pairs],
    ]
    return F.coalesce(*checks)


def generated_problem(gate: Gate, source: Column, target: Column, same_form: Column) -> Column:
    """Why a generated value is not accepted, or null: empty, model artifacts, form, percentages, too short, or a gate problem."""
    count = lambda t: F.regexp_count(t, F.lit(r"\p{L}+"))
    return F.coalesce(
        F.when(F.trim(F.coalesce(target, F.lit(""))) == "", "EMPTY"),
        F.when(target.rlike(gate.artifacts), "ARTIFACT"),
        F.when(~same_form, "FORM"),
        F.when(percentages(source) != percentages(target), "PERCENTAGE"),
        F.when((count(source) >= 8) & (count(target) < F.ceil(count(source) * gate.least_words)), "SHORT"),
        gate_problem(gate, source, target),
    )


def terms_problem(rows: DataFrame, key: str, source: str, target: str, terms: DataFrame, stem: int = 4) -> DataFrame:
    """``key, term, expected`` of the longest term (``term, value``) in each source whose value is not in the target.

    Terms are words or phrases of words, found where the texts lie by walking a
    trie of the terms' words (see ``names``); texts are neither copied nor
    shuffled, whatever the number of terms. A value counts as used where the
    target has a word that begins like each of its words: with the whole word,
    or but for its last letters, of which ``stem`` at least must stay.
    """
    words = lambda t: _JOINED.findall(t.lower())
    listed = terms.select(F.lower("value").alias("value"), F.struct("value").alias("as"), F.lower("term").alias("term")).select("value", F.col("as.value").alias("spelt"), "term")
    known = names.name_blocks(listed, "spelt", "term")
    kind = rows.schema[key].dataType.simpleString()
    found = names.passed(rows.select(key, source, target), [key, target], source, known, _term_trie, lambda t, trie: _terms_in(words(t), trie), None, "map<string,array<string>>")
    if found is None:
        return rows.sparkSession.createDataFrame([], f"key {kind}, term string, expected string")

    def judge(t: str, hits: dict) -> list[tuple[str, str]]:
        if not hits:
            return []
        term, value = max(((term, v) for term, values in hits.items() for v in values), key=lambda x: (len(x[0]), x[0], x[1]))
        begins = {w[:n] for w in words(t) for n in range(1, len(w) + 1)}
        used = all(v in begins or (len(v) > stem and v[: max(stem, len(v) - 2)] in begins) for v in words(value))
        return [] if used else [(term, value)]

    lost = of_two(judge, "array<struct<term:string,expected:string>>")(target, "found")
    return found.select(F.col(key).alias("key"), F.explode(lost).alias("r")).select("key", "r.*")


def _term_trie(block: list[tuple]) -> dict:
    root: dict = {}
    for value, term in block:
        node = root
        for word in _JOINED.findall(term):
            node = node.setdefault(word, {})
        if node is not root:
            node.setdefault(None, []).append(value)
    return root


def _terms_in(words: list[str], trie: dict) -> dict[str, list[str]]:
    """All terms that stand in a text, each with its values."""
    out = {}
    for i in range(len(words)):
        node, j = trie.get(words[i]), i + 1
        while node is not None:
            if None in node:
                out[" ".join(words[i:j])] = node[None]
            node, j = (node.get(words[j]) if j < len(words) else None), j + 1
    return out


def by_severity(findings: DataFrame, order: list[str]) -> DataFrame:
    """Findings with ``rank``, sorted by severity as listed, then code, then key."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("severity")), F.lit(0))
    return findings.withColumn("rank", F.when(rank == 0, len(order) + 1).otherwise(rank)).orderBy("rank", "code", "key")


def first_k(rows: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """``group, n, first``: how many distinct items a group has, and its first ``k`` in order."""
    counts = rows.groupBy(group).agg(F.count_distinct(item).alias("n"))
    return counts.join(first_members(rows, [group], item, k), group, "left")


def residue_histogram(rows: DataFrame, reason: str, pattern: str) -> DataFrame:
    """``token, n``: what the reasons name (the pattern's first group), most frequent first."""
    token = F.regexp_extract(reason, pattern, 1)
    return rows.select(token.alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token")


def progress(rows: DataFrame, source: str, target: str, excluded: Column, form: Column) -> DataFrame:
    """One row of counts, each row counted once: excluded, missing, same, broken, translated."""
    t = F.trim(F.coalesce(F.col(target), F.lit("")))
    kind = F.when(excluded, "excluded").when(t == "", "missing").when(F.col(source) == F.col(target), "same").when(~form, "broken").otherwise("translated")
    return rows.select(kind.alias("kind")).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("excluded", "missing", "same", "broken", "translated")])


def release_problems(row: DataFrame, tag: str) -> DataFrame:
    """``file, problem`` for each thing wrong with a release's manifest row (all are found, not only the first).

    Columns: ``file, size, sha256, actual_size, actual_sha256, game_version, patch_version``.
    """
    checks = [
        F.when(F.col("file").isNull() | (F.trim("file") == ""), "NO_FILE"),
        F.when(~F.coalesce(F.col("sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "BAD_HASH"),
        F.when(F.lower("sha256") != F.lower("actual_sha256"), "HASH_DIFFERS"),
        F.when(F.col("size") != F.col("actual_size"), "SIZE_DIFFERS"),
        F.when(~F.coalesce(F.col("game_version").rlike(GAME_VERSION), F.lit(False)), "BAD_VERSION"),
        F.when(F.concat(F.lit("v"), F.col("patch_version")) != tag, "TAG_DIFFERS"),
    ]
    return row.select("file", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


# The forms of game versions, patch versions and time stamps.
GAME_VERSION = r"^[0-9]+(?:\.[0-9]+){1,10}(?:_[0-9]+(?:\.[0-9]+){1,10})?$"
PATCH_VERSION = r"^[0-9]{4}\.[0-9]{2}\.[0-9]{2}\.(?:0|[1-9][0-9]*)$"
STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})$"


def patch_version(text: Column) -> Column:
    """A patch version as four numbers, or null where its form or its date is wrong."""
    date = F.try_to_date(F.replace(F.substring_index(text, ".", 3), F.lit("."), F.lit("-")), "yyyy-MM-dd")
    return F.when(text.rlike(PATCH_VERSION) & date.isNotNull(), F.transform(F.split(text, r"\."), lambda x: x.cast("int")))


def stamp(text: Column) -> Column:
    """A timestamp whose text has an offset, or null."""
    return F.when(text.rlike(STAMP), F.try_to_timestamp(text))


def response_text(json: Column) -> Column:
    """The translated text of a provider's answer in any of three shapes, or null: an object with a result, a list of parts, a list of candidates.

    Parts of a list are joined; the marks that HTML names are put back.
    """
    parts = F.from_json(F.get_json_object(json, "$[0]"), "array<array<string>>")
    joined = F.when(F.trim(json).startswith("["), F.array_join(F.transform(parts, lambda p: F.coalesce(F.get(p, F.lit(0)), F.lit(""))), ""))
    text = F.coalesce(F.get_json_object(json, "$.responseData.translatedText"), F.get_json_object(json, "$.translations[0].text"), joined)
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return text


def template(fields: dict[str, Column]) -> Column:
    """A body of lines ``Label: `value```."""
    return F.array_join(F.array(*[F.concat(F.lit(f"{label}: `"), value, F.lit("`")) for label, value in fields.items()]), "\n")


def field_of(body: Column, label: str) -> Column:
    """The value of a label's line in such a body, or null."""
    found = F.regexp_extract(body, rf"(?im)^\s*\Q{label}\E\s*:\s*`([^`]+)`\s*$", 1)
    return F.when(found != "", found)


def candidates(requests: DataFrame, prefix: str, repo: str) -> DataFrame:
    """Open requests against main from our branches of the same repository that are no tests and whose body names a version."""
    head = F.lower("head_ref")
    fit = (F.col("state") == "open") & (F.col("base_ref") == "main") & F.col("head_ref").startswith(prefix) & ~head.contains("test") & ~head.contains("fixture") & (F.col("repo") == repo)
    return requests.where(fit).withColumn("version", field_of(F.col("body"), "Game version")).where(F.col("version").isNotNull())


RELEASES = "array<struct<id:bigint,tag_name:string,draft:boolean,prerelease:boolean,assets:array<struct<id:bigint,name:string,size:bigint>>>>"


def releases(lines: DataFrame, json: str) -> DataFrame:
    """Releases of JSON texts that hold a list, or a single object: a row each; texts that are neither give none."""
    text = F.when(F.trim(json).startswith("["), F.col(json)).otherwise(F.concat(F.lit("["), F.col(json), F.lit("]")))
    return lines.select(F.explode(F.from_json(text, RELEASES)).alias("r")).select("r.*").where("id is not null")


def usable_releases(rows: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """Published releases whose tag is a version and that have exactly one of each wanted asset, of at most its size; with ``version``."""
    one = [(F.size(F.filter("assets", lambda a: a["name"] == name)) == 1) & F.forall(F.filter("assets", lambda a: a["name"] == name), lambda a: (a["size"] > 0) & (a["size"] <= most)) for name, most in wanted.items()]
    ok = ~F.col("draft") & ~F.col("prerelease") & F.col("tag_name").startswith("v")
    for test in one:
        ok = ok & test
    return rows.where(ok).withColumn("version", patch_version(F.substring("tag_name", 2, 100))).where("version is not null")
