"""Audit rules as a table, and an engine whose cost does not grow with each rule.

A rule (a row, see ``RULES``) fires where all it asks for holds: patterns that
the key, source or target must or must not match, lists of words of which the
source or target must hold one (at word borders, ignoring case) or none, and
named tests, which are boolean columns of the caller's. Rules come in order of
``priority``.

The table is compiled once a task: the words of all lists, and for each
pattern the longest literal that any match must hold, go into one automaton
for sources and one for targets. A row is scanned once by each. Rules that ask
for a literal which is not there are not looked at; a pattern that several
rules share is tried once a row. Null texts are empty ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from re import _parser as parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = """priority int, code string, severity string, reason string,
 key string, not_key string, source string, not_source string, target string, not_target string,
 source_words array<string>, not_source_words array<string>, target_words array<string>, not_target_words array<string>, tests array<string>"""
FOUND = "array<struct<code:string,severity:string,reason:string>>"
#: Characters of all words and patterns of a table, at most: it goes with the code.
TABLE_CHARS = 8_000_000
#: A shorter literal tells too little to ask for it first.
LEAST_LITERAL = 3


def required_literal(pattern: str) -> str | None:
    """The longest run of characters, folded, that every match of a pattern holds; None if it is shorter than LEAST_LITERAL."""
    best, run = "", ""

    def walk(items) -> None:
        nonlocal best, run
        for op, what in items:
            name = str(op)
            if name == "LITERAL" and len(chr(what).casefold()) == 1:
                run += chr(what).casefold()
                best = max(best, run, key=len)
            elif name == "SUBPATTERN" and not what[1] & re.VERBOSE:
                walk(what[3])
            elif name != "AT":
                run = ""
                if name in ("MAX_REPEAT", "MIN_REPEAT") and what[0] >= 1:
                    walk(what[2])
                    run = ""

    walk(parser.parse(pattern))
    return best if len(best) >= LEAST_LITERAL else None


def _flat(text: str) -> str:
    """A text in which whatever a pattern may match ignoring case is the same: its dots on and off the letter i go too."""
    return text.casefold().replace("\u0307", "").replace("ı", "i")


class _Literals:
    """Literals that rules ask for, found all at once."""

    def __init__(self):
        self.numbers: dict[str, int] = {}

    def add(self, literal: str) -> int:
        return self.numbers.setdefault(literal, len(self.numbers))

    def build(self) -> None:
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for literal, number in self.numbers.items():
            self.auto.add_word(literal, (len(literal), number))
        if self.numbers:
            self.auto.make_automaton()

    def anywhere(self, text: str) -> set[int]:
        return {number for _, (_, number) in self.auto.iter(text)} if self.numbers else set()

    def at_borders(self, text: str) -> set[int]:
        found: set[int] = set()
        joined = lambda i: 0 < i < len(text) and all(c.isalnum() or c == "_" for c in text[i - 1 : i + 1])
        for end, (n, number) in self.auto.iter(text) if self.numbers else ():
            if number not in found and not joined(end + 1 - n) and not joined(end + 1):
                found.add(number)
        return found


class _Side:
    """What rules ask for in one text: words at word borders, and parts of patterns anywhere."""

    def __init__(self):
        self.words, self.parts = _Literals(), _Literals()

    def found(self, text: str) -> tuple[set[int], set[int]]:
        return self.parts.anywhere(_flat(text)), self.words.at_borders(text.casefold())


class Engine:
    """A compiled rule table."""

    def __init__(self, rules: list[dict]):
        self.rules = sorted(rules, key=lambda r: r["priority"])
        self.sides = {"source": _Side(), "target": _Side()}
        self.regex: dict[tuple[str, str], re.Pattern] = {}
        self.wanted: dict[tuple[str, bool, int], list[int]] = {}  # side, word?, literal: conditions that it satisfies
        self.conditions: list[int] = []  # the rule of each literal condition
        self.needs = [0] * len(self.rules)
        self.always: list[int] = []
        for i, r in enumerate(self.rules):
            for side, table in self.sides.items():
                if r[f"{side}_words"]:
                    self._need(i, side, [table.words.add(w.casefold()) for w in r[f"{side}_words"] if w], True)
                for w in r[f"not_{side}_words"] or []:
                    table.words.add(w.casefold())
                literal = r[side] and required_literal(r[side])
                if literal:
                    self._need(i, side, [table.parts.add(_flat(literal))], False)
            for name in ("key", "source", "target"):
                for field in (name, f"not_{name}"):
                    if r[field]:
                        self.regex[name, r[field]] = re.compile(r[field])
            if not self.needs[i]:
                self.always.append(i)
        for table in self.sides.values():
            table.words.build()
            table.parts.build()

    def _need(self, rule: int, side: str, literals: list[int], word: bool) -> None:
        self.conditions.append(rule)
        self.needs[rule] += 1
        for number in literals:
            self.wanted.setdefault((side, word, number), []).append(len(self.conditions) - 1)

    def fired(self, key: str, source: str, target: str, tests: dict[str, bool]) -> Iterator[dict]:
        """The rules that fire, in order of priority."""
        texts = {"key": key, "source": source, "target": target}
        found = {side: table.found(texts[side]) for side, table in self.sides.items()}
        met: set[int] = set()
        for side, hits in found.items():
            for word, numbers in enumerate(hits):
                for number in numbers:
                    met.update(self.wanted.get((side, bool(word), number), ()))
        left: dict[int, int] = {}
        for condition in met:
            rule = self.conditions[condition]
            left[rule] = left.get(rule, self.needs[rule]) - 1
        tried: dict[tuple[str, str], bool] = {}

        def matches(name: str, pattern: str) -> bool:
            at = (name, pattern)
            if at not in tried:
                tried[at] = bool(self.regex[at].search(texts[name]))
            return tried[at]

        for i in sorted([*self.always, *(i for i, n in left.items() if n == 0)]):
            r = self.rules[i]
            if not all(tests.get(t, False) for t in r["tests"] or []):
                continue
            if any(self.sides[side].words.numbers[w.casefold()] in found[side][1] for side in found for w in r[f"not_{side}_words"] or []):
                continue
            if all((not r[n] or matches(n, r[n])) and not (r[f"not_{n}"] and matches(n, r[f"not_{n}"])) for n in texts):
                yield r


def rule_list(rules: DataFrame) -> list[dict]:
    """The rows of a rule table (missing columns are null), which may have TABLE_CHARS characters at most."""
    names = [c.split()[0] for c in RULES.replace("\n", " ").split(", ")]
    rows = [{n: getattr(r, n, None) for n in names} for r in rules.toLocalIterator()]
    if sum(len(str(v)) for r in rows for v in r.values() if v) > TABLE_CHARS:
        raise ValueError("the rule table is too large to go with the code")
    return rows


def audited(rows: DataFrame, rules: DataFrame, key: str, source: str, target: str, tests: dict[str, Column] | None = None, first: bool = False) -> DataFrame:
    """``key, found``: the rules that fire for each row (``code, severity, reason``), in order, or the first alone."""
    kind = rows.schema[key].dataType.simpleString()
    tests = tests or {}
    named = {f"_t{i}": t for i, t in enumerate(tests)}
    shared = rows.sparkSession.sparkContext.broadcast(rule_list(rules))  # TABLE_CHARS at most

    def judge(frames):
        engine = Engine(shared.value)
        for frame in frames:
            marks = [dict(zip(named.values(), m)) for m in zip(*(frame[c] for c in named))] if named else [{}] * len(frame)
            out = []
            for k, s, t, m in zip(frame["_key"], frame["_source"], frame["_target"], marks):
                hits = islice(engine.fired(k or "", s or "", t or "", m), 1 if first else None)
                out.append([{"code": r["code"], "severity": r["severity"], "reason": r["reason"]} for r in hits])
            yield pd.DataFrame({key: frame[key], "found": out})

    columns = [F.col(key), F.col(key).cast("string").alias("_key"), F.col(source).alias("_source"), F.col(target).alias("_target")]
    asked = rows.select(*columns, *[F.coalesce(tests[t], F.lit(False)).alias(c) for c, t in named.items()])
    return asked.mapInPandas(judge, f"`{key}` {kind}, found {FOUND}")
