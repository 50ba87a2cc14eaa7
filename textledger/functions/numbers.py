"""Numbers of texts: read as digits and as words, and compared between a source and its target.

Digits are read by one walk over a text's digit runs: what stands before a run
and behind it says whether it is a clock, a percentage, a count of thousands
or signed. Words are read by a small grammar of units, tens, hundreds and
scales, in both languages. Structural tokens are blanks to both. Null texts
have null results; empty ones have no numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from decimal import Decimal
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql.types import ArrayType, BooleanType, StringType

from .rowwise import of_one, of_two
from .tokens import spans

_RUN = re.compile(r"[0-9]+")
_CLOCK = re.compile(r"([0-9]{1,2})[:]([0-5][0-9])(?![0-9])")
_DOTTED_CLOCK = re.compile(r"([0-9]{1,2})[.]([0-5][0-9])(?![0-9])")
#: Digits with separators; what is a clock behind a separator is left to the next run.
_BODY = re.compile(r"[0-9]+(?:[.,](?![0-9]{1,2}:[0-5][0-9](?![0-9]))[0-9]+)*")
_HOUR = re.compile(r"\bsaat\s+\Z", re.IGNORECASE)
_THOUSANDS = re.compile(r"\s+bin\b", re.IGNORECASE)
_PERCENT_BEHIND = re.compile(r"\s*%")
_GROUPED = re.compile(r"[0-9]{1,3}(?:[.,][0-9]{3})+")


#: Without any of these, a text has no structural tokens.
_MARKS = re.compile(r"[\\<\[{}%]")


def visible(text: str) -> str:
    """The text with structural tokens as blanks of their length."""
    if not _MARKS.search(text):
        return text
    out, at = [], 0
    for a, b, _, _ in spans(text):
        out += [text[at:a], " " * (b - a)]
        at = b
    return "".join([*out, text[at:]])


def _plain(value: Decimal) -> str:
    text = format(value, "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def _spelling(body: str, percent: bool) -> str:
    """Digits in the common spelling: no grouping, a point for decimals, no leading zeros."""
    if not percent and _GROUPED.fullmatch(body):
        body = re.sub("[.,]", "", body)
    body = body.replace(",", ".")
    if body.count(".") > 1:
        return body
    whole, dot, rest = body.partition(".")
    return (whole.lstrip("0") or "0") + dot + rest


def digit_numbers(text: str) -> list[str]:
    """All numbers that a text writes in digits, sorted: ``time:08:00``, ``-4.5``, ``50%``, ``10000``.

    A percent sign may stand before or behind; a plus sign goes, a minus sign
    stays where no word touches it; ``2,5 bin`` is 2500; an x before a number
    says nothing; digits in a word are none.
    """
    text = visible(text)
    out, read = [], 0  # what lies before ``read`` is said
    clock_before = False
    for run in _RUN.finditer(text):
        a = run.start()
        if a < read:
            continue
        fresh = text[read:a]
        lead = (" " if clock_before else text[read - 1 : read]) + fresh
        clock = _CLOCK.match(text, a) or (_HOUR.search(text, read, a) and _DOTTED_CLOCK.match(text, a))
        clock_before = bool(clock)
        if clock:
            out.append(f"time:{int(clock[1]):02d}:{clock[2]}")
            read = clock.end()
            continue
        if lead[-1:] in ("x", "X") and not _touches(lead[-2:-1]):
            lead = lead[:-1]
        percent = fresh.rstrip().endswith("%")
        if not percent and (_touches(lead[-1:]) or lead[-1:] == "%"):
            read = run.end()
            continue
        near = lead.rstrip()[:-1] if percent else lead
        minus = near[-1:] == "-" and (percent or not (_touches(near[-2:-1]) or near[-2:-1] == "%"))
        body = _BODY.match(text, a)
        value, read = body[0], body.end()
        thousand = _THOUSANDS.match(text, read)
        if thousand and len(re.findall("[.,]", value)) < 2:
            value, minus, read = _plain(Decimal(value.replace(",", ".")) * 1000), minus and percent, thousand.end()
        behind = None if percent else _PERCENT_BEHIND.match(text, read)
        if behind:
            percent, read = True, behind.end()
        out.append(("-" if minus else "") + _spelling(value, percent) + ("%" if percent else ""))
    return sorted(out)


def _touches(char: str) -> bool:
    return char.isalnum() or char == "_"


# The words of numbers. Ordinals and single words for one stand for their number too.
UNITS, TENS, SCALES = "unit", "ten", "scale"
WORDS = {
    "en": {
        UNITS: "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(),
        TENS: ". twenty thirty forty fifty sixty seventy eighty ninety".split(),
        SCALES: {"hundred": 100, "thousand": 1000, "million": 1000000},
        "also": {"single": 1, "first": 1, "second": 2, "third": 3, "fifth": 5, "eighth": 8, "ninth": 9, "twelfth": 12, "twelvians": 12, "twelvian": 12},
        "ordinal": r"(?:th|ieth)\Z",
        "join": {"and"},
        "half": ("and", "a", "half"),
    },
    "tr": {
        UNITS: "bir iki üç dört beş altı yedi sekiz dokuz".split(),
        TENS: "on yirmi otuz kırk elli altmış yetmiş seksen doksan".split(),
        SCALES: {"yüz": 100, "bin": 1000, "milyon": 1000000},
        "also": {"ilk": 1, "tek": 1},
        "ordinal": r"(?:(?:[ıiuü]?nc[ıiuü])|d[ıiuü]r|t[ıiuü]r|l[ae]r)\Z",
        "join": set(),
        "half": ("buçuk",),
    },
}
_LETTERS = re.compile(r"[^\W\d_]+|[^\s-]")


def _lexicon(language: str) -> dict[str, tuple[str, int]]:
    w = WORDS[language]
    known = {x: (UNITS, i + 1) for i, x in enumerate(w[UNITS])} | {x: (TENS, 10 * (i + 1)) for i, x in enumerate(w[TENS])}
    return known | {x: (SCALES, n) for x, n in w[SCALES].items()} | {x: (UNITS, n) for x, n in w["also"].items()}


_LEXICONS = {x: _lexicon(x) for x in WORDS}
_ONE_OF = re.compile(r"\b(?:a|an)\s+(?:level|turn|mp|ap|wp)\b", re.IGNORECASE)


@lru_cache(1 << 16)
def _meaning(word: str, language: str) -> tuple[str, int, bool] | None:
    """Kind and value of a number word, and whether a number ends with it (ordinals and suffixed words)."""
    known = _LEXICONS[language]
    if word in known:
        return *known[word], word in WORDS[language]["also"]
    stem = re.sub(WORDS[language]["ordinal"], "", word)
    if stem != word:
        for guess in (stem, stem + "y", {"dörd": "dört"}.get(stem, stem), *([stem + v for v in "ıiüu"] if language == "tr" else [])):
            if guess in known:
                return *known[guess], True
    return None


class _Reading:
    """A number that is being read, word by word."""

    def __init__(self):
        self.closed = self.group = 0
        self.least = 10**9  # below which further parts of the group must lie
        self.scale = 10**12
        self.some = False

    def take(self, kind: str, value: int) -> bool:
        """Whether the word goes on with the number."""
        if kind == SCALES and value > 100:
            if value >= self.scale or (self.some and not self.group):
                return False
            self.closed += (self.group or 1) * value
            self.group, self.least, self.scale = 0, 10**9, value
        elif kind == SCALES:
            if self.group > 9 or (self.some and not self.group and not self.closed):
                return False
            self.group, self.least = (self.group or 1) * 100, 100
        else:
            if value >= self.least:
                return False
            self.group += value
            self.least = 10 if kind == TENS and value >= 10 else 1
        self.some = True
        return True

    @property
    def value(self) -> int:
        return self.closed + self.group


def word_numbers(text: str, language: str) -> list[str]:
    """The numbers that a text spells as words, in digits, in text order: ``twenty-four``, ``one hundred and twenty``, ``yüz yirmi``, ``on iki bin``, ordinals, ``twelve and a half``."""
    w = WORDS[language]
    fold = str.lower if language == "en" else lambda t: t.replace("İ", "i").replace("I", "ı").lower()
    text = visible(text)
    words = [x.strip() for x in _LETTERS.findall(fold(text))]
    out, now, i = [], _Reading(), 0

    def close():
        nonlocal now
        if now.some:
            out.append(str(now.value))
        now = _Reading()

    while i < len(words):
        found = _meaning(words[i], language)
        half = w["half"]
        if now.some and tuple(words[i : i + len(half)]) == half:
            out.append(f"{now.value}.5")
            now, i = _Reading(), i + len(half)
            continue
        if found is None:
            joined = now.some and words[i] in w["join"] and now.least != 1 and i + 1 < len(words) and _meaning(words[i + 1], language)
            if not (joined and (now.group % 100 == 0)):
                close()
        else:
            if not now.take(*found[:2]):
                close()
                now.take(*found[:2])
            if found[2]:
                close()
        i += 1
    close()
    if language == "en":
        out += ["1"] * len(_ONE_OF.findall(text))
    return out


# Verbs and words that say in the target what a minus sign says in the source, and a rate per one per cent.
LESS = re.compile(r"\b(?:azal\w*|kayb\w*|kaybet\w*|düş\w*|kaldır\w*|indir\w*|eksi|negatif)\b", re.IGNORECASE)
PER_PERCENT = re.compile(r"\b(?:per|each|for each)\s+%", re.IGNORECASE)


def agree(source: str, target: str, languages: tuple[str, str] = ("en", "tr")) -> bool:
    """Whether both texts say the same numbers, as digits or otherwise.

    A number that one side alone has in digits is accounted for by the other's
    words, a minus sign by a verb of loss, one per cent by *per %*, and a
    missing percent sign where both sides speak of per cents.
    """
    found = digit_numbers(source), digit_numbers(target)
    if found[0] == found[1]:
        return True
    lost, new = map(Counter, found)
    lost, new = lost - new, new - lost
    shown = visible(source), visible(target)
    same: list[tuple[str, str]] = []  # a lost number, and the new one that stands for it
    if LESS.search(shown[1]):
        same += [(x, x[1:]) for x in lost if x.startswith("-")]
    if "%" in shown[0] and "%" in shown[1]:
        same += [(x, x + "%") for x in lost if x[0] not in "+-" and not x.endswith("%")]
    if PER_PERCENT.search(shown[0]):
        said = next((x for x in ("1%", "1") if new[x]), None)
        new -= Counter([said] if said else [])
    for gone, come in same:
        n = min(lost[gone], new[come])
        lost, new = lost - Counter({gone: n}), new - Counter({come: n})
    lost -= Counter(word_numbers(target, languages[1]))
    new -= Counter(word_numbers(source, languages[0]))
    return not lost and not new


_PERCENT = re.compile(r"(?<![\w#])(?:%\s*([0-9]+(?:[.,][0-9]+)?)|([0-9]+(?:[.,][0-9]+)?)\s*%)")


def percent_values(text: str) -> list[str]:
    """The numbers with a percent sign before or behind them, decimals with a point, sorted as text."""
    return sorted((a or b).replace(",", ".") for a, b in _PERCENT.findall(text))


#: ``visible`` of a column: places in the text stay.
visible_text = of_one(visible, StringType())
numeric_signature = of_one(digit_numbers, ArrayType(StringType()))
percentages = of_one(percent_values, ArrayType(StringType()))


def spelt_numbers(text: Column, language: str) -> Column:
    """``word_numbers`` of a column."""
    return of_one(lambda t: word_numbers(t, language), ArrayType(StringType()))(text)


#: ``agree`` of two columns; null where either is.
numbers_explained = of_two(agree, BooleanType())
