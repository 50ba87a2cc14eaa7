"""Gates: the first reason to turn a value down, out of a list of checks in order of priority.

A check is a code and a test of a ``Pair``, which reads and counts a source and
its target once, however many checks ask for the same of them. A gate is a
list of checks, so one can be made of others. Null texts are empty ones.
Words are read by ``folded``, or by ``lowered`` where SQL is to see the same.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property
from unicodedata import normalize

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.numbers import percent_values, visible

# Fixed values of the quality gate: words of the source language that are no words of the target's, words that may be repeated, and how often others may.
RESIDUE = frozenset(
    "age archmonster active ascending available bridge building cap cell center celestial crate damage dead descending disabled enabled entity environmental extreme family "
    "harvest inflicted interact invalid island ivory least limit living max maximum minimum monster most newest no oldest occupied paddock peddock place poster prairie "
    "prairies quarter quartermaster quest ranching reconstruction removal rewards score season sector starfish stool yes vomit".split()
)
COMMON = frozenset("ama bu da de için ile mi mı mu mü ve bir şu".split())
REPEATS = 4
# Fixed values of the acceptance gate: what a source and its target show when a known mistake was made ("" fits any source).
MISTAKES = {
    "SPELL_AS_SYLLABLE": (r"(?i)\bspells?\b", r"(?i)\b(?:heceler?|yazılımlar?)\b"),
    "MONSTER_TERM": ("", r"(?i)\b(?:monstrolar?|monstre|monsta)\b"),
    "TURN_AS_RETURN": (r"(?i)\bturn\b", r"(?i)\bdönüş\s+(?:başına|sonunda|başlangıcında)\b"),
}
COMMENTARY = re.compile(r"\s*(translation|turkish|türkçe|çeviri|here is|işte)\s*:", re.IGNORECASE)
BROKEN = re.compile("ÃƒÆ’|Ãƒâ€|Ãƒâ€¦|Ã¢â‚¬|ï¿½")
PLACEHOLDER = re.compile("ZXQ|XQ|QXZ")
CASE_BEFORE_OWNER = re.compile(r"\b[A-Za-zÇĞİÖŞÜçğıöşü]+(?:y?[ıiuü])\s+sahip\b", re.IGNORECASE)
SHORT_WORDS, LEAST_WORDS, SHORT_CHARS, LEAST_CHARS = 8, 0.35, 45, 0.30
# Phrases that only a machine writes, words that must not be left in a target, and words that both languages share (names of games and places are the caller's).
MACHINE_PHRASES = (
    "kullanıcı adınız", "yeterince iyileştim", "satın alma fırsatı", "sıfırsa sahip", "zerosa sahip", "görüşüm açıldı", "pencerem ekleyemezsiniz", "pencerem kayıt", "kilitedeki",
    "onaylıyormusunuz", "dağıttiniz", "güvenlikler", "emin misiniz ki", "pazar yeri'de", "pazar yeri’de", "savaş alanı katıl", "satırsınız", "yapı et",
)
LEFTOVERS = (
    "the and you your with from into must cannot available unavailable a an of to for on at as it its be been being by this that these those which who whom what when where why how "
    "not can could would should may all any each every some more less than then only also just now new make makes made reduce reduced received given use used using default damage "
    "mastery characteristics recommended rarity pockets page click level choose select inventory market reward quest search current challenge item items build resistance earth water "
    "fire air exact ones following remove purchase sale window offer remaining team are is was were has have hidden color spell spells active open chest ranking rank close cancel "
    "confirm yes no name description price quantity equipment achievement achievements fight turn round target range cost health armor critical penalty locked unlocked copy paste "
    "delete edit save load next previous back"
).split()
SHARED = frozenset("bonus normal portal festival video internet arena robot radar test risk plan mode pixel server forum menu status premium kama kamas".split())

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_LATIN = re.compile("[A-Za-z]+")


def folded(text: str) -> str:
    """What is seen of a text, its letters told apart by neither case nor form: ``ß`` is ``ss``."""
    return normalize("NFKC", visible(text)).replace("’", "'").casefold()


def lowered(text: str) -> str:
    """The text as SQL's ``lower`` has it, letter by letter: ``ß`` stays, ``İ`` is ``i``. Numerals as ``²`` are blanks, for they are no letters."""
    text = text.replace("İ", "i").replace("Σ", "σ").lower()
    if not text.isascii():
        for c in set(text):
            if c.isnumeric() and not (c.isalpha() or c.isdecimal()):
                text = text.replace(c, " ")
    return text


class Pair:
    """A source and its target, each thing about them worked out at most once. ``read`` gives what their words are taken from."""

    def __init__(self, source: str | None, target: str | None, names: re.Pattern | None = None, read: Callable[[str], str] = folded):
        self.source, self.target, self.names, self.read = source or "", target or "", names, read

    shown = cached_property(lambda self: (self.read(self.source), self.read(self.target)))
    words = cached_property(lambda self: tuple(map(_WORD.findall, self.shown)))
    counts = cached_property(lambda self: tuple(map(Counter, self.words)))
    letters = cached_property(lambda self: tuple(len(re.findall(r"[A-Za-zÇĞİÖŞÜçğıöşüÀ-ž']+", t)) for t in (self.source, self.target)))
    unnamed = cached_property(lambda self: self.names.sub(" ", self.target) if self.names else self.target)


@dataclass(frozen=True)
class Check:
    """``test`` gives a detail (as the word that is wrong) or true where the value is to be turned down."""

    code: str
    test: Callable[[Pair], str | bool | None]


def _repeated(pair: Pair) -> str | None:
    ours, theirs = pair.counts
    return next((w for w, n in theirs.items() if n >= REPEATS and n > ours[w] and w not in COMMON), None)


def _phrases(words: Iterable[str]) -> re.Pattern:
    return re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(words, key=len, reverse=True)))})(?!\w)", re.IGNORECASE)


def _copied(pair: Pair) -> str | None:
    theirs = {w.casefold() for w in _LATIN.findall(pair.unnamed)}
    return next((w for w in _LATIN.findall(pair.source) if len(w) >= 4 and w.casefold() in theirs and w.casefold() not in SHARED), None)


#: The gate for candidates of a release.
QUALITY = (
    Check("EMPTY", lambda p: not p.words[1]),
    Check("REPEATED_WORD", _repeated),
    Check("COPY", lambda p: len(p.words[0]) >= 2 and p.words[0] == p.words[1]),
    Check("RESIDUE", lambda p: next((w for w in p.words[1] if w in RESIDUE), None)),
    Check("STOOL_AS_BATTALION", lambda p: "stool" in p.shown[0] and "tabur" in p.words[1]),
    Check("RANCHED_AS_RUN", lambda p: "ranched" in p.shown[0] and "çalıştır" in p.shown[1]),
    Check("HAVEN_PLACE_LEFT", lambda p: all("haven place" in t for t in p.shown)),
)
_LEFT, _MACHINE = _phrases(LEFTOVERS), _phrases(MACHINE_PHRASES)


def _mistake(code: str) -> Check:
    source, target = map(re.compile, MISTAKES[code])
    return Check(code, lambda p: bool(target.search(p.target) and source.search(p.source)))


#: The gate for what a model wrote.
ACCEPTANCE = (
    *map(_mistake, MISTAKES),
    Check("EMPTY", lambda p: not p.target.strip()),
    Check("DOUBLED_PERCENT", lambda p: "%%" in p.target),
    Check("PERCENTAGE", lambda p: percent_values(p.source) != percent_values(p.target)),
    Check("COPY", lambda p: p.source.strip() == p.target.strip() and bool(re.search("[A-Za-z]{3}", p.source))),
    Check("COMMENTARY", lambda p: bool(COMMENTARY.match(p.target))),
    Check("FEW_WORDS", lambda p: p.letters[0] >= SHORT_WORDS and p.letters[1] < max(2, int(p.letters[0] * LEAST_WORDS))),
    Check("SHORT", lambda p: len(p.source) >= SHORT_CHARS and len(p.target) < int(len(p.source) * LEAST_CHARS)),
    Check("ENCODING", lambda p: bool(BROKEN.search(p.target))),
    Check("PLACEHOLDER", lambda p: bool(PLACEHOLDER.search(p.target))),
    Check("CASE_BEFORE_OWNER", lambda p: bool(CASE_BEFORE_OWNER.search(p.target))),
    Check("MACHINE_PHRASE", lambda p: (m := _MACHINE.search(p.target)) and m[0]),
    Check("LEFTOVER", lambda p: (m := _LEFT.search(p.unnamed)) and m[0]),
    Check("COPIED_WORD", _copied),
)

REASON = StructType().add("code", StringType()).add("detail", StringType())


def first_reason(gate: Iterable[Check], source: Column, target: Column, names: Iterable[str] = (), read: Callable[[str], str] = folded) -> Column:
    """``{code, detail}`` of the first check that turns the value down, else nulls. ``names`` (of three letters or more) are no leftovers; ``read`` as in ``Pair``."""
    checks = tuple(gate)
    listed = sorted((n for n in names if len(n) >= 3), key=len, reverse=True)
    hide = re.compile("|".join(map(re.escape, listed))) if listed else None

    def find(s: str | None, t: str | None) -> tuple[str | None, str | None]:
        pair = Pair(s, t, hide, read)
        hits = ((c.code, x) for c in checks if (x := c.test(pair)))
        code, detail = next(hits, (None, None))
        return code, detail if isinstance(detail, str) else None

    return F.udf(find, REASON, useArrow=False)(source, target)
