"""Text functions as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = r"<[^>]*>"
WORDS = r"\p{L}+"

# Words that tell a source language, tested in this order; Cyrillic letters come before them.
LANGUAGE_WORDS = (
    ("fr", "je|tu|vous|nous|les|des|une|est|sont|pas|pour|avec|dans|sur|que|qui|votre|guilde|quête|joueur|amis|pensez|faire|permet"),
    ("es", "el|la|los|las|una|es|son|para|con|que|por|donde|gracias|amigos"),
    ("de", "der|die|das|und|ist|sind|für|mit|nicht|wo|danke"),
    ("pt", "os|uma|não|para|com|onde|obrigado|amigos"),
)
CYRILLIC = "[А-Яа-я]"

# Hosts of link shorteners and suffixes of binaries.
SHORTENERS = ("bit.ly", "cutt.ly", "goo.gl", "is.gd", "lnkd.in", "ow.ly", "rb.gy", "t.co", "tiny.cc", "tinyurl.com")
BINARY_SUFFIXES = (".7z", ".appimage", ".argosmodel", ".bin", ".com", ".dll", ".dmg", ".exe", ".jar", ".msi", ".pkg", ".rar", ".scr", ".tar", ".tar.gz", ".tgz", ".whl", ".zip")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TAG), F.lit(0))


def visible(text: Column) -> Column:
    """Text with every tag as one space."""
    return F.regexp_replace(text, TAG, " ")


#: Letters that fold to an ASCII one, besides its own capital.
_ALSO = {"k": "\u212a", "s": "ſ"}


def any_case(words_: str) -> str:
    """Lower-case words (alternatives) in either case by Unicode's simple folding: Java's ``(?i)`` knows ASCII only, and with ``u`` takes ``ı`` for ``i``."""
    return re.sub(r"[^\W\d_]", lambda m: f"[{m[0]}{m[0].upper()}{_ALSO.get(m[0], '')}]", words_)


def language_guess(text: Column) -> Column:
    """Russian for a Cyrillic letter, else the first language one of whose words occurs (in any case), else English."""
    out = F.lit("en")
    for lang, words_ in reversed(LANGUAGE_WORDS):
        out = F.when(text.rlike(rf"(^|[^\p{{L}}])({any_case(words_)})([^\p{{L}}]|$)"), lang).otherwise(out)
    return F.when(text.rlike(CYRILLIC), "ru").otherwise(out)


def all_terms(text: Column, terms: list[str]) -> Column:
    """Whether every term occurs, whatever its case; several columns are searched as one text joined by line feeds."""
    return reduce(lambda a, b: a & b, [F.lower(text).contains(t.lower()) for t in terms])


def search_rank(value: Column, query: str) -> Column:
    """0 for an exact match, 1 where it is contained, 2 otherwise."""
    return F.when(value == query, 0).when(value.contains(query), 1).otherwise(2)


def complete(source: Column, target: Column) -> Column:
    """False where a long source has far too short a target (a quarter of 8 or more words, 35 % of 45 or more characters)."""
    sw, tw = F.regexp_count(source, F.lit(WORDS)), F.regexp_count(target, F.lit(WORDS))
    few = (sw >= 8) & (tw < F.ceil(sw * 25 / 100))
    short = (F.length(source) >= 45) & (F.length(target) < F.ceil(F.length(source) * 35 / 100))
    return ~(few | short)


def gibberish(text: Column) -> Column:
    """Long, nearly without letters, and no two ASCII letters in a row."""
    return (F.length(text) >= 12) & (F.regexp_count(text, F.lit(r"\p{L}")) <= 6) & ~text.rlike("[A-Za-z]{2,}")


def slug(text: Column, hashed: int = 0) -> Column:
    """Letters and digits with hyphens between, and ``hashed`` digits of the text's SHA-256 behind it if asked for."""
    plain = F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), F.lit("-"))
    return F.concat(plain, F.lit("-"), F.left(F.sha2(text, 256), F.lit(hashed))) if hashed else plain


def escape_field(text: Column) -> Column:
    """A TSV field: backslash, tab, return and line feed as two characters."""
    for raw, out in (("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        text = F.replace(text, F.lit(raw), F.lit(out))
    return text


def unescape_field(text: Column) -> Column:
    """Undo ``escape_field``: the text is cut at escaped backslashes, so none is read twice."""
    parts = F.transform(F.split(text, r"\\\\"), lambda p: F.replace(F.replace(F.replace(p, F.lit("\\t"), F.lit("\t")), F.lit("\\r"), F.lit("\r")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def cascade(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Literal replacements, longest first (ties in the order given); later rules see what earlier ones wrote."""
    for old, new in sorted(rules, key=lambda r: -len(r[0])):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def url_verdict(host: Column, path: Column, allowed: list[str]) -> Column:
    """``SHORTENER``, ``BINARY`` (a binary suffix, off the allowed hosts and their subdomains) or ``OK``, whatever the case of host and suffix."""
    host, path = F.lower(host), F.lower(path)
    binary = reduce(lambda a, b: a | b, [path.endswith(s) for s in BINARY_SUFFIXES])
    return F.when(host.isin(*SHORTENERS), "SHORTENER").when(binary & ~reduce(lambda a, b: a | b, [(host == h.lower()) | host.endswith("." + h.lower()) for h in allowed]), "BINARY").otherwise("OK")
