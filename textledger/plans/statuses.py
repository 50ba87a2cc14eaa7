"""The desktop analysis of a value as a rule table: a status, a reason and whether it is an issue.

The rules below are rows of the table that ``ruletable`` compiles, in order of
priority; a caller adds rows of its own (as reviewed keys) by priority. What
patterns cannot say is a named test, worked out as a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tokens as T
from . import ruletable

# Statuses, and what a source and a target show (Python patterns; None: anything) where a known mistake was made.
POINTS = (
    r"(?i)(?:action|skill|specialty|experience|movement|mastery|agility|ability|aptitude|characteristic|conquest|score|citizenship|health|life)\s+points?"
    r"|\bpoints?\s+(?:to distribute|available|remaining|earned|gained|lost|spent|bonus|penalty)"
)
CHESTS = (
    r"(?i)\b(?:account|guild|house|manor|treasure|golden|large|big|hidden|locked|mystery|reward|vault)\s+chests?\b"
    r"|\bchests?\s+(?:locked|room|contains?|contents?|capacity|slots?|rewards?|is\s+(?:empty|open|closed|locked))\b"
    r"|\b(?:open|unlock|find|search|access|examine|interact\s+with|remove\s+.+?\s+from|deposit\s+.+?\s+in|take\s+.+?\s+from|get\s+.+?\s+from)\s+(?:the\s+|a\s+)?chests?\b"
)
MISTAKES = (
    ("YANLIS_TERIM", "points are puan", POINTS, r"(?i)\b(?:nokta\w*|skor\w*)\b"),
    ("YAZIM_ANLAM_SUPHESI", "no plural after a number", None, r"(?i)(?:\[#\d+\]|\b\d+)\s+puanlar\b"),
    ("YANLIS_TERIM", "a penalty is ceza", None, r"(?i)\bpenaltiler\b"),
    ("YAZIM_ANLAM_SUPHESI", "a broken word for monster", None, r"(?i)\b(?:monstrolar?|monstre|monsta)\b"),
    ("YAZIM_ANLAM_SUPHESI", "a turn is tur", r"(?i)\bturn\b", r"(?i)\bdönüş\s+(?:başına|sonunda|başlangıcında)\b"),
    ("YANLIS_TERIM", "a spell is no syllable", r"(?i)\bspells?\b", r"(?i)\b(?:heceler?|yazılımlar?)\b"),
    ("YANLIS_TERIM", "the mount is no turkey", r"(?i)\bdragoturkey\b", r"(?i)dragotürkiye|drag\s+turk\w*|drag\s+turkey|dragot(?:uck|uğ|uş)\w*|sürükleyici\s+hindi|atlı\s+hindi|\bhindi(?:'|y|n|ler|nin|yi|ye)"),
    ("YANLIS_TERIM", "defeat is an order", r"(?i)(?:^|\\n)\s*-?\s*Defeat\s+[^-\s]", r"(?i)(?:^|\\n)\s*-?\s*Yenilgi\s+"),
    ("YAZIM_ANLAM_SUPHESI", "the verb of kill stands last", r"(?i)^\s*Kill\s+[^,!]", r"(?i)^\s*Öldür\s+"),
    ("YAZIM_ANLAM_SUPHESI", "get without what", r"(?i)^\s*(?:Get|Take)\b", r"(?i)^\s*Al şunu\."),
    ("INGILIZCE_KALINTISI", "an article left", None, r"(?i)\b(?:bir|için)\s+a\b"),
    ("YAZIM_ANLAM_SUPHESI", "a conjunction glued on", None, r"(?i)\b(?:Experienceve|Hasarve|Eşyalar?ve|puanve|seviyeve)\b"),
    ("YANLIS_TERIM", "a chest is sandık", CHESTS, r"(?i)\bgöğs"),
    ("YANLIS_TERIM", "a rune is rün", r"(?i)\brunes?\b", r"(?i)yazılım"),
)
ENCODING = "Ã|Ä|Å|â€|�"
SUSPICIOUS = (
    "yanlız herşey birşey hiçbirşey şuan orjinal değilmi yalnış kilitedeki onaylıyormusunuz dağıttiniz güvenlikler satırsınız".split()
    + ["yeterince iyileştim", "kullanıcı adınız", "satın alma fırsatı", "sıfırsa sahip", "zerosa sahip", "görüşüm açıldı", "pencerem ekleyemezsiniz", "pencerem kayıt", "emin misiniz ki"]
    + ["pazar yeri'de", "pazar yeri’de", "savaş alanı katıl", "yapı et"]
)
SUSPICIOUS_FORM = r"(?i)\bne oldu\d+\b|\b[^\W\d_]+(?:y?[ıiuü])\s+sahip\b"
COMMENTARY = r"(?i)^\s*(translation|turkish|türkçe|çeviri|here is|işte)\s*:"
LEFT = (
    "the and you your with from into must cannot available unavailable default damage mastery characteristics recommended rarity pockets page click level search current challenge item items "
    "build resistance earth water fire air exact ones following remove purchase sale window offer remaining team are is was were has have reach access juice"
).split()
TECHNICAL = r"^[A-Z0-9_.+/% -]{1,12}$"
LINK = r"^(https?://|www\.)"
HIDDEN = r"\{[^{}]*\}|\[[^\]]*\]|<[^>]*>|\\[ntr]"


def desktop_rules(spark: SparkSession) -> DataFrame:
    """The table: priorities are tens, so that rows may come between."""
    rows: list[dict] = [
        {"code": "BOZUK_KODLAMA", "reason": "a question mark before a suffix", "tests": ["question_suffix"]},
        {"code": "BOZUK_NOKTALAMA", "reason": "a question mark within a word", "tests": ["question_inside"]},
    ]
    known = [{"code": code, "reason": reason, "source": source, "target": target} for code, reason, source, target in MISTAKES]
    rows += known[:6]
    rows.append({"code": "INGILIZCE_KALINTISI", "reason": "harvest left", "target": r"(?i)\bharvest\w*\b", "tests": ["differs"]})
    rows += known[6:]
    rows += [
        {"code": "KORUNAN_AD", "reason": "a protected name", "tests": ["protected"]},
        {"code": "TEKNIK_KORUNAN", "reason": "nothing to translate", "tests": ["empty", "technical_source"]},
        {"code": "EKSIK", "reason": "no value", "tests": ["empty"]},
        {"code": "TEKNIK_KORUNAN", "reason": "nothing to translate", "tests": ["technical"]},
        {"code": "BICIM_HATASI", "reason": "tokens differ", "tests": ["form_differs"]},
        {"code": "INGILIZCE_KALDI", "reason": "as the source", "tests": ["copy"]},
        {"code": "EKSIK_CUMLE", "reason": "far too short", "tests": ["incomplete"]},
        {"code": "KODLAMA_HATASI", "reason": "broken characters", "target": ENCODING},
        {"code": "YAZIM_ANLAM_SUPHESI", "reason": "a suspicious phrase", "target_words": SUSPICIOUS},
        {"code": "YAZIM_ANLAM_SUPHESI", "reason": "a suspicious form", "target": SUSPICIOUS_FORM},
        {"code": "MODEL_ACIKLAMASI", "reason": "a comment of the model's", "target": COMMENTARY},
        {"code": "INGILIZCE_KALINTISI", "reason": "source words left", "tests": ["left"]},
    ]
    kept = {"KORUNAN_AD", "TEKNIK_KORUNAN"}
    full = [{"priority": 10 * (i + 1), "severity": "OK" if r["code"] in kept else "ERROR"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame(full, ruletable.RULES)


def desktop_tests(source: Column, target: Column, protected: Column) -> dict[str, Column]:
    """What the table's named tests are. Words left are looked for where tokens are out of sight."""
    s, t = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    unlinked = F.regexp_replace(t, r"https?://\S+", " ")
    seen, shown = F.trim(F.regexp_replace(s, HIDDEN, " ")), F.regexp_replace(t, HIDDEN, " ")
    letters = lambda x: F.regexp_count(x, F.lit(r"\p{L}"))
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    heavy = X.gibberish(s)
    words = "|".join(LEFT)
    return {
        "question_suffix": unlinked.rlike(r"\p{L}\?'[a-zçğıöşüA-ZÇĞİÖŞÜ]"),
        "question_inside": unlinked.rlike(r"\p{L}\?\p{L}"),
        "differs": strip(t) != strip(s),
        "protected": protected,
        "empty": strip(t) == "",
        "technical_source": s.rlike(LINK) | (letters(s) == 0) | heavy | s.rlike(TECHNICAL),
        "technical": (letters(seen) == 0) | seen.rlike(TECHNICAL) | seen.rlike(LINK),
        "form_differs": ~T.format_ok(s, t, "strict"),
        "copy": (strip(t) == strip(s)) & ~s.rlike(TECHNICAL) & (letters(seen) > 0),
        "incomplete": ~X.complete(F.regexp_replace(s, HIDDEN, " "), shown),
        "left": shown.rlike(rf"(?iU)\b(?:{words}|key(?!-keeper))\b"),
    }


def desktop_analysis(rows: DataFrame, key: str, source: str, target: str, protected: Column, more: DataFrame | None = None) -> DataFrame:
    """``key, status, reason, issue`` of every row; ``more`` are rules of the caller's. A row that no rule finds fault with is ``CEVRILDI``."""
    rules = desktop_rules(rows.sparkSession)
    rules = rules if more is None else rules.unionByName(more, allowMissingColumns=True)
    found = ruletable.audited(rows, rules, key, source, target, desktop_tests(F.col(source), F.col(target), protected), first=True)
    hit = F.get("found", F.lit(0))
    return found.select(key, F.coalesce(hit["code"], F.lit("CEVRILDI")).alias("status"), F.coalesce(hit["reason"], F.lit("")).alias("reason"), F.coalesce(hit["severity"] != "OK", F.lit(False)).alias("issue"))
