"""The rule engine equals trying every rule on every row, and gates find the first reason."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textledger.plans import gates as G
from textledger.plans import ruletable as B

FIELDS = [c.split()[0] for c in B.RULES.replace("\n", " ").split(", ")]
texts = st.text(alphabet="ab İıiß'_-1", max_size=12)
patterns = st.sampled_from([None, "ab", "a+b", "(?i)abi", "(ab|ba)b", "b.a", "(?i)İab", "^a", "iab?", "(?:ab)+i", "[ab]iii"])
words = st.one_of(st.none(), st.lists(st.text(alphabet="abiß", min_size=1, max_size=3), min_size=1, max_size=3))
rules = st.lists(st.fixed_dictionaries({"key": patterns, "not_source": patterns, "source": patterns, "target": patterns, "not_target": patterns, "source_words": words, "not_target_words": words, "target_words": words}), max_size=8)


def whole_words(text, listed):
    low = text.casefold()
    edge = lambda i: not (0 < i < len(low) and all(c.isalnum() or c == "_" for c in low[i - 1 : i + 1]))
    return any(low.startswith(w.casefold(), i) and edge(i) and edge(i + len(w.casefold())) for w in listed for i in range(len(low)))


def plain(rule, key, source, target):
    said = {"key": key, "source": source, "target": target}
    for name, text in said.items():
        if rule.get(name) and not re.search(rule[name], text) or rule.get(f"not_{name}") and re.search(rule[f"not_{name}"], text):
            return False
        if rule.get(f"{name}_words") and not whole_words(text, rule[f"{name}_words"]) or rule.get(f"not_{name}_words") and whole_words(text, rule[f"not_{name}_words"]):
            return False
    return True


@settings(deadline=None, max_examples=300)
@given(rules, texts, texts, texts)
def test_engine_equals_every_rule_tried(found, key, source, target):
    table = [dict.fromkeys(FIELDS) | r | {"priority": -i, "code": str(i)} for i, r in enumerate(found)]
    got = [r["code"] for r in B.Engine(table).fired(key, source, target, {})]
    assert got == [r["code"] for r in reversed(table) if plain(r, key, source, target)]


def test_table_from_rows(spark):
    rules = spark.createDataFrame([(2, "B", "ERROR", "r", ["Sword"], ["same"]), (1, "A", "OK", None, ["iron sword"], None), (3, "C", "ERROR", "", None, ["same"])], "priority int, code string, severity string, reason string, source_words array<string>, tests array<string>")
    rows = spark.createDataFrame([(1, "iron sword", "x"), (2, "swords", "swords"), (3, "SWORD", "sword"), (4, None, None)], "id long, s string, t string")
    same = {"same": F.col("s") == F.col("t")}
    got = {r["id"]: [(f["code"], f["reason"]) for f in r["found"]] for r in B.audited(rows, rules, "id", "s", "t", same).collect()}
    assert got == {1: [("A", None)], 2: [("C", "")], 3: [], 4: []}
    got = {r["id"]: [f["code"] for f in r["found"]] for r in B.audited(rows, rules.where("priority > 1"), "id", "s", "t", {"same": F.lit(True)}, first=True).collect()}
    assert got == {1: ["B"], 2: ["C"], 3: ["B"], 4: ["C"]}
    assert B.audited(rows, rules.limit(0), "id", "s", "t").where("size(found) > 0").count() == 0


@pytest.mark.parametrize(("pattern", "literal"), [(r"(?i)\bDefeat\s+x", "defeat"), ("(the|and)", None), ("a?bcd+", None), ("(?:foo)barx", "foobarx"), ("x{2}yzw", "yzw"), ("^abc|def$", None)])
def test_required_literals(pattern, literal):
    assert B.required_literal(pattern) == literal


def reason(gate, source, target):
    return next(((c.code, x if isinstance(x, str) else None) for c in gate if (x := c.test(G.Pair(source, target)))), None)


@pytest.mark.parametrize(
    ("source", "target", "want"),
    [
        ("Extreme", "Extreme Extreme Extreme Extreme", ("REPEATED_WORD", "extreme")),
        ("a b c", "bu bu bu bu", None),
        ("FPS limit:", "FPS limit:", ("COPY", None)),
        ("FPS", "FPS", None),
        ("stool", "bir tabur", ("STOOL_AS_BATTALION", None)),
        ("ranched", "çalıştırıldı", ("RANCHED_AS_RUN", None)),
        ("my Haven Place x", "Haven Place evim", ("RESIDUE", "place")),
        ("hi", "<b>[#1]</b>", ("EMPTY", None)),
        ("{[~1]?quest:x}", "{[~1]?Quest:y} z", ("RESIDUE", "quest")),
        ("a", None, ("EMPTY", None)),
    ],
)
def test_quality(source, target, want):
    assert reason(G.QUALITY, source, target) == want


@pytest.mark.parametrize(
    ("source", "target", "want"),
    [
        ("Two spells", "İki heceler", ("SPELL_AS_SYLLABLE", None)),
        ("x", "monstre", ("MONSTER_TERM", None)),
        ("each turn", "dönüş başına", ("TURN_AS_RETURN", None)),
        ("x", " ", ("EMPTY", None)),
        ("5%", "5%%", ("DOUBLED_PERCENT", None)),
        ("5%", "%6", ("PERCENTAGE", None)),
        ("abc", "abc ", ("COPY", None)),
        ("abc", "Çeviri: x", ("COMMENTARY", None)),
        ("a b c d e f g h", "bir", ("FEW_WORDS", None)),
        ("a" * 50, "bir", ("SHORT", None)),
        ("abc", "ï¿½", ("ENCODING", None)),
        ("abc", "ZXQ0001QXZ", ("PLACEHOLDER", None)),
        ("abc", "gücü sahip", ("CASE_BEFORE_OWNER", None)),
        ("abc", "bunu yapı et", ("MACHINE_PHRASE", "yapı et")),
        ("abc", "bu The şey", ("LEFTOVER", "The")),
        ("nagged me", "beni nagged", ("COPIED_WORD", "nagged")),
        ("Normal video", "normal video", None),
        ("%5 extra", "5% fazla", None),
    ],
)
def test_acceptance(source, target, want):
    assert reason(G.ACCEPTANCE, source, target) == want


def test_names_are_no_leftovers(spark):
    rows = spark.createDataFrame([("The Lord nagged", "The Lord geldi"), (None, "x")], "a string, b string")
    got = [tuple(r["r"]) for r in rows.select(G.first_reason(G.ACCEPTANCE, F.col("a"), F.col("b"), ["The Lord"]).alias("r")).collect()]
    assert got == [(None, None), (None, None)]


def test_desktop_analysis(spark):
    from textledger.plans import statuses as S

    cases = [
        ("the name", "ad?'ın", "BOZUK_KODLAMA"), ("a b", "ad?ın", "BOZUK_NOKTALAMA"), ("see https://a.b/x?y=1 now", "bak https://a.b/x?y=1 şimdi", "CEVRILDI"),
        ("Action points", "eylem noktası", "YANLIS_TERIM"), ("5 x", "5 puanlar", "YAZIM_ANLAM_SUPHESI"), ("each turn", "dönüş başına", "YAZIM_ANLAM_SUPHESI"),
        ("Dragoturkey", "atlı hindi", "YANLIS_TERIM"), ("Defeat Bob", "Yenilgi Bob", "YANLIS_TERIM"), ("on a thing", "bir a şey", "INGILIZCE_KALINTISI"),
        ("Open the chest", "göğsü aç", "YANLIS_TERIM"), ("Harvest it", "harvest et", "INGILIZCE_KALINTISI"), ("HP +5", "", "TEKNIK_KORUNAN"), ("some words", " ", "EKSIK"),
        ("some words", None, "EKSIK"), ("[#1] {x}", "y", "TEKNIK_KORUNAN"), ("a [#1] word", "bir sözcük", "BICIM_HATASI"), ("some words", "some words", "INGILIZCE_KALDI"),
        ("one two three four five six seven eight nine", "bir", "EKSIK_CUMLE"), ("some words", "bÃ¼yü", "KODLAMA_HATASI"), ("some words", "Herşey iyi", "YAZIM_ANLAM_SUPHESI"),
        ("some words", "gücü sahip", "YAZIM_ANLAM_SUPHESI"), ("some words", "Çeviri: x", "MODEL_ACIKLAMASI"), ("some words", "bazı The sözler", "INGILIZCE_KALINTISI"), ("some words", "bazı sözler", "CEVRILDI"), ("Bob", "Bob", "KORUNAN_AD"),
    ]
    rows = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(cases)], "k long, s string, t string")
    out = {r["k"]: r for r in S.desktop_analysis(rows, "k", "s", "t", F.col("s") == "Bob").collect()}
    assert [(s, t, out[i]["status"]) for i, (s, t, _) in enumerate(cases)] == cases
    assert not out[11]["issue"] and out[12]["issue"]
    more = spark.createDataFrame([(5, "CEVRILDI", "OK", "reviewed", "^24$")], "priority int, code string, severity string, reason string, key string")
    assert S.desktop_analysis(rows, "k", "s", "t", F.col("s") == "Bob", more).where("k = 24").first()["reason"] == "reviewed"


def test_repair_pass(spark):
    from textledger.operators import repairs as E

    store = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "big ring"), ("d", " two  blanks "), ("e", "alone  x"), ("p", "kept?"), ("f", None)], "key string, value string")
    sources = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "the ring"), ("d", "D"), ("p", "P"), ("q", "Q"), ("n", "new 5"), ("m", "nothing"), ("f", "F")], "key string, source string")
    by_key = spark.createDataFrame([("a", "own"), ("q", "gone")], "key string, value string")
    by_source = spark.createDataFrame([("A", "of source"), ("B", "of source")], "source string, value string")
    words = spark.createDataFrame([("c", 1, "big", "huge"), ("c", 2, "huge", "vast")], "key string, at int, old string, new string")
    got = {r["key"]: (r["value"], r["change"]) for r in E.repair_pass(store, sources, by_key, by_source, [("new ([0-9]+)", "yeni $1")], [("ring", "ring", "halka")], words, F.col("key").isin("p", "q")).collect()}
    assert got == {"a": ("own", "KEY"), "b": ("of source", "SOURCE"), "c": ("vast halka", "VARIANT"), "d": ("two blanks", "TYPOGRAPHY"), "e": ("alone x", "TYPOGRAPHY"), "p": (None, "REMOVED"), "n": ("yeni 5", "PATTERN")}
