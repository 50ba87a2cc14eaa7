"""Linguistic functions against plain cases: what SQL cannot express, and nulls."""

import datetime

import pytest
from pyspark.sql import functions as F

from textledger.functions import language as G
from textledger.functions import text as X
from textledger.operators import files as Z
from textledger.operators import repairs as E
from textledger.plans import audit as A
from textledger.plans import names as N
from textledger.plans import rules as R
from textledger.sources import catalogs as C


def values(spark, texts, *columns):
    rows = spark.createDataFrame([(i, *(t if isinstance(t, tuple) else (t,))) for i, t in enumerate(texts)], f"i int, {', '.join(f'{c} string' for c in 'ab'[: 2 if isinstance(texts[0], tuple) else 1])}")
    return [tuple(r)[1:] for r in rows.select("i", *columns).orderBy("i").collect()]


def test_folds(spark):
    got = values(spark, ["Straße ﬁ İ", "ﬀ’s ①", None, ""], G.casefold(F.col("a")), G.nfkc(F.col("a")))
    assert got == [("strasse fi i̇", "Straße fi İ"), ("ﬀ’s ①".casefold(), "ff's 1"), (None, None), ("", "")]


def test_replacements(spark):
    a = F.col("a")
    got = values(spark, ["red reddish red", "cost $5 a", None], G.replace_words(a, [("red", "$x"), ("a", "\\")]), G.replace_once(a, {"red": "a red", "a": "b"}), G.without_names(a, ["red"]))
    assert got == [("$x reddish $x", "a red a reddish a red", "  reddish  "), ("cost $5 \\", "cost $5 b", "cost $5 a"), (None, None, None)]


def test_morphology(spark):
    got = values(spark, ["Kitap", "Ali", "Göz", "Bkt", None], *[G.with_case(F.col("a"), c) for c in G.CASES])
    assert got == [("Kitap'ı", "Kitap'a", "Kitap'ta", "Kitap'tan", "Kitap'ın"), ("Ali'yi", "Ali'ye", "Ali'de", "Ali'den", "Ali'nin"), ("Göz'ü", "Göz'e", "Göz'de", "Göz'den", "Göz'ün"), ("Bkt'i", "Bkt'e", "Bkt'te", "Bkt'ten", "Bkt'in"), (None,) * 5]


def test_repaired_encoding(spark):
    broken = "Größe für".encode().decode("latin-1")
    got = values(spark, [broken, "Größe für", "Ã", "Ã¼ и", None], G.repaired(F.col("a")))
    assert [r[0] for r in got] == ["Größe für", "Größe für", "Ã", "Ã¼ и", None]


def test_changed_span_and_search(spark):
    got = values(spark, [("abcd", "abxd"), ("aa", "aaa"), ("", "x"), ("same", "same")], G.changed_span(F.col("a"), F.col("b")))
    assert [tuple(r[0]) for r in got] == [(2, 1, "c", "x"), (2, 0, "", "a"), (0, 0, "", "x"), (4, 0, "", "")]
    got = values(spark, [("Red Widget", "k"), ("red", "Widget"), ("red", "x"), (None, "x")], X.all_terms(F.concat_ws("\n", "a", "b"), ["RED", "widget"]))
    assert [r[0] for r in got] == [True, True, False, False]


def test_names_hidden_from_a_provider(spark):
    rows = spark.createDataFrame([(1, "The Iron Lord has [#1] iron"), (2, None), (3, "no names")], "k long, t string")
    names = spark.createDataFrame([("iron lord",), ("iron",)], "name string")
    hidden = N.protect(rows, "k", "t", names, "name")
    got = {r["k"]: (r["tokens"], r["back"], r["moved"]) for r in hidden.select("k", "tokens", N.restored(F.col("masked"), F.col("tokens")).alias("back"), N.restored(F.regexp_replace("masked", " has", "in has"), F.col("tokens")).alias("moved")).collect()}
    assert got[1][:2] == (["Iron Lord", "[#1]", "iron"], "The Iron Lord has [#1] iron")
    assert got[1][2] == "The Iron Lord in has [#1] iron"
    assert got[2][1] is None and got[3][:2] == ([], "no names")


def test_rule_engines(spark):
    pairs = [("a b", "a b"), ("a", "a"), ("a", " "), ("x", "the y"), ("w w", "w w w w w"), ("ok", "fine"), (None, "y"), ("y", None)]
    gate = A.Gate(residue=("the",))
    got = [r[0] for r in values(spark, pairs, A.gate_problem(gate, F.col("a"), F.col("b")))]
    assert got == ["COPY", None, "EMPTY", "RESIDUE", "REPEATED_WORD", None, None, "EMPTY"]
    rules = [R.Rule("FIRST", target="x", reason="r"), R.Rule("SECOND", "OK", source="a")]
    got = [tuple(r[0]) for r in values(spark, [("a", "x"), ("a", "y"), ("b", "y")], A.analyze(rules, F.lit("k"), F.col("a"), F.col("b")))]
    assert got == [("FIRST", "r", True), ("SECOND", "", False), ("DONE", "", False)]


def test_terms(spark):
    rows = spark.createDataFrame([(1, "an Iron Sword", "demir kılıçla"), (2, "iron", "tahta"), (3, "irony", "x"), (4, None, "x"), (5, "iron sword iron", "demir")], "k long, s string, t string")
    terms = spark.createDataFrame([("iron", "demir"), ("iron sword", "demir kılıç")], "term string, value string")
    assert {r["key"]: r["term"] for r in A.terms_problem(rows, "k", "s", "t", terms).collect()} == {2: "iron", 5: "iron sword"}


def test_safe_value_and_phrases(spark):
    rows = [("a", "1", True, "T", "x"), ("a", "2", False, " t", "y"), ("b", "1", True, "T", "x"), ("b", "2", False, "U", "y"), ("c", "1", True, "T", None), ("d", "1", False, "T", "x"), ("d", "2", False, "U", "x"), ("e", "1", False, "T", "bad"), ("e", "0", True, "T", "bad2")]
    df = spark.createDataFrame(rows, "key string, identity string, main boolean, source string, value string")
    got = {r["key"]: (r["value"], r["problem"]) for r in E.one_safe_value(df, lambda s, v: ~v.startswith("bad")).collect()}
    assert got == {"a": ("x", None), "b": (None, "SOURCES_DIFFER"), "c": (None, "NO_VALUE"), "d": ("x", None), "e": (None, "NOT_VALID")}
    parts = spark.createDataFrame([("k1", "Iron "), ("k2", "lord"), ("k3", "other")], "k string, v string")
    assert sorted(map(tuple, E.phrase_parts(parts, "k", F.col("v"), ["iron", "lord", "iron"]).collect())) == [("iron", "k1"), ("lord", "k2")]
    assert E.phrase_parts(parts, "k", F.col("v"), ["iron", "absent"]).count() == 0


def test_versions_and_stamps(spark):
    texts = ["2024.01.31.7", "2024.02.31.7", "2024.1.1.1", None]
    assert [r[0] for r in values(spark, texts, A.patch_version(F.col("a")))] == [[2024, 1, 31, 7], None, None, None]
    got = [r[0] for r in values(spark, ["2024-01-01T10:00:00+03:00", "2024-01-01T10:00:00", "2024-01-01T10:00:00Z", "no"], A.stamp(F.col("a")))]
    assert got == [datetime.datetime(2024, 1, 1, 7), None, datetime.datetime(2024, 1, 1, 10), None]


def test_json_and_fingerprints(spark):
    assert [r[0] for r in values(spark, ['{"a": 1, "b": {"c": 1, "c": 2}, "a": 3}', "{}", "no", None], C.repeated_json_keys("a"))] == [["a", "c"], [], None, None]
    small, large = "x" * 10, "ab" * 50
    got = [r[0] for r in values(spark, [small, large], Z.quick_fingerprint(F.col("a").cast("binary"), 20, 4))]
    import hashlib

    assert got == [hashlib.sha256(small.encode()).hexdigest(), hashlib.sha256(b"100ababab"[:3] + b"abab" + b"abab").hexdigest()]


def test_inflected_rules():
    rules = G.inflected_rules("Varna", "Kıyı")
    assert (rules["Varna"], rules["Varna'ta"], rules["Varna'dan"], rules["Varna'ın"], rules["Varna'a"]) == ("Kıyı", "Kıyıda", "Kıyıdan", "Kıyının", "Kıyıya")
    assert G.inflected_rules("Kale'de", "hisarda")["Kale'den"] == "hisardan" and G.inflected_rules("x", "y") == {"x": "y"}
    assert [G.with_ending(w, c) for w, c in (("evleri", "dative"), ("evleri", "locative"), ("kitap", "locative"), ("göz", "genitive"), ("su", "accusative"), ("brk", "dative"))] == ["evlerine", "evlerinde", "kitapta", "gözün", "suyu", "brka"]


def test_edits_one_after_another(spark):
    edits = spark.createDataFrame([(1, "k1", "go to Varna", "go to Kıyı"), (2, "k9", "old Kıyı", "old Sahil"), (3, "k1", "a", "b"), (4, "k1", None, "b"), (5, "k1", "x {y}", "x {z}")], "edit int, key string, old string, new string")
    rules = E.edit_rules(edits, "edit", "key", "old", "new")
    assert {r["edit"] for r in rules.collect()} == {1, 2}
    rows = spark.createDataFrame([("k1", "Varna"), ("k2", "Varna'da Varna"), ("k3", "none"), ("k4", None), ("k5", "Varna"), ("k9", "Kıyı")], "key string, v string")
    got = dict(map(tuple, E.propagate_edits(rows, "key", "v", rules, F.col("key") == "k5").collect()))
    assert got == {"k2": "Sahilda Sahil"}
    assert E.propagate_edits(rows, "key", "v", rules.limit(0), F.lit(False)).count() == 0


def test_glued_and_copied_words(spark):
    pairs = [("guild House", "GuildEvi"), ("the house", "evHouse"), ("see https://x.y/house", "house"), ("[#house] {[~1]?house:} x", "house"), ("eht dna rof house", "house"), ("House rules", "House kurallar"), ("nagged", "nagged"), (None, "x")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = [tuple(r) for r in rows.select(G.glued_word(F.col("a"), F.col("b"), ["lar"], joinable=["guild"]), G.copied_word(F.col("a"), F.col("b"), [], generic=["house"])).collect()]
    assert got == [("GuildEvi", None), ("evHouse", None), (None, None), (None, None), (None, None), (None, "House"), (None, "nagged"), (None, None)]


def test_long_texts_are_no_slower_than_they_are_long(spark):
    long = " ".join(f"w{i}x" for i in range(60_000))
    rows = spark.createDataFrame([(long, long + " end end end end")], "a string, b string")
    got = rows.select(G.changed_span("a", "b").alias("s"), A.repeated_word(F.col("a"), F.col("b"), 4).alias("w"), G.copied_word(F.col("a"), F.col("b"), []).alias("c")).first()
    assert (got["s"]["prefix"], got["s"]["now"], got["w"]) == (len(long), " end end end end", "end")
