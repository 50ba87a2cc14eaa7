"""Dictionary matching: no result depends on how the dictionary is cut, and folding moves no place."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textledger.functions import tokens as T
from textledger.plans import names as N

letters = st.text(alphabet="abİßﬁ -,'", min_size=1, max_size=6)


def plain_scan(text, names):
    """From each place the longest name at word borders, compared letter by letter folded."""
    fold = [c.casefold() for c in text]
    keys = {n.casefold() for n in names if n}
    out, a = [], 0
    while a < len(text):
        ends = [b for b in range(len(text), a, -1) if "".join(fold[a:b]) in keys and N._at_borders(text, a, b)]
        if ends:
            out.append((a, ends[0]))
            a = ends[0]
        else:
            a += 1
    return out


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="abİßﬁ -,'ABIs", max_size=20), st.lists(letters, max_size=6), st.integers(1, 5))
def test_blocks_change_nothing(text, names, size):
    names = sorted(set(names))
    best: dict = {}
    for i in range(0, len(names), size):
        block = N._automaton({n.casefold(): None for n in names[i : i + size]})
        for a, b in N.border_hits(text, block).items():
            best[a] = max(b, best.get(a, 0))
    assert N.leftmost(best) == plain_scan(text, names)


@pytest.mark.parametrize("size", [4, 8_000_000])
def test_names_in_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(N, "BLOCK_CHARS", size)
    rows = spark.createDataFrame([(1, "red ring of gold"), (2, "İyi red ring of gold"), (3, "Straße, STRASSE ﬁn"), (1, "red ring of gold"), (4, None)], "k long, text string")
    names = spark.createDataFrame([(n,) for n in ("ring of", "of gold", "red ring", "strasse", "fin", None, "")], "name string")
    got = sorted(map(tuple, N.scan(rows, "k", "text", names, "name").collect()))
    assert got == sorted([(1, 0, 8, "red ring"), (1, 9, 16, "of gold")] * 2 + [(2, 4, 12, "red ring"), (2, 13, 20, "of gold"), (3, 0, 6, "Straße"), (3, 8, 15, "STRASSE"), (3, 16, 18, "ﬁn")])
    keyed = spark.createDataFrame([("a", "red"), ("a", "gold"), ("b", "ring"), ("a", "of")], "n string, name string")
    assert sorted(map(tuple, N.contained(rows.where("k = 2"), "k", "text", keyed, "n", "name").collect())) == [(2, "a"), (2, "b")]
    words = spark.createDataFrame([("red ring",), ("ring of gold",), ("of",), ("gold",)], "name string")
    assert {tuple(r["names"]) for r in N.longest_matches(rows, "k", "text", words, "name").collect()} == {("red ring", "of", "gold")}


def test_genitives_and_word_borders(spark):
    rows = spark.createDataFrame([(1, "Iron Lord's sword and Ernest’s [#1] chaos")], "k long, t string")
    names = spark.createDataFrame([("iron lord",), ("ernest",)], "name string")
    hidden = N.protect(rows, "k", "t", names, "name").withColumn("glued", F.regexp_replace("masked", " (sword|chaos)", "$1"))
    row = hidden.select("tokens", N.restored("masked", "tokens").alias("back"), N.restored("glued", "tokens").alias("glued")).first()
    assert row["tokens"] == ["Iron Lord'un", "Ernest'in", "[#1]"]
    assert row["back"] == "Iron Lord'un sword and Ernest'in [#1] chaos" and row["glued"] == "Iron Lord'un sword and Ernest'in [#1]chaos"
    assert [N.genitive(x) for x in ("Ali", "Göz", "Bkt", "Ana", "Kulu", "Yıl")] == ["'nin", "'ün", "'ın", "'nın", "'nun", "'ın"]


def cond(depth):
    text = st.text(alphabet="ab :s", max_size=4)
    if not depth:
        return text
    return st.tuples(text, cond(depth - 1), cond(depth - 1), text).map(lambda x: f"{x[0]}{{[=1]?{x[1].replace(':', '')}:{x[2]}}}{x[3]}")


@settings(deadline=None, max_examples=150)
@given(cond(3))
def test_branches_are_the_text(text):
    pieces = T.branches(text)
    assert "".join(t for _, _, t in pieces) == text
    assert all(t == t.strip() and "{" not in t and "}" not in t for _, prose, t in pieces if prose)
    owners = [o for o, _, _ in pieces]
    assert all(o == "" or o[:-1] + "y" in owners for o in owners)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Lucky Charm{[~1]?s:}", [("", "Lucky Charm")]),
        ("a {[1]?b {[2]?c:d}:e} f", [("", "a"), ("/0y", "b"), ("/0y/0y", "c"), ("/0y/0n", "d"), ("/0n", "e"), ("", "f")]),
        ("{[1]?a\\}b\\:c:d}", [("/0y", "a\\}b\\:c"), ("/0n", "d")]),
        ("{[1=3]Text:}", [("", "Text:")]),
        ("[#1] %n% <b>5</b>", []),
    ],
)
def test_prose_of_branches(text, want):
    assert [(o, t) for o, prose, t in T.branches(text) if prose] == want


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("{[1]?a\\}b:c}", "{[1]?x\\}y:z}", True),
        ("{[1]?a\\}b:c}", "{[1]?x:z}", False),
        ("{[1]?a\\:b:c}", "{[1]?x:z}", True),
        ("{[1]?[#1]:c}", "{[1]?a:[#1]}", False),
        ("{[1=3]Text:}", "{[1=3]Metin:}", True),
        ("{[1=3]Text:}", "{[1=3]Metin}", False),
        ("{[1=2]{0=3]?Text:}", "{[1=2]{0=3]?Metin:}", True),
        ("a } b", "a b", False),
        ("{[x]?a:b} {[y", "{[x]?c:d} {[y", True),
        ("[#ONE] <B>", "[#one] <b>", True),
        ("[two words]", "iki", True),
    ],
)
def test_structure(a, b, same):
    assert (T.signature(a) == T.signature(b)) is same
    assert T.signature("[#ONE]", "strict") != T.signature("[#one]", "strict") and T.signature("{", "strict") != T.signature("", "strict")


@pytest.mark.parametrize(("inside", "atom"), [("#1", True), ("/x", True), ("12=3", True), ("Name_1", True), ("a" * 33, False), ("two words", False), ("", False), ("é", False)])
def test_bracket_atoms(inside, atom):
    assert T.is_bracket_atom(inside) is atom and not T.is_bracket_atom("/x", slash=False)
