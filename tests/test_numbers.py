"""Numbers as digits and words."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textledger.functions import numbers as D

EN = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
EN_TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()
TR = ". bir iki üç dört beş altı yedi sekiz dokuz".split()
TR_TENS = ". on yirmi otuz kırk elli altmış yetmiş seksen doksan".split()


def english(n):
    if n < 20:
        return EN[n]
    if n < 100:
        return EN_TENS[n // 10] + (f"-{EN[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{EN[n // 100]} hundred" + (f" and {english(n % 100)}" if n % 100 else "")
    return f"{english(n // 1000)} thousand" + (f"{' and' if n % 1000 < 100 else ''} {english(n % 1000)}" if n % 1000 else "")


def turkish(n):
    if n >= 1000:
        return " ".join(x for x in (turkish(n // 1000) if n >= 2000 else "", "bin", turkish(n % 1000) if n % 1000 else "") if x)
    parts = [(TR[n // 100] + " " if n >= 200 else "") + "yüz" if n >= 100 else "", TR_TENS[n // 10 % 10] if n // 10 % 10 else "", TR[n % 10] if n % 10 else ""]
    return " ".join(p for p in parts if p)


@settings(max_examples=300)
@given(st.integers(1, 999_999))
def test_words_and_back(n):
    assert D.word_numbers(f"take {english(n)} coins", "en") == [str(n)] == D.word_numbers(f"şu {turkish(n)} para", "tr")
    assert D.agree(f"take {english(n)} coins", f"{n} para") and D.agree(f"take {n} coins", f"{turkish(n)} para")
    assert not D.agree(f"take {n} coins", f"{turkish(n + 1)} para")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("8:00 and 08:00", ["time:08:00", "time:08:00"]),
        ("saat 08.00 ve 8.30", ["8.30", "time:08:00"]),
        ("1,000 or 1.000", ["1000", "1000"]),
        ("10 bin", ["10000"]),
        ("2,5 bin", ["2500"]),
        ("x1 = 1x", ["1", "1"]),
        ("%50 and 50 %", ["50%", "50%"]),
        ("74.999%", ["74.999%"]),
        ("+3 -4,5 007 -%5", ["-4.5", "-5%", "3", "7"]),
        ("5-7 a-9 -x5", ["-5", "5", "7", "9"]),
        ("v2 a3b", []),
        ("12:30:45 123:45", ["123", "45", "45", "time:12:30"]),
        ("[#1] 5 <b7> %name1%", ["5"]),
        ("", []),
    ],
)
def test_digits(text, want):
    assert D.digit_numbers(text) == want


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("en", "twelve and a half", ["12.5"]),
        ("tr", "on iki buçuk", ["12.5"]),
        ("en", "one two three", ["1", "2", "3"]),
        ("en", "two and three", ["2", "3"]),
        ("en", "a level and a turn", ["1", "1"]),
        ("en", "twentieth eighth ninth", ["20", "8", "9"]),
        ("tr", "üçüncü dördüncü onuncu yedinci", ["3", "4", "10", "7"]),
        ("tr", "altıncı yirmi beşinci birdir on birler İKİ", ["6", "25", "1", "11", "2"]),
        ("en", "nothing", []),
    ],
)
def test_words(language, text, want):
    assert D.word_numbers(text, language) == want


def test_numbers_of_two_languages(spark):
    pairs = [
        ("two coins", "2 para", True), ("2 coins", "iki para", True), ("2 and 2", "iki ve 2", True), ("2 and 2", "2", False), ("3 coins", "iki para", False), ("ten", "on", True),
        (None, "x", None), ("-5 HP", "5 HP azalır", True), ("-5 HP", "5 HP", False), ("heal per % HP", "her %1 HP", True), ("10% not 20", "%10 yerine %20", True), ("10% not 20", "%10 yerine 30", False),
    ]
    rows = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert [r["got"] for r in rows.select(D.numbers_explained("a", "b").alias("got")).collect()] == [p[2] for p in pairs]


def test_percentages(spark):
    rows = spark.createDataFrame([("%50, 5% #7%", "50 %"), ("12,5%", "3,5%"), ("1.5 %", "%1,5"), (None, "")], "a string, b string")
    got = [tuple(r) for r in rows.select(D.percentages("a"), D.percentages("b"), D.numeric_signature("a"), D.spelt_numbers(F.col("b"), "tr")).collect()]
    assert [g[:2] for g in got] == [(["5", "50"], ["50"]), (["12.5"], ["3.5"]), (["1.5"], ["1.5"]), (None, [])]
    assert got[3][2] is None and got[3][3] == []
