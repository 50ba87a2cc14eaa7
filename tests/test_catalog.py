"""Small cases for the catalog engine's operators."""

import io
import random
import re
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from textledger.functions import tokens as T
from textledger.operators import ladder as L
from textledger.operators import versions as V
from textledger.plans import audit as A
from textledger.plans import names as N
from textledger.sources import catalogs as C
from textledger.sources import reports as W


@pytest.mark.parametrize(
    ("source", "target", "same"),
    [
        ("Use [#1] now", "Nimm [#1] jetzt", True),
        ("Use [#1] now", "Nimm es", False),
        ("{[c]?yes [#1]:no [#2]}", "{[c]?ja [#1]:nein [#2]}", True),
        ("{[c]?yes [#1]:no [#2]}", "{[c]?ja [#2]:nein [#1]}", False),
        ("{[a]?x {[b]?y:z}:}", "{[a]?p {[b]?q:r}:}", True),
        ("{[a]?x:y}", "{[a]?p:q}}", False),
        ("[#NAME]", "[#name]", True),
        ("<b>t</b>", "<b>u</b>", True),
        ("<b>t</b>", "<i>u</i>", False),
        ("50% off", "die Hälfte", True),
    ],
)
def test_signatures(source, target, same):
    assert (T.signature(source) == T.signature(target)) is same


@pytest.mark.parametrize(
    ("source", "target", "same"),
    [
        (r"{[a]?x\:y [#1]:z}", r"{[a]?p [#1]:q\:r}", True),  # an escaped colon parts nothing
        ("{[=0]?} {[=1]?[#1]:[#2]}", "{[=0]?} {[=1]?[#1][#2]:}", False),  # a malformed neighbour excuses nothing
        ("{[1=3]Text [#1]:}", "{[1=3]Metin [#1]:}", True),  # no question mark
        ("{[1=3]Text [#1]:}", "{[1=4]Metin [#1]:}", False),
        ("{[a] ?x:y}", "{[a] ?p:q}", True),  # a blank before the question mark
        ("{[a?x:y}", "{[a?p:q}", True),  # no closing bracket
        ("{[a]?x", "{[a]?y", True),
        ("{[a]?x", "{[a]?x:y}", False),
        ("<a href='>'>t</a>", "<a href='>'>u</a>", True),
        ("[3] or [#x] or [two words]", "[3] und [#x] oder [zwei]", False),
        ("a: b", "c d", True),  # prose marks are prose
    ],
)
def test_irregular_signatures(source, target, same):
    assert (T.signature(source) == T.signature(target)) is same


def test_dialects():
    assert T.signature("[#NAME]", "strict") != T.signature("[#name]", "strict")
    assert T.signature("[/x]", "audit") == T.signature("", "audit") != T.signature("[/x]")
    deep = "{[a]?" * 3000 + "x" + ":y}" * 3000
    assert len(T.spans(deep)) == 9000 and T.signature_nodes(deep)


@given(st.text(alphabet="ab <>[]#1{}?:%\\n"))
def test_masks_and_segments_restore(text):
    masked, tokens = T.mask(text)
    assert T.unmask(masked, tokens) == text
    assert "".join(s for _, s in T.segments(text)) == text
    assert "".join(text[a:b] for a, b, _, _ in T.spans(text)) == "".join(tokens)
    assert T.signature(text) == T.signature(text)


def test_unmask_takes_moved_tokens_and_refuses_lost_and_doubled_ones():
    masked, tokens = T.mask("a [#1] b <i>")
    assert tokens == ["[#1]", "<i>"]
    one, two = (c for c in masked if ord(c) >= T.MASK_FROM)
    assert T.unmask(f"{two} x {one}", tokens) == "<i> x [#1]"
    assert T.unmask(f"{one} x", tokens) is None
    assert T.unmask(masked + one, tokens) is None
    with pytest.raises(ValueError):
        T.mask(masked)


@pytest.mark.parametrize(
    ("source", "target", "out"),
    [
        ("Charm{[~1]?s:}", "Tılsım", "Tılsım{[~1]?s:}"),
        ("Charm{[~1]?s:} ", "Tılsım ", "Tılsım{[~1]?s:} "),
        ("Charm{[~1]?s:}", "Tılsım{[~1]?lar:}", "Tılsım{[~1]?lar:}"),
        ("Charm{[~1]?s:} of", "Tılsım", "Tılsım"),
        ("{[~1]?es:}x", "y", "{[~1]?es:}y"),
        ("Charm{[~1]?words:}", "Tılsım", "Tılsım"),
    ],
)
def test_graft(source, target, out):
    assert T.graft(source, target) == out


def test_align():
    assert T.align("<B>a</B> [#One]", "[#one] <b>x</b>") == "[#one] <b>x</b>"
    assert T.align("<B>a</B> [#One]", "<b>x</b> [#one]") == "<B>x</B> [#One]"


def test_text_columns_are_null_safe(spark):
    rows = spark.createDataFrame([(None,), ("",), ("a [#1]",)], "t string")
    got = rows.select(T.format_signature("t"), T.token_spans("t"), T.token_segments("t"), T.masked_text("t")).collect()
    assert tuple(got[0]) == (None,) * 4 and got[1][2] == [] and got[2][3]["tokens"] == ["[#1]"]


def _rows(spark, pairs):
    r = spark.createDataFrame([("main", k, i, v) for i, (k, v) in enumerate(pairs)], "entry string, key string, line_no long, value string")
    return V.snapshot(V.with_identity(r))


def test_duplicate_occurrences_diff_apart(spark):
    old = _rows(spark, [("d", "P"), ("d", "Q"), ("gone", "x")])
    new = _rows(spark, [("d", "P"), ("d", "R"), ("fresh", "y")])
    got = {r["identity"]: r["kind"] for r in V.diff(old, new).collect()}
    assert got == {"main:d#1": "UNCHANGED", "main:d#2": "MODIFIED", "main:gone#1": "REMOVED", "main:fresh#1": "NEW"}
    assert {r["kind"] for r in V.diff(old, old).collect()} == {"UNCHANGED"}


def test_ladder_order_and_approval(spark):
    changed = spark.createDataFrame([("1", "k1", "s1"), ("2", "k2", "s2"), ("3", "k3", "s3")], "identity string, key string, source string")
    good = spark.createDataFrame([("k1", "s1"), ("k2", "old")], "key string, s string").selectExpr("key", "sha2(s, 256) as source_sha256")
    manual = spark.createDataFrame([("k1", "m1"), ("k2", "m2")], "key string, value string")
    memory = spark.createDataFrame([("k2", "y2"), ("k3", " ")], "key string, value string")
    stores = [L.Store("manual", manual, approvals=good), L.Store("memory", memory, skip_blank=True)]
    got = {r["key"]: r["origin"] for r in L.resolve(changed, stores).collect()}
    assert got == {"k1": "manual", "k2": "memory", "k3": None}
    assert [r["key"] for r in L.unresolved(changed, stores).collect()] == ["k3"]


def test_rungs_do_not_multiply_records(spark):
    changed = spark.createDataFrame([("1", "k", "s")], "identity string, key string, source string")
    store = spark.createDataFrame([("k", "z", 1), ("k", "a", 2), ("k", None, 3)], "key string, value string, at int")
    assert [r["value"] for r in L.resolve(changed, [L.Store("m", store, order="at")]).collect()] == ["a"]
    assert [r["value"] for r in L.resolve(changed, [L.Store("m", store)]).collect()] == ["z"]


def test_seeds_must_be_there(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x")], "k string, s string")
    assert L.seeded(rows, spark.createDataFrame([("a", "r")], "seed_key string, replacement string"), "k", "s").count() == 2
    with pytest.raises(Exception, match="seed key"):
        L.seeded(rows, spark.createDataFrame([("c", "r")], "seed_key string, replacement string"), "k", "s").collect()


def plain_longest(text, names, widest=8):
    """Word by word from the left, the longest name at each place; a name also fits without its last word's suffix."""
    words = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", text)
    out, i = [], 0
    while i < len(words):
        for n in range(min(widest, len(words) - i), 0, -1):
            whole = " ".join(words[i : i + n])
            fit = [w for w in (whole, re.sub(r"['’][^\W\d_]+$", "", whole)) if w in names]
            if fit:
                out.append(fit[0])
                i += n
                break
        else:
            i += 1
    return out


def test_longest_names_equal_a_plain_scan(spark):
    rng = random.Random(3)
    words = ["iron", "sword", "of", "Zor'gan", "well-made", "the", "x"]
    texts = [" ".join(rng.choice([*words, "iron's", "12", ",", "sword’a"]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "iron"]
    names = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 8))) for _ in range(60)} | {"iron", "iron sword", "sword of"}
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    known = spark.createDataFrame([(n,) for n in sorted(names)] + [("",), (None,)], "name string")
    got = {r["k"]: r["names"] for r in N.longest_matches(rows, "k", "text", known, "name").collect()}
    want = {k: plain_longest(t or "", names) for k, t in enumerate(texts)}
    assert got == {k: v for k, v in want.items() if v}


def test_contained_names_of_any_form(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "an iron sword"), (2, "environ"), (3, None), (1, "iron"), (4, "")], "k long, text string")
    names = spark.createDataFrame([("a", "iron"), ("b", "iron"), ("c", "n iron sw"), ("d", ""), ("e", None), ("f", "absent")], "n string, name string")
    want = [(1, "a"), (1, "a"), (1, "b"), (1, "b"), (1, "c"), (2, "a"), (2, "b")]
    assert sorted(map(tuple, N.contained(rows, "k", "text", names, "n", "name").collect())) == want
    monkeypatch.setattr(N, "BLOCK_CHARS", 5)
    assert sorted(map(tuple, N.contained(rows, "k", "text", names, "n", "name").collect())) == want
    assert N.contained(rows, "k", "text", names.limit(0), "n", "name").count() == 0


def test_names_at_borders(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "Iron sword, ironing IRON"), (2, None)], "k long, text string")
    names = spark.createDataFrame([("iron",), ("iron sword",), ("sword",)], "name string")
    want = [(1, 0, 10, "Iron sword"), (1, 20, 24, "IRON")]
    assert sorted(map(tuple, N.scan(rows, "k", "text", names, "name").collect())) == want
    monkeypatch.setattr(N, "BLOCK_CHARS", 4)
    assert sorted(map(tuple, N.scan(rows, "k", "text", names, "name").collect())) == want
    assert N.scan(rows, "k", "text", names.limit(0), "name").count() == 0


def package(path, *entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return str(path)


def test_packages(spark, tmp_path):
    path = package(tmp_path / "p.jar", ("main.txt", "\ufeff# note\r\nk=a=b\r\n !odd=1\nk=c\nbad line\n=x\n"), ("pic.bin", b"\xff\xfe\x00"))
    rows = C.read_packages(spark, path, ["main.txt"]).collect()
    assert sorted((r["identity"], r["value"]) for r in rows) == [("main.txt: !odd#1", "1"), ("main.txt:#1", "x"), ("main.txt:k#1", "a=b"), ("main.txt:k#2", "c")]
    assert C.read_packages(spark, path, ["main.txt"], "DROPMALFORMED").count() == 3
    with pytest.raises(Exception, match="NO_EQUALS"):
        C.read_packages(spark, path, ["main.txt"], "FAILFAST").collect()
    last = {r["key"]: r["value"] for r in C.last_values(C.read_packages(spark, path, ["main.txt"])).collect()}
    assert last["k"] == "c" and C.keys_of(C.read_packages(spark, path, ["main.txt"])).count() == 3
    assert C.read_packages(spark, path, ["absent", "main.txt"], fallback=True).count() == 4
    with pytest.raises(Exception, match="no entry"):
        C.read_packages(spark, path, ["main.txt", "absent"], "FAILFAST").collect()


def test_packages_number_apart(spark, tmp_path):
    for n in "ab":
        package(tmp_path / f"{n}.jar", ("main", "k=1\nk=2\u2028x=3"))
    rows = C.read_packages(spark, str(tmp_path / "*.jar"), ["main"]).collect()
    assert sorted(r["identity"] for r in rows) == ["main:k#1", "main:k#1", "main:k#2", "main:k#2", "main:x#1", "main:x#1"]
    assert C.read_packages(spark, str(tmp_path / "a.jar"), ["main"], ends="feed").count() == 2
    with pytest.warns(UserWarning):
        package(tmp_path / "c.jar", ("main", "k=1"), ("main", "k=2"))
    assert [r["value"] for r in C.read_packages(spark, str(tmp_path / "c.jar"), ["main"]).collect()] == ["2"]
    with pytest.raises(Exception, match="2 times"):
        C.read_packages(spark, str(tmp_path / "c.jar"), ["main"], "FAILFAST").collect()
    with pytest.raises(Exception, match="utf-8"):
        C.read_packages(spark, package(tmp_path / "d.jar", ("main", b"k=\xff")), ["main"], "FAILFAST").collect()


def test_rewrite_changes_nothing_else(spark, tmp_path):
    text = "\ufeff# note\r\nk=a=b\r\n\r\n! x\nk=c\nbad\nlast=z"
    lines = C.read_lines(spark, package(tmp_path / "p.jar", ("main", text), ("other", "q=1\n")), ["main", "other"])
    new = spark.createDataFrame([("main:k#2", "new\nline $1 \\"), ("main:no#1", "x")], "identity string, value string")
    out = tmp_path / "out"
    W.pack(W.rewrite(lines, new)).write.parquet(str(out))
    content = spark.read.parquet(str(out)).first()["content"]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        assert z.namelist() == ["main", "other"]
        assert z.read("main").decode() == text.replace("k=c", "k=new\\nline $1 \\")
        assert z.read("other") == b"q=1\n"
    W.pack(lines).write.mode("overwrite").parquet(str(out))
    with zipfile.ZipFile(io.BytesIO(spark.read.parquet(str(out)).first()["content"])) as z:
        assert z.read("main").decode() == text


def test_policy_rewrite_reports_what_it_leaves_out(spark, tmp_path):
    lines = C.read_lines(spark, package(tmp_path / "p.jar", ("main", "a=1\nb=2\nc=3\nd=4\na=5\n")), ["main"])
    rows = [("main:a#1", "a", "1", "eins", False), ("main:a#2", "a", "5", None, False), ("main:b#1", "b", "2", "zwei", True), ("main:c#1", "c", "3", "3", False), ("main:d#1", "d", "4", "vier [#1]", False)]
    resolved = spark.createDataFrame(rows, "identity string, key string, source string, value string, stale boolean")
    written, skipped = W.rewrite_by_policy(lines, resolved, T.format_ok)
    assert sorted(r["raw"] for r in written.collect()) == ["a=5", "a=eins", "b=2", "c=3", "d=4"]
    assert {r["key"]: (r["identity"], r["reason"]) for r in skipped.collect()} == {"a": ("main:a#2", "NO_VALUE"), "b": ("main:b#1", "STALE_SOURCE"), "c": ("main:c#1", "SAME_AS_SOURCE"), "d": ("main:d#1", "FORM")}


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(2, "OPEN", "a\tb\\"), (1, "DONE", 'c\n"d"'), (3, "OPEN", None)], "k int, status string, text string")
    W.write_status(rows, str(tmp_path / "r"), ["k", "status", "text"], F.col("status") == "OPEN")
    assert [tuple(r) for r in C.read_status(spark, str(tmp_path / "r/status"), ["k", "status", "text"], strict=True).orderBy("k").collect()] == [("1", "DONE", 'c\n"d"'), ("2", "OPEN", "a\tb\\"), ("3", "OPEN", "")]
    assert C.read_status(spark, str(tmp_path / "r/issues"), ["k", "status", "text"]).count() == 2
    assert [r["value"] for r in W.counts_text(rows, "status", F.col("status") == "OPEN").collect()] == ["DONE: 1", "OPEN: 2", "TOTAL: 3", "ISSUES: 2"]
    found = spark.createDataFrame([("high", "B", "x"), ("critical", "C", "y"), ("high", "A", "z")], "severity string, code string, key string")
    ranked = A.by_severity(found, ["critical", "high"])
    assert [r["key"] for r in ranked.collect()] == ["y", "z", "x"]
    W.write_findings(ranked, str(tmp_path / "f"), ["rank", "code", "key"])
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "f/summary")).collect()) == ["critical: 1", "high: 2"]
    assert C.read_jsonl(spark, str(tmp_path / "f/json"), "severity string, code string, key string").count() == 3
    stop = W.stop_report(rows, "k", "status", 1).collect()
    assert {r["reason"]: (r["n"], r["identities"]) for r in stop} == {"DONE": (1, [1]), "OPEN": (2, [2])}


def test_glossary_jsonl_and_log(spark, tmp_path):
    (tmp_path / "g.json").write_text('\ufeff{"keys": {"a": "1"}, "values": {"b": "2"}}')
    over = spark.createDataFrame([("keys", "a", "9"), ("phrases", "p", "3")], "kind string, term string, value string")
    assert sorted(map(tuple, C.read_glossary(spark, str(tmp_path / "g.json"), over).collect())) == [("keys", "a", "9"), ("phrases", "p", "3"), ("values", "b", "2")]
    (tmp_path / "r.jsonl").write_text('{"key": "a", "translation": "x"}\nno json\n{"key": "b"}\n')
    assert sorted(map(tuple, C.read_jsonl(spark, str(tmp_path / "r.jsonl"), "key string, translation string").collect())) == [("a", "x"), ("b", None)]
    lines = spark.createDataFrame([("2024-01-01 00:00:00\tm\tk\tc\tSAVED\ts\tt\td\te",), ("broken",), (None,)], "value string")
    assert [r["detail"] for r in C.parse_log(lines).collect()] == ["d\te"]
    assert sorted(r["malformed"] for r in C.parse_log(lines, keep_malformed=True).collect()) == [False, True, True]


def test_status_fields_come_back(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('key\ttext\na\tone\\ttwo "q"\nb\tx\\\\ny\nbroken\n')
    got = {r["key"]: r["text"] for r in C.read_status(spark, str(tmp_path / "s.tsv"), ["key", "text"]).collect()}
    assert got == {"a": 'one\ttwo "q"', "b": "x\\ny"}
