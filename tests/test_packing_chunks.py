"""Chunks, packing and deletes on small cases."""

import hashlib
import random

from textledger.operators import chunks as C
from textledger.operators import ladder as L
from textledger.operators import packing as P


def greedy(items, rows, chars, alone):
    """Batches as lists, built the plain way."""
    out = []
    for x in items:
        last = out[-1] if out else None
        if last is None or x > alone or any(y > alone for y in last) or len(last) == rows or sum(last) + x > chars:
            out.append([x])
        else:
            last.append(x)
    return out


def test_batches_equal_plain_packing(spark):
    sizes = [(i, "ab"[i % 2], None if i == 7 else "x" * ((i * 37) % 90)) for i in range(300)]
    work = spark.createDataFrame(sizes, "id long, cat string, body string")
    got = P.pack(work, "cat", "id", "body", rows=4, chars=120, alone=80, span=64).collect()
    assert len(got) == 300
    for cat in "ab":
        for span in range(5):
            mine = sorted((r["id"], r["batch"]) for r in got if r["cat"] == cat and r["span"] == span)
            lengths = [len(sizes[i][2] or "") for i, _ in mine]
            want = [n for n, b in enumerate(greedy(lengths, 4, 120, 80)) for _ in b]
            assert [b for _, b in mine] == want


def end_to_end(sizes):
    """The reference's loop: batches as lists, long texts tightening the limits."""
    out, pending = [], []
    for x in sizes:
        has_long = x > 120 or any(y > 120 for y in pending)
        if x > 1400 or len(pending) >= (8 if has_long else 32) or (pending and sum(pending) + x > (5000 if has_long else 3000)):
            if pending:
                out.append(pending)
            pending = []
        if x > 1400:
            out.append([x])
        else:
            pending.append(x)
    return out + [pending] if pending else out


def test_whole_categories_are_packed_from_end_to_end(spark, monkeypatch):
    rng = random.Random(4)
    kinds = {"a": lambda i: rng.choice([5, 60, 119]), "b": lambda i: rng.choice([0, 90, 120, 121, 700, 1400, 1401]), None: lambda i: rng.choice([3, 3, 3, 3, 3, 500 if i % 50 else 2000])}
    rows = [(i * 3 if cat == "a" else i, cat, "x" * kinds[cat](i)) for cat in kinds for i in range(1000)] + [(None, "a", "xy"), (None, "a", None)]
    work = spark.createDataFrame(rows, "id long, cat string, body string").repartition(3)
    for chunk, together in ((64, 2), (100, 3), (64, 256), (P.CHUNK, P.TOGETHER)):
        monkeypatch.setattr(P, "CHUNK", chunk)
        monkeypatch.setattr(P, "TOGETHER", together)
        got = P.pack_whole(work, "cat", "id", "body").collect()
        assert len(got) == len(rows)
        for cat in kinds:
            mine = sorted((r["id"] is not None, r["id"] or 0, r["batch"]) for r in got if r["cat"] == cat)
            lengths = [n for _, _, n in sorted((i is not None, i or 0, len(t or "")) for i, c, t in rows if c == cat)]
            assert [b for *_, b in mine] == [n for n, b in enumerate(end_to_end(lengths)) for _ in b]
    assert P.pack_whole(work.limit(0), "cat", "id", "body").count() == 0


def test_pack_nulls_and_empty(spark):
    work = spark.createDataFrame([(None, None, None), (1, None, ""), (1, None, "")], "id long, cat string, body string")
    assert sorted((r["span"], r["batch"]) for r in P.pack(work, "cat", "id", "body").collect()) == [(-1, 0), (0, 0), (0, 0)]
    assert P.pack(work.limit(0), "cat", "id", "body").count() == 0


def test_chunks_come_back_and_faults_show(spark):
    data = {"a": b"0123456789" * 3, "b": b"", "c": b"0123456789", "d": None}
    files = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in data.items()], "f string, data binary")
    pieces = C.cut(files, "f", "data", 10)
    kept = C.store(pieces)
    assert kept.count() == 2
    sha = {k: hashlib.sha256(v).hexdigest() for k, v in data.items() if v is not None}
    names = spark.createDataFrame(list(sha.items()), "f string, file_sha256 string")
    manifest = pieces.select("f", "seq", "sha").join(names, "f")
    got = {r["f"]: (bytes(r["data"]), r["pieces"], r["problem"]) for r in C.reassemble(manifest, kept, "f").collect()}
    assert got == {"a": (data["a"], 3, None), "b": (b"", 1, None), "c": (data["c"], 1, None)}
    lost = {r["f"]: r["problem"] for r in C.reassemble(manifest, kept.where("length(piece) = 0"), "f").collect()}
    assert lost == {"a": "MISSING_CHUNK", "b": None, "c": "MISSING_CHUNK"}
    wrong = manifest.selectExpr("f", "seq", "sha", "'0' as file_sha256")
    assert {r["problem"] for r in C.reassemble(wrong, kept, "f").collect()} == {"BAD_FILE"}


def test_prefix_deletes_keep_listed_and_null_keys(spark):
    rows = spark.createDataFrame([("a.1",), ("a.2",), ("b.1",), (None,)], "k string")
    keep = spark.createDataFrame([("a.2",), ("a.2",), (None,)], "k string")
    assert sorted(str(r["k"]) for r in L.drop_prefixes(rows, "k", ["a."], keep).collect()) == ["None", "a.2", "b.1"]
    assert sorted(str(r["k"]) for r in L.drop_prefixes(rows, "k", ["a."]).collect()) == ["None", "b.1"]
