"""Packages as a data source: the same lines as from whole files, a partition an entry, pruned by conditions."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textledger.sources import catalogs as C
from textledger.sources import packages as P


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="ab=#\n\r é﻿ ", max_size=40), st.integers(1, 7), st.sampled_from(["unicode", "feed"]))
def test_streamed_lines_are_those_of_the_text(text, chunk, ends):
    whole, mark = (text[1:], text[0]) if text[:1] == "﻿" else (text, "")
    want = [(n, (mark if n == 1 else "") + raw, *more) for n, raw, *more in C.entry_lines(whole, C.LINE_ENDS[ends])]
    assert list(P.streamed_lines(io.BytesIO(text.encode()), C.LINE_ENDS[ends], chunk=chunk)) == want


def test_packages(spark, tmp_path):
    for name in "xy":
        with zipfile.ZipFile(tmp_path / f"{name}.jar", "w") as z:
            for entry in ("main.txt", "extra.txt"):
                z.writestr(entry, "﻿# note\r\n" + "".join(f"{name}{entry[0]}{i}=v=é{i}\n" for i in range(3)) + "broken")
    paths = [str(tmp_path / "x.jar"), str(tmp_path / "y.jar")]
    rows = P.read_entries(spark, paths)
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 20
    plain = C.read_lines(spark, str(tmp_path), ["main.txt", "extra.txt"])
    cut = lambda d: sorted((r["package"].rsplit("/", 1)[1], r["entry"], r["line_no"], r["raw"], r["newline"], r["key"] or "", r["value"] or "", r["problem"] or "") for r in d.collect())
    assert cut(rows) == cut(plain)
    one = P.read_entries(spark, paths).where(f"entry = 'main.txt' and package = '{paths[1]}'")
    assert one.rdd.getNumPartitions() == 1 and {r["entry"] for r in one.collect()} == {"main.txt"} and one.count() == 5
    assert P.read_entries(spark, paths).where("entry = 'absent'").count() == 0
    assert P.read_entries(spark, paths, ["main.txt"]).where("value = 'v=é1'").count() == 2
    with pytest.raises(Exception, match="no entry"):
        P.read_entries(spark, paths, ["absent"], strict=True).count()
