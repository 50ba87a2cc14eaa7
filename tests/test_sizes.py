"""What larger tables bring: rare texts, large batches, many rows a key."""

import io
import zipfile

import duckdb
import pytest

from textledger import queries as ledger
from textledger.sources import catalogs as C
from textledger.streaming import cache as K

SF = "/root/testdata/sf0.001"


@pytest.fixture
def both(spark, tmp_path):
    """Rows of a query and of its SQL over a table given as SQL."""

    def run(name, table, rows):
        duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        df = ledger.QUERIES[name](spark, str(tmp_path))
        cols = ", ".join(df.columns)
        return sorted(map(str, map(tuple, df.collect()))), sorted(map(str, con.execute(f"SELECT {cols} FROM ({ledger.ORACLES[name]})").fetchall()))

    return run


def test_lost_chunks_that_others_end_with(both):
    """A lost document of one word is found again where another one's last chunk is that word; copies are, too; null texts are no files."""
    rows = "SELECT * FROM (VALUES (7, 'der'), (8, repeat('a', 1024) || 'der'), (14, 'die'), (21, repeat('b', 1500)), (22, repeat('b', 1500)), (28, NULL), (29, NULL), (30, '')) t(doc_id, text)"
    ours, theirs = both("bundle_reassembly", "documents", rows)
    assert ours == theirs
    assert [x.split(", ")[:2] for x in ours if "MISSING" in x] == [["('14'", "'MISSING_CHUNK'"]] and len(ours) == 6


def test_words_of_a_language_in_capitals(both):
    ours, theirs = both("language_guesses", "documents", "SELECT *, 'x' AS lang FROM (VALUES ('FÜR'), ('QUÊTE'), ('NÃO'), ('ſind'), ('DANKE'), ('DİE'), ('dıe')) t(text)")
    assert ours == theirs == ["('x', 'de', 3)", "('x', 'en', 2)", "('x', 'fr', 1)", "('x', 'pt', 1)"]


def test_reasons_name_words_in_lower_case(both):
    """``ß`` is no ``ss`` to SQL, neither where words are counted nor where one is named; numerals are no letters; texts may be null."""
    texts = ["und", "Straße straße straße straße", "weiß weiß weiss weiss", "GROẞ groß groß groß", "İz iz iz iz", "x²y x²y x²y x²y", "ΑΣ ΑΣ ΑΣ ΑΣ", "don’t don’t don't don't", "a < b <i>", "[red] red red red", None, "eß eß eß eß", "haus", "quest", None]
    said = ["NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in texts]
    ours, theirs = both("quality_reasons", "conversations", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {t}, {x})" for i in range(16) for t, x in enumerate(said)) + ") t(conv_id, turn, text)")
    assert ours == theirs and len(ours) == 16 * 14
    assert any("'REPEATED_WORD', 'straße'" in x for x in ours) and not any("weiss" in x for x in ours)


@pytest.mark.parametrize("name", ["normal_forms", "masked_tokens", "strict_forms", "token_segments", "generated_gate", "required_terms", "numeric_signatures", "translated_segments"])
def test_texts_go_to_python_in_small_batches(spark, name):
    """Arrow's batches of 10,000 whole texts made a worker grow with the table."""
    plan = ledger.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "BatchEvalPython" in plan and not any(x in plan for x in ("ArrowEvalPython", "MapInPandas", "MapInArrow"))


def test_long_work_is_spread(spark):
    """A small file of many rows is one task's input, not one task's work; pieces are counted without a second shuffle."""
    assert spark.read.parquet(f"{SF}/orders.parquet").rdd.getNumPartitions() == 1
    assert ledger.QUERIES["numeric_signatures"](spark, SF).rdd.getNumPartitions() == 16
    plan = ledger.QUERIES["translated_segments"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan and "distinct" not in plan


def test_lines_of_entries_in_pieces(monkeypatch):
    text = "﻿a=1\r\nb=ü\rc= 3\r\n\r\n# x\nd=4\r"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("main", text)
    whole = [*C.package_lines(data.getvalue(), "p", ["main"])]
    assert "".join(r[3] + r[4] for r in whole) == text and [r[4] for r in whole] == ["\r\n", "\r", " ", "\r\n", "\r\n", "\n", "\r"]
    for size in range(1, 9):
        monkeypatch.setattr(C, "PIECE", size)
        assert [*C.package_lines(data.getvalue(), "p", ["main"])] == whole


class Store:
    """A key's state and timers, counting the calls."""

    def __init__(self):
        self.kept, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.kept

    def update(self, kept):
        self.calls += 1
        self.kept = kept

    def clear(self):
        self.kept = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.now

    def expire(self, processor, now):
        self.now, come, out = now, [t for t in self.timers if t <= now], []
        for at in come:
            self.timers.remove(at)
            self.getExpiryTimeInMs = lambda at=at: at
            out += [(r["text"], r["millis"]) for r in processor.handleExpiredTimer(("u",), self, self)]
        return out


def test_calls_to_the_store_for_a_key():
    """Two in a batch, once the key has a timer; one that is too early is set anew, and waiting texts bring it forward."""
    store = Store()
    processor = K._Processor(5, 1000)
    processor.init(store)
    said = lambda *rows: [r["action"] for r in processor.handleInputRows(("u",), iter([{"millis": at, "text": t, "outcome": o} for at, t, o in rows]), None)]
    assert said((10, "a", None)) == ["ASK"] and store.timers == [1010]
    store.calls = 0
    assert said((20, "a", None), (15, "b", None)) == ["ASK", "KNOWN"] and store.calls == 2 and store.timers == [1010]
    assert store.expire(processor, 1015) == [] and store.timers == [1020] and store.kept
    assert said((30, "a", "failed")) == ["WAIT"] and store.timers == [1020]
    assert store.expire(processor, 30 + K.FAILED + 1) == [("a", 30 + K.FAILED)]
    assert said((1, "a", None)) == ["KNOWN"]
    assert store.expire(processor, 10**9) == [] and store.kept is None
