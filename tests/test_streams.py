"""State of streams: bounded caches with back-off, live rows in levels."""

import os
import random

from pyspark.sql import functions as F

from textledger.streaming import cache as K
from textledger.streaming import live as S


def test_recent_texts_of_a_key():
    r = K.Recent(2)
    assert [r.message(1, t) for t in "aab"] == [[("a", "ASK")], [("a", "KNOWN")], [("b", "ASK")]]
    assert r.message(2, "c") == [("c", "ASK")] and r.known == ["b", "c"]
    assert r.message(3, "a") == [("a", "ASK")]
    assert r.outcome(4, "a", "failed") == [("a", "WAIT")] and r.until == 4 + K.FAILED
    assert r.message(5, "c") == [("c", "KNOWN")] and r.message(6, "x") == [("x", "WAIT")]
    assert r.message(7, "y") == [("y", "WAIT"), ("a", "DROPPED")] and r.waiting == ["x", "y"]
    assert r.outcome(8, "x", "limited") == [("x", "WAIT")] and r.until == 8 + 2 * K.LIMITED
    assert r.message(r.until, "z") == [("y", "ASK"), ("x", "ASK"), ("z", "ASK")] and r.known == ["x", "z"] and not r.waiting
    assert r.outcome(r.until, "z", "ok") == [] and (r.failures, r.until) == (0, 0)


def test_cache_over_several_batches(spark, tmp_path):
    rows = [[("u", 0, "a", None), ("u", 1, "b", None), ("v", 1, "a", None)], [("u", 2, "a", None), ("u", 3, "b", "failed"), ("u", 4, "c", None), ("u", 4, None, None)], [("w", 100, "q", None)], [("w", 200, "q", None)]]
    schema = "k string, s int, t string, o string"
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).withColumn("at", F.timestamp_seconds(F.col("s") + 1000)).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        file = next(f for f in os.listdir(f"{tmp_path}/{i}") if f.endswith(".parquet"))
        os.makedirs(f"{tmp_path}/all", exist_ok=True)
        os.rename(f"{tmp_path}/{i}/{file}", f"{tmp_path}/all/{i}.parquet")
        os.utime(f"{tmp_path}/all/{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    stream = S.limited(spark, f"{tmp_path}/all", schema + ", at timestamp", 1)
    out = K.run_cached(stream, key="k", time="at", text="t", outcome="o", most=5, idle="50 seconds")
    got = sorted((r["key"], r["text"], r["action"]) for r in out.collect())
    # What waits is asked for by the timer, without another row of the key.
    want = [("u", "a", "ASK"), ("u", "b", "ASK"), ("v", "a", "ASK"), ("u", "a", "KNOWN"), ("u", "b", "WAIT"), ("u", "c", "WAIT"), ("u", "b", "ASK"), ("u", "c", "ASK"), ("w", "q", "ASK")]
    assert got == sorted([*want, ("w", "q", "KNOWN")])


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_live_rows_in_levels(spark, tmp_path):
    rng, state = random.Random(1), S.LiveState(str(tmp_path), spark.createDataFrame([], "k long, n long, v string").schema, "k", [F.col("n")])
    want, n = {}, 0
    for number in range(10):
        batch = []
        for _ in range(40):
            n += 1
            batch.append((rng.randint(0, 30), n if rng.random() < 0.9 else n - 100, f"v{n}"))
        frame = spark.createDataFrame(batch, "k long, n long, v string").coalesce(1)
        state.merge(frame, number)
        if number == 6:
            state.merge(frame, number)  # a replay changes nothing
        for k, at, v in batch:
            if k not in want or at > want[k][0]:
                want[k] = (at, v)
        got = {r["k"]: (r["n"], r["v"]) for r in state.last(spark, number).collect()}
        assert got == want
        assert all(len([1 for level, _ in state.index(spark, number) if level == x]) < S.FANOUT for x in range(5))
    assert len(state.index(spark, 9)) == 4  # two runs each of levels 0 and 1
    runs = [d for d in os.listdir(tmp_path) if d.startswith("run-")]
    assert len(runs) == 10 + 2  # each batch one, and a merge every FANOUT batches


def test_unseen_and_chat(spark):
    lines = spark.createDataFrame([("12:00:01,123 - [Trade] Ann : WTS x",), ("nothing",), (None,)], "value string")
    assert [tuple(r) for r in S.chat_messages(lines).collect()] == [("12:00:01", "Trade", "Ann", "WTS x")]
