"""A keyed cache over a stream: what to ask a provider, what is known, what waits, with bounded state for each key.

Every key keeps at most ``most`` known texts and at most ``most`` waiting ones,
the oldest out first. A failure makes the key back off: its texts wait until
the time is over, which doubles with each failure in a row; a timer of event
time then asks for what waits, whether or not the key has new rows. A key that
says nothing for ``idle`` is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .live import shared_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ACTIONS = "key string, at timestamp, text string, action string"
#: Milliseconds that a key waits after a first failure, and after one for too many requests.
FAILED, LIMITED = 15_000, 45_000


class Recent:
    """What is kept of a key. A plain object, so that it can be tried without a stream."""

    def __init__(self, most: int, known=(), waiting=(), failures: int = 0, until: int = 0, last: int = 0):
        self.most, self.known, self.waiting = most, list(known), list(waiting)
        self.failures, self.until, self.last = failures, until, last

    def _push(self, rows: list, text: str) -> list[str]:
        """``text`` at the end of ``rows``; what falls out at the begin."""
        if text in rows:
            rows.remove(text)
        rows.append(text)
        out = rows[: max(0, len(rows) - self.most)]
        del rows[: len(out)]
        return out

    def ask(self, text: str) -> str:
        self._push(self.known, text)
        return "ASK"

    def release(self) -> list[tuple[str, str]]:
        """Ask for all that waits."""
        texts, self.waiting = self.waiting, []
        return [(t, self.ask(t)) for t in texts]

    def message(self, at: int, text: str) -> list[tuple[str, str]]:
        self.last = max(self.last, at)
        if at >= self.until:
            out = self.release()
            return [*out, (text, "KNOWN" if text in self.known else self.ask(text))]
        if text in self.known:
            return [(text, "KNOWN")]
        return [(text, "WAIT"), *((t, "DROPPED") for t in self._push(self.waiting, text))]

    def outcome(self, at: int, text: str, outcome: str) -> list[tuple[str, str]]:
        """A provider's answer: ``ok``, or a failure, after which the text is not known and waits."""
        self.last = max(self.last, at)
        if outcome == "ok":
            self.failures = self.until = 0
            self._push(self.known, text)
            return self.release()
        self.failures += 1
        self.until = max(self.until, at + (LIMITED if outcome == "limited" else FAILED) * 2 ** (self.failures - 1))
        if text in self.known:
            self.known.remove(text)
        return [(text, "WAIT"), *((t, "DROPPED") for t in self._push(self.waiting, text))]


class _Processor(StatefulProcessor):
    def __init__(self, most: int, idle: int):
        self.most, self.idle = most, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("recent", "known array<string>, waiting array<string>, failures int, until long, last long, timer long")

    def _load(self) -> tuple[Recent, int | None]:
        """What is kept of the key, and its timer."""
        known, waiting, failures, until, last, timer = self.state.get() or ((), (), 0, 0, 0, None)
        return Recent(self.most, known, waiting, failures, until, last), timer

    def _due(self, kept: Recent) -> int:
        return kept.until if kept.waiting else kept.last + self.idle

    def _save(self, kept: Recent, timer: int | None, key: str, out: list[tuple]) -> Iterator[Row]:
        """Every call to the store costs as much as many rows, so a timer that comes too early is left, and set anew when it has come."""
        due = self._due(kept)
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.state.update((kept.known, kept.waiting, kept.failures, kept.until, kept.last, timer))
        for at, text, action in out:
            yield Row(key=key, millis=at, text=text, action=action)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (kept, timer), out = self._load(), []
        for at, text, outcome in sorted(((r["millis"], r["text"], r["outcome"]) for r in rows), key=lambda r: r[:2]):
            said = kept.message(at, text) if outcome is None else kept.outcome(at, text, outcome)
            out += [(at, *x) for x in said]
        yield from self._save(kept, timer, key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept, _ = self._load()
        due = self._due(kept)
        come = due <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        if come and not kept.waiting:
            self.state.clear()
        else:
            yield from self._save(kept, None, key[0], [(due, *x) for x in kept.release()] if come else [])


def cached(stream: DataFrame, key: str, time: str, text: str, outcome: str | None = None, most: int = 100, idle: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """``key, at, text, action`` of a stream's rows: ``ASK``, ``KNOWN``, ``WAIT`` or ``DROPPED``.

    Rows of one key and micro-batch are taken by time, then text. ``outcome`` is
    null for a message and else what a provider said of the text. Rows without
    a time or text are left out; a null key is the empty one. The session's
    state store must be RocksDB (see ``PROVIDER``).
    """
    at = F.col(time).cast("timestamp")
    said = F.lit(None).cast("string") if outcome is None else F.col(outcome)
    rows = stream.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), at.alias("event_time"), F.unix_millis(at).alias("millis"), F.col(text).alias("text"), said.alias("outcome"))
    rows = rows.where("millis is not null and text is not null").withWatermark("event_time", late)
    span = int(pd.Timedelta(idle).total_seconds() * 1000)
    out = rows.groupBy("key").transformWithState(_Processor(most, span), "key string, millis long, text string, action string", "Append", "EventTime")
    return out.select("key", F.timestamp_millis("millis").alias("at"), "text", "action")


def run_cached(stream: DataFrame, **options) -> DataFrame:
    """Run ``cached`` over what is there now, and return what it wrote."""
    spark: SparkSession = stream.sparkSession
    base, before = shared_folder(spark), spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        out = cached(stream, **options).writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(ACTIONS).parquet(f"{base}/rows")
