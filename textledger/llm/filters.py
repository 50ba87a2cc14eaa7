"""Filter interaction audit: what each of several filters removes, in every order they could be applied in.

Every filter leaves sorted posting lists: per part (a source) and id range, the
places of the documents that fail it, ascending by id. What a set of filters
removes together is the union of its lists, what one removes after others is
the difference of its list and their union; both are k-way merges that gallop
over runs of ids which other lists do not touch. Sizes are summed over ranges.
A range holds at most ``RANGE`` documents, so a part of any size is spread over
tasks, and no merge holds more than a range.

Nulls: a null text is empty; a null part is the empty string; a null id is
below all others, equal to no other, and has no label. Empty texts fail A and
equal each other. Texts of any length are read whole. Rows that repeat count
each; of equal texts those of the least id stay, however many rows have it.
Labels that repeat count once if any says 1. An empty table gives no rows.
Extra columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, lookup, settle, slices

FILTERS = "ABCDE"
MIN_WORDS = 50
#: Distinct words of all words, and capitals of all code points, in per cent.
MIN_DISTINCT, MAX_CAPITALS = 65, 5
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = re.compile(rb"[#$%&*|]")
#: Documents of a range, at most.
RANGE = 1 << 16

_FLAGS = "doc_id long, part string, bits int, digest binary"
_LISTS = "part string, ids array<long>, fails array<array<int>>, good array<int>, toxic array<int>"
_COUNTS = "part string, filter long, before long, n long, failing long, removed long, gone long, good long, toxic long"


def failed(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at ASCII blanks, as bytes have no others
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
        | (100 * capitals > MAX_CAPITALS * len(text)) << 2
        | (_MARKS.search(raw) is not None) << 3
    )


def _flags(batches):
    for batch in slices(batches):
        texts = column(batch, "text", "")
        digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(map(failed, texts), pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "bits", "digest"])


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, part, row, bits, good, toxic`` of every document: bit ``i`` says that it fails filter ``i``."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    rows = settle(read.mapInArrow(_flags, _FLAGS), "filter-flags").withColumn("row", F.monotonically_increasing_id())
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    rows = lookup(rows, least, "digest").select("doc_id", "part", "row", (F.col("bits") + F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0)).alias("bits"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max((F.col(old) == 1).cast("int")).alias(new) for old, new in (("quality", "good"), ("toxic", "toxic"))])
    known = rows.where("doc_id is not null").join(marks, "doc_id", "left")
    whole = known.unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    return whole.withColumns({c: F.coalesce(c, F.lit(0)) == 1 for c in ("good", "toxic")})


def _lists(batches):
    part, ids, bits, good, toxic = None, [], [], [], []

    def row():
        fails = [[at for at, b in enumerate(bits) if b >> f & 1] for f in range(len(FILTERS))]
        marked = [[at for at, m in enumerate(marks) if m] for marks in (good, toxic)]
        kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.int32())]
        data = [pa.array([v], k) for v, k in zip((part, ids, fails, *marked), kinds)]
        return pa.RecordBatch.from_arrays(data, names=["part", "ids", "fails", "good", "toxic"])

    for batch in batches:
        for p, i, b, g, t in zip(*(column(batch, c) for c in ("part", "doc_id", "bits", "good", "toxic"))):
            if ids and (p != part or len(ids) >= RANGE):
                yield row()
                ids, bits, good, toxic = [], [], [], []
            part = p
            ids.append(i)
            bits.append(b)
            good.append(g)
            toxic.append(t)
    if ids:
        yield row()


def postings(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The settled posting lists, a row per part and id range.

    ``ids`` are the range's ids in order (equal and null ones each); ``fails``
    has for each filter the places in ``ids`` that fail it, ``good`` and
    ``toxic`` those labelled so.
    """
    order = ["part", F.col("doc_id").asc_nulls_first(), "row"]
    dealt = flagged(docs, labels).repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(dealt.select("part", "doc_id", "bits", "good", "toxic").mapInArrow(_lists, _LISTS), "postings")


def failing_ids(lists: DataFrame, name: str) -> DataFrame:
    """``part, doc_id`` of all documents that fail the filter ``name``."""
    at = F.explode(F.col("fails")[FILTERS.index(name)]).alias("at")
    return lists.select("part", "ids", at).select("part", F.col("ids")[F.col("at")].alias("doc_id"))


def gallop(xs: list[int], at: int, limit: int) -> int:
    """The first place of ``xs`` from ``at`` on that is not below ``limit``: steps double, then halve."""
    step = 1
    while at + step <= len(xs) and xs[at + step - 1] < limit:
        at += step
        step += step
    return bisect_left(xs, limit, at, min(len(xs), at + step - 1))


def union(lists: list[list[int]]) -> list[int]:
    """The ascending union of ascending lists. The list with the least head gives all it has before the next head."""
    live, out = [[x[0], 0, x] for x in lists if x], []
    while len(live) > 1:
        live.sort(key=lambda c: c[0])
        (_, at, xs), limit = live[0], live[1][0]
        end = gallop(xs, at, limit)
        out += xs[at:end]
        end += end < len(xs) and xs[end] == limit  # the other list has it too
        if end < len(xs):
            live[0][:2] = xs[end], end
        else:
            del live[0]
    return out + (live[0][2][live[0][1] :] if live else [])


def difference(xs: list[int], ys: list[int]) -> list[int]:
    """What the ascending list ``xs`` has that ``ys`` has not."""
    out, i, j = [], 0, 0
    while i < len(xs) and j < len(ys):
        end = gallop(xs, i, ys[j])
        out += xs[i:end]
        if end < len(xs):
            j = gallop(ys, j, xs[end])
            end += j < len(ys) and xs[end] == ys[j]
        i = end
    return out + xs[i:]


def _counts(batches):
    sets = 1 << len(FILTERS)
    for batch in slices(batches, 1):
        part, ids, fails, good, toxic = (batch.column(c)[0].as_py() for c in ("part", "ids", "fails", "good", "toxic"))
        rows = []
        for before in range(sets):
            gone = union([x for f, x in enumerate(fails) if before >> f & 1])
            for f, own in enumerate(fails):
                if not before >> f & 1:
                    here = difference(own, gone)
                    lost = [len(here) - len(difference(here, marked)) for marked in (good, toxic)]
                    rows.append((part, f, before, len(ids), len(own), len(here), len(gone) + len(here), *lost))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["part", "filter", "before", "n", "failing", "removed", "gone", "good", "toxic"])


def interactions(lists: DataFrame) -> DataFrame:
    """Per part, filter and set of filters applied before it (``before``, as bits): documents, those failing the filter, removed here, gone after it, and labelled ones lost."""
    return lists.mapInArrow(_counts, _COUNTS).groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in ("n", "failing", "removed", "gone", "good", "toxic")])


def _weight(before: Column) -> Column:
    """In how many orders exactly the filters of ``before`` come first."""
    k = len(FILTERS)
    orders = F.array(*[F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k)])
    return orders[F.bit_count(before)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step: see the columns' names.

    ``shapley`` is what the step's filter removes, summed over all orders.
    """
    found = settle(interactions(postings(docs, labels)), "interactions")
    own = W.partitionBy("part", "filter")  # a row per set of the other filters
    last = F.bit_count("before") == len(FILTERS) - 1
    found = found.withColumns(
        {
            "unique_fails": F.max(F.when(last, F.col("removed"))).over(own),
            "shapley": F.sum(F.col("removed") * _weight(F.col("before"))).over(own),
        }
    )
    steps = [("".join(o), i + 1, FILTERS.index(f), sum(1 << FILTERS.index(x) for x in o[:i])) for o in permutations(FILTERS) for i, f in enumerate(o)]
    orders = F.broadcast(docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter long, before long"))  # as many as the filters have orders and steps
    return found.join(orders, ["filter", "before"]).select(
        "part",
        "filter_order",
        "step",
        (F.col("n") - F.col("gone")).alias("kept"),
        "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails",
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        "shapley",
    )
