"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with every run of characters other
than letters and digits as one space. An item of n such characters may differ
in ``floor(n * ERROR_RATE)`` edits. It is cut into one piece more than that,
so at least one piece occurs unchanged in any match; exact piece hits are found
with one automaton, then verified up a tree of halves of the item (one of the
halves of a match has at most half of its edits, and so on down to the piece)
with Myers' bit-parallel edit distance.

An item of fewer than ``MIN_CHARS`` characters is looked for without edits and
between word borders (in scripts without blanks, where items have no such
borders, anywhere).

Nulls: a null text or item matches nothing, nor does an item without a letter
or digit. Equal items all match. Repeated rows each give their own results, and
``clean`` judges every row by its own text, whatever its id. Very long texts are
searched whole. An empty table gives an empty result. Extra columns, of any
name, are ignored (``clean`` returns them).
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, slices

ERROR_RATE = 0.1
#: Items of fewer characters allow no edits.
MIN_CHARS = 20
#: Items are matched in blocks of at most so many characters, a pass over the documents each.
BLOCK_CHARS = 4_000_000
_GAPS = re.compile(r"[\W_]+")
#: Scripts that are written without blanks: CJK and kana, Thai, Lao, Burmese, Khmer.
_UNSPACED = re.compile("[\u2e80-\ua4cf\uf900-\ufaff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")


def normal(text: str) -> str:
    return _GAPS.sub(" ", text.lower()).strip()


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to any substring of ``text`` and where that ends, if within ``budget``.

    Myers (1999): the column of the distance matrix is held as two bit vectors.
    """
    m = len(pattern)
    where: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        where[ch] = where.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (m, 0)
    for j, ch in enumerate(text):
        eq = where.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= budget else None


def chain(n: int, budget: int, piece: int) -> list[tuple[int, int, int]]:
    """From piece number ``piece`` up to the whole item: (first, last + 1, edits allowed) for each node of the tree of halves."""
    out, a, b, k = [], 0, budget + 1, budget
    cut = lambda i: n * i // (budget + 1)
    while True:
        out.append((cut(a), cut(b), k))
        if b - a == 1:
            return out[::-1]
        mid = (a + b) // 2
        left = mid - a - 1  # pieces less one: the halves' edits and one for the cut make up the node's
        if piece < mid:
            a, b, k = a, mid, left
        else:
            a, b, k = mid, b, b - mid - 1


class Matcher:
    """All items of one block, ready to be searched for in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, self.auto = [], ahocorasick.Automaton()
        hits: dict[str, list] = {}
        for item_id, raw in items:
            text = normal(raw)
            if not text:
                continue
            if len(text) < MIN_CHARS:
                bound = text if _UNSPACED.search(text) else f" {text} "
                hits.setdefault(bound, []).append((len(self.items), 0, []))
                self.items.append((item_id, bound, 0))
                continue
            budget = int(len(text) * rate)
            for p in range(budget + 1):
                nodes = chain(len(text), budget, p)
                a, b, _ = nodes[0]
                hits.setdefault(text[a:b], []).append((len(self.items), a, nodes[1:]))
            self.items.append((item_id, text, budget))
        for piece, where in hits.items():
            self.auto.add_word(piece, (len(piece), where))
        self.auto.make_automaton()

    def search(self, raw: str, any_: bool = False) -> list[tuple[int, int]]:
        """(item_id, least distance) of every item that occurs in the text (with ``any_``, of one of them)."""
        text, best, tried = f" {normal(raw)} ", {}, set()
        for end, (size, where) in self.auto.iter(text) if self.items else ():
            for item, offset, nodes in where:
                if best.get(item, 1) == 0:
                    continue
                begin = end + 1 - size - offset  # where the item would begin without edits
                key = (item, begin)
                if key in tried:
                    continue
                _, pattern, budget = self.items[item]
                distance = 0
                for a, b, k in nodes:
                    found = myers(pattern[a:b], text[max(0, begin + a - k) : max(0, begin + b + k)], k)
                    if not found:
                        break
                    distance = found[0]
                else:
                    tried.add(key)
                    if not nodes:
                        distance = 0
                    best[item] = min(distance, best.get(item, budget))
                    if any_:
                        return [(self.items[item][0], distance)]
        return sorted((self.items[i][0], d) for i, d in best.items())


_SCHEMA = "doc_id long, item_id long, distance int"


def _blocks(items: DataFrame, rate: float) -> list:
    """The items, as broadcast blocks of at most ``BLOCK_CHARS`` characters (or one item)."""
    spark = items.sparkSession
    rows = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").distinct()
    blocks, block, size = [], [], 0
    for item_id, text in rows.toLocalIterator():
        if block and size + len(text) > BLOCK_CHARS:
            blocks.append(spark.sparkContext.broadcast((block, rate)))
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    return blocks + ([spark.sparkContext.broadcast((block, rate))] if block else [])


def contaminated(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """``doc_id, item_id, distance`` for each item that occurs in a document with at most its budget of edits.

    Documents are scanned where they lie: no shuffle. The items come in blocks
    of bounded size; each block is one pass over the documents.
    """
    result = docs.sparkSession.createDataFrame([], _SCHEMA)

    def search_with(shared):
        def search(batches):
            matcher = Matcher(*shared.value)
            for batch in slices(batches):
                found = [(d, i, n) for d, t in zip(column(batch, "doc_id"), column(batch, "text", "")) for i, n in matcher.search(t)]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "distance"])

        return search

    for shared in _blocks(items, rate):
        result = result.union(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search_with(shared), _SCHEMA))
    return result


def clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` whose text holds no item. Each block of items filters the rows where they lie."""

    def keep_with(shared):
        def keep(batches):
            matcher = Matcher(*shared.value)
            for batch in slices(batches):
                yield batch.filter(pa.array([not matcher.search(t, any_=True) for t in column(batch, "text", "")], pa.bool_()))

        return keep

    for shared in _blocks(items, rate):
        docs = docs.mapInArrow(keep_with(shared), docs.schema)
    return docs
