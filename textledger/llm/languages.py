"""Language identification as a mixture of n-gram models, inferred by expectation-maximisation.

Each language is a distribution over hashed letter trigrams. A document's
language proportions are estimated by EM; the set of languages starts with the
best single one and grows while that raises the likelihood by more than a
penalty per language.

Nulls: null texts, and texts without a letter, are ``und`` with score 0;
training rows without text or language teach nothing. Without any training row
all is ``und``. Ties go to the language first in code-point order. Repeated
rows are kept. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import codes_of, column, keyed_sum, mix64, runs, slices

#: Slots of each language's table, however many languages there are: a task holds languages * SLOTS counts.
SLOTS = 1 << 15
_BLOCK = 1 << 12
PRIOR = 0.5
STEPS = 12
#: What a further language must add to the log likelihood, per log of the document's trigrams.
PENALTY = 4.0

_LETTERS: np.ndarray | None = None


def letters_table() -> np.ndarray:
    """Code point to lower case for letters, to a space for all else."""
    global _LETTERS
    if _LETTERS is None:
        table = np.full(0x110000, 32, np.uint32)
        for cp in range(0x110000):
            ch = chr(cp)
            if ch.isalpha():
                table[cp] = ord(ch.lower()[0])
        _LETTERS = table
    return _LETTERS


def trigrams(texts: list[str], slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, slot, count) of each text's distinct trigrams whose middle is a letter, ascending."""
    c = letters_table()[codes_of(texts)].astype(np.uint64)
    ends = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    owner = np.repeat(np.arange(len(texts)), ends)
    mid = np.flatnonzero(c != 32)
    left = np.where(mid > 0, c[mid - 1], 32).astype(np.uint64)
    h = mix64((left << np.uint64(42)) + (c[mid] << np.uint64(21)) + c[mid + 1])
    key, n = np.unique(owner[mid] * slots + (h >> np.uint64(20)).astype(np.int64) % slots, return_counts=True)
    return key // slots, key % slots, n


class Model:
    """Languages and their trigram distributions (languages x slots)."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + PRIOR
        self.p = (smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)

    def mixtures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (texts x languages) and which texts have letters."""
        k = len(self.langs)
        doc, slot, n = trigrams(texts, self.p.shape[1])
        have = np.unique(doc)
        w = np.zeros((len(texts), k))
        if not len(have) or not k:
            return w, np.zeros(len(texts), bool)
        d = np.searchsorted(have, doc)
        starts = np.searchsorted(doc, have)
        p, n = self.p[:, slot].T.astype(np.float64), n.astype(np.float64)
        size = np.add.reduceat(n, starts)
        single = np.add.reduceat(np.log(p) * n[:, None], starts)
        own = np.zeros((len(have), k))
        own[np.arange(len(have)), single.argmax(axis=1)] = 1
        like = single.max(axis=1)
        open_ = np.ones(len(have), bool)
        for _ in range(k - 1):
            rows = np.flatnonzero(open_[d])
            if not len(rows):
                break
            ids, dd = np.unique(d[rows], return_inverse=True)
            at, pp, nn = np.searchsorted(dd, np.arange(len(ids))), p[rows], n[rows]
            s = (pp * own[ids][dd]).sum(axis=1)
            gain = np.add.reduceat(pp * (nn / s)[:, None], at) / size[ids][:, None]
            gain[own[ids] > 0] = 0
            new = gain.argmax(axis=1)
            try_ = own[ids] * 0.9
            try_[np.arange(len(ids)), new] = 0.1
            for _ in range(STEPS):
                q = pp * try_[dd]
                try_ = np.add.reduceat(q * (nn / q.sum(axis=1))[:, None], at) / size[ids][:, None]
            after = np.add.reduceat(nn * np.log((pp * try_[dd]).sum(axis=1)), at)
            better = (gain.max(axis=1) > 1) & (after - like[ids] > PENALTY * np.log(size[ids] + 1))
            own[ids[better]], like[ids[better]] = try_[better], after[better]
            open_[ids[~better]] = False
        w[have] = own
        letters = np.zeros(len(texts), bool)
        letters[have] = True
        return w, letters


def learn(rows: DataFrame) -> Model:
    """Count trigrams by language over all rows of ``text, lang``."""
    langs = sorted(r[0] for r in rows.where("lang is not null and text is not null").select("lang").distinct().collect())
    slots = SLOTS
    number = {x: i for i, x in enumerate(langs)}
    size = slots * len(langs)

    def count(batches):
        table, seen = np.zeros(size, np.int64), 0
        for batch in slices(batches):
            texts, which = column(batch, "text"), np.array([number[x] for x in column(batch, "lang")], np.int64)
            seen += len(texts)
            for i, j in runs(texts):
                doc, slot, n = trigrams(texts[i:j], slots)
                table += np.bincount(which[i:j][doc] * slots + slot, n, size).astype(np.int64)
        yield from keyed_sum.emit(table, seen, _BLOCK)

    if not langs:
        return Model([], np.zeros((0, slots)))
    counts, _ = keyed_sum.total(rows.where("lang is not null and text is not null").select("text", "lang").mapInArrow(count, keyed_sum.SCHEMA), size, _BLOCK)
    return Model(langs, counts.reshape(len(langs), slots))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, mixture`` for all of ``docs``; ``mixture`` maps languages to proportions."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        own = shared.value
        for batch in slices(batches):
            texts = column(batch, "text", "")
            parts = [own.mixtures(texts[i:j]) for i, j in runs(texts)]
            w, some = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
            lead = w.argmax(axis=1) if w.shape[1] else np.zeros(len(texts), int)
            names = [own.langs[i] if s else "und" for i, s in zip(lead, some)]
            score = np.where(some, w.max(axis=1, initial=0), 0.0).clip(0, 1)
            mixed = [[(own.langs[i], float(x[i])) for i in np.flatnonzero(x > 0)] for x in w]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(score), pa.array(mixed, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "mixture"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, mixture map<string,double>")
