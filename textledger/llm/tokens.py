"""Token-id output: a wavelet matrix per shard.

Documents are dealt to buckets of rising ids, encoded, and packed into shards
of at most ``SHARD_TOKENS`` tokens (a longer document has a shard of its own).
A shard is one row of a Parquet file: the bit planes of its ids (most
significant first, each level stably partitioned by its bit, with the number
of ones before every 512th bit) and a directory of documents. Tokens are read
back, counted and located from the planes alone, by rank and select.

Nulls: a null text is empty, so it is the end id alone. Null ids come first;
rows of equal ids are ordered by text; repeated rows are each written. An empty
table writes no shard. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, mix64, order_buckets, place_weights, runs, settle, slices

END_ID = 0
SHARD_TOKENS = 1 << 19
#: Code points of the pieces whose ids a worker remembers, about at most; with more it begins anew.
REMEMBERED = 8_000_000
#: A text with a longer piece than this is encoded whole.
LONGEST = 1024
_RUN = 1_000_000
_GROUP = 512

_KINDS: np.ndarray | None = None
#: A blank or none, then letters: one word of the byte-level pattern.
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")


def _kinds_table() -> np.ndarray:
    """Code point to 1 for Latin letters, 2 for ASCII marks other than the apostrophe, 3 for other visible ASCII, else 0."""
    global _KINDS
    if _KINDS is None:
        table = np.zeros(0x110000, np.uint8)
        for cp in range(33, 0x250):
            ch = chr(cp)
            if ch.isalpha() and (cp < 127 or cp >= 0xC0):
                table[cp] = 1
            elif cp < 127:
                table[cp] = 3 if ch.isdigit() or ch == "'" else 2
        _KINDS = table
    return _KINDS


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible bytes stand for themselves, the others for letters from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts with a tokenizer file of the tokenizers library.

    For a byte-level BPE with the usual word pattern, texts are cut where that
    pattern always ends a word: before a blank or line feed that follows a
    visible character, before a mark that follows a letter, after a line feed
    between visible characters. The library encodes each distinct piece once;
    its ids are remembered. A piece is found by a hash and then compared code
    point by code point; a text with a piece that differs is encoded whole. So
    are texts that contain an added token (as ``<|endoftext|>``) or a piece of
    more than ``LONGEST`` code points, and all texts of other tokenizers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(path)
        added = [re.escape(x.content) for x in t.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        pre = t.pre_tokenizer
        self.cuts = isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space and t.normalizer is None and isinstance(t.model, models.BPE)
        self.model, self.letters = t.model, _byte_letters()
        self._forget()

    def _forget(self):
        self.keys = np.zeros(0, np.uint64)
        self.offs, self.lens, self.froms, self.sizes = (np.zeros(0, np.int64) for _ in range(4))  # of the ids, of the code points
        self.pool, self.codes = np.zeros(0, np.uint32), np.zeros(0, np.uint32)

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        other = []
        for i, piece in enumerate(pieces):
            if _WORD.fullmatch(piece):
                out[i] = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
            else:
                other.append(i)
        for i, found in zip(other, self.tokenizer.encode_batch_fast([pieces[i] for i in other], add_special_tokens=False)):
            out[i] = found.ids
        return out

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Remember the ids of pieces with new ``hashes`` (ascending)."""
        found = self._ids(pieces)
        lens, sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (found, pieces))
        keys = np.concatenate((self.keys, hashes))
        by = np.argsort(keys, kind="stable")  # two sorted runs
        self.keys = keys[by]
        self.offs = np.concatenate((self.offs, len(self.pool) + np.cumsum(lens) - lens))[by]
        self.lens = np.concatenate((self.lens, lens))[by]
        self.froms = np.concatenate((self.froms, len(self.codes) + np.cumsum(sizes) - sizes))[by]
        self.sizes = np.concatenate((self.sizes, sizes))[by]
        self.pool = np.concatenate((self.pool, np.fromiter((i for f in found for i in f), np.uint32, int(lens.sum()))))
        self.codes = np.concatenate((self.codes, np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)))

    def _run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts, how many each has, and the texts for which they do not hold."""
        joined = "\n".join(texts) + "\n"
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1  # the separators
        kind = _kinds_table()[c]
        feed = c == 10
        begins = np.zeros(len(c) + 1, bool)
        cut = begins[:-1]
        cut[1:] = (feed[1:] | (c[1:] == 32)) & (kind[:-1] > 0)
        cut[1:] |= (kind[1:] == 2) & (kind[:-1] == 1)
        cut[2:] |= (kind[2:] > 0) & feed[1:-1] & (kind[:-2] > 0)
        begins[0] = True
        begins[ends] = True
        begins[ends + 1] = True
        at = np.flatnonzero(begins)
        size, at = np.diff(at), at[:-1]
        values = (c.astype(np.uint64) + np.uint64(1)) * place_weights(np.arange(len(c)) - np.repeat(at, size))
        h = mix64(np.add.reduceat(values, at) + size.astype(np.uint64))
        text = ~np.isin(at, ends, assume_unique=True) & (size <= LONGEST)
        long = np.searchsorted(ends, at[size > LONGEST])
        at, size, h = at[text], size[text], h[text]
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64), np.unique(long)
        order = np.argsort(h)
        sorted_h = h[order]
        new = np.diff(sorted_h, prepend=sorted_h[:1] - np.uint64(1)) != 0
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        uniq, rep = sorted_h[new], order[new]
        if len(self.codes) > REMEMBERED:
            self._forget()
        spot = np.searchsorted(self.keys, uniq)
        spot[spot == len(self.keys)] = 0
        missing = np.flatnonzero(self.keys[spot] != uniq) if len(self.keys) else np.arange(len(uniq))
        if len(missing):
            self._learn(uniq[missing], [joined[a : a + n] for a, n in zip(at[rep[missing]].tolist(), size[rep[missing]].tolist())])
            spot = np.searchsorted(self.keys, uniq)
        entry = spot[which]
        same = np.minimum(size, self.sizes[entry])
        upto = np.cumsum(same)
        inner = np.arange(int(upto[-1])) - np.repeat(upto - same, same)
        differs = np.add.reduceat(c[np.repeat(at, same) + inner] != self.codes[np.repeat(self.froms[entry], same) + inner], upto - same, dtype=np.int64)
        other = np.searchsorted(ends, at[(differs > 0) | (size != self.sizes[entry])])
        n, off = self.lens[entry], self.offs[entry]
        upto = np.cumsum(n)
        ids = self.pool[np.repeat(off - (upto - n), n) + np.arange(int(upto[-1]))]
        return ids, np.diff(np.concatenate(([0], upto))[np.searchsorted(at, ends)], prepend=0), np.unique(np.concatenate((long, other)))

    def encode(self, texts: list[str], end: int = END_ID) -> list[np.ndarray]:
        """The ids of each text, and the end id after them."""
        out = []
        for i, j in runs(texts, _RUN):
            some = texts[i:j]
            if self.cuts:
                added = {k for k, t in enumerate(some) if self.added and self.added.search(t)}
                ids, counts, others = self._run(["" if k in added else t for k, t in enumerate(some)])
                parts = np.split(ids, np.cumsum(counts)[:-1])
                whole = sorted(added.union(others.tolist()))
            else:
                parts, whole = [np.zeros(0, np.uint32)] * len(some), list(range(len(some)))
            if whole:
                for k, found in zip(whole, self.tokenizer.encode_batch_fast([some[k] for k in whole], add_special_tokens=False)):
                    parts[k] = np.array(found.ids, np.uint32)
            out += [np.append(x, np.uint32(end)) for x in parts]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder for a file; later tasks of the worker find it with what it remembers."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Wavelet:
    """A wavelet matrix over a sequence of ids."""

    def __init__(self, n: int, planes: list[tuple[bytes, bytes, int]]):
        self.n, self.depth = n, len(planes)
        self.raw = [np.frombuffer(bits, np.uint8) for bits, _, _ in planes]
        self.ranks = [np.frombuffer(ranks, "<u4") for _, ranks, _ in planes]
        self.zeros = [z for _, _, z in planes]
        self._padded = None

    @staticmethod
    def build(ids: np.ndarray) -> list[tuple[bytes, bytes, int]]:
        """The planes of ``ids``: packed bits, ones before each group of bits, number of zeros."""
        depth = max(1, int(ids.max(initial=0)).bit_length())
        level = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        planes = []
        for b in range(depth - 1, -1, -1):
            bit = (level >> np.array(b, level.dtype)) & np.array(1, level.dtype)
            ones = bit.astype(bool)
            groups = np.add.reduceat(ones, np.arange(0, len(ones), _GROUP), dtype=np.uint32) if len(ones) else np.zeros(0, np.uint32)
            ranks = (np.cumsum(groups) - groups).astype("<u4")
            low = level.take(np.flatnonzero(~ones))
            planes.append((np.packbits(ones).tobytes(), ranks.tobytes(), len(low)))
            level = np.concatenate((low, level.take(np.flatnonzero(ones))))
        return planes

    def bit(self, level: int, i: int) -> int:
        return int(self.raw[level][i >> 3] >> (7 - (i & 7)) & 1)

    def rank1(self, level: int, i: int) -> int:
        """Ones before position ``i``."""
        if i >= self.n:
            return self.n - self.zeros[level]
        g = i // _GROUP
        part = np.unpackbits(self.raw[level][g * _GROUP // 8 : (i + 7) // 8])[: i - g * _GROUP]
        return int(self.ranks[level][g]) + int(part.sum())

    def select(self, level: int, one: bool, k: int) -> int:
        """Position of the ``k``-th (from 0) one or zero."""
        starts = self.ranks[level].astype(np.int64)
        if not one:
            starts = np.arange(len(starts)) * _GROUP - starts
        g = int(np.searchsorted(starts, k, "right")) - 1
        part = np.unpackbits(self.raw[level][g * _GROUP // 8 : (g + 1) * _GROUP // 8])[: self.n - g * _GROUP]
        return g * _GROUP + int(np.flatnonzero(part == one)[k - starts[g]])

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        out = 0
        for level in range(self.depth):
            ones = self.rank1(level, i)
            one = self.bit(level, i)
            out = out << 1 | one
            i = self.zeros[level] + ones if one else i - ones
        return out

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        for level in range(self.depth):
            x, y = self.rank1(level, a), self.rank1(level, b)
            if token >> (self.depth - 1 - level) & 1:
                a, b = self.zeros[level] + x, self.zeros[level] + y
            else:
                a, b = a - x, b - y
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of ``token`` in positions ``a`` to ``b``."""
        if token >> self.depth:
            return 0
        x, y = self._range(token, a, self.n if b is None else b)
        return y - x

    def locate(self, token: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0, self.n)[0] + k
        for level in range(self.depth - 1, -1, -1):
            one = bool(token >> (self.depth - 1 - level) & 1)
            i = self.select(level, one, i - self.zeros[level] if one else i)
        return i

    def _rows(self, level: int, group: np.ndarray) -> np.ndarray:
        """The bytes of groups of bits, as rows."""
        if self._padded is None:
            size = _GROUP // 8
            self._padded = [np.pad(raw, (0, size - len(raw) % size)).reshape(-1, size) for raw in self.raw]
        return self._padded[level][np.minimum(group, len(self._padded[level]) - 1)]

    def ranks1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each of many positions: the directory's count and those of the group's bytes."""
        group, rest = at // _GROUP, at % _GROUP
        known = np.append(self.ranks[level].astype(np.int64), self.n - self.zeros[level])
        rows = self._rows(level, group)
        whole = np.bitwise_count(rows) * (np.arange(_GROUP // 8) < (rest >> 3)[:, None])
        last = np.take_along_axis(rows, (rest >> 3)[:, None], 1)[:, 0] & (0xFF00 >> (rest & 7)).astype(np.uint8)
        return np.where(at >= self.n, known[-1], known[np.minimum(group, len(known) - 1)] + whole.sum(axis=1, dtype=np.int64) + np.bitwise_count(last))

    def selects(self, level: int, one: bool, k: np.ndarray) -> np.ndarray:
        """Positions of the ones or zeros of many ranks."""
        starts = self.ranks[level].astype(np.int64)
        if not one:
            starts = np.arange(len(starts)) * _GROUP - starts
        group = np.searchsorted(starts, k, "right") - 1
        bits = np.unpackbits(self._rows(level, group), axis=1)
        bits = bits if one else 1 - bits
        return group * _GROUP + np.argmax(np.cumsum(bits, axis=1) > (k - starts[group])[:, None], axis=1)

    def accesses(self, at: np.ndarray) -> np.ndarray:
        """The ids at many positions."""
        out = np.zeros(len(at), np.int64)
        for level in range(self.depth):
            ones = self.ranks1(level, at)
            bit = self.raw[level][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
            out = out << 1 | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return out

    def counts(self, token: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Occurrences of ``token`` in many ranges of positions."""
        if token >> self.depth:
            return np.zeros(len(a), np.int64)
        for level in range(self.depth):
            x, y = self.ranks1(level, a), self.ranks1(level, b)
            one = token >> (self.depth - 1 - level) & 1
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if one else (a - x, b - y)
        return b - a

    def places(self, token: int) -> np.ndarray:
        """The positions of all occurrences of ``token``, ascending."""
        if token >> self.depth:
            return np.zeros(0, np.int64)
        a, b = self._range(token, 0, self.n)
        at = np.arange(a, b)
        for level in range(self.depth - 1, -1, -1):
            one = bool(token >> (self.depth - 1 - level) & 1)
            at = self.selects(level, one, at - self.zeros[level] if one else at) if len(at) else at
        return at

    def decode(self) -> np.ndarray:
        """All ids, by undoing the partitions from the last level up."""
        kind = np.uint16 if self.depth <= 16 else np.uint32
        level = np.zeros(self.n, kind)
        for k in range(self.depth - 1, -1, -1):
            ones = np.unpackbits(self.raw[k], count=self.n).view(bool)
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~ones)], up[np.flatnonzero(ones)] = level[: self.zeros[k]], level[self.zeros[k] :]
            up |= ones.astype(kind) << np.array(self.depth - 1 - k, kind)
            level = up
        return level.astype(np.uint32)


_PLANES = "array<struct<bits:binary,ranks:binary,zeros:long>>"
SHARD = f"bucket int, part int, n_tokens long, doc_ids array<long>, lengths array<long>, planes {_PLANES}"


def _pack(path: str, end: int):
    def pack(batches):
        encoder, bucket, part, ids, data, size = encoder_of(path), None, 0, [], [], 0

        def shard():
            tokens = np.concatenate(data)
            planes = [{"bits": x, "ranks": y, "zeros": z} for x, y, z in Wavelet.build(tokens)]
            row = {"bucket": bucket, "part": part, "n_tokens": len(tokens), "doc_ids": ids, "lengths": [len(d) for d in data], "planes": planes}
            kind = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("planes", pa.list_(pa.struct([("bits", pa.binary()), ("ranks", pa.binary()), ("zeros", pa.int64())])))])
            return pa.RecordBatch.from_pylist([row], schema=kind)

        for batch in slices(batches, 512):
            for b, i, x in zip(column(batch, "_b"), column(batch, "_id"), encoder.encode(column(batch, "_text", ""), end)):
                if data and (b != bucket or size + len(x) > SHARD_TOKENS):
                    yield shard()
                    part = part + 1 if b == bucket else 0
                    ids, data, size = [], [], 0
                bucket = b
                ids.append(i)
                data.append(x)
                size += len(x)
        if data:
            yield shard()

    return pack


def write_shards(docs: DataFrame, tokenizer: str, end: int = END_ID) -> DataFrame:
    """Write the shards of ``docs`` to the shared folder; returns the written table, a row per shard.

    Texts are shuffled once, to their place in id order. ``tokenizer`` is the
    path of a tokenizer file that every executor can open.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    rows = order_buckets(rows, "_id", "_b")
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = rows.repartitionById(int(n), "_b").sortWithinPartitions("_b", F.col("_id").asc_nulls_first(), "_text")
    return settle(dealt.mapInArrow(_pack(tokenizer, end), SHARD), "tokens")


def _open(row: dict) -> tuple[Wavelet, np.ndarray]:
    """A shard's matrix, and where its documents begin and end."""
    wavelet = Wavelet(row["n_tokens"], [(p["bits"], p["ranks"], p["zeros"]) for p in row["planes"]])
    return wavelet, np.concatenate(([0], np.cumsum(row["lengths"]))).astype(np.int64)


def _documents(end: int):
    def documents(batches):
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            wavelet, at = _open(row)
            ids = wavelet.decode().astype("<u4")
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at, at[1:])]
            n = len(crc)
            more = [wavelet.accesses(at[:-1]), wavelet.counts(end, at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(at[:-1] + row["before"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64()), pa.array([row["bucket"]] * n, pa.int32()), pa.array([row["part"]] * n, pa.int32()), *[pa.array(x, pa.int64()) for x in more]], names=["doc_id", "start", "n_tokens", "ids_crc32", "bucket", "part", "first_id", "ends"])

    return documents


def ids_at(shards: DataFrame, offset: int) -> DataFrame:
    """``doc_id, id``: the id at ``offset`` of every document, by access alone; null where the document is shorter."""

    def find(batches):
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            wavelet, at = _open(row)
            there = np.array(row["lengths"], np.int64) > offset
            ids = np.zeros(len(there), np.int64)
            ids[there] = wavelet.accesses(at[:-1][there] + offset)
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(ids, pa.int64(), mask=~there)], names=["doc_id", "id"])

    return shards.mapInArrow(find, "doc_id long, id long")


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """``doc_id, token, n``: how often every document has each of ``tokens``, by rank alone; documents without one have no row for it."""

    def find(batches):
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            wavelet, at = _open(row)
            for token in tokens:
                n = wavelet.counts(token, at[:-1], at[1:])
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][k] for k in some], pa.int64()), pa.array([token] * len(some), pa.int64()), pa.array(n[some])], names=["doc_id", "token", "n"])

    return shards.mapInArrow(find, "doc_id long, token long, n long")


def token_places(shards: DataFrame, token: int) -> DataFrame:
    """``doc_id, offset`` of every occurrence of ``token``, by rank and select alone."""

    def find(batches):
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            wavelet, at = _open(row)
            places = wavelet.places(token)
            doc = np.searchsorted(at, places, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][k] for k in doc], pa.int64()), pa.array(places - at[doc])], names=["doc_id", "offset"])

    return shards.mapInArrow(find, "doc_id long, offset long")


def read_documents(shards: DataFrame, end: int = END_ID) -> DataFrame:
    """From written shards: ``doc_id, start, n_tokens, ids_crc32, bucket, part, first_id, ends`` of every document.

    The first id is found by access and the number of end ids by rank.
    """
    sizes = shards.groupBy("bucket").agg(F.sum("n_tokens").alias("all"))  # a row per bucket
    base = sizes.withColumn("base", F.coalesce(F.sum("all").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("bucket", "base")
    parts = shards.select("bucket", "part", "n_tokens")
    inner = W.partitionBy("bucket").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.join(base, "bucket").select("bucket", "part", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).alias("before"))
    # Three numbers per shard. They grow with the input, so the join is Spark's choice, by the size of the written table.
    placed = shards.join(settle(offsets, "offsets"), ["bucket", "part"])
    return placed.mapInArrow(_documents(end), "doc_id long, start long, n_tokens long, ids_crc32 long, bucket int, part int, first_id long, ends long")
