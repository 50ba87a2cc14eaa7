"""Merkle manifest of a dataset: a leaf per document, a tree per language, one root, and a proof for each leaf.

Leaf coordinates come from ranks, not from a sort. Every language's ids are
merged into compressed bitmaps, one container per 8,192 ids (ascending
16-bit numbers where there are few, else bits with a popcount directory), and
a leaf's place is the number of ids in the containers before plus its rank in
its own. Then slots are filled by coordinate: the leaves of one subtree of
``LEVELS`` levels are one row of a table, laid at their slots and hashed up in
one task; the subtrees' tops are the next table's leaves. Sibling paths come
down the same tables.

Nulls: a null field is hashed as ``-``; a null language is a tree of its own,
before the others; null ids stand before all others and are never tampered
with. Rows of one id and language stand in the order of their leaves; equal
rows have equal leaves and a place each. Empty and very long texts are hashed
as they are. An empty table has no rows and no root. Extra columns, of any
name, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, running_offsets, settle, slices

#: Children of a node, levels of a subtree that one task builds, and so the leaves of a subtree.
WIDTH, LEVELS = 8, 4
BLOCK = WIDTH**LEVELS
#: Ids of a container (as bits of the id), from how many on it is kept as bits, and bits that share an entry of the directory.
SPAN_BITS, GROUP = 13, 512
SPAN = 1 << SPAN_BITS
SPARSE = SPAN // 16
#: Where null ids are counted: a container before all others.
NO_ID = -(2**63)

_PIECE = "part string, hi long, data binary, again binary"
_CONTAINER = "part string, hi long, n long, data binary, again binary, directory binary"
_PLACED = "part string, idx long, total long, doc_id long, leaf binary, changed binary"
_BLOCKS = "part string, block long, below long, total long, doc_ids array<long>, leaves binary, changed binary, leaf binary"
_PATHS = "part string, block long, root binary, subroot binary, lefts array<string>, rights array<string>"
_PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_AGAIN = np.dtype([("low", "<u2"), ("more", "<i8")])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaves(docs: DataFrame) -> DataFrame:
    """The settled ``part, doc_id, leaf, changed``; ``part`` stands for the language and sorts like it, null first; ``changed`` is a tampered document's leaf."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def leaf(text: Column) -> Column:
        return F.unhex(F.sha2(F.concat(*map(_field, (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))), 256))

    part = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit(""))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = docs.select(part.alias("part"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("leaf"), F.when(tampered, leaf(lower)).alias("changed"))
    return settle(found, "leaves")


def _squeeze(lows: np.ndarray) -> bytes:
    """Ascending distinct 16-bit numbers, as they are or as SPAN bits, whichever is shorter."""
    if len(lows) < SPARSE:
        return lows.astype("<u2").tobytes()
    bits = np.zeros(SPAN, np.uint8)
    bits[lows] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _lows(data: bytes) -> np.ndarray:
    if len(data) < SPAN // 8:
        return np.frombuffer(data, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")).astype(np.uint16)


def _more(lows: np.ndarray, counts: np.ndarray) -> bytes:
    """Numbers that occur more than once, and how many times more."""
    out = np.zeros(int((counts > 1).sum()), _AGAIN)
    out["low"], out["more"] = lows[counts > 1], counts[counts > 1] - 1
    return out.tobytes()


def _pieces(batches):
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        names = batch.column("part").dictionary_encode()
        order = np.lexsort((ids, names.indices.to_numpy()))
        ids, code = ids[order], names.indices.to_numpy()[order]
        hi = ids >> SPAN_BITS
        at = np.flatnonzero((np.diff(hi, prepend=hi[:1] - 1) != 0) | (np.diff(code, prepend=code[:1] - 1) != 0)) if len(ids) else []
        data, again = [], []
        for a, b in zip(at, np.append(at[1:], len(ids))):
            lows, counts = np.unique((ids[a:b] & (SPAN - 1)).astype(np.uint16), return_counts=True)
            data.append(_squeeze(lows))
            again.append(_more(lows, counts))
        if data:
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(code[at])), pa.array(hi[at], pa.int64()), pa.array(data, pa.binary()), pa.array(again, pa.binary())], names=["part", "hi", "data", "again"])


def _merge(pieces: pa.Table) -> pa.Table:
    """One container of all pieces, with ones before every GROUP bits."""
    seen = np.zeros(SPAN, np.int64)
    for data, again in zip(pieces.column("data").to_pylist(), pieces.column("again").to_pylist()):
        seen[_lows(data)] += 1
        more = np.frombuffer(again, _AGAIN)
        seen[more["low"]] += more["more"]
    lows = np.flatnonzero(seen)
    ones = np.bincount(lows // GROUP, minlength=SPAN // GROUP)
    row = [seen.sum(), _squeeze(lows), _more(lows, seen[lows]), (np.cumsum(ones) - ones).astype("<u4").tobytes() if len(lows) >= SPARSE else b""]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pieces.column("part").slice(0, 1), pieces.column("hi").slice(0, 1), *[pa.array([v], k) for v, k in zip(row, kinds)]], names=["part", "hi", "n", "data", "again", "directory"])


class Ranks:
    """Rank queries on a container."""

    def __init__(self, data: bytes, again: bytes, directory: bytes):
        self.dense = len(data) == SPAN // 8
        self.words = np.frombuffer(data, "<u8" if self.dense else "<u2")
        self.before = np.frombuffer(directory, "<u4")
        self.again = np.frombuffer(again, _AGAIN)
        self.more = np.concatenate(([0], np.cumsum(self.again["more"])))
        self.seen: dict[int, int] = {}

    def rank(self, low: np.ndarray) -> np.ndarray:
        """How many rows of the container have a smaller id."""
        if self.dense:
            out = self.before[low // GROUP].astype(np.int64)
            word = low // 64
            for k in range(GROUP // 64 - 1):
                at = word // (GROUP // 64) * (GROUP // 64) + k
                out += np.where(at < word, np.bitwise_count(self.words[at]), 0)
            out += np.bitwise_count(self.words[word] & ((np.uint64(1) << (low % 64).astype(np.uint64)) - np.uint64(1)))
        else:
            out = np.searchsorted(self.words, low.astype(np.uint16)).astype(np.int64)
        return out + self.more[np.searchsorted(self.again["low"], low.astype(np.uint16))]

    def places(self, low: np.ndarray) -> np.ndarray:
        """Ranks, and for each further row of an id one more than for the last."""
        out = self.rank(low)
        if len(self.again):
            for i in np.flatnonzero(np.isin(low, self.again["low"])):
                k = int(low[i])
                out[i] += self.seen.get(k, 0)
                self.seen[k] = self.seen.get(k, 0) + 1
        return out


def containers(rows: DataFrame) -> DataFrame:
    """The settled bitmaps of every part's ids, with the rows ``before`` each container and in all of its part (``total``)."""
    found = rows.where("doc_id is not null").select("part", "doc_id").mapInArrow(_pieces, _PIECE)
    found = found.groupBy("part", "hi").applyInArrow(_merge, _CONTAINER)
    bare = rows.where("doc_id is null").groupBy("part").agg(F.count("*").alias("n")).withColumn("hi", F.lit(NO_ID))
    found = settle(found.unionByName(bare, allowMissingColumns=True), "containers")
    sizes = running_offsets(found.select("part", "hi", "n").withColumn("bucket", F.shiftright("hi", 10)), ["part"], "bucket", [F.col("hi")], F.col("n"), "before")
    totals = found.groupBy("part").agg(F.sum("n").alias("total"), F.count("*").alias("n"))
    known = lookup(settle(sizes.select("part", "hi", "before"), "container-offsets"), totals, "part").drop("n")
    return settle(found.join(known, ["part", "hi"]), "ranked-containers")


def _ranked(batches):
    name, ranks, before, total = None, None, 0, 0
    for batch in batches:
        is_row = batch.column("is_row").to_numpy(zero_copy_only=False)
        edges = np.append(np.flatnonzero(~is_row), batch.num_rows)
        at = 0
        for edge in edges:
            if edge > at:
                ids = batch.column("doc_id").slice(at, edge - at).to_numpy()
                idx = before + ranks.places(ids & (SPAN - 1))
                rest = [batch.column(c).slice(at, edge - at) for c in ("doc_id", "leaf", "changed")]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(idx), pa.array([total] * len(ids), pa.int64()), *rest], names=["part", "idx", "total", "doc_id", "leaf", "changed"])
            if edge < batch.num_rows:
                one = {c: batch.column(c)[edge].as_py() for c in ("part", "data", "again", "directory", "before", "total")}
                name, before, total = one["part"], one["before"], one["total"]
                ranks = Ranks(one["data"], one["again"], one["directory"])
            at = edge + 1


def placed(rows: DataFrame) -> DataFrame:
    """``part, idx, total, doc_id, leaf, changed``: every leaf's coordinate and how many leaves its part has.

    A container comes before the leaves it ranks; the leaves stream past it, in
    the order of their digests, which only tells rows of one id apart.
    """
    found = containers(rows)
    own = rows.where("doc_id is not null").withColumns({"hi": F.shiftright("doc_id", SPAN_BITS), "is_row": F.lit(True)})
    dealt = own.unionByName(found.where(F.col("hi") != NO_ID).withColumn("is_row", F.lit(False)), allowMissingColumns=True)
    dealt = dealt.repartition("part", "hi").sortWithinPartitions("part", "hi", "is_row", "leaf", F.col("changed").asc_nulls_first())
    ranked = dealt.drop("hi", "n").mapInArrow(_ranked, _PLACED)
    bare = rows.where("doc_id is null").withColumn("bucket", F.conv(F.hex(F.substring("leaf", 1, 2)), 16, 10).cast("int"))
    bare = settle(running_offsets(bare, ["part"], "bucket", [F.col("leaf")], F.lit(1), "idx"), "bare-leaves")
    bare = lookup(bare, found.where(F.col("hi") == NO_ID).select("part", "total", "n"), "part")
    return ranked.unionByName(bare.select(*ranked.columns))


def _up(nodes: list[str], total: int) -> list[list[str]]:
    """The levels of a subtree from its leaves up; ``total`` nodes lie at its leaves' level in the whole tree."""
    out = [nodes]
    while len(out) <= LEVELS and total > 1:
        nodes = [digest("".join(nodes[i : i + WIDTH])) for i in range(0, len(nodes), WIDTH)]
        total = -(-total // WIDTH)
        out.append(nodes)
    return out


def _block(nodes: pa.Table) -> pa.Table:
    """A subtree's leaves, laid at their slots, and its top."""
    slot = nodes.column("idx").to_numpy() % BLOCK
    total, block = nodes.column("total")[0].as_py(), nodes.column("idx")[0].as_py() // BLOCK
    laid = {c: np.zeros((len(slot), 32), np.uint8) for c in ("leaf", "changed")}
    own = nodes.column("leaf").to_pylist()
    for name, values in (("leaf", own), ("changed", [c or x for c, x in zip(nodes.column("changed").to_pylist(), own)])):
        laid[name][slot] = np.frombuffer(b"".join(values), np.uint8).reshape(-1, 32)
    ids = np.empty(len(slot), object)
    ids[slot] = nodes.column("doc_id").to_pylist()
    top = _up([x.tobytes().hex() for x in laid["leaf"]], total)[-1][0]
    row = [nodes.column("part")[0].as_py(), block, total, -(-total // BLOCK), ids.tolist(), laid["leaf"].tobytes(), laid["changed"].tobytes(), bytes.fromhex(top)]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["part", "block", "below", "total", "doc_ids", "leaves", "changed", "leaf"])


def grown(nodes: DataFrame) -> list[DataFrame]:
    """The settled tables of subtrees from ``nodes`` up to one for each part."""
    tables = []
    while True:
        blocks = nodes.withColumn("block", F.expr(f"idx div {BLOCK}")).groupBy("part", "block").applyInArrow(lambda t: _block(t.drop_columns("block")), _BLOCKS)
        blocks = settle(blocks, "subtrees")
        tables.append(blocks)
        if (blocks.agg(F.max("total")).first()[0] or 1) == 1:
            return tables
        nodes = blocks.select("part", F.col("block").alias("idx"), "total", F.lit(None).cast("long").alias("doc_id"), "leaf", F.lit(None).cast("binary").alias("changed"))


def _sides(levels: list[list[str]]) -> list[list[tuple[str, str]]]:
    """For every level below the top, each node's siblings to the left and to the right."""
    out = []
    for nodes in levels[:-1]:
        sides = []
        for i in range(0, len(nodes), WIDTH):
            run = nodes[i : i + WIDTH]
            sides += [("".join(run[:k]), "".join(run[k + 1 :])) for k in range(len(run))]
        out.append(sides)
    return out


def _levels(row: dict) -> tuple[list[list[str]], list[list[tuple[str, str]]]]:
    nodes = [row["leaves"][i : i + 32].hex() for i in range(0, len(row["leaves"]), 32)]
    levels = _up(nodes, row["below"])
    return levels, _sides(levels)


def _down(batches):
    """Paths of a subtree's leaves from that of its top."""
    for batch in slices(batches, 1):
        row = batch.to_pylist()[0]
        levels, sides = _levels(row)
        n = len(levels[0])
        lefts, rights = ([[sides[k][i // WIDTH**k][side] for k in range(len(sides))] + row[c] for i in range(n)] for side, c in ((0, "lefts"), (1, "rights")))
        first = row["block"] * BLOCK
        columns = [[row["part"]] * n, range(first, first + n), [row["root"]] * n, [row["subroot"]] * n, lefts, rights]
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=["part", "block", "root", "subroot", "lefts", "rights"])


def _prove(batches):
    """Proofs of a subtree's leaves, and the roots that they lead to."""
    names = [c.split()[0] for c in _PROVED.split(", ")]
    for batch in slices(batches, 1):
        row = batch.to_pylist()[0]
        levels, sides = _levels(row)
        above = list(zip(row["lefts"], row["rights"]))
        siblings = ["".join(a + b for a, b in above)]
        for level in reversed(sides):
            siblings = [a + b + siblings[i // WIDTH if len(siblings) > 1 else 0] for i, (a, b) in enumerate(level)]
        root, subroot = row["root"].hex(), row["subroot"].hex()
        folded = []
        for i in range(len(levels[0])):
            node = row["changed"][32 * i : 32 * i + 32].hex()
            for k, level in enumerate(sides):
                left, right = level[i // WIDTH**k]
                node = digest(left + node + right)
            for left, right in above:
                node = digest(left + node + right)
            folded.append(node)
        n = len(folded)
        columns = [row["doc_ids"], levels[0], [subroot] * n, [root] * n, [digest(s) for s in siblings], folded, [x == root for x in folded]]
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=names)


def _joined(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Subtrees with the paths of their tops. A path is for BLOCK leaves; how to join is Spark's choice, by the written tables' sizes."""
    return blocks.drop("total", "leaf").join(paths, ["part", "block"])


def _descend(tables: list[DataFrame], paths: DataFrame) -> DataFrame:
    """The paths of all leaves of ``tables``, from those of their tops down."""
    for blocks in reversed(tables):
        paths = settle(_joined(blocks, paths).mapInArrow(_down, _PATHS), "paths")
    return paths


def manifest(docs: DataFrame) -> DataFrame:
    """A row per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    The proof is checked with the document as it would be after tampering:
    where 3 divides the id's checksum, with its text's capitals in lower case.
    """
    tables = grown(settle(placed(leaves(docs)), "placed-leaves"))
    tops = settle(tables[-1].select("part", F.col("leaf").alias("subroot")).repartitionByRange("part").withColumn("bucket", F.spark_partition_id()), "subroots")
    tops = settle(running_offsets(tops, [], "bucket", [F.col("part")], F.lit(1), "idx"), "placed-subroots")
    nodes = tops.select(F.lit("").alias("part"), "idx", F.lit(tops.count()).cast("long").alias("total"), F.lit(None).cast("long").alias("doc_id"), F.col("subroot").alias("leaf"), F.lit(None).cast("binary").alias("changed"))
    upper = grown(nodes)
    none = F.array().cast("array<string>")
    root = upper[-1].select("part", "block", F.col("leaf").alias("root"), F.lit(None).cast("binary").alias("subroot"), none.alias("lefts"), none.alias("rights"))
    paths = _descend(upper, root).select(F.col("block").alias("idx"), "root", "lefts", "rights").join(tops.select("idx", "part", "subroot"), "idx")
    paths = paths.select("part", F.lit(0).cast("long").alias("block"), "root", "subroot", "lefts", "rights")
    return _joined(tables[0], _descend(tables[1:], paths)).mapInArrow(_prove, _PROVED)
