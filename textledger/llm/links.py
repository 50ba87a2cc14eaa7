"""From signature bands to verified links to classes of near duplicates.

Rows are told apart by their texts: equal texts are one node, with a number of
its own (``rep``), whatever their ids, so repeated and null ids lose nothing.
Nulls: a null text is in a class of its own; a null id counts behind all
others. Empty texts and texts without words equal each other only where they
are the same text. Very long texts are compared whole. Ties go to the least id,
then to the least text digest. Similarity is exact but for shingles of one
text whose 32-bit hashes are equal, which count as one. Repeated rows share a class. An empty table
gives no classes. Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, likely, runs, settle, shingles, slices, squeezed, unsqueezed

#: Samples in a band; two texts of similarity s agree in one band with probability s ** BAND_ROWS.
BAND_ROWS = 4
BANDS = 16
#: In buckets of so many texts at most, all pairs are candidates; in larger ones each text meets leaders.
SMALL_BUCKET = 8
#: Texts of a large bucket that share a second leader.
SUB_GROUP = 32
#: Rounds of new leaders; what they leave apart is compared by prefixes, so more of them would only shift work.
ROUNDS = 1
BANDED = "doc_id long, text_key string, bands array<long>"
#: Stands for a null id where ids are compared.
NO_ID = -(2**63)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the digest that tells equal texts (null texts equal none)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", F.md5(F.col("text")))


def _at(doc_id: str = "doc_id"):
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def banded_batch(batch, samples: np.ndarray) -> pa.RecordBatch:
    """Fold samples (texts x at least BANDS * BAND_ROWS) into band hashes."""
    rows = [
        [int.from_bytes(hashlib.blake2b(bytes([b]) + row[b * BAND_ROWS : (b + 1) * BAND_ROWS].tobytes(), digest_size=8).digest(), "big", signed=True) for b in range(BANDS)]
        for row in samples
    ]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "text_key", "bands"])


def plain_vectors(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct shingles (32-bit hashes, ascending), all of weight 1."""
    out = []
    for i, j in runs(texts):
        hashes, bounds = shingles(texts[i:j])
        for a, b in zip(bounds, bounds[1:]):
            own = np.unique((hashes[a:b] >> np.uint64(32)).astype(np.uint32))
            out.append((own, np.ones(len(own), np.float32)))
    return out


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity; 0 if either has no shingle."""
    if not len(x[0]) or not len(y[0]):
        return 0.0
    at = np.searchsorted(y[0], x[0])
    at[at == len(y[0])] = 0
    both = y[0][at] == x[0]
    least = float(np.minimum(x[1][both], y[1][at[both]]).sum(dtype=np.float64))
    return least / (float(x[1].sum(dtype=np.float64)) + float(y[1].sum(dtype=np.float64)) - least)


def _pack(vector) -> bytes:
    return vector[0].astype("<u4").tobytes() + vector[1].astype("<f4").tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(data) // 2
    return np.frombuffer(data[:half], "<u4"), np.frombuffer(data[half:], "<f4")


def vectors_of(wanted: DataFrame, rows: DataFrame, vectors: Callable, known: DataFrame | None = None) -> DataFrame:
    """The settled vectors ``rep, vector`` of the texts ``wanted`` (``rep, at, text_key``; ``at`` is the least id that has the text).

    ``known`` (``doc_id, text_key, dfs``) has what ``vectors`` needs besides the text.

    The texts are as many as the input makes them, so none are broadcast: texts
    are shuffled once, compressed, whatever the size, and one row of each is
    kept. A filter of fixed size keeps most texts that no one wants out of it, and their frequencies.
    """

    def pack(batches):
        for batch in slices(batches):
            given = [unsqueezed(column(batch, "text")), *[column(batch, c, b"") for c in more]]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([_pack(v) for v in vectors(*given)], pa.binary())], names=["rep", "vector"])

    more, key = [], ["at", "text_key"]
    asked = wanted = settle(wanted, "wanted")
    if known is not None:
        more.append("dfs")
        wanted = likely(known.select(_at().alias("at"), "text_key", "dfs"), asked).join(wanted.hint("shuffle_hash"), key).dropDuplicates(key)
    found = squeezed(likely(rows.select(_at().alias("at"), "text_key", "text"), asked)).join(wanted.hint("shuffle_hash"), key).dropDuplicates(key)
    return settle(found.select("rep", "text", *more).mapInArrow(pack, "rep long, vector binary"), "vectors")


def verify(pairs: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """Of the distinct pairs ``a, b`` those whose similarity is ``threshold`` or more."""

    def compare(batches):
        for batch in slices(batches, 512):
            x, y = batch.column("x"), batch.column("y")
            ok = [similarity(_unpack(x[i].as_py()), _unpack(y[i].as_py())) >= threshold for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = packed.select(F.col("rep").alias("a"), F.col("vector").alias("x")), packed.select(F.col("rep").alias("b"), F.col("vector").alias("y"))
    return settle(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "links")


def _starred(edges: DataFrame) -> bool:
    """Whether the edges ``a, b`` (a > b) are stars: no ``a`` has two edges or is a ``b`` too."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges ``a, b``: ``node, label`` with the least member as label.

    Alternating large-star and small-star steps, each written to the shared
    folder, until the edges are stars around least members. A hub's neighbours
    are never gathered: only minima are, by partial aggregation.
    """
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    ends = lambda x, y, m, n: F.explode(F.array(F.struct(F.col(x).alias("a"), F.col(y).alias("b")), F.struct(F.col(m).alias("a"), F.col(n).alias("b")))).alias("e")
    while not _starred(edges):
        both = edges.select(ends("a", "b", "b", "a")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(ends("a", "m", "b", "m")).select("e.a", "e.b")
        edges = settle(small.where("a <> b").distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def prefixes(members: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """The shingles of ``members`` of which two texts as similar as ``threshold`` share one: ``rep, shingle, rest``.

    A text's shingles stand in one order for all texts, those of fewest members
    first; ``rest`` is the weight from the shingle on. Similar texts overlap in
    ``threshold`` of the heavier one's weight at least, all of it from their
    first common shingle on: so that one has so much ``rest``, and the others
    need not be kept. Neither need shingles of a single member.
    """

    def unpack(batches):
        for batch in slices(batches, 64):
            vectors = [_unpack(v) for v in column(batch, "vector")]
            ids = np.repeat(batch.column("rep").to_numpy(), [len(v[0]) for v in vectors])
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([v[0] for v in vectors]).astype(np.int64)), pa.array(np.concatenate([v[1] for v in vectors]))], names=["rep", "shingle", "weight"])

    rows = settle(members.select("rep").join(packed, "rep").select("rep", "vector").mapInArrow(unpack, "rep long, shingle long, weight float"), "member-shingles")
    counts = rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    own = W.partitionBy("rep")  # one text
    before = own.orderBy("n", "shingle").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.join(counts, "shingle", "left").withColumns({"n": F.coalesce("n", F.lit(1)), "weight": F.col("weight").cast("double")})
    whole = placed.withColumns({"before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "whole": F.sum("weight").over(own)}).withColumn("rest", F.col("whole") - F.col("before"))
    return whole.where((F.col("rest") >= F.col("whole") * (threshold * (1 - 1e-6))) & (F.col("n") > 1)).select("rep", "shingle", "rest", "whole")


def across(members: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """Candidates ``a, b`` among ``members`` (``rep, class``) of different classes, by their prefixes.

    No pair as similar as ``threshold`` is missing. Per shingle, only members
    outside its most frequent class are joined with the others, and only where
    what either text has left from the shingle on is the overlap they need.
    """
    marked = settle(prefixes(members, packed, threshold).join(members, "rep"), "prefixes")
    mixed = marked.groupBy("shingle", "class").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max_by("class", F.struct("n", "class")).alias("lead"), F.count("*").alias("classes"))
    mixed = settle(marked.join(mixed.where("classes > 1").select("shingle", "lead"), "shingle"), "mixed-prefixes")
    odd = mixed.where("class <> lead").select("shingle", F.col("rep").alias("x"), F.col("class").alias("cx"), F.col("whole").alias("wx"), F.col("rest").alias("rx"))
    met = odd.join(mixed.select("shingle", F.col("rep").alias("y"), F.col("class").alias("cy"), F.col("whole").alias("wy"), F.col("rest").alias("ry")), "shingle")
    need = (F.col("wx") + F.col("wy")) * (threshold / (1 + threshold) * (1 - 1e-6))
    return met.where((F.col("cx") != F.col("cy")) & (F.col("rx") >= need) & (F.col("ry") >= need)).select(*_pairs("x", "y")).distinct()


def _pairs(left: str, right: str):
    return [F.greatest(left, right).alias("a"), F.least(left, right).alias("b")]


def _open_buckets(placed: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of large buckets that hold several classes, and the sub-groups of these buckets with the class in the lead.

    ``placed`` has a row per member and bucket. Labels are joined to one row per
    member, and all that is known of a bucket reaches its members by sub-group,
    so neither a text of many buckets nor a bucket of many texts is one key.
    """
    members = placed.groupBy("rep").agg(F.first("rank").alias("rank"), F.collect_list(F.struct("bucket", "sub")).alias("places"))  # BANDS at most
    named = members.join(labels, members["rep"] == labels["node"], "left").select("rep", "rank", F.coalesce("label", "rep").alias("class"), F.explode("places").alias("p"))
    named = settle(named.select("rep", "rank", "class", "p.bucket", "p.sub"), "named")
    groups = named.groupBy("bucket", "sub").agg(F.max_by("class", "rank").alias("lead"), F.max("rank").alias("rank"), F.min("class").alias("lo"), F.max("class").alias("hi"))
    several = groups.groupBy("bucket").agg(F.max_by("lead", "rank").alias("lead"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("bucket", "lead")
    subs = settle(groups.select("bucket", "sub").join(several, "bucket"), "open-buckets")
    return settle(named.join(subs, ["bucket", "sub"]), "open"), subs


def classes_by_bands(rows: DataFrame, banded: DataFrame, threshold: float, vectors: Callable, known: DataFrame | None = None) -> DataFrame:
    """Classes of exact and near copies from a settled table of bands.

    1. Equal texts are one node, ``rep``.
    2. A bucket is a band value that several nodes share. In a small bucket all
       pairs are candidates. In a large one every member meets the bucket's
       leader and that of a random sub-group: leaders are the texts with the
       most company over all bands, which is what an original has among its
       copies. So candidates grow with the members, not their square.
    3. Candidates are verified exactly and joined to classes. Large buckets
       that still hold several classes get new leaders from among the classes
       other than the last leader's, for ROUNDS rounds or until one links
       nothing new; the others are done with. This only makes the next step small.
    4. Members of large buckets that still hold several classes are compared
       across classes wherever their prefixes meet (see ``across``), so that no
       link between classes of a bucket is lost.

    Returns a row per distinct text: ``text_key, class, least, lead`` with
    ``least`` the text's least id and ``lead`` the class's first text as
    ``{no_id, doc_id, text_key}`` (least id, then least digest).
    """
    with_text = banded.where("text_key is not null").groupBy("text_key").agg(F.min("doc_id").alias("least"), F.min(_at()).alias("at"), F.any_value("bands").alias("bands"))
    heads = settle(with_text.withColumn("rep", F.monotonically_increasing_id()), "heads")
    exploded = heads.select("rep", F.posexplode("bands")).select("rep", F.xxhash64("pos", "col").alias("bucket"))
    counts = exploded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = settle(exploded.join(counts, "bucket"), "buckets")

    small = shared.where(F.col("n") <= SMALL_BUCKET)
    lists = small.groupBy("bucket").agg(F.array_sort(F.collect_list("rep")).alias("ids"))  # at most SMALL_BUCKET
    some = lists.select(F.posexplode("ids").alias("i", "b"), "ids").select("b", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("a")).select("a", "b")

    big = shared.where(F.col("n") > SMALL_BUCKET)
    central = big.groupBy("rep").agg(F.sum("n").alias("company"))
    big = big.join(central, "rep").withColumn("sub", F.pmod(F.xxhash64("rep", F.lit(7)), F.ceil(F.col("n") / SUB_GROUP)))
    big = settle(big.select("rep", "bucket", "sub", F.struct(F.col("company"), -F.col("rep")).alias("rank")), "big-buckets")
    subs = big.groupBy("bucket", "sub").agg(F.max_by("rep", "rank").alias("second"), F.max("rank").alias("rank"))
    first = subs.groupBy("bucket").agg(F.max_by("second", "rank").alias("leader"))
    many = big.join(subs.join(first, "bucket").select("bucket", "sub", "leader", "second"), ["bucket", "sub"])
    many = many.select("rep", F.explode(F.array("leader", "second")).alias("leader")).select(*_pairs("rep", "leader"))

    tested = settle(some.union(many).where("a <> b").distinct(), "pairs")
    # Every text of a large bucket meets a leader, so later rounds find their vectors here too.
    wanted = tested.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(heads.select("rep", "at", "text_key"), "rep")
    packed = vectors_of(wanted, rows, vectors, known)
    links = verify(tested, packed, threshold)
    labels = components(links)
    open_ = big
    for left in range(ROUNDS, -1, -1):
        open_, subs = _open_buckets(open_, labels)
        if not left:
            break
        leaders = open_.where("class <> lead").groupBy("bucket").agg(F.max_by(F.struct("rep", "class"), "rank").alias("next"))
        met = open_.join(subs.join(leaders, "bucket").select("bucket", "sub", "next"), ["bucket", "sub"])
        fresh = met.where(F.col("class") != F.col("next.class")).select(*_pairs("rep", "next.rep")).distinct()
        fresh = settle(fresh.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.union(fresh)
        found = verify(fresh, packed, threshold)
        if found.isEmpty():
            break
        links = links.union(found)
        labels = components(links)
    members = settle(open_.select("rep", "class").distinct(), "open-members")
    if not members.isEmpty():
        last = settle(across(members, packed, threshold).join(tested, ["a", "b"], "left_anti"), "pairs")
        found = verify(last, packed, threshold)
        if not found.isEmpty():
            labels = components(links.union(found))
    named = heads.select("rep", "text_key", "least").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("text_key", "least", F.coalesce("label", "rep").alias("class"))
    lead = F.struct(F.col("least").isNull().alias("no_id"), F.col("least").alias("doc_id"), "text_key")
    return named.join(named.groupBy("class").agg(F.min(lead).alias("lead")), "class")


def class_ids(banded: DataFrame, classes: DataFrame) -> DataFrame:
    """``doc_id, text_key, class_id`` for every row of ``banded``: the least id of the row's class (null if the class has none)."""
    known = classes.select("text_key", F.col("lead.doc_id").alias("class_id"), F.lit(True).alias("known"))
    return banded.select("doc_id", "text_key").join(known, "text_key", "left").select("doc_id", "text_key", F.when(F.col("known"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
