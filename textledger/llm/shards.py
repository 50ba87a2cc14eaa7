"""Sharding by a k-d tree over document metadata.

A node is split at the weighted median of its widest dimension: dimensions are
scaled to [0, 1] over all rows, weights are the rows' bytes. All nodes of a
level are split together: histograms (a bounded number of bins per node) come
to the driver and are refined until a bin edge is within ``TOLERANCE`` of the
wanted share, so no node's rows are gathered. Rows are ordered by dimension,
then text checksum, then id, so equal texts part only where a group is larger
than the tolerance.

Nulls: a null text has size 1; null or NaN dimensions count as 0. Empty table: no rows.
A very long text is never cut: its shard is so much larger. Repeated rows are
kept. Null ids come first. Extra columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import order_buckets, running_offsets, settle

#: The share of a node's bytes by which a cut may miss the wanted share.
TOLERANCE = 0.002
#: Bins of all nodes of one level together, at most, and of one node.
ALL_BINS, NODE_BINS = 1 << 18, 1 << 12
_DIM_BITS, _TEXT_BITS, _ID_BITS = 14, 32, 16
_BITS = _DIM_BITS + _TEXT_BITS + _ID_BITS


def _order_key(dim: Column) -> Column:
    """Order within a node as one number: dimension, text checksum, id checksum."""
    scaled = F.least(F.floor(dim * (1 << _DIM_BITS)), F.lit((1 << _DIM_BITS) - 1)).cast("long")
    return F.shiftleft(scaled, _TEXT_BITS + _ID_BITS) + F.shiftleft(F.col("text_crc32"), _ID_BITS) + F.col("_tie")


def _ranges(rows: DataFrame, dims: list[str]) -> dict:
    found = rows.groupBy("_node").agg(F.sum("size").alias("w"), *[f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]).collect()  # a row per node
    return {r["_node"]: r for r in found}


def _cuts(rows: DataFrame, plan: dict[int, tuple[str, float, float]]) -> dict[int, int]:
    """For each node (dimension, total bytes, wanted left bytes): the order key at which its right part begins."""
    spark = rows.sparkSession
    low, left, width, done = dict.fromkeys(plan, 0), dict.fromkeys(plan, 0), 1 << _BITS, {}
    bins = NODE_BINS
    while bins > 16 and bins * len(plan) > ALL_BINS:
        bins >>= 1
    while len(done) < len(plan):
        width = max(1, width // bins)
        asked = [(n, plan[n][0], low[n]) for n in plan if n not in done]
        frame = F.broadcast(spark.createDataFrame(asked, "_node int, _dim string, _low long"))  # a row per node
        dim = F.coalesce(*[F.when(F.col("_dim") == d, F.col(d)) for d in {a[1] for a in asked}])
        keyed = rows.join(frame, "_node").withColumn("_bin", F.floor((_order_key(dim) - F.col("_low")) / F.lit(width)).cast("long"))
        got = keyed.where((F.col("_bin") >= 0) & (F.col("_bin") < bins)).groupBy("_node", "_bin").agg(F.sum("size").alias("w")).collect()  # bins of the open nodes
        by: dict[int, list] = {}
        for r in got:
            by.setdefault(r["_node"], []).append((r["_bin"], r["w"]))
        for node, _, at in asked:
            _, total, wanted = plan[node]
            run, best, into = left[node], (abs(left[node] - wanted), at), None
            for b, w in sorted(by.get(node, [])):
                if run + w > wanted and into is None:
                    into = (at + b * width, run)
                run += w
                best = min(best, (abs(run - wanted), at + (b + 1) * width))
            if best[0] <= TOLERANCE * total or width == 1 or into is None:
                done[node] = best[1]
            else:
                low[node], left[node] = into
    return done


def kd_shards(docs: DataFrame, dims: dict[str, Column], shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs``.

    ``dims`` are numeric metadata columns by name. Leaves are halved until
    there are ``shards``, or as many as ``target_bytes`` asks for. ``slot``
    numbers a shard's rows by id, without gaps.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [f"_d{i}" for i in range(len(dims))]
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        *[F.nanvl(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0)).alias(n) for n, c in zip(names, dims.values())],
    )
    base = settle(base.withColumn("_tie", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % (1 << _ID_BITS)), "metadata")
    ends = base.agg(F.sum("size").alias("w"), *[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]).first()
    for n in names:
        lo, hi = ends[f"min_{n}"] or 0.0, ends[f"max_{n}"] or 0.0
        base = base.withColumn(n, (F.col(n) - lo) / ((hi - lo) or 1.0))
    leaves = shards or max(1, -(-(ends["w"] or 1) // target_bytes))
    rows, todo = base.withColumn("_node", F.lit(0)), {0: (0, leaves)}
    while any(m > 1 for _, m in todo.values()):
        found = _ranges(rows, names)
        plan = {}
        for node, (_, m) in todo.items():
            if m > 1 and node in found:
                r = found[node]
                widest = max(names, key=lambda n: r[f"max_{n}"] - r[f"min_{n}"])
                plan[node] = (widest, r["w"], r["w"] * (m // 2) / m)
        cuts = _cuts(rows, plan)
        steps, ahead = [], {}
        for node, (first, m) in todo.items():
            if m == 1 or node not in cuts:
                ahead[2 * node] = (first, 1)
                steps.append((node, None, 2**63 - 1))
            else:
                ahead[2 * node], ahead[2 * node + 1] = (first, m // 2), (first + m // 2, m - m // 2)
                steps.append((node, plan[node][0], cuts[node]))
        frame = F.broadcast(rows.sparkSession.createDataFrame(steps, "_node int, _dim string, _cut long"))  # a row per node
        dim = F.coalesce(*[F.when(F.col("_dim") == n, F.col(n)) for n in names], F.lit(0.0))
        rows = rows.join(frame, "_node").withColumn("_node", (F.col("_node") * 2 + (_order_key(dim) >= F.col("_cut")).cast("int")).cast("int")).drop("_dim", "_cut")
        rows = settle(rows, "level")  # a level's passes read it as it is
        todo = ahead
    frame = F.broadcast(rows.sparkSession.createDataFrame([(n, f) for n, (f, _) in todo.items()], "_node int, shard int"))  # a row per leaf
    placed = rows.join(frame, "_node").select("doc_id", "size", "text_crc32", "shard")
    placed = settle(order_buckets(placed, "doc_id", "_bucket"), "placed")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    return running_offsets(placed, ["shard"], "_bucket", order, F.lit(1), "slot").drop("_bucket")


def document_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shards of documents by how long they are and how densely words stand in them (words a byte; 0 where there is no text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return kd_shards(docs, {"length": F.log(size + F.lit(1.0)), "density": words / F.greatest(size, F.lit(1))}, shards=shards)
