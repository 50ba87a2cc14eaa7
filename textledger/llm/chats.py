"""Chat formatting as a prefix tree with attention intervals.

A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts, a
``<`` followed by backslashes and ``|`` gets one backslash more, which keeps
control strings out of texts and is undone on reading; roles are URL-encoded.

Conversations that begin with the same turns share tree nodes. The stream holds
each node's segment once, depth first. Positions are code points of the
rendered segments (a tokenizer may be applied to segments afterwards: they are
whole turns). A node carries its first position id (the length of its
ancestors), its offset in the stream, the interval of its segment under the
loss mask, and the stream intervals its tokens may attend to: its ancestors'
and its own, neighbouring intervals merged.

Nulls: null texts are empty, null roles too; null turns come first and null
conversation ids form one conversation. Rows of equal turn numbers are ordered
by role and text; repeated rows are turns of their own. Extra columns are
ignored. An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle

START, END, LEARNER = "<|im_start|>", "<|im_end|>", "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def turns_of(conversations: DataFrame) -> DataFrame:
    """One row per turn with its rendered segment, loss interval, running prefix digest and position."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("depth", F.row_number().over(order)).drop("turn")
    head = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"))
    body = escape(F.col("text"))
    rows = rows.select(
        "conv_id",
        "depth",
        F.concat(head, body, F.lit(END + "\n")).alias("segment"),
        F.length(head).alias("loss_from"),
        F.when(F.col("role") == LEARNER, F.length(body)).otherwise(0).alias("loss_len"),
        *[F.xxhash64(F.lit(s), "depth", "role", "text").cast("decimal(20,0)").alias(f"h{s}") for s in (1, 2)],
    )
    run = W.partitionBy("conv_id").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    prior = W.partitionBy("conv_id").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    sums = [F.sum(f"h{s}").over(run).cast("string") for s in (1, 2)]  # each turn's hash holds its depth: the sum tells the prefix
    return rows.select(
        "conv_id",
        "depth",
        "segment",
        "loss_from",
        "loss_len",
        F.md5(F.concat_ws(":", F.col("depth").cast("string"), *sums)).alias("node"),
        F.coalesce(F.sum(F.length("segment")).over(prior), F.lit(0)).alias("position"),
    )


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written tree: its nodes in stream order, and the conversations with their leaves and paths.

    Nodes: ``node, parent, depth, segment, loss_from, loss_len, position, start,
    attend`` (array of ``{from, to}`` stream intervals). Conversations:
    ``conv_id, leaf``. Paths: ``leaf, path`` (an array of nodes).
    """
    turns = settle(turns_of(conversations), "turns")
    paths = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("p"))  # one conversation's turns
    paths = paths.select("conv_id", F.transform("p", lambda x: x["node"]).alias("path"))
    chats = settle(paths.select("conv_id", F.element_at("path", -1).alias("leaf"), "path"), "chats")
    leaves = chats.groupBy("leaf").agg(F.first("path").alias("path")).orderBy("path").withColumn("rank", F.monotonically_increasing_id())
    leaves = settle(leaves, "leaves")  # sorted by path, so rank order is depth first
    steps = leaves.select("leaf", "rank", F.posexplode("path").alias("at", "node")).withColumn("depth", F.col("at") + 1).drop("at")
    bodies = turns.groupBy("node").agg(F.first("segment").alias("segment"), F.first("loss_from").alias("loss_from"), F.first("loss_len").alias("loss_len"), F.first("position").alias("position"))
    nodes = steps.groupBy("node").agg(F.min("rank").alias("owner"), F.first("depth").alias("depth")).join(bodies, "node").withColumn("n", F.length("segment").cast("long"))
    nodes = settle(nodes, "nodes")

    # A leaf owns the nodes that no earlier leaf has; the stream is the leaves' own nodes, leaf by leaf.
    owned = nodes.groupBy("owner").agg(F.sum("n").alias("own")).withColumn("part", F.shiftright("owner", 33))
    parts = owned.groupBy("part").agg(F.sum("own").alias("all"))
    parts = parts.withColumn("base", F.coalesce(F.sum("all").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("all")  # a row per sorted partition
    within = W.partitionBy("part").orderBy("owner").rowsBetween(W.unboundedPreceding, -1)
    offsets = owned.join(parts, "part").withColumn("offset", F.col("base") + F.coalesce(F.sum("own").over(within), F.lit(0))).select("owner", "offset")
    inside = W.partitionBy("owner").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    placed = nodes.join(offsets, "owner").withColumn("start", F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("offset")
    placed = settle(placed, "placed")

    # Attention: along each leaf's path, a run of segments that lie side by side is one interval.
    along = steps.join(placed.select("node", "owner", "start", "n"), "node")
    line = W.partitionBy("leaf").orderBy("depth")
    along = along.withColumn("before", F.lag(F.col("start") + F.col("n")).over(line)).withColumn("parent", F.lag("node").over(line))
    new = F.col("before").isNull() | (F.col("before") != F.col("start"))
    upto = line.rowsBetween(W.unboundedPreceding, 0)
    along = along.withColumn("froms", F.collect_list(F.when(new, F.col("start"))).over(upto)).withColumn("tos", F.collect_list(F.when(new, F.col("before"))).over(upto))
    along = along.where("rank = owner").select(
        "node",
        "parent",
        F.arrays_zip(F.col("froms").alias("from"), F.concat(F.col("tos"), F.array(F.col("start") + F.col("n"))).alias("to")).cast("array<struct<from:bigint,to:bigint>>").alias("attend"),
    )
    tree = placed.join(along, "node").select("node", "parent", "depth", "segment", "loss_from", "loss_len", "position", "start", "attend").sortWithinPartitions("start")
    return settle(tree, "tree"), chats


def read_back(tree: DataFrame, chats: DataFrame) -> DataFrame:
    """What the written tree says of each conversation: rendered text, its turns (unescaped) and the text under the loss mask."""
    paths = chats.groupBy("leaf").agg(F.first("path").alias("path"))
    steps = paths.select("leaf", F.explode("path").alias("node")).join(tree, "node")
    whole = steps.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "segment", "loss_from", "loss_len"))).alias("s"))  # one conversation's turns
    whole = whole.select(
        "leaf",
        F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("formatted"),
        F.array_join(F.transform("s", lambda x: unescape(F.substring(x["segment"], x["loss_from"] + 1, x["loss_len"]))), "").alias("loss_text"),
    )
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda x: x != "")
    ended = F.transform(pieces, lambda x: F.substring(x, F.lit(1), F.length(x) - len(END) - 1))
    turn = F.transform(ended, lambda x: F.struct(F.url_decode(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substring(x, F.locate("\n", x) + 1, F.length(x))).alias("text")))
    whole = whole.withColumn("turns", turn)
    return chats.select("conv_id", "leaf").join(whole, "leaf").drop("leaf")
