"""Files as sequences of content-addressed chunks: cutting, storing each chunk once, checked reassembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(files: DataFrame, name: str, data: str, size: int) -> DataFrame:
    """``name, seq, sha, piece``: the binary column ``data`` in pieces of ``size`` bytes (an empty file has one empty piece, a null one none)."""
    last = F.greatest(F.ceil(F.octet_length(data) / size) - 1, F.lit(0)).cast("int")
    parts = files.where(F.col(data).isNotNull()).select(name, data, F.explode(F.sequence(F.lit(0), last)).alias("seq"))
    piece = F.substring(F.col(data), F.col("seq") * size + 1, F.lit(size))
    return parts.select(name, "seq", piece.alias("piece")).withColumn("sha", F.sha1("piece"))


def store(chunks: DataFrame) -> DataFrame:
    """Each distinct chunk once: ``sha, piece``. Copies are dropped before the shuffle, so a common chunk weighs no more than others."""
    return chunks.groupBy("sha").agg(F.first("piece").alias("piece"))


def reassemble(manifest: DataFrame, chunks: DataFrame, name: str) -> DataFrame:
    """Files from ``manifest`` (``name, seq, sha, file_sha256``) and a store: ``name, data, pieces, problem``.

    ``problem`` is ``MISSING_CHUNK`` where the store lacks one, ``BAD_CHUNK``
    where a piece has another hash than its name, ``BAD_FILE`` where the whole
    has, else null; ``data`` is null where there is a problem. Only one file's
    pieces are ever gathered.
    """
    found = manifest.join(chunks, "sha", "left").withColumn("bad", F.sha1("piece") != F.col("sha"))
    whole = found.groupBy(name, "file_sha256").agg(
        F.count("*").alias("pieces"),
        F.count_if(F.col("piece").isNull()).alias("missing"),
        F.count_if("bad").alias("bad"),
        F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("parts"),
    )
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["piece"])), ""))
    out = whole.withColumn("data", joined)
    wrong = F.when(F.col("missing") > 0, "MISSING_CHUNK").when(F.col("bad") > 0, "BAD_CHUNK").when(F.sha2("data", 256) != F.col("file_sha256"), "BAD_FILE")
    out = out.withColumn("problem", wrong)
    return out.select(name, F.when(F.col("problem").isNull(), F.col("data")).alias("data"), "pieces", "problem")


def locate(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """Where each wanted chunk (``name, seq, sha, size``) lies: ``bundle, offset`` of its first listing, and what is wrong.

    ``listed`` has ``bundle, offset, sha, size``; of several listings of a chunk
    the one of the least bundle and offset counts. ``problem`` is ``ABSENT``
    without one, ``SIZE_DIFFERS`` where sizes disagree, else null.
    """
    first = listed.groupBy("sha").agg(F.min(F.struct("bundle", "offset", "size")).alias("at"))
    out = wanted.join(first, "sha", "left")
    problem = F.when(F.col("at").isNull(), "ABSENT").when(F.col("at.size") != F.col("size"), "SIZE_DIFFERS")
    return out.select("name", "seq", "sha", "size", F.col("at.bundle").alias("bundle"), F.col("at.offset").alias("offset"), problem.alias("problem"))


def fetch(located: DataFrame, bundles: DataFrame) -> DataFrame:
    """The bytes of located chunks, cut out of their bundles (``bundle, data``): ``sha, piece``, each chunk once.

    A bundle is joined to its own chunks' places, gathered beforehand, so its bytes move once.
    """
    places = located.where("problem is null").select("bundle", "offset", "size", "sha").distinct()
    lists = places.groupBy("bundle").agg(F.collect_set(F.struct("offset", "size", "sha")).alias("places"))  # one bundle's chunks
    found = bundles.join(lists, "bundle").select("data", F.explode("places").alias("p"))
    return found.select("p.sha", F.expr("substring(data, p.offset + 1, p.size)").alias("piece")).dropDuplicates(["sha"])


def file_problems(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``path, problem`` of a manifest (``path, sha``) against files (``path, sha``): ``MISSING``, ``CHANGED``, and ``UNLISTED`` files."""
    have = files.select("path", F.col("sha").alias("_sha"), F.lit(True).alias("_there"))
    out = manifest.withColumn("_listed", F.lit(True)).join(have, "path", "full_outer")
    problem = F.when(F.col("_there").isNull(), "MISSING").when(F.col("_listed").isNull(), "UNLISTED").when(F.lower("sha") != F.lower("_sha"), "CHANGED")
    return out.select("path", problem.alias("problem")).where("problem is not null")
