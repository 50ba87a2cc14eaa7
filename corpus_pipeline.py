"""A corpus pipeline of five stages, from raw documents to written token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
it kept. All but the last return the columns of ``documents``:

1. quality: documents that the positive-unlabelled classifier scores below its threshold go;
2. near_dedup: one document of each class of exact and near copies stays;
3. decontaminate: documents that hold a benchmark item go;
4. mix: sources are brought to their target weights, a row per document and pass with the words taken;
5. tokens: the mix is encoded, written as wavelet matrices and read back.

In all stages rows are judged by their own text: repeated or null ids lose no
row, extra columns of any name are kept up to the last stage, very long texts
are taken whole, and an empty table gives an empty one.

Stages give the session smaller Arrow batches (see ``common.small_batches``), also
for what it runs after them: a stage's result is computed when it is written.
"""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textledger.llm import decontaminate, mixing, quality, tokens, weighted
from textledger.llm.common import shared_dir, small_batches

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Stages train classifiers and draw permutations, which SQL cannot express.
ORACLE_SQL = None


def lean(stage):
    """``stage`` in a session whose workers get small batches."""

    @functools.wraps(stage)
    def run_lean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_lean


@lean
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold go. A null text counts as empty; repeated rows score alike; without labels all stay."""
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 4 != 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(train).select("doc_id", "quality")
    return quality.keep_good(docs, quality.learn(docs.where(train).select("doc_id", "text"), labels))


@lean
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays: least id (null last), then least text digest. Rows without a text all stay."""
    return weighted.dedup(docs)


@lean
def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go; null or empty texts and items match nothing; repeated rows share their fate."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@lean
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their targets. Rows without words are never taken; equal ids are ordered by text checksum; null is a source."""
    return mixing.mixed(docs)


@lean
def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row in ascending order of id (null first), then text. A null text is the end id alone; repeated rows are each written."""
    return tokens.read_documents(tokens.write_shards(docs, TOKENIZER)).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("tokens", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again.

    With the ``run_id`` of a run that failed, stages that it finished are read,
    not made again; without one, every call is a new run.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{shared_dir(spark)}/pipeline-{run_id or uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{where}/{name}"
        if not (run_id and finished(spark, path)):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
            if run_id:
                spark.range(1).write.mode("overwrite").parquet(f"{path}.done")
        docs = spark.read.parquet(path)
    return docs


def finished(spark: SparkSession, path: str) -> bool:
    """Whether the mark of a finished stage was written."""
    try:
        return spark.read.schema("id long").parquet(f"{path}.done").count() == 1
    except AnalysisException:
        return False
