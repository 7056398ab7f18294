"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs has the columns of ``documents`` (more are kept,
whatever their names). All stages but the last return those columns. Every stage takes texts of any length, gives an
empty table for an empty one, and tells rows apart by more than their ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import bpe, decontaminate, lines, near, quality
from tabwright.llm.common import shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, trained on ``docs`` itself, rejects.

    Texts without words (null, empty) stay; repeated rows are judged alike, and ids don't matter but for the order of
    the training sample.
    """
    model, scorer = quality.train(docs)
    names = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.select(F.col("text"), F.struct(*names).alias("_row"))
    return quality.classify(own, model, scorer).filter("keep").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that came before, equal or near by length bands, and drops documents of which nothing is left; n_chars follows the text.

    Null, empty and blank texts stay as they are; null ids come last; rows that repeat id and text share every decision,
    so of a row and its copy under one id both stay here, and one goes in the next stage.
    """
    cut = lines.dedup_lines(docs, drop_emptied=True, bands=lines.BANDS)
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))) if "n_chars" in docs.columns else cut


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, similarity 0.8): the one with the smallest id, null ids last.

    Texts without words are copies of nothing and stay; of rows that repeat id and text one stays.
    """
    return near.keep_one(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of a benchmark item; null and empty texts have none, and rows are judged by their own texts."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids, their byte offsets and their number, row by row, in the place of columns of these names; null texts count as empty."""
    return bpe.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality", keep_good), ("line_dedup", cut_lines), ("near_dedup", keep_one_of_near), ("decontaminate", drop_leaked), ("bpe", tokenise)]

#: The first stages learn and compare hashes, which SQL can't express; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    """Through Hadoop's file systems, so that any shared store will do."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared checkpoint folder and read again. A stage's table goes when the next one is written; the last one stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            _delete(spark, before)
        before = f"{top}/{name}"
    return docs
