"""A corpus-cleaning pipeline of five operators.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame that
is written as Parquet and read again as the next stage's docs. All but the last return the columns of
``documents``. Rows without a doc_id cannot be named by a decision and are kept as they are; null texts stay null
through filters and are empty where text is cut or encoded. Columns other than those of ``documents`` are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grandlivre.llm import bpe, decontaminate, jaccard_join, suffix_dedup, toxicity
from grandlivre.llm.common import materialize, remainder
from grandlivre.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keep(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the ids of ``rejected``."""
    return docs.join(rejected.select("doc_id").distinct(), "doc_id", "left_anti").select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at 0.5 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 5) != 0)
    model = toxicity.train(docs, labels)
    return _keep(docs, toxicity.score(docs, model).where("score >= 0.5"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by similar word 5-grams the one with the smallest id stays, and so does an id that any of its texts keeps."""
    found = jaccard_join.similar(docs).groupBy("doc_id").agg(F.bool_and(F.col("class_id") != F.col("doc_id")).alias("copy"))
    return _keep(docs, found.where("copy"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by 100-byte strings that start earlier are cut; characters that a cut splits (and U+FFFD) go with it."""
    found = suffix_dedup.deduplicate(docs.withColumn("absent", F.col("text").isNull()), carry=("absent", "lang", "source", "n_chars"))
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.translate(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", "")).when(~F.col("absent"), F.col("kept").cast("string"))
    out = found.withColumn("text", text).withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.find_phrases(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _keep(docs, found.where("n_hit > 0").select(F.col("doc").alias("doc_id")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, with digests of ids and decoded bytes."""
    return bpe.digests(docs, *vocabulary())


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_copies), ("suffix_dedup", cut_repeats), ("decontaminate", drop_contaminated), ("bpe", encode)]
#: Learned scores, similarity joins and merge ranks have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
