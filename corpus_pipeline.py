"""From raw documents to packed training sequences: drop toxic texts, drop low quality, keep one of
each class of near duplicates, mix the sources, pack.

Every stage gets all rows that its predecessor kept, as the columns of `documents`, and each result is
written as Parquet and read again by the next.  Stages are judged on their own input: they learn and
count on the rows they get.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factorloom.llm import dart_minhash, mixing, packing, quality, toxicity
from factorloom.llm.common import shared_folder
from factorloom.llm.tokenizer import vocabulary

#: Training, sorting by hashed signatures and tokenizing have no SQL; the tests use small copies.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score stays below the threshold, by a model fitted on the rows given.

    A null or empty text scores as one without marks; ties, repeated rows and null ids are scored each; a very
    long text is scored whole; without a confirmed toxic text, or rows, nothing goes.  Other columns stay.
    """
    model = toxicity.train(docs, _labels(spark, sf_dir))
    scored = toxicity.with_scores(docs, model, out="__toxicity")
    return scored.filter(F.col("__toxicity") < toxicity.THRESHOLD).drop("__toxicity")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and, where trusted texts are known, the log-likelihood ratio.

    A null or empty text has no words and goes; repeated rows are judged alike; null ids are untrusted; a
    very long text is judged whole; an empty table stays empty.  Other columns stay.
    """
    ratios = quality.bucket_ratios(docs, quality.trusted(_labels(spark, sf_dir)))
    return quality.keep_good(quality.judge(docs, ratios))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the smallest id, one of it if it is repeated.

    A text of fewer than five words is compared as one run; null and empty texts and rows without an id are
    kept; a very long text is compared whole; an empty table stays empty.  Other columns stay.
    """
    return dart_minhash.without_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of words that the mix takes of each row, as texts; a row that it takes nothing of goes.

    A null source is one of its own; null and empty texts have no words and go; repeated rows count
    each; a very long text is as many blocks as it fills; an empty table stays empty.
    """
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the rows' ids in windows of 1024, with a checksum in place of the ids.

    A null or empty text is its end id; repeated rows are packed each; null ids stay null; a very long text
    spans windows; an empty table has no piece.  Other columns are not read.
    """
    tokens = packing.tokenized(docs, vocabulary("byte_bpe_50k.json"), end_id=0)
    pieces = packing.pack(tokens)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
