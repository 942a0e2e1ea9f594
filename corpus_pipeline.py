"""A training corpus in five stages. Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents, of any names. An empty table gives an empty one at every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomweave.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from atomweave.llm.common import written
from atomweave.llm.queries import WEIGHTS, tokenizer_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels beside the corpus, does not reject.

    Null and empty texts are scored as one passage without words, long ones by all passages; repeated rows go or stay together.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the largest doc_id, of rows that share it the first. Null counts as empty; null ids come last."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents linked at a similarity of 0.8 over five-word shingles: the smallest doc_id, of rows that share it the first.

    Null, empty and wordless texts link with nothing and stay; null ids come last.
    """
    return jaccard_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources at the target weights; a row comes as often as its epochs take it. Null languages and sources are leaves named ''; rows of equal id and text go together."""
    return mixing.mixed(docs, weights=WEIGHTS, fraction=0.8, epochs=4, seed=17)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the digest of the decoded text. Null texts count as empty: no ids."""
    r = bpe.encode_decode(docs, tokenizer_path())
    return r.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality classifier", classify), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("mixing sources", mix), ("BPE encoding", tokenize)]

#: The classifier's scores are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "pipeline")
    return docs
