"""The corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, tokens.

Each stage takes the documents that its predecessor kept and returns those that
it keeps, all columns of the table as they were (``text`` and ``n_chars`` of
documents that lose lines are new); the last returns one row of digests per
document. Every stage is written as Parquet to the shared folder and read
again, so a lost executor never costs more than its own stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.llm import decontaminate, lines, minhash, toxicity
from hydrolake.llm.queries import fold, table, token_digests
from hydrolake.sources.shared import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, scores below 0.5."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), only=fold() != 0)
    return toxicity.score(docs, model, "_toxicity").where("_toxicity < 0.5").drop("_toxicity")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of lines that an earlier one has; those of which nothing is left go."""
    out = lines.dedup_lines(docs)
    return out.where("n_removed = 0 OR trim(text) <> ''").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of each document."""
    return token_digests(docs, "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("byte_bpe", tokenize),
]

#: The classifier, the signatures and the tokenizer are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
