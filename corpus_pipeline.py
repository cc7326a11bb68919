"""A corpus pipeline: each stage is written as Parquet and read again as the documents of the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.decontaminate import drop_contaminated
from strandline.llm.mixing import mixed
from strandline.llm.near_dedup import drop_near_duplicates
from strandline.llm.quality_rules import drop_rejected
from strandline.llm.secrets import redact_secrets
from strandline.llm.shared import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the quality rules reject; rows are judged one by one, so repeated ones and those without doc_id are treated alike.

    Blank and null texts have fewer than 50 words and go; very long ones are judged whole; an empty table stays empty.
    """
    return drop_rejected(docs, _table(spark, sf_dir, "labels").filter("quality = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles, similarity 0.8.

    Of rows that share a doc_id one stays; rows without doc_id, and texts without words, stay; an empty table stays empty.
    """
    return drop_near_duplicates(docs, shingle=5, percent=80).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that overlap a benchmark item, all rows of such a doc_id; rows without doc_id stay, as do blank texts."""
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark")).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts; all rows stay, n_chars follows the text."""
    return redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the words taken of each for the target mix; what the mix leaves out has taken 0."""
    return mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs


#: SQL cannot express the learned stages; tests compare every stage with a plain version of it on a fixture.
ORACLE_SQL: str | None = None
