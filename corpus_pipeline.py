"""The corpus pipeline: five stages over documents, each reading all that the one before kept.

Each stage is written as Parquet and read again by the next, so a lost executor
costs the tasks it was running and no more. All but the last return the columns
of documents; the last returns what the tokenizer made of the texts that stay.

In every stage a null text counts as empty, other columns of whatever name and
value come through as they are, and an empty table gives an empty one. Rows are
judged one by one: those repeated with the same id and text have the same
decision, except that the second stage keeps one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontaminate, exact_dedup, ngram_join, toxicity
from quern.llm.common import read_table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field rejects go; it is fitted on labelled rows of ``docs``.

    Without labels of both classes, or where nothing tells them apart, all stay. A row without an id is scored like any other.
    """
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=True).where("predicted = 0").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, one of those repeated with it, and a row without an id only if no equal text has one."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their 5-word shingles the one with the smallest doc_id stays.

    Empty texts and rows without an id are linked with nothing and stay.
    """
    linked = ngram_join.join(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__linked")).distinct()
    return docs.join(linked, F.col("doc_id") == F.col("__linked"), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one with other values in its slots, go. Empty items match nothing."""
    return decontaminate.scan(docs, read_table(spark, sf_dir, "benchmark"), carry=True).where("NOT contaminated").select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte_bpe", tokenize),
]

#: The toxicity model and the tokenizer can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
