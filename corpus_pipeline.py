"""The training-text pipeline over ``documents``: five stages, each written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from fairlineage.llm import bpe, mixing, ngram_join, quality, secrets
from fairlineage.llm.queries import tokenizer_file
from fairlineage.session import delete_tables, recorded_tables, working_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def stage(fn: Stage) -> Stage:
    """A stage's result is written before the next stage begins, so its working tables go when that one begins."""

    @wraps(fn)
    def with_tables(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete_tables(spark, _left)
        with recorded_tables() as made:
            result = fn(spark, docs, sf_dir)
        _left.extend(made)
        return result

    return with_tables


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with five-word shingle sets similar to 0.8 or more, the one with the smallest id stays."""
    return ngram_join.one_per_group(docs, words_each=5, percent=80)


@stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    found = secrets.masked(docs, secrets.BlobLedger(spark, working_folder(spark)))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row per piece of a document in a block; a piece drawn twice is there twice."""
    pieces = mixing.mixed_texts(mixing.mix(docs, carried=docs.columns))
    return pieces.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every piece, and the text they decode to."""
    return bpe.encode_texts(docs, tokenizer_file())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan),
    ("mix_sources", mix_sources), ("encode", encode)]

#: Merges by rank, permuted draws and groups of similar sets are out of SQL's reach; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, from ``documents``; each is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage_ in STAGES:
        path = working_folder(spark)
        stage_(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        delete_tables(spark, before)
        before.append(path)
    delete_tables(spark, _left)
    return docs
