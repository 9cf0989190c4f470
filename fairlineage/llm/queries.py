"""Registered queries of this subpackage: name → function of (session, folder of the parquet tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import working_folder
from . import (block_join, bpe, html_crf, licenses, lm, mixing, ngram_join, pii, quality, secrets, shallot, topk,
               whitening)
from .common import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf, "documents"))


@query
def op10_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(bpe.encode_texts(read(spark, sf, "documents"), tokenizer_file()))


@query
def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(read(spark, sf, "documents")))


@query
def op5_secrets(spark: SparkSession, sf: str) -> DataFrame:
    ledger = secrets.BlobLedger(spark, working_folder(spark))
    return secrets.digests(secrets.scan_documents(read(spark, sf, "documents"), ledger))


@query
def op4_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_groups(read(spark, sf, "documents"))


@query
def op2_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal_data(read(spark, sf, "documents"))


@query
def op9_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf, "documents"))


@query
def op6_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.nearest_by_sign(read(spark, sf, "embeddings"))


@query
def op8_lm(spark: SparkSession, sf: str) -> DataFrame:
    return lm.lm_scores(read(spark, sf, "documents"))


@query
def op3_html_crf(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages")
    return html_crf.main_text(pages, html_crf.fit(pages)).withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op11_block_join(spark: SparkSession, sf: str) -> DataFrame:
    return block_join.nearest_by_cosine(read(spark, sf, "embeddings"))


@query
def op12_shallot(spark: SparkSession, sf: str) -> DataFrame:
    return shallot.clustered(read(spark, sf, "embeddings"))


@query
def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(read(spark, sf, "embeddings"))
