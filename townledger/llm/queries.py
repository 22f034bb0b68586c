"""Registered queries of the operators, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact, html, licences, mixing, near, negatives, phrases, quality, simhash, substring, warc
from .common import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(table: str, sql: str | None = None):
    """Register a function of one table as the query of its own name."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet"))
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return add


@query("documents", substring.SQL)
def op1_substring_dedup(docs: DataFrame) -> DataFrame:
    """Every document without the words of passages of 35 words or more that start elsewhere too."""
    return substring.remove_recurring(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


@query("pages", warc.SQL)
def op2_warc(pages: DataFrame) -> DataFrame:
    """All pages written as dictionary-compressed WARC records and read back."""
    return warc.archive(pages)


@query("documents", exact.SQL)
def op3_exact_dedup(docs: DataFrame) -> DataFrame:
    """Exact copies of every document, the largest id stays."""
    return exact.exact_dedup(docs)


@query("documents", quality.SQL)
def op4_quality_rules(docs: DataFrame) -> DataFrame:
    """Base figures and the verdict of line-first cleaning for every document."""
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("documents")
def op9_bpe(docs: DataFrame) -> DataFrame:
    """Ids of every document and the bytes they stand for, as digests."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("documents", near.SQL)
def op5_near_dedup(docs: DataFrame) -> DataFrame:
    """Near-duplicate group of every document at a similarity of 0.75, the smallest id stays."""
    return near.near_groups(docs)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors, rate and number of copies of every document for the target weights."""
    prepare(spark)
    return mixing.rates(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES["op7_mixing"] = op7_mixing


@query("pages")
def op6_html_text(pages: DataFrame) -> DataFrame:
    """Main text of every page."""
    return html.extract(pages)


@query("documents")
def op8_licence_scan(docs: DataFrame) -> DataFrame:
    """Licence notices of every document; one row each, and one without licence for documents that have none."""
    return licences.scan(docs).select("doc_id", F.explode_outer("notices").alias("x")).select("doc_id", "x.*")


@query("conversations")
def op10_chat_repair(turns: DataFrame) -> DataFrame:
    """Repaired role and rendered piece of every turn."""
    return chat.repair(turns)


@query("documents")
def op12_simhash_dedup(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document and the group of fingerprints within three bits it belongs to."""
    return simhash.simhash_groups(docs)


@query("embeddings", negatives.SQL)
def op13_hard_negatives(vectors: DataFrame) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    return negatives.hard_negatives(vectors)


@query("documents", phrases.SQL)
def op11_phrase_mining(docs: DataFrame) -> DataFrame:
    """The first 2,000 phrases of every language by the score of their weakest cut."""
    return phrases.collocations(docs)
