"""The registered queries of this folder, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import new_folder
from ..sources.tables import table
from . import bpe, collocation, decontam, exact, linededup, mixing, pii, pitmanyor, ranked, sharding, simhash, substring, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def write_table(df: DataFrame) -> DataFrame:
    """Cut lineage: write a table to the shared folder, well compressed as texts are, and read it again."""
    path = new_folder(df.sparkSession, "llm")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in every whole text of documents."""
    return decontam.report(decontam.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spans=False))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents in windows of 13 that start in an earlier document too."""
    return substring.report(table(spark, sf_dir, "documents"), write_table)


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitman-Yor scores of all documents, learnt from those that are not held out."""
    return pitmanyor.score(table(spark, sf_dir, "documents"), write_table)


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents, learnt from labels.toxic."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), write_table)


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that lie in a run that occurred earlier."""
    return linededup.report(table(spark, sf_dir, "documents"), write_table)


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), write_table)


@query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of four-word shingles over all documents, linked at four bits or fewer."""
    return simhash.near_dedup(table(spark, sf_dir, "documents"), write_table)


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact.dedup(table(spark, sf_dir, "documents"))


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 shards of equal weight, and over 25 for grown_shard."""
    return sharding.assign(table(spark, sf_dir, "documents"), weights=[1.0] * 24, grown=[1.0] * 25)


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two and three words over all documents, 2000 a language."""
    return collocation.mine(table(spark, sf_dir, "documents"), write_table)


@query
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by sources that weigh 5, 2 and 1, at most three times a source."""
    return mixing.report(mixing.allocate(table(spark, sf_dir, "documents"), write_table))


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for each benchmark item."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), write_table)


SQL.update(
    op1_decontamination=decontam.SQL,
    op2_substring_dedup=substring.SQL,
    op5_line_dedup=linededup.SQL,
    op9_exact_dedup=exact.SQL,
    op11_collocations=collocation.SQL,
    op12_mixing=mixing.SQL,
    op13_ranked_search=ranked.SQL,
)
