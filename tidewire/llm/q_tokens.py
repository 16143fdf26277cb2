"""Queries of corpus encoding (p8) and source mixing (p9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import encode, mixture


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encode_texts(table(spark, sf_dir, "documents"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document decoded from its ids again."""
    return encode.decode_ids(p8_ids(spark, sf_dir))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"])


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mixture with the number of times each is used."""
    return mixture.mix_sources(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares that the mixture reaches, by source."""
    return mixture.mix_sources(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[1]


QUERIES = {"p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_mix": p9_mix, "p9_shares": p9_shares}
