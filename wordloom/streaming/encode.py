"""Encoding of streams: row by row, without state, so the batch functions run as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import TokenizerModel
from ..operators.bpe import decode_column, encode_column


def encode_stream(stream: DataFrame, model: TokenizerModel, text_col: str = "text") -> DataFrame:
    return stream.withColumn("ids", encode_column(model)(text_col))


def register(spark: SparkSession, model: TokenizerModel, suffix: str = "") -> None:
    """encode_tokens(text) and decode_tokens(ids) for SQL."""
    spark.udf.register(f"encode_tokens{suffix}", encode_column(model))
    spark.udf.register(f"decode_tokens{suffix}", decode_column(model))
