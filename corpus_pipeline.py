"""A training corpus from raw documents: toxicity filter, exact dedup, near-dedup, packing.

Every stage but the last returns the columns of documents. Each works on all that its predecessor kept, and decides on
rows, not on doc_ids: rows are told apart by their place in the stage's input files. Near-duplicates have 80 % of their
distinct 5-word shingles in common.

Defined results: null and empty texts are never toxic by more than the classifier's bias, equal each other in exact
dedup (one of them stays) and are no one's near-copies; rows that share a doc_id are judged each by its own text, and
of rows that are equal in everything one stays; rows with a null doc_id are dropped and kept like others, after those
with one in a tie; an empty table gives no rows; columns besides doc_id and text can have any name and pass through
all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import read, small_batches, stored, with_row
from wordloom.llm.op03_toxicity import without_toxic
from wordloom.llm.op04_minhash import near_dedup
from wordloom.llm.op07_packing import pack
from wordloom.llm.op10_exact_dedup import exact_dedup

#: Two stages train or decide by method alone; tests hold run() against a brute-force version.
ORACLE_SQL = None

_ROW = "_row_of_stage"


def _kept(docs: DataFrame, judge) -> DataFrame:
    """The rows of docs that judge keeps; judge gives `row` and `kept` for each row of a table with a column of row keys."""
    rows = with_row(docs, _ROW)
    gone = stored(judge(rows.select("doc_id", "text", _ROW)).where("not kept").select(F.col("row").alias(_ROW)), "gone")
    return rows.join(gone, _ROW, "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _kept(docs, lambda rows: exact_dedup(rows, row_col=_ROW))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _kept(docs, lambda rows: near_dedup(rows, words=5, percent=80, row_col=_ROW))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("ids", F.base64("ids"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
