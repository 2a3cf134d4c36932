"""Vocabulary, special-byte and merge files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BAD_VOCAB
from ..operators.bpe import small


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


def parse_vocab(lines: DataFrame, column: str = "value") -> DataFrame:
    """token (binary), id; a line without separator raises."""
    line = F.col(column)
    at = F.instr(line, " == ")
    id_ = F.regexp_extract(F.substr(line, at + 4), r"^\s*([+-]?[0-9]+)", 1)
    token = F.unhex(F.array_join(F.regexp_extract_all(F.substr(line, F.lit(1), at - 1), F.lit("0x([0-9a-fA-F]{2})"), F.lit(1)), ""))
    return lines.select(F.when(at == 0, F.raise_error(F.lit(BAD_VOCAB))).otherwise(token).alias("token"), id_.try_cast("int").alias("id"))


def format_vocab(token: Column, id_: Column) -> Column:
    return F.concat(F.regexp_replace(F.hex(token), "(..)", "0x$1"), F.lit(" == "), id_.cast("string"))


def write_vocab(vocab: DataFrame, path: str) -> None:
    """One text file, ordered by id: a vocabulary is small."""
    vocab.orderBy("id").select(format_vocab(F.col("token"), F.col("id")).alias("value")).coalesce(1).write.text(path)


def parse_special(lines: DataFrame, column: str = "value") -> DataFrame:
    """byte, replacement; a line without separator or with another number than a byte's raises, and so does an empty replacement."""
    part = F.split(F.col(column), " == ", 2)
    byte = part[0].try_cast("int")
    wrong = (F.size(part) < 2) | byte.isNull() | (byte < 0) | (byte > 255)
    checked = F.when(wrong, F.raise_error(F.lit("Invalid format in special character file."))).otherwise(byte)
    value = F.when(F.get(part, 1) == "", F.raise_error(F.lit("Value is empty in special character file."))).otherwise(F.get(part, 1))
    return lines.select(checked.cast("int").alias("byte"), value.alias("replacement"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """surface, ord, analysis from files of lines "surface<tab>analysis"; ord is the line's number in its file.

    Each file is read in one task, since analyses of a word are in the order of their lines; lines without tab are left out.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "line"))
    part = F.split("line", "\t", 2)
    return lines.where(F.size(part) == 2).select(part[0].alias("surface"), "ord", part[1].alias("analysis"))


def resolve_merges(rules: DataFrame, vocab: DataFrame) -> DataFrame:
    """rank, left_id, right_id, merge_id of rules (line_no, left, right) whose sides and result are tokens.

    A merge file is small; its rank is a running number over all of it.
    """
    from pyspark.sql import Window

    side = lambda name: small(vocab.select(F.col("token").alias(name), F.col("id").alias(f"{name}_id")))
    found = rules.withColumn("merge", F.concat("left", "right")).join(side("left"), "left").join(side("right"), "right").join(side("merge"), "merge")
    rank = F.row_number().over(Window.orderBy("line_no")) - 1
    return found.select(rank.alias("rank"), "left_id", "right_id", "merge_id")
