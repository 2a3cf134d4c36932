"""Morphemes of words from a lexicon of bracketed analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segments(analysis: Column) -> Column:
    """Every second piece between runs of brackets, beginning with the first piece that is not empty."""
    pieces = F.filter(F.split(analysis, r"[\[\]]+"), lambda x: x != "")
    return F.filter(pieces, lambda x, i: i % 2 == 0)


def depth(analysis: Column) -> Column:
    return F.length(analysis) - F.length(F.replace(analysis, F.lit("["), F.lit("")))


def look_up_words(words: DataFrame, lexicon: DataFrame, only_longest: bool = False) -> DataFrame:
    """word, ord, segments; lexicon: surface, ord, analysis. Longest: the first with the most opening brackets."""
    found = words.join(lexicon, words["word"] == lexicon["surface"]).select("word", "ord", "analysis")
    if only_longest:
        found = found.groupBy("word").agg(F.max_by(F.struct("ord", "analysis"), F.struct(depth(F.col("analysis")), -F.col("ord"))).alias("x")).select("word", "x.ord", "x.analysis")
    return found.select("word", "ord", segments(F.col("analysis")).alias("segments"))
