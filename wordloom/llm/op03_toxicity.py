"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier in numpy learns from confirmed toxic texts and unlabelled ones alone. Its risk is
prior * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - prior * E_pos[loss(-g)]): the second part is the risk on clean
texts, freed of the toxic share among the unlabelled; where it falls below zero, the step goes against it instead,
so that the classifier cannot fit unlabelled texts by calling all of them clean.

Features are the distinct 4-byte sequences of the lower-cased text, hashed into 2^20 places, so stems of any language
count. The prior is the toxic share over all label rows of the training fold, counted in Spark.

Sampling, for the fit alone: at most `n_positive` toxic and `n_unlabelled` other texts of the training fold, those of
smallest id hash. Every row of docs is scored, over its whole text.

Defined results: null and empty texts have no features and get the score of the classifier's bias; without toxic
training rows the score is the prior's default for all; rows that share a doc_id are scored each by its own text; a
null doc_id is never in the held-out fold and never used in training; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, give_back, utf8

BITS = 20


class Features:
    """Distinct hashed 4-byte sequences of texts, without sorting them."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, np.int32)

    def __call__(self, text: bytes, step: int = 1 << 22) -> np.ndarray:
        text = b" " + text.lower() + b" "
        found = []
        for at in range(0, max(1, len(text) - 3), step):
            raw = np.frombuffer(text[at : at + step + 3], np.uint8).astype(np.uint32)
            if len(raw) < 4:
                continue
            h = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
            h = ((h * np.uint32(0x9E3779B1)) ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS)
            order = np.arange(len(h), dtype=np.int32)
            self.last[h] = order
            found.append(h[self.last[h] == order])
        return found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 300, rate: float = 0.05, penalty: float = 0.0005, least_z: float = 5.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with logistic loss and an L1 penalty.

    Only features whose share of the positives differs from that of the unlabelled by least_z standard errors have a
    weight: of a million, the others would drown the few in noise.
    """
    weights, bias = np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return weights, bias
    rows = [*positive, *unlabelled]
    n_pos, n_unl = len(positive), len(unlabelled)
    flat = np.concatenate(rows)
    in_pos = np.bincount(np.concatenate(positive), minlength=1 << BITS)
    seen = np.bincount(flat, minlength=1 << BITS)
    share = seen / len(rows)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_pos + 1 / n_unl))
    used = np.flatnonzero((np.abs(in_pos / n_pos - (seen - in_pos) / n_unl) >= least_z * error) & (seen >= 3))
    place = np.full(1 << BITS, -1, np.int64)
    place[used] = np.arange(len(used))
    of = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    col = place[flat]
    of, col = of[col >= 0], col[col >= 0]
    w, b = np.zeros(len(used)), bias
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        g = b + np.bincount(of, w[col], len(rows))
        p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        loss_as_clean = np.logaddexp(0, g)
        clean = loss_as_clean[n_pos:].mean() - prior * loss_as_clean[:n_pos].mean()
        d = np.zeros(len(rows))
        if clean >= 0:
            d[:n_pos] = prior * (p[:n_pos] - 1) / n_pos - prior * p[:n_pos] / n_pos
            d[n_pos:] = p[n_pos:] / n_unl
        else:
            d[:n_pos] = prior * p[:n_pos] / n_pos
            d[n_pos:] = -p[n_pos:] / n_unl
        grad = np.bincount(col, d[of], len(used))
        grad = np.where(w == 0, np.sign(grad) * np.maximum(np.abs(grad) - penalty, 0), grad + penalty * np.sign(w))
        grad = np.append(grad, d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        moved = w - step[:-1]
        w = np.where(w * moved < 0, 0, moved)
        b -= step[-1]
    weights[used] = w
    return weights, float(b)


def _features_of(docs: DataFrame) -> list[np.ndarray]:
    """The features of a bounded number of rows, in id order."""

    def run(batches):
        make = Features()
        for batch in (x for b in batches for x in by_bytes(b, 1)):
            data = [make(t).astype("<u4").tobytes() for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])
        give_back()

    return [np.frombuffer(r["data"], "<u4") for r in sorted(docs.mapInArrow(run, "doc_id long, data binary").collect(), key=lambda r: (r["doc_id"], bytes(r["data"])))]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", n_positive: int = 2000, n_unlabelled: int = 4000, default_prior: float = 0.1, **kw) -> tuple[np.ndarray, float]:
    """Weights and bias from the training fold: rows whose crc32 of the id's text is no multiple of 5."""
    fold = lambda x: (F.crc32(F.col(x).cast("string").cast("binary")) % 5) != 0
    labels = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & fold("doc_id"))
    total = labels.agg(F.count("*").alias("n"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("p")).first()
    prior = float(np.clip(total["p"] / total["n"], 0.01, 0.9)) if total["n"] and total["p"] else default_prior
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("doc_id").isNotNull() & fold("doc_id"))
    order = (F.xxhash64("doc_id", F.lit(3)), F.col("doc_id"))
    toxic = labels.where("label = 1").select("doc_id").distinct()
    first = toxic.join(texts.select("doc_id"), "doc_id", "left_semi").orderBy(*order).limit(n_positive)
    other = texts.select("doc_id").orderBy(*order).limit(n_unlabelled)
    pick = lambda ids: _features_of(texts.join(F.broadcast(ids.distinct()), "doc_id", "left_semi"))  # noqa: E731  ids: bounded by its limit
    return fit(pick(first), pick(other), prior, **kw)


def scorer(spark: SparkSession, model: tuple[np.ndarray, float]) -> Callable[[Column], Column]:
    """A function from a text column to its score; the other columns of a table stay in the JVM."""
    weights = spark.sparkContext.broadcast(model[0])
    bias = model[1]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        make = Features()
        w = weights.value
        for column in batches:
            g = [bias + float(w[make(t)].sum(dtype=np.float64)) for x in by_bytes(pa.record_batch([column], ["text"]), 0) for t in utf8(x.column(0))]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(g, np.float64), -30, 30))), pa.float64())
        give_back()

    return F.arrow_udf(run, "double")


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), scorer(docs.sparkSession, model)(F.col(text_col).cast("string")).alias("score"))
    held = F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    return score(docs, train(docs, labels, **kw))


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs, with all their columns, that score below 0.5; each is judged by its own text, and none is moved."""
    score_of = scorer(docs.sparkSession, train(docs, labels, text_col=text_col, **kw))
    return docs.where(score_of(F.col(text_col).cast("string")) < 0.5)
