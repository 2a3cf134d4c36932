"""Learning byte-pair vocabularies: pair counts, the winner of a round, replacement, and the whole loop.

A row is a text whose characters are token ids: byte b is U+00b, a learned id k is code point k (from 0xD800 on
shifted past the surrogates). Pairs never cross rows. Among pairs with the highest count the one wins whose last
place comes first, that is, which reached the count first in a scan. A round is one distributed aggregate: executors
count the pairs of about a million characters at once with numpy, Spark adds these counts; only the winner comes to the
driver.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, IntegralType, LongType, StringType, StructField, StructType, TimestampType

from ..model import format_vocab_line
from .bpe import parts

#: Bytes of text whose pairs are counted at once.
STEP = 1 << 20


def as_ids(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def id_char(i: int) -> str:
    return chr(i if i < 0xD800 else i + 0x800)


def char_id(c: str) -> int:
    return ord(c) if ord(c) < 0xD800 else ord(c) - 0x800


def pair_rows(texts: DataFrame, order: str = "doc_id", column: str = "s") -> DataFrame:
    """(order, pos, pair) for each two neighbours; overlapping pairs all count."""
    units = F.regexp_extract_all(F.col(column), F.lit(r"[\s\S]"), F.lit(0))
    texts = texts.select(order, units.alias("u")).where(F.size("u") > 1)
    pairs = F.zip_with(F.slice("u", F.lit(1), F.size("u") - 1), F.slice("u", F.lit(2), F.size("u") - 1), lambda a, b: F.concat(a, b))
    return texts.select(order, F.posexplode(pairs).alias("pos", "pair"))


def _tally(texts: list[str], ranks: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Left and right character, count, and row and place of the last occurrence, of each pair in some texts.

    ranks: of the rows, ascending; the last place is one of the highest rank, and in equal ranks the highest. None: each
    row is counted by itself.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    known = np.arange(256) if not len(codes) or codes.max() < 256 else np.unique(codes)
    symbols = codes.astype(np.int64) if len(known) == 256 and known[-1] == 255 else np.searchsorted(known, codes)
    square = len(known) ** 2
    inner = np.ones(max(len(codes) - 1, 0), bool)
    inner[(cut := ends[ends > 0] - 1)[cut < len(inner)]] = False  # no pair reaches into the next row
    at = np.flatnonzero(inner)
    if ranks is not None and len(np.unique(ranks)) < len(ranks):
        row = np.searchsorted(ends, at, "right")
        at = at[np.lexsort((at - (ends - sizes)[row], ranks[row]))]
    keys = symbols[at] * len(known) + symbols[at + 1]
    if ranks is not None and square <= 1 << 16:
        last = np.zeros(square, np.int64)
        last[keys] = at  # of equal keys the last one stays
        n = np.bincount(keys, minlength=square)
        pairs = np.flatnonzero(n)
        n, last = n[pairs], last[pairs]
    else:
        if ranks is None:
            keys += np.searchsorted(ends, at, "right") * square
        pairs, back, n = np.unique(keys[::-1], return_index=True, return_counts=True)
        last, pairs = at[::-1][back], pairs % square
    row = np.searchsorted(ends, last, "right")
    return known[pairs // len(known)], known[pairs % len(known)], n, row, last - (ends - sizes)[row]


def _counted(texts: DataFrame, order: str, column: str, by_row: bool) -> DataFrame:
    """order, pair, n, pos: pairs of a part of the rows (or of each row), how often they occur there, and their last place."""
    texts = texts.select(order, F.col(column).alias("s")).where(F.length("s") > 1)
    schema = StructType([texts.schema[0], StructField("pair", StringType()), StructField("n", LongType()), StructField("pos", IntegerType())])

    def run(batches):
        def table(keys, texts, ranks, first=0):
            left, right, n, row, place = _tally(texts, ranks)
            pairs = pa.array([chr(a) + chr(b) for a, b in zip(left.tolist(), right.tolist())], pa.string())
            return pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pairs, pa.array(n, pa.int64()), pa.array(first + place, pa.int32())], names=schema.names)

        for batch in batches:
            at = 0
            for part in parts(batch.column(1), STEP):
                keys, rows, ranks = batch.column(0).slice(at, len(part)), part, None
                at += len(part)
                if not by_row:
                    ranks = pc.rank(keys, null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
                    by = np.argsort(ranks, kind="stable")
                    keys, rows, ranks = keys.take(pa.array(by)), part.take(pa.array(by)), ranks[by]
                rows, short = rows.to_pylist(), []
                for i, text in enumerate(rows):  # a long text goes piece by piece, which overlap by a character
                    if len(text) > 2 * STEP:
                        for first in range(0, len(text) - 1, STEP):
                            yield table(keys.slice(i, 1), [text[first : first + STEP + 1]], np.zeros(1, np.int64), first)
                    else:
                        short.append(i)
                if short:
                    yield table(keys.take(pa.array(short)), [rows[i] for i in short], None if ranks is None else ranks[short])

    return texts.mapInArrow(run, schema)


def pair_counts(texts: DataFrame, order: str = "doc_id", column: str = "s") -> DataFrame:
    """pair, n, last: count and last place of each pair.

    Rows whose order is of another type than these are counted each by itself, so that Spark alone compares them.
    """
    kind = texts.select(order).schema[0].dataType
    by_row = not (isinstance(kind, (IntegralType, DateType, TimestampType)) or kind == StringType())
    last = F.max(F.struct(F.col(order), F.col("pos"))).alias("last")
    return _counted(texts, order, column, by_row).groupBy("pair").agg(F.sum("n").alias("n"), last)


def pair_counts_of_rows(texts: DataFrame, order: str = "doc_id", column: str = "s") -> DataFrame:
    """order, pair, n, last: the pairs of each row (of all rows with the same order), with count and last place."""
    return _counted(texts, order, column, True).groupBy(order, "pair").agg(F.sum("n").alias("n"), F.max("pos").alias("last"))


def best_pair(counts: DataFrame) -> tuple[str, int] | None:
    top = counts.orderBy(F.desc("n"), F.asc("last")).limit(1).collect()
    return (top[0]["pair"], top[0]["n"]) if top else None


def merge_pair(column: Column, pair: str, new: str) -> Column:
    """All occurrences of pair, left to right and without overlap, as new."""
    return F.replace(column, F.lit(pair), F.lit(new))


def train(texts: DataFrame, vocab_size: int, order: str = "doc_id", text_col: str = "text", least: int = 2, first_id: int = 256, every: int = 8) -> tuple[dict[int, bytes], list[tuple[int, str, int]]]:
    """Tokens by id, and the log (id, pair, count). Stops at vocab_size, or when no pair occurs `least` times.

    Pairs cross words, so rounds count whole texts. Every `every` rounds the texts are written to the shared folder
    (spark.checkpoint.dir) and read again, which cuts the plan; what was written before goes. A pair cannot win twice:
    after its round it stands nowhere.
    """
    if vocab_size < 256:
        raise RuntimeError("vocab_size must be at least 256.")
    spark = texts.sparkSession
    rows = texts.select(F.col(order), as_ids(F.coalesce(F.col(text_col), F.lit(""))).alias("s"))
    tokens: dict[int, bytes] = {i: bytes([i]) for i in range(256)}
    log: list[tuple[int, str, int]] = []
    root, held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir(), None
    while len(tokens) < vocab_size:
        best = best_pair(pair_counts(rows, order))
        if best is None or best[1] < least:
            break
        new = first_id + len(log)
        tokens[new] = b"".join(tokens[char_id(c)] for c in best[0])
        log.append((new, best[0], best[1]))
        rows = rows.withColumn("s", merge_pair(F.col("s"), best[0], id_char(new)))
        if root and len(log) % every == 0:
            path = f"{root.rstrip('/')}/wordloom/train-{uuid.uuid4().hex}"
            rows.write.parquet(path)
            rows = spark.read.parquet(path)
            _remove(spark, held)
            held = path
    _remove(spark, held)
    return tokens, log


def _remove(spark: SparkSession, path: str | None) -> None:
    if path:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def train_compat(text: str, vocab_size: int) -> list[tuple[str, int, int]]:
    """What training without a least count makes of one short text when two faults of old vocabularies are kept.

    For vocabularies that must come out as they once did: (token, id, count) by round. Faults: the places behind the
    live symbols keep what they held before and are still counted; the last live symbol is lost in each round in which
    it is not the right side of the winner. Ends, too, when a pair wins in two rounds on end, or at fewer than two symbols.
    """
    if vocab_size < 256:
        raise RuntimeError("vocab_size must be at least 256.")
    data = text.encode()
    places = [data[i : i + 1] for i in range(len(data))]
    live, known, out = len(places), 256, []
    names, last = set(), None
    while known < vocab_size and live >= 2:
        seen: dict[bytes, int] = {}
        best, most = None, 0
        for pair in map(bytes.__add__, places, places[1:]):
            seen[pair] = seen.get(pair, 0) + 1
            if seen[pair] > most:
                best, most = pair, seen[pair]
        out.append((best.decode("utf-8", "replace"), known + 1, most))
        if best not in names:
            names.add(best)
            known += 1
        kept, at = [], 0
        while at < live - 1:
            both = places[at] + places[at + 1]
            kept.append(both if both == best else places[at])
            at += 2 if both == best else 1
        places[: len(kept)] = kept
        live = len(kept)
        if best == last:
            break
        last = best
    return out


def train_bbpe(texts: DataFrame, vocab_size: int, **kw) -> tuple[dict[int, bytes], list[tuple[int, str, int]]]:
    """Byte-level training: stops when no pair occurs twice."""
    return train(texts, vocab_size, least=2, **kw)


def train_bpe(texts: DataFrame, vocab_size: int, **kw) -> tuple[dict[int, bytes], list[tuple[int, str, int]]]:
    """Training without a least count; learned ids start at 257, as the count of tokens is taken before adding.

    For old faults, see train_compat.
    """
    return train(texts, vocab_size, least=1, first_id=257, **kw)


def write_vocab(tokens: dict[int, bytes], path: str) -> None:
    """A vocabulary file, ordered by id; the name must end in .txt."""
    if not path.endswith(".txt"):
        raise RuntimeError("File name must end with .txt.")
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.writelines(format_vocab_line(t, i) + "\n" for i, t in sorted(tokens.items()))
