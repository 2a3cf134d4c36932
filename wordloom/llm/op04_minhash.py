"""Near-dedup with MinHash and tensored banding.

A document is its set of distinct word shingles. Two collections of `m` half-keys, each of `r` minhashes, make
m * m tables: the key of table (i, j) is half-key i of the first collection with half-key j of the second. So
2 * m * r minhashes serve m * m tables of 2 * r rows, about a square root of what separate tables take. Two sets of
Jaccard similarity s share a table with probability (1 - (1 - s^r)^m)^2: 0.9999 for s = 0.8, r = 2, m = 10.

1. Equal sets fall to one representative (128-bit hash of the sorted set), so copies cost nothing later.
2. In each bucket every member meets the bucket's smallest member; never all pairs.
3. Candidate pairs of the tables pass a size bound and a loose bound on equal minhashes (a true link fails it with
   probability below 1e-6, and step 5 still finds it), then are verified on full sets, one partner for each document at
   a time, so that pairs whose ends are already connected need no verification.
4. Connected components come from minimum labels with pointer jumping, as tables.
5. Documents in buckets that still hold several components are joined exactly among themselves by prefix
   filtering: each posts only its rarest items, one of which any similar set must share, and the places of a shared
   item bound what two sets can have in common, as the parities of hashed items (1,024 bits for a set) bound in how
   many they differ. Postings whose members are in one component already drop out; the
   pairs of the others that the bound allows are listed, and while there are too many to look at, the member that
   shares most meets all others of its posting and leaves it, in as many rounds as that takes. These pairs pass by
   the bound on minhashes. So no link among these documents is lost, and the pairs of a large group are never all made.

Inside, a document is a number of its class, whatever its doc_id. Tables of one row for each key are stored before rows
are joined to them, so that the rows of a hot key can be split among tasks; hot classes and components are broadcast.

Defined results: null or empty texts and texts without words have an empty set, belong to no other and keep
themselves; equal sets are one class, whatever their texts; rows that share a doc_id get the component of their
own text; a row with a null doc_id links like any other but names its component only if no other row can, and then the
first by the row key alone is kept; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, give_back, hot_join, scratch, stored, utf8, with_row

_ODD = np.random.default_rng(4).integers(1, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(44).integers(1, 1 << 63, 512, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    parts = text.lower().split()  # of bytes: A-Z alone, and [\x20\x09-\x0D] alone
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = min(words, len(parts))
    rolled = np.full(len(parts) - n + 1, n, np.uint64)
    for i in range(n):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
        rolled ^= rolled >> np.uint64(29)
    return np.unique(_mixed(rolled))


def minhashes(shingles: np.ndarray, n: int) -> np.ndarray:
    return np.array([((shingles * _ODD[i] + _ADD[i]) >> np.uint64(32)).min() for i in range(n)], np.uint32)


def half_keys(signature: np.ndarray, m: int, r: int) -> np.ndarray:
    """2 * m half-keys of each row's 2 * m * r minhashes."""
    parts = signature.reshape(len(signature), 2 * m, r).astype(np.uint64)
    out = np.zeros((len(signature), 2 * m), np.uint64) + np.arange(1, 2 * m + 1, dtype=np.uint64)
    for i in range(r):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return out


def tensored_keys(halves: np.ndarray, m: int) -> np.ndarray:
    """m * m table keys of each row, from pairs of its half-keys."""
    pairs = halves[:, :m, None] * np.uint64(0x9E3779B97F4A7C15) + halves[:, None, m:]
    return _mixed(pairs).reshape(len(halves), m * m)


def signatures(docs: DataFrame, words: int, m: int, r: int) -> DataFrame:
    """docs: doc_id, text, row."""

    def run(batches):
        for batch in (x for b in batches for x in by_bytes(b, 1)):
            n, low, high, signs = [], [], [], []
            for text in utf8(batch.column(1)):
                own = shingle_set(text, words)
                n.append(len(own))
                key = xxhash.xxh3_128_digest(own.tobytes())
                low.append(int.from_bytes(key[:8], "little", signed=True))
                high.append(int.from_bytes(key[8:], "little", signed=True))
                signs.append(minhashes(own, 2 * m * r).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(signs, pa.binary()), batch.column(2)], names=["doc_id", "n_shingles", "k1", "k2", "sign", "row"])
        give_back()

    return docs.select("doc_id", "text", "row").mapInArrow(run, f"doc_id long, n_shingles long, k1 long, k2 long, sign binary, row {docs.schema['row'].dataType.simpleString()}")


def table_rows(members: DataFrame, m: int, r: int) -> DataFrame:
    """(key, doc) for each table; members: doc, sign."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                signs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(part.num_rows, -1)
                keys = tensored_keys(half_keys(signs, m, r), m)
                docs = np.repeat(part.column(0).to_numpy(), m * m)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(docs)], names=["key", "doc"])
        give_back()

    return members.select("doc", "sign").mapInArrow(run, "key long, doc long")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in (x for b in batches for x in by_bytes(b, 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, words).tobytes() for t in utf8(batch.column(1))], pa.binary())], names=["doc", "items"])
        give_back()

    return docs.select("doc", "text").mapInArrow(run, "doc long, items binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            hit = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(one.as_py(), np.uint64), np.frombuffer(two.as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                hit.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))
        give_back()

    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("items").alias("one")), "a").join(sets.select(F.col("doc").alias("b"), F.col("items").alias("two")), "b")
    return both.select("a", "b", "one", "two").mapInArrow(run, "a long, b long")


def _likely(pairs: DataFrame, members: DataFrame, percent: int, total: int, sure: bool) -> DataFrame:
    """The pairs that sizes and, unless sure, equal minhashes allow."""
    side = lambda x, *more: members.select(F.col("doc").alias(x), F.col("n_shingles").alias(f"n_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in more))
    sized = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    if sure:
        return pairs.join(side("a"), "a").join(side("b"), "b").where(sized).select("a", "b")
    bound = 0
    p = percent / 100
    chance = (1 - p) ** total  # of `bound` equal minhashes or fewer, at the least similarity
    sum_ = chance
    while bound < total and sum_ < 1e-7:
        bound += 1
        chance *= (total - bound + 1) / bound * p / (1 - p)
        sum_ += chance

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
                hit = (one == two).sum(axis=1) >= bound
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hit))

    joined = pairs.join(side("a", "sign"), "a").join(side("b", "sign"), "b").where(sized)
    return joined.select("a", "b", "sign_a", "sign_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, comp): the smallest vertex that each vertex of edges (a, b) reaches."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = stored(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("low")).select("v", F.least("v", "low").alias("comp")), "labels")
    while True:
        near = both.join(label, both.b == label.v).groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("near"))
        step = stored(label.join(near, "v").select("v", F.least("comp", "near").alias("comp"), F.col("comp").alias("was")), "labels")
        onto = step.select(F.col("v").alias("comp"), F.col("comp").alias("next"))
        new = stored(step.join(onto, "comp", "left").select("v", F.coalesce("next", "comp").alias("comp"), "was"), "labels")
        if new.where("comp <> was").isEmpty():
            return new.select("v", "comp")
        label = new.select("v", "comp")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(key, doc, n, rest) for the items, rarest first, that a similar set must share at least one of.

    Of n items in rarity order, one of the first n - ceil(percent% of n) + 1 is in any similar set; those that are
    in no other of these sets give no row. rest: how many items from this one on are in any other set. Two sets that
    share this item and none before it have at most the smaller rest in common.
    """

    def run(batches):
        for batch in batches:
            for doc, items in zip(batch.column(0), batch.column(1), strict=True):
                own = np.frombuffer(items.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), doc.as_py())), pa.array(np.full(len(own), len(own)))], names=["item", "doc", "n"])

    items = stored(sets.select("doc", "items").mapInArrow(run, "item long, doc long, n long"), "items")
    seen = items.groupBy("item").agg(F.count("*").alias("seen")).where("seen > 1")
    held = items.join(seen, "item").groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("seen", "item"))).alias("held"))
    held = held.withColumn("most", F.size("held").cast("long"))
    room = f"cast(n - (n * {percent} + 99) div 100 + 1 - (n - most) as int)"
    held = held.where(f"{room} > 0").withColumn("held", F.expr(f"slice(held, 1, {room})"))
    return held.select("doc", "n", "most", F.posexplode("held").alias("at", "h")).select(F.col("h.item").alias("key"), "doc", "n", (F.col("most") - F.col("at")).alias("rest"))


_WORDS = 16


def parities(sets: DataFrame) -> DataFrame:
    """(doc, p0 to p15): for each of 1,024 hash values, whether an odd number of the set's items has it.

    Each bit that differs between two sets stands for an item, at least, that is in one of them alone.
    """

    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, _WORDS), np.uint64)
            for i, items in enumerate(batch.column(1)):
                odd = np.bincount(np.frombuffer(items.as_py(), np.uint64) & np.uint64(64 * _WORDS - 1), minlength=64 * _WORDS) & 1
                out[i] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, k].view(np.int64)) for k in range(_WORDS))], names=["doc", *(f"p{k}" for k in range(_WORDS))])
        give_back()

    return sets.select("doc", "items").mapInArrow(run, "doc long, " + ", ".join(f"p{k} long" for k in range(_WORDS)))


class _Linker:
    """Candidate pairs in, verified links and components out."""

    def __init__(self, docs: DataFrame, classes: DataFrame, words: int, percent: int, n_hashes: int, many: int):
        self.docs, self.classes, self.words, self.percent, self.n_hashes, self.many = docs, classes, words, percent, n_hashes, many
        self.rounds = 0
        spark = docs.sparkSession
        self.sets = spark.createDataFrame([], "doc long, items binary")
        self.met = spark.createDataFrame([], "a long, b long")
        self.comp = spark.createDataFrame([], "v long, comp long")

    def need_sets(self, ends: DataFrame) -> None:
        missing = ends.select("doc").distinct().join(self.sets.select("doc"), "doc", "left_anti")
        missing = stored(self.classes.select("doc", F.col("first.row").alias("row")).join(missing, "doc", "left_semi"), "missing")
        texts = self.docs.select("row", "text").join(missing, "row")
        self.sets = self.sets.unionByName(stored(full_sets(texts, self.words), "sets"))

    def _open(self, pairs: DataFrame) -> DataFrame:
        ca = self.comp.select(F.col("v").alias("a"), F.col("comp").alias("c1"))
        cb = self.comp.select(F.col("v").alias("b"), F.col("comp").alias("c2"))
        return pairs.join(ca, "a", "left").join(cb, "b", "left").where("coalesce(c1, a) <> coalesce(c2, b)").select("a", "b")

    def _verify(self, pairs: DataFrame) -> None:
        links = stored(_verified(pairs, self.sets, self.percent), "links").distinct()
        if not links.isEmpty():
            # A component's links, however many, are as good as those of its members to its smallest.
            self.comp = components(links.unionByName(self.comp.select(F.col("v").alias("a"), F.col("comp").alias("b")).where("a <> b")))

    def add(self, pairs: DataFrame, sure: bool = False) -> None:
        pairs = stored(_likely(pairs.join(self.met, ["a", "b"], "left_anti"), self.classes, self.percent, self.n_hashes, sure), "pairs")
        if pairs.isEmpty():
            return
        self.met, self.rounds = self.met.unionByName(pairs), self.rounds + 1
        if self.rounds % 8 == 0:  # unions of many tables make long plans
            self.met, self.sets = stored(self.met, "met"), stored(self.sets, "sets")
        self.need_sets(pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))))
        while True:
            # One partner for each document first; what is still open then is little as a rule, and goes at once.
            first = pairs.groupBy("a").agg(F.min("b").alias("b"))
            self._verify(first)
            pairs = stored(self._open(pairs.join(first, ["a", "b"], "left_anti")), "pairs")
            n = pairs.count()
            if 0 < n <= self.many:
                self._verify(pairs)
            if n <= self.many:
                return


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, m: int = 10, r: int = 2, listed: int = 512, row_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    listed: so many remaining pairs for each representative are looked at at once. With row_col, a column that is another
    in each row, also `row`, and kept holds for one row of a component.
    """
    docs = docs if row_col else with_row(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    docs = docs.select(F.col(id_col if row_col else "doc_id").cast("long").alias("doc_id"), F.col(text_col if row_col else "text").cast("string").alias("text"), F.col(row_col or "row").alias("row"))
    with scratch() as keep:
        made = stored(signatures(docs, words, m, r), "signatures")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
        classes = made.where("n_shingles > 0").groupBy("k1", "k2").agg(first, F.first("sign").alias("sign"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n_rows"))
        classes = stored(classes.withColumn("doc", F.monotonically_increasing_id()), "classes")
        link = _Linker(docs, classes, words, percent, 2 * m * r, listed * max(100_000, classes.count()))
        _link_all(classes, link, m, r, percent)
        named = classes.select("doc", "first").join(link.comp.withColumnRenamed("v", "doc"), "doc")
        names = stored(named.groupBy("comp").agg(F.min("first").alias("top"), F.count("*").alias("n")), "names")
        tops = hot_join(link.comp, names, ["comp"], "n", "inner").select(F.col("v").alias("doc"), "top")
        out = classes.select("doc", "k1", "k2", "first", "n_rows").join(tops, "doc", "left").where("n_rows > 1 or top is not null")
        out = stored(out.select("k1", "k2", "n_rows", F.coalesce("top", "first").alias("top")), "class-components")
        keep(made, out)
    done = hot_join(made.select("doc_id", "n_shingles", "k1", "k2", "row"), out, ["k1", "k2"], "n_rows")
    comp, is_first = F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")), F.coalesce(F.col("row") == F.col("top.row"), F.lit(True))
    kept = is_first if row_col else F.when(comp.isNull(), is_first).otherwise(F.col("doc_id").eqNullSafe(comp))
    return done.select("doc_id", "n_shingles", comp.alias("component_id"), kept.alias("kept"), *(["row"] if row_col else []))


def _link_all(classes: DataFrame, link: _Linker, m: int, r: int, percent: int) -> None:
    """Finds the links of all classes (steps 2 to 5)."""
    members = classes.select("doc", "sign")
    rows = table_rows(members, m, r)
    hubs = stored(rows.groupBy("key").agg(F.min("doc").alias("b"), F.max("doc").alias("high")).where("b < high").select("key", "b"), "hubs")
    rows = stored(table_rows(members, m, r).join(hubs, "key").distinct(), "table-rows")
    if not rows.isEmpty():
        link.add(rows.select(F.col("doc").alias("a"), "b").where("a <> b").distinct())
        rows = _mixed_buckets(rows.select("key", "doc"), link)
    if not rows.isEmpty():
        link.need_sets(rows)
        sets = stored(link.sets.join(rows.select("doc").distinct(), "doc", "left_semi"), "open-sets")
        rows, odd = stored(prefixes(sets, percent), "table-rows"), stored(parities(sets), "parities")
    while not rows.isEmpty():
        rows = _mixed_buckets(rows, link)
        left = rows.groupBy("key").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("n")).first()["n"]
        if left <= link.many:  # what remains, all at once
            wide = stored(rows.join(odd, "doc"), "wide-rows")
            other = wide.select("key", F.col("doc").alias("b"), F.col("comp").alias("other"), F.col("n").alias("n2"), F.col("rest").alias("rest2"), *(F.col(f"p{k}").alias(f"q{k}") for k in range(_WORDS)))
            found = wide.withColumnRenamed("doc", "a").join(other, "key")
            found = found.where(f"a > b and comp <> other and 100 * least(rest, rest2) >= {percent} * (n + n2 - least(rest, rest2))")
            differ = " + ".join(f"bit_count(p{k} ^ q{k})" for k in range(_WORDS))
            found = found.where(f"{100 + percent} * ({differ}) <= {100 - percent} * (n + n2)")
            link.add(found.select("a", "b").distinct(), sure=True)
            break
        hubs = stored(rows.groupBy("key").agg(F.max(F.struct(F.col("rest") / F.col("n"), "doc", "comp")).alias("hub")).select("key", F.col("hub.doc").alias("b"), F.col("hub.comp").alias("other")), "hubs")
        link.add(rows.withColumnRenamed("doc", "a").join(hubs, "key").where("a <> b and comp <> other").select("a", "b").distinct(), sure=True)
        rows = rows.join(hubs.select("key", F.col("b").alias("doc")), ["key", "doc"], "left_anti")  # it has met all others
        rows = stored(rows.select("key", "doc", "n", "rest"), "table-rows")


def _mixed_buckets(rows: DataFrame, link: _Linker) -> DataFrame:
    """The rows of buckets that hold several components, with `comp`."""
    held = stored(rows.drop("comp").join(link.comp.withColumnRenamed("v", "doc"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc")), "held")
    mixed = stored(held.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("key"), "mixed")
    return stored(held.join(mixed, "key", "left_semi"), "table-rows")
