"""The training-data operators against brute force, on small tables with nulls, empty, long and repeated texts."""

import base64
import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordloom.llm import op01_media, op02_url_rules, op03_toxicity, op04_minhash, op05_bpe, op06_line_dedup, op07_packing, op08_license_scan, op09_token_files, op10_exact_dedup, tokens
from wordloom.llm.queries import URL_RULES

rng = random.Random(7)
WORDS = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near(text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split())


BASE = [prose(rng.randint(30, 200)) for _ in range(12)]
REPEATED = "this line stands in a good many documents of the table"
TEXTS = [
    None, "", " ", "one", "One  two\tthree", "don't I'll <|endoftext|> x!", "A\u00a0b\x1cc  d　", *BASE, *BASE[:4], *(near(t, s) for t in BASE[:6] for s in (0.01, 0.02, 0.05, 0.1)),
    *(f"{prose(12)}\n  {REPEATED.upper() if i % 2 else REPEATED} \n{prose(5)}" for i in range(7)), prose(30_000), "x" * 9000, "Under the MIT license. CC BY-NC; apache license, version 2.0",
]
ROWS = [(i if i != 9 else None, t, "src", "clash") for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, kept string, component_id string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3, "text")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_media(docs, none):
    got = {r["doc_id"]: r for r in rows(op01_media.media_columns(docs))}
    for i, text, *_ in ROWS:
        data = (text or "").encode()
        want = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        image = op01_media.to_png(data)
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        assert op01_media.from_png(image) == (want, len(data))
    assert rows(op01_media.media_columns(none)) == []


def test_media_ranges_and_retries(spark, docs):
    folder = op01_media.write_archives(docs, archive_bytes=4000)
    small = op01_media.read_archives(spark, folder, rangeBytes="700", batchBytes="100")
    assert small.count() == len(ROWS)

    class Flaky:
        def __init__(self, data):
            self.data, self.at, self.bad = data, 0, 1

        def seek(self, at):
            self.at = at

        def read(self, n):
            out = self.data[self.at : self.at + n]
            self.at += n
            if n > 100 and self.bad:
                self.bad = 0
                return out[:-1] + bytes([out[-1] ^ 1])
            return out

    import io
    import zipfile

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a", b"y" * 500)
    info = zipfile.ZipFile(raw).infolist()[0]
    f = Flaky(raw.getvalue())
    with pytest.raises(ValueError):
        op01_media.member(f, info.header_offset, info.compress_size, info.CRC)
    assert op01_media.member(f, info.header_offset, info.compress_size, info.CRC) == b"y" * 500


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://com", "HTTP://WWW.Example.COM/en/x?y", "http://example.com/en/x", "http://a.example.com/en", "http://notexample.com/en/", "https://x.net/es/1", "x://net/fr/?q", "http://x.net/de/", "http://xcom/"]
    want = [(None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("com/", "allow"), ("net/es/", "block"), ("net/fr/", "block"), (None, "allow"), (None, "allow")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in rows(op02_url_rules.url_filter(pages, labels, URL_RULES))}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == want
    assert (got[4]["host"], got[4]["path"]) == ("www.example.com", "/en/x")


def test_url_rules_are_mined(spark):
    pages = [(i, f"http://{'bad' if i % 4 == 0 else 'good'}.org/{'a' if i % 3 else 'b'}/{i}") for i in range(400)]
    labels = [(i, 0 if i % 4 == 0 and i % 3 else 1, 0) for i in range(0, 300)]
    got = rows(op02_url_rules.url_filter(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), URL_RULES, min_confidence=0.9))
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {i for i in range(400) if i % 4 == 0 and i % 3}


def fp_rules(transactions, labels, least, confidence):
    """All rules, by counting every set of tokens in every transaction, without those that a shorter rule implies."""
    seen = {}
    for t, y in zip(transactions, labels):
        own = sorted(set(t))
        for size in range(1, len(own) + 1):
            for items in combinations(own, size):
                n, bad = seen.get(items, (0, 0))
                seen[items] = (n + 1, bad + y)
    found = [(frozenset(k), bad / n) for k, (n, bad) in seen.items() if bad >= least and bad / n >= confidence]
    return {(a, round(c, 9)) for a, c in found if not any(b < a and d >= c for b, d in found)}


def mined(spark, transactions, labels, **kw):
    pages = spark.createDataFrame(list(enumerate(transactions)), "page_id long, tokens array<string>")
    marks = spark.createDataFrame(list(enumerate(labels)), "page_id long, rejected int")
    return {(frozenset(r["tokens"]), round(r["confidence"], 9)) for r in op02_url_rules.mine(pages, marks, **kw)}


def test_url_rules_are_mined_from_all_tokens(spark):
    own = random.Random(3)
    names = [f"t{i}" for i in range(13)]
    transactions = [[x for x in names if own.random() < 0.65] + ["d:com"] for _ in range(300)]
    labels = [int({"t1", "t7", "t11"} <= set(t) and own.random() < 0.9 or own.random() < 0.03) for t in transactions]
    want = fp_rules(transactions, labels, 30, 0.6)
    assert max(map(len, transactions)) > 8 and len(want) > 3 and max(len(a) for a, _ in want) > 2
    assert mined(spark, transactions, labels, min_rows=30) == want
    # Tokens that always stand together do not multiply the sets.
    long = [[f"q:{i}" for i in range(40)] + [f"p:{n % 2}"] for n in range(100)]
    assert mined(spark, long, [n % 2 for n in range(100)]) == {(frozenset(["p:1"]), 1.0)}


def test_url_rules_from_mostly_rejected_labels(spark):
    urls = [f"{'http' if i % 10 else 'https'}://{'hot' if i % 10 else 'calm'}.org/{i}" for i in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = rows(op02_url_rules.url_filter(pages, labels, URL_RULES, min_confidence=0.95))
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {i for i in range(300) if i % 10}
    transactions = [["a"] * (n % 2) + ["b"] * (n % 3 > 0) + ["c"] for n in range(120)]
    bad = [int(n % 4 > 0) for n in range(120)]
    assert mined(spark, transactions, bad) == fp_rules(transactions, bad, 10, 0.6)


def test_url_rules_of_odd_tables(spark):
    """Repeated rows, tokens that always stand together, very long URLs, clashing columns and empty tables."""
    long = "http://long.org/" + "/".join(f"p{i}" for i in range(3000))
    pages = [(i, f"http://{'bad' if i % 2 else 'good'}.org/a/b/{i}", "x") for i in range(80)] + [(1, "http://bad.org/a/b/1", "y"), (None, "http://bad.org/", None), (90, None, ""), (91, long, "")]
    pages = spark.createDataFrame(pages, "page_id long, url string, tokens string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0, "c") for i in range(60)] + [(3, 0, 0, "c"), (None, 0, 1, "c"), (500, 0, 1, "c")], "doc_id long, quality int, toxic int, host string")
    got = rows(op02_url_rules.url_filter(pages, labels, URL_RULES, min_confidence=0.9))
    assert len(got) == 84
    for r in got:
        assert r["verdict"] == ("block" if r["host"] == "bad.org" else "allow"), r
    mined_rules = op02_url_rules.mine(spark.createDataFrame([(i, ["d:org", "d:bad.org"] if i % 2 else ["d:org"]) for i in range(60)], "page_id long, tokens array<string>"), spark.createDataFrame([(i, i % 2) for i in range(60)], "page_id long, rejected int"))
    assert [r["tokens"] for r in mined_rules] == [["d:bad.org"]]
    empty = pages.where("false")
    assert rows(op02_url_rules.url_filter(empty, labels, URL_RULES)) == [] and len(rows(op02_url_rules.url_filter(pages, labels.where("false"), URL_RULES))) == 84
    ties = [op02_url_rules.Rule("block", "a.b", "/c"), op02_url_rules.Rule("allow", "a.b", "/c")]
    one = spark.createDataFrame([(0, "http://a.b/c")], "page_id long, url string")
    assert [r["verdict"] for r in rows(op02_url_rules.url_filter(one, labels, ties))] == ["block"]


def numeric_risk(w, b, pos, unl, prior):
    loss = lambda rows, sign: np.mean([np.logaddexp(0, -sign * (b + w[x].sum())) for x in rows])
    clean = loss(unl, -1) - prior * loss(pos, -1)
    return prior * loss(pos, 1) + max(0.0, clean)


def test_toxicity_lowers_the_risk_that_it_names():
    own = np.random.default_rng(5)
    n = 1 << op03_toxicity.BITS
    pos = [np.unique(np.append(own.integers(10, 60, 8), [1, 2])).astype(np.uint32) for _ in range(80)]
    unl = [np.unique(np.append(own.integers(10, 60, 8), [1, 2] if i % 10 == 0 else [3])).astype(np.uint32) for i in range(300)]
    w, b = op03_toxicity.fit(pos, unl, 0.1, penalty=0.0)
    assert numeric_risk(w, b, pos, unl, 0.1) < 0.5 * numeric_risk(np.zeros(n), np.log(0.1 / 0.9), pos, unl, 0.1)
    # Around the result no step along a weight in use, or along the bias, lowers the risk by much.
    for place in (1, 2, 3, None):
        for step in (-0.3, 0.3):
            moved, c = w.copy(), b
            if place is None:
                c += step
            else:
                moved[place] += step
            assert numeric_risk(moved, c, pos, unl, 0.1) > numeric_risk(w, b, pos, unl, 0.1) - 0.02
    assert op03_toxicity.fit([], unl, 0.1)[1] == pytest.approx(np.log(0.1 / 0.9))


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y"), (3, "z" * 300_000, "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, "q"), (2, 0, "q"), (None, 1, "q")], "doc_id long, toxic int, text string")
    got = rows(op03_toxicity.toxicity(docs, labels))
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"]
    assert rows(op03_toxicity.toxicity(docs.where("false"), labels)) == [] and len(rows(op03_toxicity.toxicity(docs, labels.where("false")))) == 5
    assert op03_toxicity.without_toxic(docs, labels).columns == docs.columns


def test_toxicity(spark):
    bad = ["vile", "nasty"]
    texts = [(i, prose(40) + (" " + rng.choice(bad) + " " + prose(5) if i % 5 == 0 else "")) for i in range(1500)] + [(1500, None), (1501, ""), (None, "vile")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1500)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = rows(op03_toxicity.toxicity(docs, labels))
    assert len(got) == len(texts)
    held = [r for r in got if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held) and held
    right = [r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held if r["doc_id"] < 1500]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def shingles(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_dedup(docs, none):
    sets = [(i, shingles(t, 4)) for i, t, *_ in ROWS]
    comp = {n: n for n in range(len(sets))}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                comp[find(a)] = find(b)
    smallest = {}
    for n, (i, s) in enumerate(sets):
        if i is not None:
            smallest[find(n)] = min(i, smallest.get(find(n), i))
    want = sorted((str(i), len(s), str(smallest.get(find(n)))) for n, (i, s) in enumerate(sets))
    got = rows(op04_minhash.near_dedup(docs, words=4))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert rows(op04_minhash.near_dedup(none)) == []


def test_bpe_is_tiktoken(docs, none):
    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tk = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in rows(op05_bpe.decode(op05_bpe.encode(docs, path, P.PATTERN), path, P.PATTERN))}
    for i, text, *_ in ROWS:
        assert got[i]["ids"] == tk.encode_ordinary(text or "")
        assert bytes(got[i]["data"]) == (text or "").encode()
    model = op05_bpe.ByteBpe.load(path, P.PATTERN)
    pieces = [bytes(rng.choice(b"abcdst \xc3\xa9") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    assert model.merge(pieces) == [[ranks[p]] if p in ranks else model._merge_long(p) for p in pieces]
    with pytest.raises(ValueError):
        model.decode([10**6])
    digests = {r["doc_id"]: r for r in rows(op05_bpe.round_trip(docs, path, P.PATTERN))}
    for i, text, *_ in ROWS:
        ids = np.array(got[i]["ids"], "<u4")
        assert (digests[i]["n_tokens"], digests[i]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert digests[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert rows(op05_bpe.round_trip(none, path, P.PATTERN)) == [] == rows(op05_bpe.decode(op05_bpe.encode(none, path, P.PATTERN), path, P.PATTERN))


def test_bpe_with_other_patterns():
    """Patterns that let tokens reach over words: nothing may be cut between them."""
    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    texts = ["one two three. four", "", "a  b\n\nc d.", prose(300)]
    for pattern in (r"(?s).{1,9}", r"\w+ \w+|.", r"(?s).+"):
        tk = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        model = op05_bpe.ByteBpe.load(path, pattern)
        assert [x.tolist() for x in model.memo.encode([t.encode() for t in texts])] == [tk.encode_ordinary(t) for t in texts]


def test_memo_forgets_and_stays_right():
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole = tokens.library_memo(P.path("byte_bpe_50k.json"))
    memo = tokens.ChunkMemo(whole.fresh, limit=50, step=400)
    for _ in range(2):
        texts = [prose(rng.randint(0, 60)) + rng.choice(["", "###", ".,*", "'s don't!!", "(x)? \"y\" <|endoftext|> z%%% "]) for _ in range(60)]
        assert [x.tolist() for x in memo.encode([t.encode() for t in texts])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(memo.place) < 400
        memo.trim()
        assert len(memo.place) <= 25


def line_result(table, least=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, text, *_ in table:
        for k in {key(x) for x in (text or "").split("\n")}:
            held.setdefault(k, []).append(i)
    hot = {k: max(x for x in v if x is not None) for k, v in held.items() if len(k) >= 40 and len(v) >= least}
    out = {}
    for i, text, *_ in table:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (key(x) in hot and i is not None and i < hot[key(x)])]
        out[i] = (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


def test_line_dedup_and_deletion(spark, docs, none):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows(op06_line_dedup.line_dedup(docs))}
    assert got == line_result(ROWS) and sum(x[1] for x in got.values()) > 0
    assert rows(op06_line_dedup.line_dedup(none)) == []
    last = [r for r in ROWS if r[1] and REPEATED in r[1].lower()][-3:]
    gone = spark.createDataFrame(last, SCHEMA)
    index = op06_line_dedup.LineIndex(spark).insert(docs).delete(gone)
    rest = [r for r in ROWS if r not in last]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows(index.apply(spark.createDataFrame(rest, SCHEMA)))}
    assert got == line_result(rest)
    index.insert(gone)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows(index.apply(docs, texts=True))}
    assert got == line_result(ROWS)


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    f = op06_line_dedup.CuckooFilter(5000)
    assert f.insert(keys) == [] and f.contains(keys).all()
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01


def test_deletion_of_a_key_without_room():
    keys = np.random.default_rng(2).integers(0, 1 << 63, 300_000, dtype=np.uint64)
    f = op06_line_dedup.CuckooFilter(1)
    prints, one, _ = f._places(keys)
    same = np.flatnonzero((prints == prints[0]) & (one == one[0]))[:2]
    held, listed = keys[same[:1]], keys[same[1:]]
    assert f.insert(held) == [] and len(listed)
    assert len(op06_line_dedup.change_cells(f, listed, listed, np.array([False]))) == 0
    assert f.contains(held).all()
    op06_line_dedup.change_cells(f, listed, held, np.array([False]))
    assert not f.contains(held).any()


def test_filters_grow_with_insertions(spark):
    line = "a line long enough to be counted, by its number {}".format
    table = lambda ids, ns: spark.createDataFrame([(i, "\n".join(map(line, ns))) for i in ids], "doc_id long, text string")
    index = op06_line_dedup.LineIndex(spark, 2).insert(table([1, 2], [0])).insert(table([3, 4], range(1, 400)))
    assert index.filters.agg(F.sum(F.size("rest")).alias("n")).first()["n"] == 0
    got = {r["doc_id"]: r["n_dropped"] for r in rows(index.apply(table([3, 4], range(1, 400))))}
    assert got == {3: 399, 4: 0}


def test_packing(docs, none):
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = rows(op07_packing.pack(docs, P.path("word_bpe_49k.json"), window=64))
    got.sort(key=lambda r: (r["sequence_id"], r["offset"]))
    assert [r["sequence_id"] * 64 + r["offset"] for r in got] == list(np.cumsum([0, *(r["length"] for r in got)])[:-1])
    for i, text, *_ in ROWS:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in own) == ids.tobytes()
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in own)
    assert rows(op07_packing.pack(none, P.path("word_bpe_49k.json"))) == []


def test_license_scan(docs, none):
    import re

    got = {r["doc_id"]: r for r in rows(op08_license_scan.license_scan(docs))}
    for i, text, *_ in ROWS:
        words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        places = sorted((n, label) for phrase, label in op08_license_scan.BASE.items() for n in range(len(words)) if words[n : n + len(phrase.split())] == phrase.split())
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
    assert rows(op08_license_scan.license_scan(none)) == []


def test_license_span_with_a_gap(spark):
    text = op08_license_scan.TEMPLATES["gpl"].split()
    df = spark.createDataFrame([(1, " ".join([*text[:10], "indeed", *text[10:]])), (2, " ".join(text[:6]))], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in rows(op08_license_scan.license_scan(df))}
    assert got == {1: "gpl", 2: ""}


def words_apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_license_texts_with_changes(spark):
    """Whole licences with words put in, left out or replaced: found as far as their words in order agree."""
    own, table, want = random.Random(8), [], {}
    for label in ("mit", "isc", "zlib", "agpl"):
        text = op08_license_scan.plain_words(op08_license_scan.TEXTS[label])
        for share in (0, 0.03, 0.05, 0.5, 0.7):
            made = []
            for w in text:
                kind = own.random()
                made += [] if kind < share / 3 else [w, "qq"] if kind < 2 * share / 3 else ["zz"] if kind < share else [w]
            i = len(table)
            table.append((i, " ".join([prose(30), *made, prose(30)])))
            want[i] = (label, words_apart(made, text) / len(text))
        rolled = [w for at in range(len(text) - 2) for w in text[at : at + 3]]  # each 3-gram in turn: all votes, but no passage
        table.append((len(table), " ".join(rolled)))
        want[len(table) - 1] = (label, 1.0)
    got = {r["doc_id"]: r for r in rows(op08_license_scan.license_scan(spark.createDataFrame(table, "doc_id long, text string"), names={}, templates=list(op08_license_scan.TEXTS.items())))}
    for i, (label, apart) in want.items():
        assert got[i]["labels"] == (label if apart < 0.1 else "") or 0.1 <= apart <= 0.3, (i, label, apart, got[i])
        if apart < 0.1:
            assert 1 - apart - 0.02 <= got[i]["score"] <= 1


def test_license_words_and_telling_words(spark):
    odd = ["", "a", "A\x00b\x7fc|d~e`F[G]", "École à 5€ x_y-z", "  two\n\tlines\r\n", "日本 語"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", op08_license_scan.words_of(F.col("t")).alias("w"))
    assert {r["i"]: r["w"] for r in rows(df)} == {i: op08_license_scan.plain_words(t) for i, t in enumerate(odd)}
    kinds = [("under the mit license".split(), "mit", True, True), ("one two three four five six seven eight nine ten".split(), "x", False, False)]
    telling = set(op08_license_scan.telling_words(kinds, 0.8))
    assert telling & set(kinds[0][0]) and sum(not telling & set(kinds[1][0][i : i + 3]) for i in range(8)) < 0.8 * 8


def test_license_scan_of_odd_tables(spark):
    line = "Licensed under the Apache License, Version 2.0."
    table = [(1, line, "x"), (1, line, "x"), (None, line, None), (2, None, "y"), (3, f"{prose(40_000)} {line} {prose(10)}", "z"), (4, " ".join([line] * 50), "z")]
    got = rows(op08_license_scan.license_scan(spark.createDataFrame(table, "doc_id long, text string, labels string")))
    assert sorted((str(r["doc_id"]), r["labels"], r["n_base"]) for r in got) == [("1", "apache-2", 1), ("1", "apache-2", 1), ("2", "", 0), ("3", "apache-2", 1), ("4", "apache-2", 50), ("None", "apache-2", 1)]
    four = next(r for r in got if r["doc_id"] == 4)
    assert (four["first_word"], four["last_word"]) == (3, 3 + 49 * 8)


def test_license_lines(spark):
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under the GNU Lesser General Public Licence v2.1 or later.": "lgpl",
        "Distributed under the GNU Affero General Public License.": "agpl",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "Released under the MIT License.": "mit",
        "Licensed under the Apache License, Version 2.0.": "apache-2",
        "Apache License, Version 1.1": "apache-1",
        "Subject to the Mozilla Public License, v. 2.0.": "mpl-2",
        "Text: Creative Commons Attribution-ShareAlike 3.0 Unported": "cc-by-sa",
        "Image: CC BY-SA 4.0": "cc-by-sa",
        "Photo: CC BY 4.0": "cc-by",
        "// SPDX-License-Identifier: GPL-2.0-only": "gpl",
        "BSD 3-Clause": "bsd",
        "The general public may license the work.": "",
    }
    df = spark.createDataFrame([(i, f"Some words before it.\n{x}\nAnd more after it.") for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in rows(op08_license_scan.license_scan(df))}
    assert [got[i] for i in range(len(lines))] == list(lines.values())


def test_license_spans_are_verified(spark):
    t = op08_license_scan.TEMPLATES
    notices = {
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "cc-by-nc-sa",
        t["gpl"]: "gpl",
        t["gpl"].replace("program", "library").replace("gnu general", "gnu lesser general"): "lgpl",
        t["gpl"].replace("gnu general", "gnu affero general"): "agpl",
        t["apache-2"].replace("2 0", "1 1"): "apache-1",
        t["mpl-2"].replace("2 0", "1 1"): "mpl-1",
        t["mit"].replace("is hereby", "is not hereby"): "",
        t["bsd"].replace("binary forms", "other binary forms"): "bsd",
        t["mit"].replace("hereby ", "") + " not more": "mit",
        **{text: label for label, text in t.items()},
    }
    df = spark.createDataFrame([(i, f"Lesser words, not of it. {x} and no other words") for i, x in enumerate(notices)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in rows(op08_license_scan.license_scan(df))}
    assert [got[i] for i in range(len(notices))] == list(notices.values())


def test_token_files(docs, none):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = rows(op09_token_files.token_files(docs, P.path("byte_bpe_50k.json")))
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in ROWS), key=lambda x: -1 if x is None else x)
    texts, at = {r[0]: r[1] for r in ROWS}, 0
    for r in got:
        ids = np.array([*tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2], "<u4")
        assert bytes(r["ids"]) == ids.tobytes() and r["start"] == at and r["n_tokens"] == len(ids)
        at += len(ids)
    assert rows(op09_token_files.token_files(none, P.path("byte_bpe_50k.json"))) == []


@pytest.mark.parametrize("n", [1, 3, 4, 1001])
def test_variable_length_code(n):
    values = np.random.default_rng(n).integers(0, [1 << 8, 1 << 16, 1 << 24, 1 << 32][n % 4], n).astype(np.uint32)
    assert (op09_token_files.unpack_ids(*op09_token_files.pack_ids(values), n) == values).all()


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(docs, none, bits):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    got = rows(op10_exact_dedup.exact_dedup(docs, id_bits=bits))
    texts = {r[0]: r[1] for r in ROWS}
    for r in got:
        own = groups[norm(texts[r["doc_id"]])]
        assert (r["keep_id"], r["group_size"]) == (min(own)[2], len(own))
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
        assert r["text_sha256"] == hashlib.sha256(norm(texts[r["doc_id"]]).encode()).hexdigest()
    assert len(got) == len(ROWS) and rows(op10_exact_dedup.exact_dedup(none)) == []


def test_chunks_follow_content():
    data = bytes(rng.randrange(256) for _ in range(200_000))
    a = op10_exact_dedup.cut_points(data)
    b = op10_exact_dedup.cut_points(b"!" * 7 + data)
    assert a[-1] == len(data) and len({x + 7 for x in a} & set(b)) > len(a) * 0.7
    assert a == op10_exact_dedup.cut_points(data, block=10_000)


def test_near_dedup_with_null_and_repeated_ids(spark):
    """A text whose rows have no doc_id links others; rows that share an id are judged each by its text."""
    words = [f"w{i}" for i in range(100)]
    a, b, c = " ".join(words), " ".join([*words[:91], *(f"x{i}" for i in range(9))]), " ".join([*words[9:91], *(f"x{i}" for i in range(9)), *(f"y{i}" for i in range(9))])
    assert not op04_minhash.near_dedup(spark.createDataFrame([(1, a), (2, c)], "doc_id long, text string")).where("not kept").count()
    table = [(5, a), (None, b), (3, c), (7, prose(50)), (7, prose(60)), (None, prose(70)), (None, None)]
    got = rows(op04_minhash.near_dedup(spark.createDataFrame(table, "doc_id long, text string")))
    assert sorted(str((r["doc_id"], r["component_id"], r["kept"])) for r in got) == sorted(map(str, [(5, 3, False), (None, 3, False), (3, 3, True), (7, 7, True), (7, 7, True), (None, None, True), (None, None, True)]))


def test_near_dedup_of_a_chain(spark):
    """A group whose members are linked over others, and members that share most with it and are not."""
    own = random.Random(11)
    base = [f"v{i}" for i in range(150)]
    table = []
    for i in range(60):
        words = list(base)
        for at in own.sample(range(150), 1 + i % 3):
            words[at] = f"n{own.randrange(40)}"
        table.append((i, " ".join(words)))
    sets = {i: shingles(t, 5) for i, t in table}
    comp = {i: i for i in sets}
    for _ in sets:
        for x, y in combinations(sets, 2):
            if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                comp[x] = comp[y] = min(comp[x], comp[y])
    got = {r["doc_id"]: r["component_id"] for r in rows(op04_minhash.near_dedup(spark.createDataFrame(table, "doc_id long, text string")))}
    assert got == comp and 1 < len(set(comp.values())) < 60


def test_parities_bound_the_difference(spark):
    own = np.random.default_rng(3)
    sets = [np.unique(own.integers(0, 5000, n)).astype(np.uint64) for n in (1, 50, 400, 3000, 50)]
    got = {r["doc"]: r for r in rows(op04_minhash.parities(spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "doc long, items binary")))}
    for i, j in combinations(range(len(sets)), 2):
        bits = sum(bin((got[i][f"p{k}"] ^ got[j][f"p{k}"]) & (1 << 64) - 1).count("1") for k in range(16))
        assert bits <= len(np.setxor1d(sets[i], sets[j]))


def test_hot_join(spark):
    from wordloom.llm.common import hot_join, stored

    table = spark.createDataFrame([(k, i) for k, n in (("a", 500), ("b", 3), ("c", 60)) for i in range(n)] + [("d", 0)], "key string, i int")
    groups = stored(table.where("key <> 'd'").groupBy("key").agg(F.count("*").alias("n"), F.max("i").alias("top")), "groups")
    for how in ("left", "inner"):
        want = sorted(tuple(r[x] for x in ("key", "i", "n", "top")) for r in table.join(groups, "key", how).where("n is not null").collect())
        got = hot_join(table, groups, ["key"], "n", how, share=10, least=50)
        assert sorted(tuple(r[x] for x in ("key", "i", "n", "top")) for r in got.where("n is not null").collect()) == want
        assert got.count() == len(want) + (how == "left")


def test_line_filters_beyond_the_broadcast(spark, docs):
    index = op06_line_dedup.LineIndex(spark).insert(docs)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows(index.apply(docs, filter_bytes=0))}
    assert got == line_result(ROWS)


def test_line_texts_of_repeated_ids(spark):
    line = "a line of more than forty characters that is repeated"
    table = [(1, f"{line}\na"), (1, f"{line}\nb"), (1, "c"), (None, line), (2, line), (3, line), (3, None)]
    got = rows(op06_line_dedup.line_dedup(spark.createDataFrame(table, "doc_id long, text string"), texts=True))
    assert sorted(str((r["doc_id"], r["kept_text"])) for r in got) == sorted(str(x) for x in [(1, "a"), (1, "b"), (1, "c"), (None, line), (2, ""), (3, line), (3, "")])


def test_row_keys_and_folders(spark, tmp_path):
    from wordloom.llm import common

    spark.range(100).withColumn("row", F.lit("x")).repartition(3).write.parquet(str(tmp_path / "t"))
    plain = spark.read.parquet(str(tmp_path / "t"))
    for df in (plain, plain.where("id > 5"), plain.join(plain.select("id"), "id"), plain.unionByName(plain), spark.range(5)):
        keyed = common.with_row(df, "own")
        assert keyed.select("own").distinct().count() == df.count()
    with common.scratch() as keep:
        a, b = common.stored(spark.range(3), "a"), common.stored(spark.range(4), "b")
        keep(a)
    assert a.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(b._wordloom_path).count()


def test_exact_dedup_keeps_one_of_equal_rows(spark):
    table = spark.createDataFrame([(1, "aaaa", 0), (5, "a a a a", 1), (5, "different", 2), (5, "different", 3), (None, "x", 4), (None, "x", 5), (None, None, 6), (8, "", 7)], "doc_id long, text string, n long")
    got = {r["row"]: r["kept"] for r in rows(op10_exact_dedup.exact_dedup(table, row_col="n"))}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 7: True}


def test_pipeline_keeps_rows_apart(spark, tmp_path):
    """Labels, null and repeated doc_ids, equal rows, empty tables."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    bad = lambda: f"{prose(15)} vilest nastiness {prose(15)}"
    table = [(i, bad() if i % 4 == 0 else prose(30)) for i in range(400)]
    extra = [(5000, "aaaa"), (5001, "aaaa"), (5001, "quite different words"), (5002, "both rows"), (5002, "both rows"), (None, "no id here"), (None, "no id here"), (None, "no id there"), (5003, None), (5004, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r") for i, t in table + extra], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = rows(corpus_pipeline.run(spark, str(tmp_path)))
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = sorted([str((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1)) for i, t in table if i % 4] + [str((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1)) for i, t in (extra[0], extra[2], extra[3], extra[5], extra[7], extra[9])])
    found = [str((r["doc_id"], r["doc_tokens"])) for r in got if r["start"] == 0]
    toxic = {str((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1)) for i, t in table if i % 4 == 0}
    assert len([x for x in found if x in toxic]) <= 2 and sorted(x for x in found if x not in toxic) == want
    (tmp_path / "none").mkdir()
    docs.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert rows(corpus_pipeline.run(spark, str(tmp_path / "none"))) == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    table = [(i, t, "en", "s", len(t or "")) for i, t, *_ in ROWS if i is not None]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = rows(corpus_pipeline.run(spark, str(tmp_path)))
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    best = {}
    for i, t, *_ in table:
        best[norm(t)] = min(best.get(norm(t), (0, 1 << 60)), (-len(t or ""), i))
    rest = sorted(i for _, i in best.values())
    texts = {r[0]: r[1] for r in table}
    sets = {i: shingles(texts[i], 5) for i in rest}
    comp = {i: i for i in rest}
    for _ in rest:
        for a in rest:
            for b in rest:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if all(comp[comp[a]] == comp[a] for a in rest):
            break
    assert {r["doc_id"] for r in got} == {i for i in rest if comp[i] == i}
