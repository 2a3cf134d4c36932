"""The tokenisation engine: model files, splitting, merging, decoding, training, streams."""

import itertools
import json
import os
import random
import re
import time
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom import batch, facade, model

from wordloom.functions.text import chunk_parts, detokenize, pretokenize, split_words
from wordloom.model import BAD_VOCAB, OUT_OF_RANGE, WORD_PATTERN, TokenizerModel, convert_json_vocab, format_vocab_line, infer_prefix, load_folder, load_merges, load_model, load_special, load_vocab, parse_vocab_line
from wordloom.operators import train
from wordloom.operators.bpe import decode_column, encode_column, look_up
from wordloom.operators.morph import look_up_words
from wordloom.plans.engine_queries import ID_MODEL, PREFIX_MODEL, STRING_MODEL, VOCAB
from wordloom.sources.files import parse_special, read_lexicon
from wordloom.streaming.encode import encode_stream, register

TEXTS = ["", "hello world", "A  B   C", "\t\n\r\f\v", "árvíztűrő tükörfúrógép", "12 34abc", "€ 5, 10%!", "emoji 😀 x", " lead", "\n\nTest\n", "ñandú"]


def column(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def test_words(spark):
    got = {r.id: r.w for r in column(spark, TEXTS).select("id", split_words(F.col("text")).alias("w")).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == [m.group() for m in re.finditer(WORD_PATTERN, text)]
        assert "".join(got[i]) == text
    assert got[2] == ["A", "  ", "B", "   ", "C"]
    assert got[9] == ["\n", "\n", "Test", "\n"]


def random_maps():
    """Replacements that can be told apart from each other and from the text around them."""
    own = random.Random(5)
    for _ in range(4):
        letters = own.sample("cdkmoqrvwxyz ", own.randint(1, 5))
        special = {ord(c): own.choice("ΑΒΓΔΕ") * own.randint(1, 3) + str(i) for i, c in enumerate(letters)}
        yield special, own.choice([None, "Ω", "ΩΩ "]), own.random() < 0.5


def test_replacements_there_and_back(spark):
    texts = ["", "w", "wax wood", "mm  kk", "zoé döry", "\tq\n", "oxo moxy!"]
    df = column(spark, texts)
    for special, prefix, byte_mode in random_maps():
        own = TokenizerModel({b"x": 0}, special, prefix=prefix, byte_mode=byte_mode)
        there = df.select("id", pretokenize(F.col("text"), own, prefix).alias("m"))
        back = {r.id: (r.m, r.t) for r in there.select("id", "m", detokenize(F.col("m"), own).alias("t")).collect()}
        for i, text in enumerate(texts):
            source = text.encode().decode("latin-1") if byte_mode else text
            want = (prefix or "") + "".join(special.get(ord(c), c) for c in source)
            assert back[i] == (want, text) and own.pretokenize(text, prefix) == want and own.detokenize(want).decode() == text


def slow_merge(symbols, rank):
    s = list(symbols)
    while True:
        found = [(rank[s[i] + s[i + 1]], i) for i in range(len(s) - 1) if s[i] + s[i + 1] in rank]
        if not found:
            return s
        i = min(found)[1]
        s[i : i + 2] = [s[i] + s[i + 1]]


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=300), st.sets(st.text("abc", min_size=2, max_size=5), max_size=25), st.integers(0, 99))
def test_merging_is_the_scan(word, pairs, seed):
    names = sorted(pairs)
    random.Random(seed).shuffle(names)
    rank = {x: i for i, x in enumerate(names)}
    want = slow_merge(word, rank)
    for run in (model.merged, model._merged_from_heap):
        assert run(list(word), lambda a, b: rank.get(a + b), lambda a, b: a + b) == want


def test_many_words_at_once_are_each_word(monkeypatch):
    """Random vocabularies, rules with equal ranks, replacements of several characters, units and unknown characters."""
    monkeypatch.setattr(batch, "STEP", 500)
    own = random.Random(11)
    for _ in range(60):
        letters = own.choice(["ab", "abé<0 ", "xyz€𝄞"])
        text = lambda most: "".join(own.choice(letters + "aQ") for _ in range(own.randint(0, most)))
        tokens = sorted({text(5) + own.choice(letters) for _ in range(own.randint(1, 40))})
        vocab = dict(zip((t.encode() for t in tokens), own.sample(range(900), len(tokens))))
        known = list(vocab.values())
        merges = {(own.choice([-1, *known]), own.choice(known)): (own.randint(0, 5), own.choice(known)) for _ in range(20)} if own.random() < 0.5 else None
        m = TokenizerModel(vocab, own.choice([{}, {97: "<b", 32: "_"}, {32: "_"}]), merges, byte_mode=own.random() < 0.5)
        words = ["", "<0x61>a", "Q" * 200, *(text(own.choice([3, 12, 150])) for _ in range(batch.FEW))]
        assert batch.BatchMerger(m).word_ids(words) == [batch.as_bytes(m.word_ids(w)) for w in words]


@pytest.mark.parametrize("m", [STRING_MODEL, ID_MODEL, PREFIX_MODEL])
def test_columns_are_encoded_like_texts(spark, m):
    own = random.Random(3)
    many = " ".join("".join(own.choices("thenrioé€", k=own.randint(1, 9))) for _ in range(3 * batch.FEW))  # enough for merging at once
    texts = [None, *TEXTS, many, " ".join(TEXTS) * 3]
    rows = column(spark, texts).select("id", encode_column(m)("text").alias("ids")).orderBy("id").collect()
    assert [r["ids"] for r in rows] == [None if t is None else m.encode(t) for t in texts]


def test_long_words_take_linear_time():
    began = time.process_time()
    word = "the" * 100_000
    for own in (STRING_MODEL, ID_MODEL):
        ids = own.encode(word)
        assert own.decode(ids) == word and len(ids) == 100_000
    assert time.process_time() - began < 60


def test_units_of_bytes():
    own = TokenizerModel({b"<0xE2>": 0, b"<0x82>": 1, b"<0xE2><0x82>": 2, b"a": 3, b"<": 4, b"0": 5})
    assert own.encode("<0xE2><0x82>a") == [2, 3] or own.merge_strings(b"<0xE2><0x82>a") == [2, 3]
    assert own.merge_strings(b"<0a") == [4, 5, 3]


def test_decoding_by_ids_is_decoding_of_the_whole():
    own = random.Random(2)
    for m in (STRING_MODEL, ID_MODEL, PREFIX_MODEL):
        assert m.bytes_of is not None
        for _ in range(100):
            ids = [own.choice(list(m.vocab.values())) for _ in range(own.randint(0, 12))]
            assert m.decode_bytes(ids) == m.detokenize(b"".join(m.tokens[i] for i in ids).decode())
    assert TokenizerModel({b"xy": 0, b"z": 1}, {65: "yz"}).bytes_of is None
    assert TokenizerModel({b"xy": 0, b"z": 1}, {65: "yz"}).decode([0, 1]) == "xA"


def test_longest_matches(spark):
    """Of alternatives the longest match counts, not the first."""
    pattern = "ab|abcd|[[:digit:]]+|x*"
    df = column(spark, ["abcdab 12", "", "xxabc", None])
    got = {r.id: r.w for r in df.select("id", split_words(F.col("text"), pattern).alias("w")).collect()}
    assert got == {0: ["abcd", "ab", "12"], 1: [], 2: ["xx", "ab"], 3: None}
    own = TokenizerModel({b"a": 0, b"b": 1, b"c": 2, b"d": 3, b"ab": 4, b"abc": 5, b"abcd": 6}, pattern="ab|abcd")
    assert own.encode("abcd") == [6] and own.encode("ab cd") == [4]
    with pytest.raises(ValueError, match="Regex could not be compiled"):
        split_words(F.lit("a"), "(|")


def test_round_trips_and_prefix(spark):
    df = column(spark, TEXTS)
    for model in (STRING_MODEL, ID_MODEL, PREFIX_MODEL):
        got = df.select("id", encode_column(model)("text").alias("ids")).select("id", "ids", decode_column(model)("ids").alias("back")).collect()
        for r in got:
            assert r.ids == model.encode(TEXTS[r.id])
            # Before a text that starts with a space, the prefix is mapped like text, so decoding does not take it off.
            assert r.back == ("Ġ" if model is PREFIX_MODEL and TEXTS[r.id].startswith(" ") else "") + TEXTS[r.id]
    assert PREFIX_MODEL.encode("") == []
    assert PREFIX_MODEL.encode("a")[0] != STRING_MODEL.encode("a")[0]
    assert column(spark, [None]).select(encode_column(STRING_MODEL)("text")).first()[0] is None


def test_bad_ids(spark):
    with pytest.raises(ValueError, match=OUT_OF_RANGE):
        STRING_MODEL.decode([999999, -1])
    df = spark.createDataFrame([([999999],), ([104, 105],)], "ids array<int>")
    assert sorted(str(r[0]) for r in df.select(decode_column(STRING_MODEL, strict=False)("ids")).collect()) == ["None", "hi"]
    with pytest.raises(ValueError):
        STRING_MODEL.batch_decode([])
    with pytest.raises(TypeError):
        STRING_MODEL.batch_encode("x")
    assert STRING_MODEL.batch_encode([]) == []
    for wrong in ("ab", 5, None):
        with pytest.raises(TypeError, match="list of integers"):
            STRING_MODEL.decode(wrong)


def test_files(tmp_path):
    assert parse_vocab_line("0x680x69 == 7") == (b"hi", 7)
    assert format_vocab_line(b"hi", 7) == "0x680x69 == 7"
    for bad in ("", "invalid_line_format", "0x41 == 99999999999", "0x41 == x"):
        with pytest.raises(ValueError):
            parse_vocab_line(bad)
    with pytest.raises(ValueError, match=BAD_VOCAB):
        load_vocab(["invalid_line_format"])
    with pytest.raises(ValueError):
        load_special(["300 == x"])
    for twice in (["0x61 == 0", "0x61 == 5"], ["0x61 == 5", "0x62 == 5"]):
        with pytest.raises(ValueError, match="twice"):
            load_vocab(twice)
    with pytest.raises(ValueError, match="twice"):
        TokenizerModel({b"a": 1, b"b": 1})
    vocab = {b"a": 0, b"b": 1, b"ab": 2, b"#": 3, b"#a": 4}
    assert load_merges(["#version: 1", "a b", "# a", "b a"], vocab) == {(0, 1): (0, 2), (3, 0): (1, 4)}
    assert load_merges(["a b", "# a"], vocab, skip_all_hashes=True) == {(0, 1): (0, 2)}
    assert convert_json_vocab({"a": 5, "b": 3}) == ["0x61 == 0", "0x62 == 1"]
    train.write_vocab({0: b"\0", 1: b"a"}, str(tmp_path / "v.txt"))
    assert load_model(str(tmp_path / "v.txt")).vocab == {b"\0": 0, b"a": 1}
    with pytest.raises(RuntimeError):
        train.write_vocab({}, "v.bin")


def scan_train(text, rounds, least):
    ids, out = list(text.encode()), []
    for k in range(rounds):
        n, best = {}, (0, None)
        for pair in zip(ids, ids[1:]):
            n[pair] = n.get(pair, 0) + 1
            if n[pair] > best[0]:
                best = (n[pair], pair)
        if best[0] < least:
            break
        # the winner reaches the highest count first
        top, run, win = max(n.values()), {}, None
        for pair in zip(ids, ids[1:]):
            run[pair] = run.get(pair, 0) + 1
            if run[pair] == top:
                win = pair
                break
        out.append((win, top))
        new, i = [], 0
        while i < len(ids):
            if tuple(ids[i : i + 2]) == win:
                new.append(256 + k)
                i += 2
            else:
                new.append(ids[i])
                i += 1
        ids = new
    return out


def test_training_is_the_scan(spark):
    text = "aaaa banana bandana aaab ananas"
    df = spark.createDataFrame([(0, text)], "doc_id int, text string")
    tokens, log = train.train_bbpe(df, 256 + 6)
    assert [(tuple(train.char_id(c) for c in pair), n) for _, pair, n in log] == scan_train(text, 6, 2)
    assert len(tokens) == 256 + len(log)


def test_training_with_old_faults():
    assert train.train_compat("", 300) == [] == train.train_compat("a", 300)
    # "abab": ab wins; of the live symbols ab, ab the last is lost, and a, b behind them are counted again.
    log = train.train_compat("abab", 259)
    assert log[0] == ("ab", 257, 2) and len(log) <= 3
    assert train.train_compat("xyz", 256) == []
    with pytest.raises(RuntimeError):
        train.train_compat("ab", 10)


def test_morphemes(spark, tmp_path):
    (tmp_path / "words.tsv").write_text("teakettles\tteakettle[/N]s[Pl]\nno analysis\nteakettles\ttea[/N]kettle[_N]s[Pl]\nset\t[/V]set[Inf]\n", "utf-8")
    lexicon = read_lexicon(spark, str(tmp_path / "words.tsv"))
    assert [(r.surface, r.ord) for r in lexicon.orderBy("ord").collect()] == [("teakettles", 0), ("teakettles", 2), ("set", 3)]
    words = spark.createDataFrame([("teakettles",), ("",), ("unknown",)], "word string")
    assert [r.segments for r in look_up_words(words, lexicon).orderBy("ord").collect()] == [["teakettle", "s"], ["tea", "kettle", "s"]]
    assert [r.segments for r in look_up_words(words, lexicon, True).collect()] == [["tea", "kettle", "s"]]


def test_special_table(spark):
    lines = lambda *x: spark.createDataFrame([(y,) for y in x], "value string")
    assert [tuple(r) for r in parse_special(lines("32 == Ġ", "9 == a == b")).collect()] == [(32, "Ġ"), (9, "a == b")]
    for bad in ("32", "x == y", "300 == x", "5 == "):
        with pytest.raises(Exception, match="special character file"):
            parse_special(lines(bad)).collect()


def test_folder_of_an_exported_tokenizer(tmp_path):
    """Vocabulary, rules, byte alphabet and prefix come from the files that a tokenizer's export has."""
    folder = tmp_path / "org" / "small"
    folder.mkdir(parents=True)
    names = [*model.byte_alphabet().values(), "hu", "he", "ll", "llo", "hello", "Ġw"]
    (folder / "vocab.json").write_text(json.dumps({x: i for i, x in enumerate(names)}), "utf-8")
    (folder / "merges.txt").write_text("#version: 0.2\nh u\nh e\nl l\nll o\nhe llo\nĠ w\n", "utf-8")
    own = load_folder(str(folder))
    assert own.byte_mode and own.prefix is None and len(own.merges) == 6
    assert own.encode("hello w") == [names.index("hello"), names.index("Ġw")] and own.decode(own.encode("é hu\n")) == "é hu\n"
    (folder / "small.txt").write_text("0x61 == 0\n0x62 == 1\n0xE2960x81 == 2\n", "utf-8")
    (folder / "small_special_chars.txt").write_text("32 == ▁\n", "utf-8")
    (folder / "merges.txt").unlink()
    plain = load_folder(str(folder), prefix="▁")
    assert not plain.byte_mode and plain.merges is None and plain.special == {32: "▁"} and plain.prefix == "▁"
    with pytest.raises(ValueError, match="No vocab"):
        load_folder(str(tmp_path))
    assert (infer_prefix("▁hu"), infer_prefix("hu")) == ("▁", None)


def test_folder_of_a_public_tokenizer(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    (tmp_path / "tokenizer.json").write_text(open(public.path("byte_bpe_50k.json"), encoding="utf-8").read(), "utf-8")
    own, want = load_folder(str(tmp_path)), tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert own.byte_mode and own.prefix is None
    for text in ("hello world", "Words in a plain sentence, and numbers: 12345!", " leading", "unbelievably"):
        assert own.encode(text) == want.encode(text, add_special_tokens=False).ids and own.decode(own.encode(text)) == text


def test_facade(tmp_path):
    facade._current.clear()
    for call in (lambda: facade.encode("a"), lambda: facade.decode([0]), lambda: facade.batch_encode(["a"]), lambda: facade.batch_decode([[0]])):
        with pytest.raises(RuntimeError):
            call()
    (tmp_path / "v.txt").write_text("0x61 == 0\n0x62 == 1\n0x610x62 == 2\n", "utf-8")
    facade.initialize(str(tmp_path / "v.txt"), token_id=7, pattern="[ab]+")
    assert facade.encode("ab ba") == [2, 1, 0] and facade.decode([2, 0]) == "aba"
    assert facade.batch_encode(["a", "b"], num_threads=3) == [[0], [1]] and facade.batch_decode([[0], [2]]) == ["a", "ab"]
    with pytest.raises(ValueError):
        facade.decode([9])
    for call in (lambda: facade.decode("ab"), lambda: facade.batch_encode("ab"), lambda: facade.batch_decode([])):
        with pytest.raises(RuntimeError):
            call()
    for args, kw in ((("/nowhere/v.txt",), {}), ((str(tmp_path / "v.txt"), "/nowhere/s"), {}), ((str(tmp_path / "v.txt"),), {"merges_file": "/nowhere/m"}), ((str(tmp_path / "v.txt"),), {"pattern": "(|"})):
        with pytest.raises(ValueError):
            facade.initialize(*args, **kw)
    facade._current.clear()


def test_debug_messages(monkeypatch, capfd):
    model.log.handlers.clear()
    monkeypatch.setenv("DEBUG", "0")
    model.initialize_logging()
    assert not model.log.handlers
    monkeypatch.setenv("DEBUG", "1")
    model.initialize_logging()
    STRING_MODEL.encode("two words")
    assert re.search(r"\[\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\] DEBUG: 2 words", capfd.readouterr().err)
    model.log.handlers.clear()
    model.log.setLevel("WARNING")


def test_vocabularies_that_are_not_small(spark, monkeypatch):
    from wordloom.operators import bpe

    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "token string, id int")
    words = spark.createDataFrame([("a",), ("c",)], "token string")
    want = [("a", 0), ("c", -1)]
    assert sorted(tuple(r) for r in look_up(words, vocab).select("token", "id").collect()) == want
    monkeypatch.setattr(bpe, "SMALL", 1)
    assert sorted(tuple(r) for r in look_up(words, vocab).select("token", "id").collect()) == want


def test_chunks(spark):
    text = "one two three four five six seven"
    chunks = column(spark, [text]).select(chunk_parts(F.col("text"), 3)).first()[0]
    assert "".join(chunks) == text and len(chunks) <= 4


def test_stream_and_sql(spark, tmp_path):
    column(spark, TEXTS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in"))
    q = encode_stream(stream, STRING_MODEL).writeStream.format("memory").queryName("encoded").start()
    q.processAllAvailable()
    q.stop()
    assert {r.id: r.ids for r in spark.table("encoded").collect()} == {i: STRING_MODEL.encode(t) for i, t in enumerate(TEXTS)}
    register(spark, STRING_MODEL)
    assert spark.sql("select decode_tokens(encode_tokens('hello there'))").first()[0] == "hello there"


@pytest.mark.parametrize("m", [STRING_MODEL, ID_MODEL])
def test_words_that_a_worker_remembers_are_bounded_in_bytes(spark, monkeypatch, m):
    """Long words, each met once, go again; ids stay right whatever is forgotten."""
    from wordloom.operators import bpe

    monkeypatch.setattr(bpe, "_memos", {})
    monkeypatch.setattr(bpe, "_BYTES", 1 << 18, raising=False)
    own = random.Random(4)
    texts = [None, "", *(f"the {'thenr' * 200}{i} {own.random()}" for i in range(3000)), None]
    run = encode_column(m).func
    got = run(pa.array(texts))
    (memo,) = bpe._memos.values()
    assert sum(4 * len(w) + len(ids) for w, ids in memo.items()) <= 1 << 18
    assert got.to_pylist() == [None if t is None else m.encode(t) for t in texts]
    assert run(pa.array(texts).slice(1, 5)).to_pylist() == [m.encode(t) for t in texts[1:6]] and run(pa.array([], pa.string())).to_pylist() == []


@pytest.mark.parametrize("m", [STRING_MODEL, ID_MODEL])
def test_words_of_a_long_text_are_not_listed_at_once(spark, monkeypatch, m):
    """Texts of many times a part's size, between others, take a few bytes a byte; the ids are those of the texts one by one."""
    from wordloom.operators import bpe

    monkeypatch.setattr(bpe, "_memos", {})
    texts = ["the end", " ".join(f"the {i % 999}\té" for i in range(250_000)), None, "", " of" + "x " * 1_000_000, "and"]
    run, batch = encode_column(m).func, pa.array(texts)
    run(batch.slice(0, 1))
    tracemalloc.start()
    got = run(batch)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    memo: dict = {}
    want = pa.array([None if t is None else m.encode(t, memo) for t in texts], pa.list_(pa.int32()))
    assert got.equals(want)
    assert most < 12 * sum(len(t or "") for t in texts)


def test_long_texts_keep_their_words_and_prefix():
    """Whatever is cut where: prefix at a long text's start only, given patterns with groups and empty matches."""
    from wordloom.operators.bpe import _runs

    for m in (PREFIX_MODEL, TokenizerModel(VOCAB, STRING_MODEL.special, prefix=PREFIX_MODEL.prefix, byte_mode=True, pattern="([a-z]{1,2})|([0-9]*)")):
        for texts in (["a b", "the hen 12 and 345 then", None, " the  end of", "x"], ["the hen 12 and 345 then"], ["", None]):
            for size, words in ((0, 1), (3, 2), (12, 3), (99, 9)):
                got = [[] for _ in texts]
                for rows in _runs(m, texts, size, words):
                    for row, head, own in rows:
                        got[row] += head + [i for w in own for i in m.word_ids(w)]
                assert got == [m.encode(t or "") for t in texts]


def test_batches_of_registered_queries_are_small(spark, tmp_path):
    import __spark_entry__ as e

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    column(spark, TEXTS).withColumnRenamed("id", "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get(key)
    spark.conf.unset(key)
    e.queries()["encode_id_bpe"](spark, str(tmp_path))
    assert spark.conf.get(key) == str(1 << 22)
    spark.conf.set(key, "1m")
    e.queries()["encode_id_bpe"](spark, str(tmp_path))
    assert spark.conf.get(key) == "1m"
    spark.conf.set(key, before)


@pytest.mark.parametrize("kind", ["int", "string", "double"])
def test_pairs_are_counted_without_a_row_for_each(spark, kind):
    """Characters of any size, null and repeated keys, null and short texts, a text that is counted in pieces."""
    own = random.Random(9)
    key = {"int": lambda i: i, "string": lambda i: "aé€😀"[i % 4] * (i % 7), "double": lambda i: [float("nan"), -0.0, 0.0, 1.5][i % 4]}[kind]
    word = lambda letters: "".join(own.choices(letters, k=own.randint(0, 30)))
    rows = [(None if i % 11 == 0 else key(own.randint(-9, 9)), None if i % 13 == 0 else word(own.choice(["ab", "aÿ\n", "ab€😀"]))) for i in range(200)]
    long = "aab" * 800_000
    rows = spark.createDataFrame([*rows, (key(3), long)], f"doc_id {kind}, s string").repartition(3)
    want = train.pair_rows(rows.where(F.length("s") < 100)).groupBy("pair").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "pos")).alias("last"))
    of_long = [("aa", 800_000, len(long) - 3), ("ab", 800_000, len(long) - 2), ("ba", 799_999, len(long) - 4)]
    more = spark.createDataFrame([(p, n, (key(3), at)) for p, n, at in of_long], f"pair string, n long, last struct<doc_id:{kind},pos:int>")
    want = want.unionByName(more).groupBy("pair").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    got = train.pair_counts(rows)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select("pair", "n", "last").collect()))
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    by_row = train.pair_counts_of_rows(rows.where(F.length("s") < 100))
    want = train.pair_rows(rows.where(F.length("s") < 100)).groupBy("doc_id", "pair").agg(F.count("*").alias("n"), F.max("pos").alias("last"))
    assert sorted(map(str, by_row.collect())) == sorted(map(str, want.collect()))


def test_ids_of_a_batch_are_not_listed_at_once(spark):
    ids = [VOCAB[b"he"]] * 5000
    batch = pa.array([None, [], *[ids] * 400, [104, 105]], pa.list_(pa.int32()))
    run = decode_column(STRING_MODEL).func
    tracemalloc.start()
    got = run(batch)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [None, "", *["he" * 5000] * 400, "hi"]
    assert most < 30e6
    assert run(batch.slice(401, 2)).to_pylist() == ["he" * 5000, "hi"] and run(batch.slice(0, 0)).to_pylist() == []
    with pytest.raises(ValueError, match=OUT_OF_RANGE):
        run(pa.array([[999999]], pa.list_(pa.int32())))
    assert decode_column(STRING_MODEL, strict=False).func(pa.array([[999999], [104]], pa.list_(pa.int32()))).to_pylist() == [None, "h"]


def test_native_merging_looks_up_a_few_tokens_each(spark):
    """The ids of model.merge_strings, with units of bytes and unknown characters; no map holds a large part of a vocabulary."""
    from wordloom.operators.bpe import encode_words_native, vocab_map

    many = TokenizerModel({f"{a}{b}{c}".encode(): i for i, (a, b, c) in enumerate(itertools.product("abcdefghij", repeat=3))})
    maps = spark.range(1).select(F.transform(vocab_map(many), F.size).alias("n")).first()["n"]
    assert sum(maps) == 1000 and max(maps) < 20
    own = random.Random(6)
    for _ in range(6):
        letters = own.choice(["ab", "abé<0 ", "xy€𝄞"])
        text = lambda most: "".join(own.choice(letters + "aQ") for _ in range(own.randint(0, most)))
        tokens = sorted({text(4) + own.choice(letters) for _ in range(own.randint(1, 60))})
        m = TokenizerModel(dict(zip((t.encode() for t in tokens), own.sample(range(900), len(tokens)))))
        words = [None, "", "<0x61>a", "a", "ab<0xE2><0>", *(text(40) for _ in range(60))]
        got = column(spark, words).select("id", encode_words_native(F.col("text"), vocab_map(m)).alias("ids")).orderBy("id").collect()
        assert [r["ids"] for r in got] == [None if w is None else m.merge_strings(w.encode()) for w in words]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_native_encoding_uses_all_cores(spark):
    import __spark_entry__ as e

    df = e.queries()["encode_native_hof"](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
