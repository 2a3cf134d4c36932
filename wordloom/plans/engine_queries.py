"""Registered queries of the tokenisation engine and, for each, the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunk_spans, class_counts, detokenize, pretokenize, split_words, utf8_lengths
from ..model import LETTERS, WORD_PATTERN, TokenizerModel, byte_alphabet, special_bytes
from ..operators import train
from ..operators.bpe import decode_column, decode_native, encode_column, encode_words_native, look_up, out_of_vocabulary, valid_ids, vocab_map
from ..operators.morph import look_up_words
from ..runtime import spread
from ..sources.files import format_vocab, parse_vocab, resolve_merges

_ALPHABET = byte_alphabet()
_SPACE = _ALPHABET[32]

# The learned tokens of the demonstration vocabulary, "_" for the space; ids follow the 256 bytes.
_PIECES = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro the ing ion and _t _a _the _of _and tion".split()
PIECES = [x.replace("_", _SPACE) for x in _PIECES]
VOCAB = {_ALPHABET[b].encode(): b for b in range(256)} | {p.encode(): 256 + i for i, p in enumerate(PIECES)}
#: Each piece's rule: its longest known beginning with what is left of it.
_known = {t.decode() for t in VOCAB}
RULES = [next((p[:i], p[i:]) for i in reversed(range(1, len(p))) if p[:i] in _known and p[i:] in _known) for p in PIECES]
MERGES = {(VOCAB[a.encode()], VOCAB[b.encode()]): (i, VOCAB[(a + b).encode()]) for i, (a, b) in enumerate(RULES)}

STRING_MODEL = TokenizerModel(VOCAB, special_bytes(), byte_mode=True)
ID_MODEL = TokenizerModel(VOCAB, special_bytes(), MERGES, byte_mode=True)
PREFIX_MODEL = TokenizerModel(VOCAB, special_bytes(), prefix=_SPACE, byte_mode=True)
#: Replacements of one another's beginnings, for longest match.
LONGEST_MODEL = TokenizerModel({b"x": 0}, {65: "he", 66: "her", 67: "hers", 68: "an", 69: "a"})
REGEX = r"[[:alpha:]]+|[0-9]{1,3}"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _texts(spark: SparkSession, sf_dir: str, *key: str, table: str = "documents") -> DataFrame:
    return spread(_read(spark, sf_dir, table).select(*key, "text"))


def _digest(ids):
    return F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").cast("binary"))


def _joined(words):
    return F.md5(F.array_join(words, "\x1f").cast("binary"))


def _encoded(docs: DataFrame, model: TokenizerModel, *key: str) -> DataFrame:
    ids = docs.select(*key, encode_column(model)("text").alias("ids"))
    unknown = F.size(F.filter("ids", lambda x: x < 0)).cast("long")
    return ids.select(*key, F.size("ids").cast("long").alias("n_tokens"), unknown.alias("n_unknown"), _digest(F.col("ids")).alias("ids_md5"))


def _vocab(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.decode(), i) for t, i in VOCAB.items()], "token string, id int")


def _mapped_words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(split_words(F.col("text"))).alias("word")).withColumn("token", pretokenize(F.col("word"), STRING_MODEL))


def _name_corpus(spark, sf_dir):
    names = _read(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))  # 25 rows at any scale
    return names.select(F.lit(0).alias("doc_id"), F.array_join(F.transform("x", lambda r: r["n_name"]), " ").alias("text"))


def _log(spark: SparkSession, log) -> DataFrame:
    return spark.createDataFrame([(i, pair, n) for i, pair, n in log], "id long, pair string, n long")


def split_words_(spark, d):
    w = split_words(F.col("text"))
    return _texts(spark, d, "doc_id").select("doc_id", F.size(w).cast("long").alias("n_words"), _joined(w).alias("words_md5"))


def word_freq_topk(spark, d):
    return _texts(spark, d).select(F.explode(split_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


def char_class_counts(spark, d):
    return _read(spark, d, "documents").groupBy("lang").agg(*[F.sum(c).cast("long").alias(k) for k, c in class_counts(F.col("text")).items()])


def utf8_len_profile(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), *[c.cast("long").alias(k) for k, c in utf8_lengths(F.col("text")).items()])


def byte_map_encode(spark, d):
    return _texts(spark, d, "doc_id").select("doc_id", F.md5(pretokenize(F.col("text"), STRING_MODEL).cast("binary")).alias("mapped_md5"))


def byte_map_roundtrip(spark, d):
    return _texts(spark, d, "conv_id", "turn", table="conversations").select("conv_id", "turn", F.md5(detokenize(pretokenize(F.col("text"), STRING_MODEL), STRING_MODEL).cast("binary")).alias("text_md5"))


def special_longest_match(spark, d):
    return _read(spark, d, "part").select("p_partkey", detokenize(F.concat("p_name", F.lit(" hers her he")), LONGEST_MODEL).alias("plain"))


def vocab_parse(spark, d):
    lines = _read(spark, d, "nation").select(format_vocab(F.encode("n_name", "UTF-8"), F.col("n_nationkey")).alias("value"))
    return parse_vocab(lines).select(F.hex("token").alias("token"), "id")


def vocab_format(spark, d):
    return _read(spark, d, "part").select("p_partkey", format_vocab(F.encode("p_name", "UTF-8"), F.col("p_partkey")).alias("line"))


def merge_rules_resolve(spark, d):
    words = _read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.lower("n_name").alias("w"))
    extra = words.select((F.col("k") + 1000).cast("int").alias("line_no"), F.substring("w", 1, 2).alias("left"), F.substring("w", 3, 1).alias("right"))
    rules = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(RULES)], "line_no int, left string, right string").unionByName(extra)
    return resolve_merges(rules, _vocab(spark))


def encode_string_bpe(spark, d):
    return _encoded(_texts(spark, d, "doc_id"), STRING_MODEL, "doc_id")


def encode_id_bpe(spark, d):
    return _encoded(_texts(spark, d, "doc_id"), ID_MODEL, "doc_id")


def encode_native_hof(spark, d):
    names = spread(_read(spark, d, "part").select("p_partkey", "p_name"), always=True).select("p_partkey", F.posexplode(split_words(F.col("p_name"))).alias("pos", "word"))
    ids = encode_words_native(pretokenize(F.col("word"), STRING_MODEL), vocab_map(STRING_MODEL))
    return names.select(F.col("p_partkey").alias("doc_id"), F.col("pos").cast("long").alias("pos"), _digest(ids).alias("ids_md5"))


def encode_prefix_cases(spark, d):
    part = _read(spark, d, "part")
    cases = part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text")).unionByName(part.select((-F.col("p_partkey") - 1).alias("doc_id"), F.concat(F.lit(" "), "p_name").alias("text")))
    return _encoded(cases, PREFIX_MODEL, "doc_id")


def oov_report(spark, d):
    return out_of_vocabulary(_mapped_words(_texts(spark, d, "doc_id")), _vocab(spark))


def word_look_up(spark, d):
    return look_up(_mapped_words(_texts(spark, d, "doc_id")), _vocab(spark)).groupBy("id").agg(F.count("*").alias("n"))


def decode_tokens(spark, d):
    ids = _texts(spark, d, "doc_id").select("doc_id", encode_column(STRING_MODEL)("text").alias("ids"))
    return ids.select("doc_id", F.md5(decode_column(STRING_MODEL)("ids").cast("binary")).alias("text_md5"))


def decode_tokens_native(spark, d):
    ids = _texts(spark, d, "conv_id", "turn", table="conversations").select("conv_id", "turn", encode_column(STRING_MODEL)("text").alias("ids"))
    return ids.select("conv_id", "turn", F.md5(detokenize(decode_native(F.col("ids"), STRING_MODEL), STRING_MODEL).cast("binary")).alias("text_md5"))


def decode_validate(spark, d):
    ids = F.array(F.col("p_size").cast("int"), (F.col("p_partkey") - 10).cast("int"))
    return _read(spark, d, "part").select("p_partkey", valid_ids(ids, STRING_MODEL).alias("valid"))


def batch_encode_conversations(spark, d):
    return _encoded(_texts(spark, d, "conv_id", "turn", table="conversations"), STRING_MODEL, "conv_id", "turn")


def _ids(spark, d):
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), train.as_ids(F.col("text")).alias("s"))


def pair_counts(spark, d):
    return train.pair_counts(_ids(spark, d)).select("pair", "n", F.col("last.doc_id").alias("last_doc"), F.col("last.pos").cast("long").alias("last_pos"))


def pair_counts_documents(spark, d):
    rows = _texts(spark, d, "doc_id").select("doc_id", train.as_ids(F.col("text")).alias("s"))
    return train.pair_counts(rows).select("pair", "n", F.col("last.doc_id").alias("last_doc"), F.col("last.pos").cast("long").alias("last_pos"))


def bbpe_train_benchmark(spark, d):
    rows = _texts(spark, d, "item_id", table="benchmark").withColumnRenamed("item_id", "doc_id")
    return _log(spark, train.train_bbpe(rows, 256 + 10)[1])


def pair_argmax_tiebreak(spark, d):
    best = train.pair_counts_of_rows(_ids(spark, d)).groupBy("doc_id").agg(F.min_by(F.struct("pair", "n"), F.struct(-F.col("n"), "last")).alias("b"))
    return best.select("doc_id", "b.pair", "b.n")


def merge_pair(spark, d):
    merged = train.merge_pair(train.as_ids(F.col("text")), "th", train.id_char(256))
    return _texts(spark, d, "doc_id").select("doc_id", F.length(merged).cast("long").alias("n_ids"), F.md5(merged.cast("binary")).alias("ids_md5"))


def bbpe_train_small(spark, d):
    return _log(spark, train.train_bbpe(_name_corpus(spark, d), 256 + 12)[1])


def bpe_train_small(spark, d):
    return _log(spark, train.train_bpe(_name_corpus(spark, d), 256 + 8)[1])


def _lexicon(spark, d):
    part = _read(spark, d, "part")
    words = F.split("p_name", " ")
    analysis = F.concat(words[0], F.lit("[/N]"), F.coalesce(F.get(words, 1), F.lit("")), F.lit("[Nom]"))
    plain = part.select(F.col("p_name").alias("surface"), F.col("p_partkey").alias("ord"), F.concat(F.lit("["), "p_name", F.lit("]")).alias("analysis"))
    return part.select(F.col("p_name").alias("surface"), F.col("p_partkey").alias("ord"), analysis.alias("analysis")).unionByName(plain)


def _morphs(spark, d, only_longest):
    words = _read(spark, d, "part").select(F.col("p_name").alias("word")).distinct()
    found = look_up_words(words, _lexicon(spark, d), only_longest)
    return found.select("word", "ord", F.array_join("segments", "|").alias("segments"))


def morph_split(spark, d):
    return _morphs(spark, d, False)


def morph_longest(spark, d):
    return _morphs(spark, d, True)


def tokens_per_lang(spark, d):
    docs = _texts(spark, d, "lang").select("lang", F.octet_length("text").alias("bytes"), F.size(encode_column(STRING_MODEL)("text")).alias("tokens"))
    out = docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("tokens").cast("long").alias("n_tokens"), F.sum("bytes").cast("long").alias("n_bytes"))
    return out.withColumn("bytes_per_token", F.round(F.col("n_bytes") / F.col("n_tokens"), 4))


def chunk_document(spark, d):
    chunks = chunk_spans(F.col("text"), 500)
    return _texts(spark, d, "doc_id").select("doc_id", F.size(chunks).cast("long").alias("n_chunks"), _joined(chunks).alias("chunks_md5"))


def regex_mode_split(spark, d):
    w = split_words(F.col("text"), REGEX)
    return _texts(spark, d, "conv_id", "turn", table="conversations").select("conv_id", "turn", F.size(w).cast("long").alias("n_words"), _joined(w).alias("words_md5"))


QUERIES = {f.__name__.rstrip("_"): f for f in (
    split_words_, word_freq_topk, char_class_counts, utf8_len_profile, byte_map_encode, byte_map_roundtrip, special_longest_match, vocab_parse,
    vocab_format, merge_rules_resolve, encode_string_bpe, encode_id_bpe, encode_native_hof, encode_prefix_cases, oov_report, word_look_up,
    decode_tokens, decode_tokens_native, decode_validate, batch_encode_conversations, pair_counts, pair_argmax_tiebreak, merge_pair,
    pair_counts_documents, bbpe_train_benchmark, bbpe_train_small, bpe_train_small, morph_split, morph_longest, tokens_per_lang, chunk_document, regex_mode_split,
)}

# --- the same in SQL


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PAT = _q(WORD_PATTERN.replace(r"\x0B", r"\v"))
_CHARS = "[" + ", ".join(_q(_ALPHABET[b]) for b in range(256)) + "]"
_LATIN = "[" + ", ".join(f"chr({b})" for b in range(256)) + "]"
_VOCAB_ROWS = "vocab(token, id) AS (VALUES " + ", ".join(f"({_q(t.decode())}, {i})" for t, i in VOCAB.items()) + ")"
_MERGE_ROWS = "merges(l, r, rank, id) AS (VALUES " + ", ".join(f"({a}, {b}, {r}, {m})" for (a, b), (r, m) in MERGES.items()) + ")"


def _bytes(text: str, table: str) -> str:
    """A list with a character of table for each byte."""
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: {table}[16 * (instr('0123456789ABCDEF', h[1]) - 1) + instr('0123456789ABCDEF', h[2])])"


def _map(text: str) -> str:
    return f"array_to_string({_bytes(text, _CHARS)}, '')"


def _latin(text: str) -> str:
    return f"array_to_string({_bytes(text, _LATIN)}, '')"


def _words(table: str, key: str, text: str = "text") -> str:
    return f"""split AS (SELECT {key}, regexp_extract_all({text}, {_PAT}) AS ws FROM {table}),
        words AS (SELECT {key}, word, pos, {_map('word')} AS m FROM (SELECT {key}, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM split))"""


_STRING_STEPS = f"""{_VOCAB_ROWS},
        bpe AS (
            SELECT m, regexp_extract_all(m, '(?s).') AS s, 0 AS step FROM (SELECT DISTINCT m FROM words)
            UNION ALL
            SELECT m, list_concat(list_concat(s[1:i-1], [s[i] || s[i+1]]), s[i+2:]), step + 1 FROM (
                SELECT p.m, any_value(p.s) AS s, any_value(p.step) AS step, arg_min(p.i, v.id * 100000 + p.i) AS i
                FROM (SELECT m, s, step, unnest(range(1, len(s))) AS i FROM bpe) p JOIN vocab v ON v.token = p.s[p.i] || p.s[p.i+1] GROUP BY p.m)),
        fin AS (SELECT m, arg_max(s, step) AS s FROM bpe GROUP BY m),
        wid AS (SELECT m, list(coalesce(id, -1) ORDER BY j) AS ids FROM (SELECT m, unnest(s) AS t, generate_subscripts(s, 1) AS j FROM fin) LEFT JOIN vocab ON token = t GROUP BY m)"""

_ID_STEPS = f"""{_VOCAB_ROWS}, {_MERGE_ROWS},
        start AS (SELECT m, list(coalesce(id, -1) ORDER BY j) AS s FROM (
            SELECT m, unnest(cs) AS t, generate_subscripts(cs, 1) AS j FROM (SELECT m, regexp_extract_all(m, '(?s).') AS cs FROM (SELECT DISTINCT m FROM words))) LEFT JOIN vocab ON token = t GROUP BY m),
        bpe AS (
            SELECT m, s, 0 AS step FROM start
            UNION ALL
            SELECT m, list_concat(list_concat(s[1:i-1], [id]), s[i+2:]), step + 1 FROM (
                SELECT p.m, any_value(p.s) AS s, any_value(p.step) AS step, arg_min(p.i, v.rank * 100000 + p.i) AS i, arg_min(v.id, v.rank * 100000 + p.i) AS id
                FROM (SELECT m, s, step, unnest(range(1, len(s))) AS i FROM bpe) p JOIN merges v ON v.l = p.s[p.i] AND v.r = p.s[p.i+1] GROUP BY p.m)),
        wid AS (SELECT m, arg_max(s, step) AS ids FROM bpe GROUP BY m)"""


def _encode_sql(table: str, key: str, steps: str) -> str:
    return f"""WITH RECURSIVE {_words(table, key)}, {steps},
        doc AS (SELECT {key}, flatten(list(ids ORDER BY pos)) AS ids FROM words JOIN wid USING (m) GROUP BY {key})
        SELECT {key}, cast(len(ids) AS BIGINT) AS n_tokens, cast(len(list_filter(ids, lambda x: x < 0)) AS BIGINT) AS n_unknown, md5(array_to_string(ids, ' ')) AS ids_md5 FROM doc"""


def _train_sql(rounds: int, least: int, first: int) -> str:
    return f"""WITH RECURSIVE t(step, s, pair, n) AS (
            SELECT 0, string_agg(n_name, ' ' ORDER BY n_nationkey), '', cast(0 AS BIGINT) FROM nation
            UNION ALL
            SELECT step + 1, replace(s, pair, chr({first} + step)), pair, n FROM (
                SELECT step, s, arg_min(pair, -n * 100000 + last) AS pair, max(n) AS n FROM (
                    SELECT step, s, pair, count(*) AS n, max(i) AS last FROM (SELECT step, s, i, substr(s, i, 2) AS pair FROM (SELECT step, s, unnest(range(1, length(s))) AS i FROM t WHERE step < {rounds})) GROUP BY step, s, pair)
                GROUP BY step, s) WHERE n >= {least})
        SELECT cast({first} + step - 1 AS BIGINT) AS id, pair, n FROM t WHERE step > 0"""


_NAMED = "SELECT p_name AS surface, p_partkey AS ord, split_part(p_name, ' ', 1) || '[/N]' || split_part(p_name, ' ', 2) || '[Nom]' AS a, 2 AS depth FROM part UNION ALL SELECT p_name, p_partkey, '[' || p_name || ']', 1 FROM part"
_SEGMENTS = "array_to_string(list_filter(list_filter(string_split_regex(a, '[\\[\\]]+'), lambda x: x <> ''), lambda x, i: i % 2 = 1), '|')"


def _pairs(table: str, key: str) -> str:
    return f"SELECT doc_id, i - 1 AS pos, substr(s, i, 2) AS pair FROM (SELECT doc_id, s, unnest(range(1, length(s))) AS i FROM (SELECT {key} AS doc_id, {_latin('text')} AS s FROM {table}))"


def _pair_counts_sql(pairs: str) -> str:
    return f"SELECT pair, count(*) AS n, max(doc_id) AS last_doc, cast(arg_max(pos, (doc_id, pos)) AS BIGINT) AS last_pos FROM ({pairs}) GROUP BY pair"


def _train_rows_sql(table: str, key: str, rounds: int, least: int, first: int) -> str:
    """Rounds over all rows of a table: a step holds the texts as one list."""
    return f"""WITH RECURSIVE t(step, ss, pair, n) AS (
            SELECT 0, list(s ORDER BY k), '', cast(0 AS BIGINT) FROM (SELECT {key} AS k, {_latin("text")} AS s FROM {table})
            UNION ALL
            SELECT step + 1, list_transform(ss, lambda x: replace(x, best.pair, chr({first} + step))), best.pair, best.n FROM t, LATERAL (
                SELECT arg_min(pair, (-n, last)) AS pair, max(n) AS n FROM (
                    SELECT pair, count(*) AS n, max((d, i)) AS last FROM (
                        SELECT d, i, substr(s, i, 2) AS pair FROM (SELECT d, s, unnest(range(1, length(s))) AS i FROM (SELECT unnest(t.ss) AS s, generate_subscripts(t.ss, 1) AS d)))
                    GROUP BY pair)) best WHERE step < {rounds} AND best.n >= {least})
        SELECT cast({first} + step - 1 AS BIGINT) AS id, pair, n FROM t WHERE step > 0"""


_PAIRS = _pairs("benchmark", "item_id")
_CLASS = {"alpha": f"[A-Za-z{LETTERS}]", "digit": "[0-9]", "space": r"[ \t\n\v\f\r]", "other": rf"[^A-Za-z{LETTERS}0-9 \t\n\v\f\r]"}
_REGEX_SQL = _q(f"[A-Za-z{LETTERS}]+|[0-9]{{1,3}}")

ORACLE_SQL = {
    "split_words": f"SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, chr(31))) AS words_md5 FROM (SELECT doc_id, regexp_extract_all(text, {_PAT}) AS w FROM documents)",
    "word_freq_topk": f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, {_PAT})) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 50",
    "char_class_counts": "SELECT lang, " + ", ".join(f"cast(sum(len(regexp_extract_all(text, {_q(v)}))) AS BIGINT) AS {k}" for k, v in _CLASS.items()) + " FROM documents GROUP BY lang",
    "utf8_len_profile": "SELECT doc_id, cast(strlen(text) AS BIGINT) AS n_bytes, " + ", ".join(f"cast(len(list_filter(regexp_extract_all(text, '(?s).'), lambda c: strlen(c) = {n})) AS BIGINT) AS len{n}" for n in (1, 2, 3, 4)) + " FROM documents",
    "byte_map_encode": f"SELECT doc_id, md5({_map('text')}) AS mapped_md5 FROM documents",
    "byte_map_roundtrip": "SELECT conv_id, turn, md5(text) AS text_md5 FROM conversations",
    "special_longest_match": "SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name || ' hers her he', '(?s)hers|her|he|an|a|.'), lambda x: CASE x WHEN 'he' THEN 'A' WHEN 'her' THEN 'B' WHEN 'hers' THEN 'C' WHEN 'an' THEN 'D' WHEN 'a' THEN 'E' ELSE x END), '') AS plain FROM part",
    "vocab_parse": "SELECT hex(encode(n_name)) AS token, n_nationkey AS id FROM nation",
    "vocab_format": "SELECT p_partkey, regexp_replace(hex(encode(p_name)), '(..)', '0x\\1', 'g') || ' == ' || p_partkey AS line FROM part",
    "merge_rules_resolve": f"WITH {_VOCAB_ROWS}, rules(line_no, l, r) AS (VALUES " + ", ".join(f"({i}, {_q(a)}, {_q(b)})" for i, (a, b) in enumerate(RULES)) + " UNION ALL SELECT n_nationkey + 1000, substr(lower(n_name), 1, 2), substr(lower(n_name), 3, 1) FROM nation) SELECT row_number() OVER (ORDER BY line_no) - 1 AS rank, a.id AS left_id, b.id AS right_id, c.id AS merge_id FROM rules JOIN vocab a ON a.token = l JOIN vocab b ON b.token = r JOIN vocab c ON c.token = l || r",
    "encode_string_bpe": _encode_sql("documents", "doc_id", _STRING_STEPS),
    "encode_id_bpe": _encode_sql("documents", "doc_id", _ID_STEPS),
    "encode_native_hof": f"WITH RECURSIVE {_words('(SELECT p_partkey AS doc_id, p_name AS text FROM part)', 'doc_id')}, {_STRING_STEPS} SELECT doc_id, pos - 1 AS pos, md5(array_to_string(ids, ' ')) AS ids_md5 FROM words JOIN wid USING (m)",
    "encode_prefix_cases": f"""WITH RECURSIVE cases AS (SELECT p_partkey AS doc_id, p_name AS text FROM part UNION ALL SELECT -p_partkey - 1, ' ' || p_name FROM part),
        {_words("cases", "doc_id").replace("words AS", "plain AS", 1)},
        words AS (SELECT doc_id, pos, CASE WHEN pos = 1 AND doc_id >= 0 THEN {_q(_SPACE)} || m ELSE m END AS m FROM plain
            UNION ALL SELECT doc_id, 0, {_q(_ALPHABET[0xC4] + _ALPHABET[0xA0])} FROM cases WHERE doc_id < 0), {_STRING_STEPS},
        doc AS (SELECT doc_id, flatten(list(ids ORDER BY pos)) AS ids FROM words JOIN wid USING (m) GROUP BY doc_id)
        SELECT doc_id, cast(len(ids) AS BIGINT) AS n_tokens, cast(len(list_filter(ids, lambda x: x < 0)) AS BIGINT) AS n_unknown, md5(array_to_string(ids, ' ')) AS ids_md5 FROM doc""",
    "oov_report": f"WITH {_words('documents', 'doc_id')}, {_VOCAB_ROWS} SELECT m AS token, count(*) AS n FROM words WHERE m NOT IN (SELECT token FROM vocab) GROUP BY m",
    "word_look_up": f"WITH {_words('documents', 'doc_id')}, {_VOCAB_ROWS} SELECT coalesce(id, -1) AS id, count(*) AS n FROM words LEFT JOIN vocab ON m = token GROUP BY 1",
    "decode_tokens": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "decode_tokens_native": "SELECT conv_id, turn, md5(text) AS text_md5 FROM conversations",
    "decode_validate": f"SELECT p_partkey, p_size BETWEEN 0 AND {max(VOCAB.values())} AND p_partkey - 10 BETWEEN 0 AND {max(VOCAB.values())} AS valid FROM part",
    "batch_encode_conversations": _encode_sql("conversations", "conv_id, turn", _STRING_STEPS),
    "pair_counts": _pair_counts_sql(_PAIRS),
    "pair_counts_documents": _pair_counts_sql(_pairs("documents", "doc_id")),
    "bbpe_train_benchmark": _train_rows_sql("benchmark", "item_id", 10, 2, 256),
    "pair_argmax_tiebreak": f"SELECT doc_id, arg_min(pair, -n * 1000000 + last) AS pair, max(n) AS n FROM (SELECT doc_id, pair, count(*) AS n, max(pos) AS last FROM ({_PAIRS}) GROUP BY doc_id, pair) GROUP BY doc_id",
    "merge_pair": f"SELECT doc_id, length(s) AS n_ids, md5(s) AS ids_md5 FROM (SELECT doc_id, replace({_latin('text')}, 'th', chr(256)) AS s FROM documents)",
    "bbpe_train_small": _train_sql(12, 2, 256),
    "bpe_train_small": _train_sql(8, 1, 257),
    "morph_split": f"SELECT surface AS word, ord, {_SEGMENTS} AS segments FROM ({_NAMED})",
    "morph_longest": f"SELECT surface AS word, ord, {_SEGMENTS} AS segments FROM (SELECT surface, arg_min(ord, -depth * 1000000000 + ord) AS ord, arg_min(a, -depth * 1000000000 + ord) AS a FROM ({_NAMED}) GROUP BY surface)",
    "tokens_per_lang": f"""WITH RECURSIVE {_words("documents", "lang, doc_id")}, {_STRING_STEPS},
        n AS (SELECT lang, sum(len(ids)) AS n_tokens FROM words JOIN wid USING (m) GROUP BY lang)
        SELECT lang, count(*) AS n_docs, cast(any_value(n_tokens) AS BIGINT) AS n_tokens, cast(sum(strlen(text)) AS BIGINT) AS n_bytes, round(sum(strlen(text)) / any_value(n_tokens), 4) AS bytes_per_token FROM documents JOIN n USING (lang) GROUP BY lang""",
    "chunk_document": r"SELECT doc_id, cast(len(c) AS BIGINT) AS n_chunks, md5(array_to_string(c, chr(31))) AS chunks_md5 FROM (SELECT doc_id, regexp_extract_all(text, '(?s).{1,500}[^ \n\t]*[ \n\t]?') AS c FROM documents)",
    "regex_mode_split": f"SELECT conv_id, turn, cast(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, chr(31))) AS words_md5 FROM (SELECT conv_id, turn, regexp_extract_all(text, {_REGEX_SQL}) AS w FROM conversations)",
}
