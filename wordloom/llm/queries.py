"""The registered queries of the training-data operators, with production parameters, and SQL for those it can express."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..runtime import spread
from . import op01_media, op02_url_rules, op03_toxicity, op04_minhash, op05_bpe, op06_line_dedup, op07_packing, op08_license_scan, op09_token_files, op10_exact_dedup
from .common import read, small_batches

# The given rules of the URL filter.
URL_RULES = [
    op02_url_rules.Rule("allow", "com", "/"),
    op02_url_rules.Rule("block", "example.com", "/en/"),
    op02_url_rules.Rule("allow", "www.example.com", "/en/"),
    op02_url_rules.Rule("block", "net", "/es/"),
    op02_url_rules.Rule("block", "net", "/fr/"),
]


def _production(query):
    """The query, in a session whose Arrow batches are small."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_media.media_columns(read(spark, sf_dir, "documents"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_url_rules.url_filter(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"), URL_RULES)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_minhash.near_dedup(read(spark, sf_dir, "documents"), words=4)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return op05_bpe.round_trip(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), path, pattern)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_line_dedup.line_dedup(read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_license_scan.license_scan(read(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_token_files.checksums(op09_token_files.token_files(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op10_exact_dedup_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_media": op1_media,
    "op2_url_rules": op2_url_rules,
    "op3_toxicity": op3_toxicity,
    "op4_minhash": op4_minhash,
    "op5_bpe": op5_bpe,
    "op6_line_dedup": op6_line_dedup,
    "op7_packing": op7_packing,
    "op8_license_scan": op8_license_scan,
    "op9_token_files": op9_token_files,
    "op10_exact_dedup": op10_exact_dedup_,
}
QUERIES = {name: _production(query) for name, query in QUERIES.items()}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op4_minhash": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')))
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
        items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT s.doc_id, cast(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id, s.doc_id = r.c AS kept
        FROM sets s JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON s.doc_id = r.x""",
    "op6_line_dedup": f"""
        WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS place FROM docs),
        keyed AS (SELECT *, {_LOWER.format("regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')")} AS k FROM lines),
        hot AS (SELECT k, max(doc_id) AS keep_id FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT d.*, h.k IS NOT NULL AND d.doc_id < h.keep_id AS gone FROM keyed d LEFT JOIN hot h ON d.k = h.k)
        SELECT doc_id, count(*) AS n_lines, cast(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
            sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY place), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op10_exact_dedup": """
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS x FROM documents),
        g AS (SELECT x, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM t GROUP BY x)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256 FROM t JOIN g ON t.x = g.x""",
}
