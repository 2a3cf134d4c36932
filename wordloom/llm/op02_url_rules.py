"""URL filtering by association rules, with DataFrame and SQL functions alone.

Given rules of host and path come first. For other URLs, Spark's FP-growth mines combinations of URL tokens that go
with rejected pages: a transaction is a labelled page's tokens and its class. Rules enough supported and confident and
not implied by a shorter rule as confident are kept in an inverted index: an array of buckets by hash of each rule's
rarest token. A URL looks up its own tokens there and checks the rest of each rule found, so matching needs no join and
no shuffle.

Mining reads every token of every labelled URL. Tokens in too few rejected URLs are in no rule and are left out of the
transactions; of tokens that stand in the very same URLs (by count and a 64-bit hash of the rows), one stands for all
while sets are mined, and rules are written out for each of them. The number of frequent sets has no fixed bound: it
depends on how many combinations of tokens are frequent. Rules that reach the thresholds come to the driver, once for
each set; matching reads all tokens of all URLs.

Defined results: null urls and urls without "://" have empty host and path and are allowed; ties between given rules
go to the first given; repeated rows are judged each; labels without page and pages without label do not teach;
without rejected pages there are no mined rules; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import json
import string
from dataclasses import dataclass
from itertools import product

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

_BUCKETS = 1024


@dataclass(frozen=True)
class Rule:
    """A given rule: it fits a host and its subdomains where the path starts with path."""

    verdict: str
    host: str
    path: str


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def given(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest given rule that fits, as text, and its verdict."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda x: len(x.host + x.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found, verdict = F.when(fits, rule.host + rule.path).otherwise(found), F.when(fits, rule.verdict).otherwise(verdict)
    return found, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: each domain that the host is in, path segments, names of query arguments, the scheme."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    domains = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), ".")))).otherwise(F.array().cast("array<string>"))
    segments = F.transform(F.filter(F.split(lower_ascii(path), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    scheme = F.array(F.concat(F.lit("s:"), F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1)))
    return F.array_distinct(F.concat(domains, segments, names, scheme))


#: The class of a rejected page's transaction; no token starts like this.
_REJECTED = "!rejected"


def mine(pages: DataFrame, labels: DataFrame, min_support: float = 0.002, min_rows: int = 10, min_confidence: float = 0.6) -> list[dict]:
    """Rules: tokens (rarest first), confidence, support. pages: page_id, tokens; labels: page_id, rejected."""
    with scratch():
        known = pages.join(labels.groupBy("page_id").agg(F.max("rejected").alias("rejected")), "page_id").select("rejected", "tokens")
        return _mined(stored(known.withColumn("row", F.monotonically_increasing_id()), "url-transactions"), min_support, min_rows, min_confidence)


def _mined(known: DataFrame, min_support: float, min_rows: int, min_confidence: float) -> list[dict]:
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("rejected"), F.lit(0)).alias("bad")).first()
    n = total["n"]
    if not total["bad"]:
        return []
    least = max(min_rows, int(min_support * n))
    token = known.select("row", "rejected", F.explode("tokens").alias("token")).groupBy("token")
    each = token.agg(F.count("*").alias("rows"), F.sum("rejected").alias("bad"), F.bit_xor(F.xxhash64("row")).alias("where")).where(F.col("bad") >= least)
    # At most (tokens of a URL) / min_support tokens pass: no more with more rows.
    each = sorted(each.collect(), key=lambda r: (r["rows"], r["token"]))
    order = {r["token"]: i for i, r in enumerate(each)}
    alike: dict[tuple, list[str]] = {}
    for r in each:
        alike.setdefault((r["rows"], r["bad"], r["where"]), []).append(r["token"])
    if not alike:
        return []
    of = {tokens[0]: tokens for tokens in alike.values()}
    first = known.sparkSession.createDataFrame([(x,) for x in of], "token string")
    kept = known.select("row", "rejected", F.explode("tokens").alias("token")).join(F.broadcast(first), "token").groupBy("row", "rejected").agg(F.collect_set("token").alias("items"))
    baskets = stored(kept.select(F.when(F.col("rejected") == 1, F.concat("items", F.array(F.lit(_REJECTED)))).otherwise(F.col("items")).alias("items")), "url-baskets")
    # Support is a share of the transactions that are left; those without any token are not among them.
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / max(1, baskets.count()), minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(_REJECTED))).select("antecedent", "confidence", "support").collect()
    share = baskets.count() / n
    rules = [(sorted(r["antecedent"], key=order.__getitem__), r["confidence"], r["support"] * share) for r in found]
    rules.sort(key=lambda r: (len(r[0]), r[0]))
    out: list[dict] = []
    shorter: dict[str, list[tuple[set, float]]] = {}
    for tokens, confidence, support in rules:
        if any(k < set(tokens) and c >= confidence - 1e-12 for t in tokens for k, c in shorter.get(t, ())):
            continue
        shorter.setdefault(tokens[0], []).append((set(tokens), confidence))
        out += [{"tokens": sorted(names, key=order.__getitem__), "confidence": confidence, "support": support} for names in product(*(of[t] for t in tokens))]
    return out


def matched(own: Column, rules: list[dict]) -> Column:
    """The highest confidence of the mined rules whose tokens are all among own; null if there is none."""
    if not rules:
        return F.lit(None).cast("double")
    spark = _session()
    anchors = spark.createDataFrame([(r["tokens"][0], i) for i, r in enumerate(rules)], "token string, rule int")
    of = {r["rule"]: r["bucket"] for r in anchors.select("rule", F.pmod(F.xxhash64("token"), F.lit(_BUCKETS)).alias("bucket")).collect()}
    buckets: list[list] = [[] for _ in range(_BUCKETS)]
    for i, rule in enumerate(rules):
        buckets[of[i]].append({"t": rule["tokens"], "c": rule["confidence"]})
    index = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<t: array<string>, c: double>>>")
    found = F.flatten(F.transform(own, lambda t: F.get(index, F.pmod(F.xxhash64(t), F.lit(_BUCKETS)).cast("int"))))
    fits = F.filter(found, lambda r: F.size(F.array_except(r["t"], own)) == 0)
    return F.array_max(F.transform(fits, lambda r: r["c"]))


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def url_filter(pages: DataFrame, labels: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", **kw) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence for each row; a labelled page is rejected if its quality is 0 or it is toxic."""
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    marked = labels.select(F.col(label_id).cast("long").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("rejected"))
    mined = mine(rows.select("page_id", "tokens"), marked, **kw)
    rule, verdict = given(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("own"), matched(F.col("tokens"), mined).alias("confidence"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence")
