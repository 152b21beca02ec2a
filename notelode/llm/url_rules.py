"""URL filtering by listed rules and by mined token combinations, in DataFrame functions only.

Listed rules name a host and a path and settle what they fit. The pages that they settle are also
the labels from which FP-growth mines token combinations: a page that is not listed counts as not
blocked, so a combination needs support and confidence over all pages to become a rule. A rule is
dropped where a part of it is as sure. What no listed rule fits is matched against an inverted index
that holds each rule under its rarest token; distinct token sets are matched once, however many
pages have them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .tables import measured, table

SUPPORT = 0.001
CONFIDENCE = 0.8
# Mined rules are broadcast up to this number, joined by a shuffle beyond it.
MAX_BROADCAST_RULES = 50_000
# Tokens that blocked rows have often enough are broadcast up to this number.
MAX_BROADCAST_TOKENS = 500_000
BLOCKED = "=block"


@dataclass(frozen=True)
class Listed:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed values.
LISTED = (
    Listed("block", "net", "/"),
    Listed("allow", "example.net", "/en/"),
    Listed("block", "example.com", "/de/"),
    Listed("allow", "org", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for a url that is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def _fits(rule: Listed) -> Column:
    own = F.col("host") == rule.host
    return (own | F.endswith("host", F.lit(f".{rule.host}"))) & F.startswith("path", F.lit(rule.path))


def _listed(rules: tuple[Listed, ...], value) -> Column:
    """``value`` of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name, r.verdict))
    return F.coalesce(*(F.when(_fits(r), F.lit(value(r))) for r in ordered), F.lit(None).cast("string"))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels but the last, path parts with numbers as ``#``, query names."""
    labels = F.split(host, r"\.")
    labels = F.slice(labels, 1, F.greatest(F.lit(0), F.size(labels) - 1))
    parts = F.split(F.regexp_replace(path, "[0-9]+", "#"), "/")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    marked = lambda mark, a: F.transform(F.filter(a, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    return F.array_sort(F.array_distinct(F.concat(marked("h:", labels), marked("p:", parts), marked("q:", names))))


def _slim(labelled: DataFrame, support: float) -> DataFrame:
    """``items`` of each row, with no rule lost: of tokens that always occur together one stands for all,
    and tokens that blocked rows have too seldom for any rule are left out.

    Tokens have the same rows if they have the same number of them and two equal sums of row hashes. One
    popular url with hundreds of query names is then one item instead of every combination of them.
    """
    rows = cut(labelled.withColumn("row", F.monotonically_increasing_id()))
    least = math.ceil(support * rows.count())
    each = rows.select("row", "block", F.explode("tokens").alias("token"))
    hash_ = lambda salt: F.sum(F.xxhash64("row", F.lit(salt)).cast("decimal(38,0)"))
    seen = each.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("block").alias("blocked"), hash_(1).alias("one"), hash_(2).alias("two")
    )
    able = seen.where(F.col("blocked") >= max(least, 1))
    kept = measured(able.groupBy("n", "one", "two").agg(F.min("token").alias("token")).select("token"), MAX_BROADCAST_TOKENS)
    held = each.join(kept, "token", "left_semi").groupBy("row").agg(F.collect_list("token").alias("own"))
    own = F.coalesce("own", F.array().cast("array<string>"))
    # Rows without a token left still count for the supports.
    return rows.select("row", "block").join(held, "row", "left").select(
        F.when(F.col("block"), F.array_append(own, F.lit(BLOCKED))).otherwise(own).alias("items")
    )


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (antecedent, confidence, key) from ``labelled`` (tokens, block); key is the rarest token."""
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(_slim(labelled, support))
    sure = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCKED)))
    sure = cut(sure.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"))
    # A rule is superfluous if leaving out one token (and so any) leaves a rule that is as sure.
    part = sure.select(
        "antecedent", "confidence",
        F.explode(F.transform("antecedent", lambda t: F.array_remove("antecedent", t))).alias("part"),
    )
    wider = sure.select(F.col("antecedent").alias("part"), F.col("confidence").alias("other"))
    covered = part.join(wider, "part").where("other >= confidence").select("antecedent").distinct()
    kept = sure.join(covered, "antecedent", "left_anti")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    counted = kept.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(single, "token")
    return counted.groupBy("antecedent", "confidence").agg(F.min_by("token", F.struct("freq", "token")).alias("key"))


def judge(pages: DataFrame, rules: tuple[Listed, ...] = LISTED, support: float = SUPPORT,
          confidence: float = CONFIDENCE) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict.

    A url that is null, empty or without ``://`` has an empty host and path, no tokens, and is
    allowed. Without any blocked page nothing is mined and all that no rule fits is allowed.
    Repeated rows and null ids are judged like all others. An empty table gives an empty result;
    other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    seen = read.select(
        "page_id", "host", "path", _listed(rules, lambda r: r.name).alias("rule"),
        _listed(rules, lambda r: r.verdict).alias("listed"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"),
    )
    seen = cut(seen)
    learned = seen.select("tokens", F.coalesce(F.col("listed") == "block", F.lit(False)).alias("block")).where(F.size("tokens") > 0)
    if learned.where("block").limit(1).count():
        mined = cut(mine(learned, support, confidence))
        few = mined.count() <= MAX_BROADCAST_RULES
        sets = seen.where("rule IS NULL").select("tokens").distinct()
        meets = sets.select("tokens", F.explode("tokens").alias("key")).join(F.broadcast(mined) if few else mined, "key")
        hit = cut(meets.where(F.size(F.array_except("antecedent", "tokens")) == 0).select("tokens").distinct())
        seen = seen.join(hit.withColumn("hit", F.lit(True)), "tokens", "left")
    else:
        seen = seen.withColumn("hit", F.lit(None).cast("boolean"))
    mined_verdict = F.when(F.col("hit"), "block").otherwise("allow")
    return seen.select("page_id", "host", "path", "rule", F.coalesce("listed", mined_verdict).alias("verdict"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages", "page_id", "url"))


QUERIES = {"op9_url_rules": op9_url_rules}
