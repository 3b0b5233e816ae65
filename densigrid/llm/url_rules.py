"""URL filtering by mined association rules, with Spark SQL functions and Spark's FP-growth only.

URL tokens (host labels, path segments, query names) of labelled pages and the item ``label=block`` are the transactions. FP-growth mines
their frequent sets; rules that end in ``label=block`` and pass the least support and confidence stay. They are matched by
an inverted index from token to rule: a URL meets a rule when as many of its tokens as the rule has point to it.
Host and path rules written by hand come first: a rule fits its host and all subdomains if the path starts with its
path, and the longest fitting rule wins.

Defined cases: a null URL, or one without ``://``, has empty host and path and no tokens, fits no rule and is allowed; repeated URLs are judged once and
get the same verdict; labels whose page is missing are ignored; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densigrid.llm.common import salted_join

BROADCAST_RULES = 20_000  # index rows that are sent to every executor; a larger index is joined by shuffle


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    raw = F.regexp_extract(after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: h=label, p=segment and q=name; an empty array without ``://``."""
    labels = F.transform(F.split(host_of(url), "\\."), lambda x: F.concat(F.lit("h="), x))
    parts = F.transform(F.split(path_of(url), "/"), lambda x: F.concat(F.lit("p="), x))
    query = F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), "^[^?#]*\\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q="), F.element_at(F.split(x, "="), 1)))
    return F.array_distinct(F.filter(F.concat(labels, parts, names), lambda x: F.length(x) > 2))


def policy_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting (verdict, host, path) of ``rules``, a short list in a configuration, as struct(n, rule, verdict), or null."""
    if not rules:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string,h:string,p:string>")
    made = F.array(*(F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, h, p in rules))
    fits = F.filter(made, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
    return F.array_max(fits)


def mine(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.5, min_rows: int = 10) -> DataFrame:
    """Rules (rule_id, items, confidence, support) from rows (url, blocked boolean); all labelled rows count.

    A rule needs ``min_support`` of the rows and ``min_rows`` of them.
    """
    items = F.concat(tokens_of(F.col("url")), F.when(F.col("blocked"), F.array(F.lit("label=block"))).otherwise(F.array().cast("array<string>")))
    sets = labelled.select(items.alias("items")).where(F.size("items") > 0)
    min_support = min(1.0, max(min_support, min_rows / max(1, sets.count())))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(sets)
    kept = model.associationRules.where((F.col("consequent") == F.array(F.lit("label=block"))) & (F.col("confidence") >= min_confidence) & (F.col("support") >= min_support))
    items = F.array_sort("antecedent")
    return kept.select(F.xxhash64(items).alias("rule_id"), items.alias("items"), "confidence", "support")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined string, confidence) of the distinct URLs that meet a rule: the surest, then the first by name."""
    index = rules.select("rule_id", "confidence", F.size("items").alias("need"), F.concat_ws(" & ", "items").alias("mined"), F.explode("items").alias("item"))
    index = F.broadcast(index) if index.count() <= BROADCAST_RULES else index
    each = urls.where(F.col("url").isNotNull()).select("url").distinct().select("url", F.explode(tokens_of(F.col("url"))).alias("item"))
    met = each.join(index, "item").groupBy("url", "rule_id", "need", "mined", "confidence").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.col("need"))
    return met.groupBy("url").agg(F.min(F.struct(-F.col("confidence"), "mined")).alias("best")).select("url", F.col("best.mined").alias("mined"), (-F.col("best.col1")).alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], min_support: float = 0.01, min_confidence: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, mined of every row of ``pages`` (page_id, url)."""
    found = matched(pages, mine(labelled, min_support, min_confidence))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    own = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    own = own.withColumn("fit", policy_rule(F.col("host"), F.col("path"), rules))
    # One URL, or none at all, may stand in very many rows.
    return salted_join(own, found, "url", "page_id", own.count(), "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined",
    )
