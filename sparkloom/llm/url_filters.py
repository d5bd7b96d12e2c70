"""URL filters: fixed rules by host and path, and association rules mined from what those label.

A fixed rule (host, path) fits its host and the host's subdomains if the url's path starts with the rule's; the longest
fitting one decides.  The urls that it labels are transactions of FP-growth: their scheme, host labels and path segments,
and the verdict.  Tokens that occur in exactly the same urls are one item there, so that a common url of many segments has
no sets of its own segments to enumerate.  Sets of one or two tokens that imply a verdict with CONFIDENCE become rules
(larger sets don't, MOST); a pair goes if one of its tokens alone implies the same verdict at least as surely, as of two
tokens of one item each does.  An inverted index from each rule's token that the fewest urls hold finds the rules of the
other urls; the surest one decides, and a url without any is allowed.

DataFrame functions only.  Distinct urls are judged once and joined back with the pages, so a common url is one row.

Nulls, ties, repeats: a null url, or one without ``://``, has an empty host and path and is allowed; of equally sure rules
the one with more support, then the one of fewer tokens, then the first in order of verdict and tokens decides; repeated
rows get equal results each; without labelled urls nothing is mined; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Share of the labelled urls that hold the tokens of a rule.
SUPPORT = 0.002
CONFIDENCE = 0.8
#: Tokens of a rule, at most.
MOST = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^(.*?)://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 3), F.lit(""))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: s:scheme, h:label, p:segment."""
    scheme = F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _LOWER)
    parts = lambda kind, c: F.transform(F.filter(c, lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}:"), x))
    return F.array_distinct(F.concat(parts("s", F.array(scheme)), parts("h", F.split(host, r"\.")), parts("p", F.split(path, "/"))))


def fixed(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest fitting rule, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (items, verdict, hits, seen) from labelled (items, verdict); hits of seen urls with the items have the verdict."""
    urls = cut(labelled.groupBy("items", "verdict").agg(F.count("*").alias("k")), "labelled")
    least = math.ceil(support * (urls.agg(F.sum("k")).first()[0] or 0))
    held = urls.select("items", "verdict", "k", F.explode("items").alias("token"), F.xxhash64("items", "verdict").cast("decimal(20,0)").alias("h"))
    often = held.groupBy("token").agg(F.sum("k").alias("seen"), F.count("*").alias("urls"), F.sum("h").alias("where")).where(F.col("seen") >= least)
    same = cut(often.groupBy("urls", "where").agg(F.min("token").alias("item"), F.collect_set("token").alias("tokens")).select("item", "tokens"), "same")
    merged = held.join(same.select("item", F.explode("tokens").alias("token")), "token").groupBy("items", "verdict").agg(F.collect_set("item").alias("own"))
    marked = labelled.join(merged, ["items", "verdict"], "left").select(F.concat(F.coalesce("own", F.array().cast("array<string>")), F.array(F.concat(F.lit("v:"), "verdict"))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=support).fit(marked).freqItemsets
    split = sets.select(F.array_sort(F.filter("items", lambda x: ~x.startswith("v:"))).alias("items"), F.filter("items", lambda x: x.startswith("v:")).alias("v"), "freq").where(F.size("items").between(1, MOST))
    split = cut(split, "itemsets")
    hits = split.where(F.size("v") == 1).select("items", F.substring(F.col("v")[0], 3, 99).alias("verdict"), F.col("freq").alias("hits"))
    seen = split.where(F.size("v") == 0).select("items", F.col("freq").alias("seen"))
    sure = hits.join(seen, "items").where(F.col("hits") >= confidence * F.col("seen"))
    alone = sure.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "verdict", (F.col("hits") / F.col("seen")).alias("alone"))
    pairs = sure.where(F.size("items") == 2)
    weaker = pairs.select("items", "verdict", (F.col("hits") / F.col("seen")).alias("c"), F.explode("items").alias("token")).join(alone, ["token", "verdict"]).where("alone >= c").select("items", "verdict").distinct()
    rules = sure.where(F.size("items") == 1).unionByName(pairs.join(weaker, ["items", "verdict"], "left_anti"))
    of = lambda place: same.select(F.col("item").alias(f"i{place}"), F.explode("tokens").alias(f"t{place}"))
    apart = rules.select(F.col("items")[0].alias("i0"), F.try_element_at("items", F.lit(2)).alias("i1"), "verdict", "hits", "seen").join(of(0), "i0").join(of(1), "i1", "left")
    return apart.select(F.array_sort(F.filter(F.array("t0", "t1"), lambda x: x.isNotNull())).alias("items"), "verdict", "hits", "seen")


def index_of(mined: DataFrame, urls: DataFrame) -> DataFrame:
    """mined with token, the one of a rule's that the fewest of urls (items) hold; without rules that no url can fit."""
    keyed = mined.select("*", F.explode("items").alias("token"))
    held = urls.select(F.explode("items").alias("token")).join(keyed.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    index = keyed.join(held, "token").groupBy("items", "verdict", "hits", "seen").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.count("*").alias("found"))
    return index.where(F.col("found") == F.size("items")).drop("found")


def judge(pages: DataFrame, *, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict and mined (the tokens of the mined rule that decided, or null)."""
    parsed = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("fixed", fixed(F.col("host"), F.col("path"), rules))
    with_items = parsed.withColumn("items", tokens(F.col("url"), F.col("host"), F.col("path")))
    labelled = with_items.where("fixed is not null").select("items", F.col("fixed.verdict").alias("verdict"))
    if labelled.isEmpty():
        return parsed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("mined"))
    mined = cut(mine(labelled, support, confidence), "rules")

    urls = cut(with_items.where("fixed is null").select("url", "items").distinct(), "urls")
    index = index_of(mined, urls)
    met = urls.select("url", F.col("items").alias("have"), F.explode("items").alias("token")).join(index, "token").where(F.forall("items", lambda x: F.array_contains("have", x)))
    best = F.struct((-F.col("hits") / F.col("seen")).alias("c"), (-F.col("seen")).alias("n"), F.size("items").alias("k"), "verdict", F.array_join("items", " ").alias("items"))
    decided = met.groupBy("url").agg(F.min(best).alias("best")).select("url", F.col("best.verdict").alias("own"), F.col("best.items").alias("mined"))
    joined = parsed.join(decided, "url", "left")
    return joined.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", F.when(F.col("fixed").isNull(), F.col("own")), F.lit("allow")).alias("verdict"), F.when(F.col("fixed").isNull(), F.col("mined")).alias("mined"))
