"""URL filter by association rules.

A list of rules decides the urls it covers. Those urls, with their verdicts as labels,
are the transactions that FP-growth mines: combinations of url tokens that go with one
verdict. Rules with enough support and confidence, and better than any of their parts,
judge the other urls. They are found by an inverted index from each rule's rarest token.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.llm.common import durable, prepared, table

#: (verdict, host, path) of the list. Fixed values.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MIN_SUPPORT, MIN_CONFIDENCE, DEFAULT = 0.01, 0.8, "allow"
#: A combination has at least so many urls.
MIN_URLS = 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for a null or one without ``://``."""
    found = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(found > 0, F.substr(url, found + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: scheme, host parts, path parts by place, query keys.

    Digits of path parts are one token whatever their value.
    """
    scheme = F.when(F.instr(url, "://") > 0, F.concat(F.lit("s:"), F.lower(F.substring_index(url, "://", 1))))
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(
        F.filter(F.split(path, "/"), lambda x: x != ""),
        lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), F.regexp_replace(x, "[0-9]+", "#")),
    )
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(
        F.filter(F.split(query, "[&;]"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1))
    )
    return F.array_distinct(F.array_compact(F.concat(F.array(scheme), labels, parts, keys)))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules ``(antecedent, verdict, confidence, support)`` from ``labelled(tokens, verdict)``.

    Rare tokens are left out before mining; so at most 1 / ``min_support`` times the
    tokens of a url remain, which bounds what the driver gets. A rule stays if no part of
    it gives the same verdict with as much confidence; ties go to the smaller rule.

    FP-growth proposes the combinations. Of two tokens of which one never comes without
    the other, no rule that stays needs both: without the implied one it says the same.
    Such tokens form chains, and each url is dealt into baskets with one token of each of
    its chains. Every combination that matters is whole in one of them; so equal or
    nested urls of a thousand parts are a thousand small baskets, not 2^1000
    combinations, and nothing is cut. The baskets of a url may propose a combination more
    often than it is there: what is proposed is counted on the whole urls.
    """
    rows = labelled.where("verdict is not null")
    total = rows.count()
    schema = "antecedent array<string>, verdict string, confidence double, support double"
    if not total:
        return labelled.sparkSession.createDataFrame([], schema)
    least = max(MIN_URLS, min_support * total)
    often = rows.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= least)
    frequent = [r["token"] for r in often.orderBy("count", "token").collect()]
    if not frequent:
        return labelled.sparkSession.createDataFrame([], schema)
    kept = F.array_sort(F.array_intersect("tokens", F.array(*[F.lit(t) for t in frequent]).cast("array<string>")))
    # Equal baskets count together, and each keeps its urls by verdict.
    baskets = durable(
        rows.select(kept.alias("basket"), "verdict").where(F.size("basket") > 0).groupBy("basket", "verdict").agg(F.count("*").alias("n")).groupBy("basket")
        .agg(F.map_from_entries(F.collect_list(F.struct("verdict", "n"))).alias("urls"), F.sum("n").alias("n")),
        "url-baskets",
    )
    dealt = durable(small_baskets(baskets, chains(baskets, frequent)), "url-chains")
    size = dealt.count()
    mined = FPGrowth(itemsCol="items", minSupport=(math.ceil(least) - 0.5) / size, minConfidence=1.0).fit(dealt)
    proposed = durable(mined.freqItemsets.select(F.array_sort("items").alias("antecedent")), "url-sets")
    # Counted on whole urls, which each set meets through its rarest token.
    rank = F.create_map(*[F.lit(x) for pair in ((t, i) for i, t in enumerate(frequent)) for x in pair])
    rarest = F.array_min(F.transform("antecedent", lambda t: F.struct(F.element_at(rank, t).alias("r"), t.alias("t"))))["t"]
    counted = (
        baskets.select("basket", F.explode("basket").alias("token"), "urls").join(proposed.withColumn("token", rarest), "token")
        .where(F.size(F.array_except("antecedent", "basket")) == 0)
        .select("antecedent", F.explode("urls").alias("verdict", "n"))
        .groupBy("antecedent", "verdict").agg(F.sum("n").alias("n"))
    )
    of_all = F.sum("n").over(Window.partitionBy("antecedent"))
    rules = counted.withColumn("of_all", of_all).select(
        "antecedent", "verdict", (F.col("n") / F.col("of_all")).alias("confidence"), (F.col("n") / F.lit(total)).alias("support"), "n"
    ).where((F.col("n") >= least) & (F.col("confidence") >= min_confidence)).drop("n")
    rules = durable(rules, "url-rules")
    # A rule's parts share a token with it: an equi-join on tokens meets them all.
    a = rules.select(F.explode("antecedent").alias("t"), "antecedent", "verdict", "confidence")
    b = rules.select(F.col("antecedent")[0].alias("t"), F.col("antecedent").alias("part"), "verdict", F.col("confidence").alias("as_good"))
    beaten = (
        a.join(b, ["t", "verdict"])
        .where((F.size("part") < F.size("antecedent")) & (F.col("as_good") >= F.col("confidence")))
        .where(F.size(F.array_except("part", "antecedent")) == 0)
        .select("antecedent", "verdict").distinct()
    )
    return rules.join(beaten, ["antecedent", "verdict"], "left_anti").select("antecedent", "verdict", "confidence", "support")


def chains(baskets: DataFrame, frequent: list[str]) -> dict[str, int]:
    """The chain of every frequent token: of two tokens of a chain, the rarer implies the other.

    ``frequent`` is in order of how often tokens are there, rarest first. The driver gets
    the pairs of which one token implies the other.
    """
    tokens = baskets.select(F.explode("basket").alias("a"), "basket", "n")
    alone = tokens.groupBy("a").agg(F.sum("n").alias("n_a"))
    both = tokens.select("a", F.explode("basket").alias("b"), "n").where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    found = both.join(alone, "a").where("n = n_a").select("a", "b").toArrow().to_pydict()
    implied: dict[str, set[str]] = {}
    for a, b in zip(found["a"], found["b"]):
        implied.setdefault(a, set()).add(b)
    out, ends = {}, []
    for token in frequent:
        at = next((i for i, end in enumerate(ends) if token in implied.get(end, ())), len(ends))
        ends[at : at + 1] = [token]
        out[token] = at
    return out


def small_baskets(baskets: DataFrame, chain: dict[str, int]) -> DataFrame:
    """``items`` of all baskets with one token of each chain of a url, once for each url."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for basket, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_chain: dict[int, list[str]] = {}
                for token in basket:
                    by_chain.setdefault(chain[token], []).append(token)
                picks = itertools.product(*by_chain.values())
                while some := list(itertools.islice(picks, 1024)):
                    yield pa.RecordBatch.from_arrays([pa.array([list(x) for x in some]), pa.array([n] * len(some), pa.int64())], ["items", "n"])

    dealt = baskets.select("basket", "n").mapInArrow(deal, "items array<string>, n bigint")
    return dealt.select("items", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy")).drop("copy")


def judge(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``sets(tokens)`` with the ``verdict`` of the best rule that each holds, if any.

    Best is the most confident rule, then that of most support, then the longest.
    """
    support = rules.select(F.explode("antecedent").alias("token"), "support").groupBy("token").agg(F.max("support").alias("often"))
    index = (
        rules.select("*", F.explode("antecedent").alias("token")).join(support, "token")
        .groupBy("antecedent", "verdict", "confidence", "support")
        .agg(F.min_by("token", F.struct("often", "token")).alias("token"))
    )
    met = (
        sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
    )
    best = F.max(F.struct("confidence", "support", F.size("antecedent"), "antecedent", "verdict")).alias("best")
    return met.groupBy("tokens").agg(best).select("tokens", F.col("best.verdict").alias("verdict"))


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """``key, host, path, rule, verdict`` of every row: the list's verdict, else the method's.

    A null url has an empty host and path and gets the default verdict, as does a url
    that no mined rule fits. Equal urls are judged alike; other columns are not read.
    """
    prepared(pages.sparkSession)
    raw = F.col("url")
    host, path = host_and_path(raw)
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url")).select("key", "url", host.alias("host"), path.alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    rows = durable(rows.select("key", "host", "path", rule.alias("rule"), verdict.alias("listed"), tokens(raw, F.col("host"), F.col("path")).alias("tokens")), "urls")
    mined = durable(mine(rows.select("tokens", F.col("listed").alias("verdict"))), "mined-rules")
    # Tokens that no rule asks for are dropped, so few distinct sets are left to judge.
    asked = [r["t"] for r in mined.select(F.explode("antecedent").alias("t")).distinct().orderBy("t").collect()]
    kept = F.array_sort(F.array_intersect("tokens", F.array(*[F.lit(t) for t in asked]).cast("array<string>")))
    rows = rows.withColumn("kept", kept)
    sets = rows.where("listed is null").select(F.col("kept").alias("tokens")).distinct()
    judged = durable(judge(sets, mined), "judged")
    return rows.join(judged.withColumnRenamed("tokens", "kept"), "kept", "left").select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("listed", "verdict", F.lit(DEFAULT)).alias("verdict")
    )


def op4_url_rules(spark, sf_dir: str) -> DataFrame:
    """Host, path, list rule and verdict of every page's url."""
    return filter_urls(table(prepared(spark), sf_dir, "pages"))
