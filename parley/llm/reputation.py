"""URL rules and host reputation, in SQL expressions only.

Labelled pages give each host, registered domain and suffix a count of good outcomes. A host's rate is drawn towards its domain's, the
domain's towards its suffix's, the suffix's towards the whole, each by a beta prior whose weight is estimated from the
spread of the rates on that level. A page without a rule is blocked if even the upper bound of its host's rate is too low.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.sources.store import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    authority = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(authority) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(authority, _UPPER, _LOWER), path


def matched(rules: Sequence[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls. Rules are settings: the expression grows with their number."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host))):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text, verdict = F.when(fits, rule.host + rule.path).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _strength(level: DataFrame) -> DataFrame:
    """One row: the weight of the prior by moments, from n, s and the parent's rate ``m``; between 2 and 1000."""
    rate, spread = F.col("s") / F.col("n"), F.col("m") * (1 - F.col("m"))
    sums = level.where("n > 0").agg(
        F.sum(F.col("n") * (rate - F.col("m")) * (rate - F.col("m"))).alias("between"), F.sum(spread).alias("within"),
        F.avg(spread).alias("base"), F.sum("n").cast("double").alias("total"), F.sum(F.col("n") * F.col("n")).cast("double").alias("squares"))
    tau = (F.col("between") - F.col("within")) / F.nullif(F.col("total") - F.col("squares") / F.col("total"), F.lit(0.0))
    weight = F.when(tau > 0, F.col("base") / tau - 1).otherwise(1000.0)
    return sums.select(F.least(F.lit(1000.0), F.greatest(F.lit(2.0), F.coalesce(weight, F.lit(1000.0)))).alias("k"))


def reputations(hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, rate, upper) from (host, n, s): labelled pages and good ones among them, n = 0 for hosts without any."""
    parts = F.split("host", r"\.")
    known = materialise(hosts.select(
        "host", F.element_at(parts, -1).alias("suffix"),
        F.when(F.size(parts) > 1, F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(F.col("host")).alias("domain"),
        F.col("n").cast("long").alias("n"), F.col("s").cast("long").alias("s")), "hosts")
    whole = known.agg(((F.coalesce(F.sum("s"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m"))
    parent, chain = None, None
    for key in ("suffix", "domain", "host"):
        keep = {"suffix": ["suffix"], "domain": ["domain", "suffix"], "host": ["host", "domain"]}[key]
        level = known.groupBy(*keep).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        level = level.withColumn("m", whole.scalar()) if parent is None else level.join(chain, parent)
        level = materialise(level, key)
        weight = level.withColumn("k", _strength(level).scalar())
        rate = (F.col("s") + F.col("k") * F.col("m")) / (F.col("n") + F.col("k"))
        if key == "host":
            held = weight.select("host", "n", rate.alias("rate"), (F.col("n") + F.col("k")).alias("seen"))
            return held.select("host", "n", "rate", (F.col("rate") + z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("seen") + 1))).alias("upper"))
        chain, parent = weight.select(key, rate.alias("m")), key
    raise AssertionError


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[UrlRule], least: float = 0.75, z: float = 1.645) -> DataFrame:
    """(page_id, host, path, rule, verdict, upper) of every page.

    ``outcomes`` (page_id, good 0 or 1; nulls say nothing) may hold several rows a page. Without a rule a page is blocked if
    the upper bound of its host's rate of good pages is below ``least``, so a host that is hardly known is allowed.
    A null or malformed url has the empty host, which has a reputation like any other. Repeated rows are judged alike.
    """
    host, path = host_path(F.col("url").cast("string"))
    parsed = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    good = outcomes.where("good is not null").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("s"))
    hosts = parsed.select("page_id", "host").join(good, "page_id", "left").groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0)).alias("s"))
    known = materialise(reputations(hosts, z).select("host", "upper"), "reputation")
    text, verdict = matched(rules, F.col("host"), F.col("path"))
    own = F.when(F.col("upper") < least, "block").otherwise("allow")
    return parsed.join(known, "host", "left").select(
        "page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "upper")
