"""Sources mixed to target weights over a domain-language-source tree, in SQL expressions only.

A budget of tokens flows down the tree by weight. What a node can't use goes to its siblings in proportion to their
weights, and only what all of them together can't use is left to the level above, since a node's capacity is the sum of its
leaves' (their tokens times the epochs allowed). A leaf takes whole epochs of its documents and a prefix of one more, in
an order seeded by the epoch. Whole numbers throughout, so the same rows come out everywhere.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.skew import BROADCAST_ROWS, skew_join
from parley.sources.store import materialise

WORD = r"[^\x20\x09-\x0D]+"
_LEVELS = ("domain", "lang", "source")


def count_tokens(text: Column) -> Column:
    """Words of the whole text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weight_of(key: Column, weights: Mapping[str, int]) -> Column:
    """The weight a setting gives to a name; names it doesn't list weigh 1."""
    out = F.lit(1)
    for name, weight in sorted(weights.items()):
        out = F.when(key == name, int(weight)).otherwise(out)
    return out.cast("long")


def domain_of(source: Column, domains: Mapping[str, str], other: str = "other") -> Column:
    """The domain a setting gives to a source."""
    out = F.lit(other)
    for name, domain in sorted(domains.items()):
        out = F.when(source == name, domain).otherwise(out)
    return out


def _share(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``budget`` of each child from its parent's ``total``: by weight, no more than ``cap``, shortages to the siblings.

    Children that need less than their share, tried from the least capacity for their weight, are filled first; the others divide
    what is left by weight, rounded down.
    """
    big = "decimal(38,0)"
    before = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*parents)
    zero = F.lit(0).cast("long")
    rows = children.where("weight > 0 and cap > 0").select(
        "*", F.coalesce(F.sum("cap").over(before), zero).alias("used"),
        (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), zero)).alias("open"))
    fits = F.col("cap").cast(big) * F.col("open") <= F.col("weight").cast(big) * F.greatest(F.col("total") - F.col("used"), zero)
    rows = rows.withColumn("full", fits).select(
        "*", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(zero)).over(all_).alias("filled"),
        F.sum(F.when(F.col("full"), zero).otherwise(F.col("weight"))).over(all_).alias("sharing"))
    part = F.expr("CAST((CAST(weight AS DECIMAL(20,0)) * CAST(total - filled AS DECIMAL(18,0))) DIV nullif(sharing, 0) AS BIGINT)")
    return rows.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.greatest(part, zero))).drop(
        "used", "open", "full", "filled", "sharing", "total")


def budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], budget: int, epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) of each leaf from its ``tokens``, the total budget and the epochs allowed.

    A weight below 1 takes a branch out. The tree is as wide as there are different names, not as long as the table.
    """
    caps = leaves.withColumn("cap", F.col("tokens") * epochs)
    for level in _LEVELS:
        caps = caps.withColumn(f"w_{level}", weight_of(F.col(level), weights.get(level, {})))
    caps = caps.where("w_domain > 0 and w_lang > 0 and w_source > 0")
    given, path = None, []
    for level in _LEVELS:
        path = [*path, level]
        children = caps.groupBy(*path).agg(F.sum("cap").alias("cap"), F.max(f"w_{level}").alias("weight"))
        if given is None:
            top = children.withColumn("root", F.lit(0)).withColumn("total", F.lit(int(budget)).cast("long"))
            given = _share(top, ["root"], level).select(*path, "budget")
        else:
            down = children.join(given.withColumnRenamed("budget", "total"), path[:-1])
            given = _share(down, path[:-1], level).select(*path, "budget")
    return leaves.join(given, list(_LEVELS))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in an epoch: the MD5 of seed, epoch and doc_id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def by_leaf(rows: DataFrame, leaves: DataFrame, spread: str, on: Sequence[str] = _LEVELS, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` joined to a stored table with one row for each leaf, that is domain, lang and source.

    Up to a counted ``most`` leaves travel to the rows, which stay where they are; beyond, only a leaf of more than a million rows
    is salted, by ``spread``. No leaf is gathered in one task either way.
    """
    if leaves.count() <= most:
        return rows.join(F.broadcast(leaves), list(on))
    return skew_join(rows, leaves, list(on), [spread])


def cutoffs(counted: DataFrame, shared: DataFrame, seed: int) -> DataFrame:
    """(domain, lang, source, whole, cut): whole epochs of each leaf, and the last key of the one begun.

    Keys are cut into 4,096 slices whose token sums locate the slice where the prefix ends; only that slice is gone
    through row by row, with the sum of each different key, so a leaf of any size is never ordered in one place. Equal keys go in or stay out together.
    """
    leaf = list(_LEVELS)
    need = materialise(shared.where("tokens > 0").select(
        *leaf, F.expr("budget DIV tokens").alias("whole"), F.expr("budget - (budget DIV tokens) * tokens").alias("left_over")), "need")
    keyed = by_leaf(counted, need, "doc_id").select(*leaf, "whole", "left_over", "n_tokens", order_key(seed, F.col("whole"), F.col("doc_id")).alias("key"))
    keyed = keyed.withColumn("slice", F.substring("key", 1, 3))
    upto = Window.partitionBy(*leaf).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = keyed.groupBy(*leaf, "slice").agg(F.sum("n_tokens").alias("n"), F.first("left_over").alias("left_over")).select(
        "*", F.sum("n").over(upto).alias("upto"))
    edge = materialise(sums.where("upto > left_over").groupBy(*leaf).agg(
        F.min(F.struct("slice", (F.col("upto") - F.col("n")).alias("before"))).alias("e")).select(
        *leaf, F.col("e.slice").alias("edge"), "e.before"), "edges")
    running = Window.partitionBy(*leaf).orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = by_leaf(keyed, edge, "key").where("slice = edge").groupBy(*leaf, "key").agg(
        F.sum("n_tokens").alias("n"), F.first("before").alias("before"), F.first("left_over").alias("left_over"))
    last = inside.withColumn("run", F.col("before") + F.sum("n").over(running)).where("run <= left_over").groupBy(*leaf).agg(F.max("key").alias("last"))
    return need.join(edge, leaf, "left").join(last, leaf, "left").select(
        *leaf, "whole", F.when(F.col("left_over") > 0, F.coalesce("last", "edge")).otherwise("").alias("cut"))


def leaf_of(domains: Mapping[str, str]) -> list[Column]:
    """Domain, lang and source of a document, nulls as empty names."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source"))
    return [domain_of(source, domains).alias("domain"), lang.alias("lang"), source.alias("source")]


def plan(documents: DataFrame, domains: Mapping[str, str], weights: Mapping[str, Mapping[str, int]], share: float, epochs: int, seed: int) -> DataFrame:
    """The cutoffs of each leaf, for a budget of ``share`` of all tokens."""
    counted = materialise(documents.select("doc_id", *leaf_of(domains), count_tokens(F.col("text").cast("string")).alias("n_tokens")), "counted")
    leaves = materialise(counted.groupBy(*_LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    budget = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * share)
    shared = materialise(budgets(leaves, weights, budget, epochs), "budgets")
    return cutoffs(counted, shared, seed)


def mix(documents: DataFrame, domains: Mapping[str, str], weights: Mapping[str, Mapping[str, int]], share: float = 1.0, epochs: int = 2,
        seed: int = 7) -> DataFrame:
    """``documents`` with ``mix_domain``, ``mix_epoch``: a row for each epoch that takes a document.

    Tokens are words of the whole text. A null lang or source is the leaf of the empty name, a null text has no
    tokens, and a leaf without any gives no rows; rows that repeat a doc_id go in or stay out together. An empty table gives no rows.
    All other columns pass unchanged, whatever their names; only columns called mix_domain or mix_epoch give way to the new ones.
    Only the leaves' cutoffs travel: the texts stay where they are.
    """
    mark = "mix"
    while any(c.lower().startswith(f"{mark}_") for c in documents.columns):
        mark += "_"
    names = [f"{mark}_{n}" for n in (*_LEVELS, "whole", "cut", "epoch")]
    domain, lang, source, whole, last, epoch = names
    cut = materialise(plan(documents, domains, weights, share, epochs, seed).toDF(domain, lang, source, whole, last), "cuts")
    rows = documents.select("*", *(c.alias(n) for c, n in zip(leaf_of(domains), names)))
    rows = by_leaf(rows, cut, "doc_id", on=[domain, lang, source])
    times = F.col(whole) + (order_key(seed, F.col(whole), F.col("doc_id")) <= F.col(last)).cast("long")
    rows = rows.withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(times, F.lit(1)) - 1))).where(times > 0)
    kept = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in ("mix_domain", "mix_epoch")]
    return rows.select(*kept, F.col(domain).alias("mix_domain"), F.col(epoch).alias("mix_epoch"))
