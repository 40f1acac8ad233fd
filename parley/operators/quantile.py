"""Exact medians without gathering a group in one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_median(df: DataFrame, keys: list[str], value: str, out: str,
                 bin_width: float = 1.0, weight: str | None = None) -> DataFrame:
    """Median of a non-negative ``value`` per key, the mean of the middle two if even.

    Equal values collapse into (value, count) first. A histogram of ``bin_width`` then
    names the one or two bins that hold the middle ranks, and only the distinct values of
    those bins are ranked. Reply gaps never exceed the session threshold, so the number of
    bins per key is bounded by that threshold and a bin by its distinct microseconds.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    values = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.floor(F.col(value) / F.lit(bin_width)).alias("_bin"), F.col(value).alias("_v"))
        .agg(n.alias("_n"))
    )
    by_bin = Window.partitionBy(*keys).orderBy("_bin")
    upto = by_bin.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = (
        values.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bn"))
        .withColumn("_end", F.sum("_bn").over(upto))
        .withColumn("_total", F.sum("_bn").over(Window.partitionBy(*keys)))
        .withColumn("_lo", F.floor((F.col("_total") - 1) / 2))
        .withColumn("_hi", F.floor(F.col("_total") / 2))
        .where((F.col("_end") > F.col("_lo")) & (F.col("_end") - F.col("_bn") <= F.col("_hi")))
        .select(*keys, "_bin", (F.col("_end") - F.col("_bn")).alias("_before"), "_lo", "_hi")
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = (
        values.join(bins, [*keys, "_bin"])
        .withColumn("_to", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_from", F.col("_to") - F.col("_n"))
    )

    def at(rank):
        holds = (F.col("_from") <= F.col(rank)) & (F.col(rank) < F.col("_to"))
        return F.max(F.when(holds, F.col("_v")))

    return (
        ranked.groupBy(*keys).agg(at("_lo").alias("_a"), at("_hi").alias("_b"))
        .select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * 0.5).alias(out))
    )
