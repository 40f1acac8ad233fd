"""Ordered scans that never put a whole archive into one task.

A chat is one long ordered stream, and one chat may hold a large share of all rows.
``Window.partitionBy("archive_id")`` would sort that chat in a single task, so every scan
here is cut into *slices*: consecutive intervals of the order, each of a bounded number of
rows. Rows are shuffled once, by (archive, slice). Only one small row per slice crosses the
slice borders: the last row (for lag) or the totals (for running counts).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.sources.store import ensure_checkpoint_dir

HOUR_MICROS = 3_600_000_000
# Rows a time slice may hold before its hour is cut into finer pieces.
SLICE_ROWS = 1_000_000
# Rows per slice when a dense message id already exists.
BLOCK_ROWS = 1 << 18


def micros(col) -> Column:
    """Microseconds of a zone-less timestamp (the session runs in UTC)."""
    return F.unix_micros(F.col(col).cast("timestamp") if isinstance(col, str) else col.cast("timestamp"))


def block_of(col: str) -> Column:
    """Slice number of a dense id or line number."""
    return F.floor(F.col(col) / F.lit(BLOCK_ROWS)).cast("long")


def with_time_slices(df: DataFrame, part: list[str], ts: str = "ts", line: str = "line_no",
                     rows: int = SLICE_ROWS) -> tuple[DataFrame, list[str], bool]:
    """Add slice columns that follow the (ts, line) order.

    A slice is one hour of one archive. Hours above ``rows`` messages are cut further at
    approximate quantiles of the position inside the hour; the cut points only steer the
    layout, the order itself stays exact. The hot hours are counted first: without any,
    nothing is joined; a few are broadcast; many are joined by key. Also returns the slice
    keys and whether any hour was cut.
    """
    hour = F.floor(micros(ts) / F.lit(HOUR_MICROS)).cast("long")
    keyed = df.withColumn("_hour", hour)
    keys = [*part, "_hour"]
    hot = (
        keyed.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(line).alias("_lo"), F.max(line).alias("_hi"))
        .where(F.col("_n") > rows)
    )
    n_hot = hot.count()
    if n_hot == 0:
        return keyed.withColumn("_piece", F.lit(0)), [*part, "_hour", "_piece"], False

    ensure_checkpoint_dir(df.sparkSession)
    steps = 1000
    fractions = [i / steps for i in range(1, steps)]
    inside = (micros(ts) - F.col("_hour") * F.lit(HOUR_MICROS)).cast("double")
    position = inside + (F.col(line) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1).cast("double")
    few = n_hot <= 1000
    bounds = hot.checkpoint()
    # The quantiles may differ between two evaluations, so they are written down once.
    cuts = (
        keyed.select(*keys, ts, line)
        .join(F.broadcast(bounds) if few else bounds, keys)
        .groupBy(*keys)
        .agg(F.percentile_approx(position, fractions).alias("_cuts"),
             F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
        .checkpoint()
    )
    joined = keyed.join(F.broadcast(cuts) if few else cuts, keys, "left")
    piece = F.coalesce(F.size(F.filter("_cuts", lambda c: c < position)), F.lit(0))
    piece = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(piece)
    return (
        joined.withColumn("_piece", piece).drop("_cuts", "_lo", "_hi"),
        [*part, "_hour", "_piece"],
        True,
    )


def _orders(order: list[str]) -> list[Column]:
    return [F.col(c) for c in order]


def lag_across(df: DataFrame, part: list[str], slices: list[str], order: list[str],
               cols: dict[str, str]) -> DataFrame:
    """``lag`` over the whole part: ``cols`` maps a new column to its source column."""
    keys = [*part, *slices]
    within = Window.partitionBy(*keys).orderBy(*_orders(order))
    local = df.withColumn("_rn", F.row_number().over(within))
    for new, src in cols.items():
        local = local.withColumn(new, F.lag(src).over(within))
    last = df.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(s).alias(n) for n, s in cols.items()]),
                 F.struct(*_orders(order))).alias("_last")
    )
    between = Window.partitionBy(*part).orderBy(*slices)
    edges = last.withColumn("_carry", F.lag("_last").over(between)).drop("_last")
    out = local.join(edges, keys)
    for new in cols:
        out = out.withColumn(new, F.when(F.col("_rn") == 1, F.col(f"_carry.{new}"))
                             .otherwise(F.col(new)))
    return out.drop("_rn", "_carry")


def count_across(df: DataFrame, part: list[str], slices: list[str], order: list[str],
                 flags: dict[str, Column]) -> DataFrame:
    """Running count, current row included: ``flags`` maps a new column to a 0/1 column."""
    keys = [*part, *slices]
    within = (Window.partitionBy(*keys).orderBy(*_orders(order))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = df
    for new, flag in flags.items():
        local = local.withColumn(new, F.sum(flag.cast("long")).over(within))
    totals = df.groupBy(*keys).agg(
        *[F.sum(flag.cast("long")).alias(f"_t_{new}") for new, flag in flags.items()]
    )
    before = (Window.partitionBy(*part).orderBy(*slices)
              .rowsBetween(Window.unboundedPreceding, -1))
    edges = totals.select(
        *keys, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in flags]
    )
    out = local.join(edges, keys)
    for new in flags:
        out = out.withColumn(new, F.col(new) + F.col(f"_b_{new}")).drop(f"_b_{new}")
    return out


def totals_across(df: DataFrame, part: list[str], slices: list[str], totals: dict[str, tuple]) -> DataFrame:
    """Add totals of the whole part to every row; ``totals`` maps a column to
    (aggregate over rows, window function that merges the slices)."""
    keys = [*part, *slices]
    whole = Window.partitionBy(*part)
    edges = df.groupBy(*keys).agg(*[rows.alias(f"_t_{n}") for n, (rows, _) in totals.items()])
    merged = edges.select(*keys, *[merge(f"_t_{n}").over(whole).alias(n) for n, (_, merge) in totals.items()])
    return df.join(merged, keys)


def dense_ids(df: DataFrame, part: list[str], slices: list[str], order: list[str],
              name: str) -> DataFrame:
    """Number the rows of every part 0, 1, 2 ... in ``order``."""
    counted = count_across(df, part, slices, order, {name: F.lit(1)})
    return counted.withColumn(name, F.col(name) - 1)
