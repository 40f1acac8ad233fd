"""Joins that stay spread out when a single key holds a large share of the rows.

Adaptive execution splits a hot partition only where both join sides are plain shuffles; a
side that was just aggregated on the join key is not. These helpers salt instead. Salts are
hashes of row values, so a retried task puts every row where it was before.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.sources.store import ensure_checkpoint_dir

SALTS = 32
HEAVY_ROWS = 1_000_000
MAX_HEAVY_KEYS = 10_000
# Rows of ids and scores, some 100 bytes each.
BROADCAST_ROWS = 200_000
# Bytes of rows a task gets where rows are sorted or handed to Python, and what a row takes besides its texts.
TASK_BYTES = 8 << 20
ROW_BYTES = 128


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow result that usually is tiny (search hits, chosen sessions), written down and counted.

    Up to ``max_rows`` rows it is marked for broadcast, so that finding its details in a huge
    table needs no shuffle of that table; beyond, it joins like any other.
    """
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint()
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def parts_of(df: DataFrame, *texts: str) -> int:
    """How many parts of ``TASK_BYTES`` the rows of ``df`` and their ``texts`` fill. ``df`` is read for it: it should be stored."""
    size = F.lit(ROW_BYTES).cast("long")
    for text in texts:
        size = size + F.coalesce(F.octet_length(text), F.lit(0))
    total = df.agg(F.sum(size)).first()[0] or 0
    return max(1, -(-total // TASK_BYTES))


def spread(df: DataFrame, keys: list[str], *texts: str) -> DataFrame:
    """``df`` shuffled by ``keys`` into ``parts_of`` parts.

    Adaptive execution merges the parts of its own shuffles up to a compressed size, and what a task sorts grows with the
    data; a number that is named stays.
    """
    return df.repartition(parts_of(df, *texts), *keys)


def spread_join(left: DataFrame, small: DataFrame, on: list[str], spread: list[str], how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Join a side with one row per ``on`` key: each of its rows is copied to every salt."""
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def skew_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner",
              heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Join (inner, left, left_semi, left_anti) that salts only the heavy keys of ``left``.

    The heavy keys are counted first. Usually there is none and the join is plain. The salt
    table that gets broadcast holds at most MAX_HEAVY_KEYS keys, the heaviest ones; all
    other keys are joined as they are.
    """
    heavy = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy_rows)
    if heavy.isEmpty():
        return left.join(right, on, how)
    salts = (
        heavy.orderBy(F.desc("_n"), *on).limit(MAX_HEAVY_KEYS)
        .select(*on, F.ceil(F.col("_n") / heavy_rows).cast("long").alias("_salts"))
    )
    n = F.coalesce("_salts", F.lit(1).cast("long"))
    salted = left.join(F.broadcast(salts), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), n)).drop("_salts")
    copies = right.join(F.broadcast(salts), on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("_salts")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
