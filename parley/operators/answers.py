"""Answers of a model that costs money: asked once, stored as they come, not asked again by a rerun."""

import math
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.sources.store import materialise, new_table_path

#: Rows that are asked before their answers are committed.
ROUND_ROWS = 100_000


def remember(work: DataFrame, key: str, ask: Callable[[DataFrame], DataFrame], path: str | None = None,
             round_rows: int = ROUND_ROWS) -> DataFrame:
    """The answer to every row of ``work``, which holds each ``key`` once, read back from the folder ``path``.

    ``ask`` maps rows to (key, ..., error). Answers are appended in rounds of about ``round_rows`` rows, each a job of
    its own: a run that breaks off loses one round, and the next one with the same ``path`` asks only what has no
    answer without error there. Without ``path`` a new folder is taken.
    """
    spark = work.sparkSession
    path = path or new_table_path(spark, "answers")
    work = materialise(work, "to-ask")
    schema = ask(work.limit(0)).schema
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    known = spark.read.schema(schema).parquet(path).where("error IS NULL").select(key)
    left = materialise(work.join(known, key, "left_anti"), "to-ask")
    rounds = max(1, math.ceil(left.count() / round_rows))
    for n in range(rounds):
        ask(left.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == n)).write.mode("append").parquet(path)
    told = spark.read.schema(schema).parquet(path).join(work.select(key), key, "left_semi")
    rest = [c for c in schema.names if c != key]
    # an answer beats the errors of earlier runs
    return told.groupBy(key).agg(F.min_by(F.struct(*rest), F.col("error").isNotNull()).alias("_told")).select(key, "_told.*")
