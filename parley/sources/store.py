"""Where derived tables live.

Derived tables are written once as Parquet into the shared folder the cluster names in
``spark.checkpoint.dir``; a lost executor then rereads files instead of lineage.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; on a local master an unset one falls back to a temp folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            named = known
        elif spark.sparkContext.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="parley-")
            spark.sparkContext.setCheckpointDir(named)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return named.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, sort: list[str] | None = None) -> DataFrame:
    """Write once, read back columnar. Sorting inside files keeps min/max pruning useful."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows that one task sorts and writes.
TASK_ROWS = 250_000


def write_messages(df: DataFrame, path: str, mode: str = "errorifexists",
                   rows_per_file: int = 5_000_000) -> None:
    """Store a table with one partition folder per archive.

    Ranges of message ids spread a big archive over many tasks; a small one stays in one file. There are as many parts as ranges,
    so that a task sorts a few ranges however large the table is.
    """
    rows = min(rows_per_file, TASK_ROWS)
    piece = F.floor(F.col("msg_id") / rows).cast("long")
    parts = df.select("archive_id", piece.alias("piece")).distinct().count()
    spread = df.repartition(max(1, 2 * parts), F.col("archive_id"), piece)
    (
        spread.sortWithinPartitions("archive_id", "msg_id")
        .write.mode(mode)
        .option("maxRecordsPerFile", rows_per_file)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("archive_id")
        .parquet(path)
    )


def read_messages(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def replace_archive(df: DataFrame, path: str) -> None:
    """Overwrite only the archives present in ``df``; all others keep their files."""
    write_messages(df, path, mode="overwrite")


def upsert_latest(existing: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Key/value tables: the row with the highest version per key survives."""
    both = existing.unionByName(updates)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")


def ingest_record(counts: DataFrame, media: DataFrame, file: str, mode: str) -> DataFrame:
    """One log row per archive of a load; ``counts`` comes from ``merge_counts``."""
    rows = media.groupBy("archive_id").agg(F.count(F.lit(1)).alias("media_added"))
    return counts.join(rows, "archive_id", "left").fillna(0, ["media_added"]).select(
        "archive_id", F.lit(file).alias("filename"), F.lit(mode).alias("mode"),
        F.col("added").alias("messages_added"), F.col("skipped").alias("messages_skipped"), "media_added")


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def list_archives(messages: DataFrame) -> DataFrame:
    """Archives with size and last activity, newest first."""
    per_person = messages.groupBy("archive_id", "participant_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    found = per_person.groupBy("archive_id").agg(
        F.sum("n").alias("messages"), F.count("participant_id").alias("people"),
        F.min("first").alias("first_message"), F.max("last").alias("last_message"))
    return found.orderBy(F.desc("last_message"), "archive_id")


def archive_counts(**tables: DataFrame) -> DataFrame:
    """Rows of every given table per archive."""
    out = None
    for name, df in tables.items():
        n = df.groupBy("archive_id").agg(F.count(F.lit(1)).alias(name))
        out = n if out is None else out.join(n, "archive_id", "full")
    return out.fillna(0, list(tables))
