"""Registered queries, their SQL twins, and the stored tables they share."""

from functools import cached_property
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import media as M
from parley.operators import retrieval as R
from parley.operators.blocks import build_blocks
from parley.operators.ordered import block_of
from parley.operators.views import v_media, v_messages, v_searchable
from parley.plans import ingest
from parley.sources import adapters
from parley.sources.store import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The vocabularies of the scored moments for the given prose, which has no laugh words.
PROSE_WORDS = {"laugh": ["eau", "lich"], "heat": ["ing", "keit"], "apology": ["ción", "zube"], "reflective": ["tion", "ment"]}
PROSE_RULES = {
    "funny": {"messages": 5, "laughs": 1, "times_normal": 1.0},
    "argument": {"messages": 5, "people": (2, 5), "heat": 2, "apologies": 2},
    "deep": {"messages": 8, "people": 5, "wordiness": 1.0, "laugh_rate": 1.0},
    "late_night": 3,
}


def query(name: str, sql: str | None = None):
    """Register ``fn(world)`` under ``name`` with its SQL twin."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(world(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def fake_describe(pdf):
    """Stands for the model in the registered queries: names the kind, fails on documents."""
    import pandas as pd

    failed = pdf["kind"] == "document"
    return pd.DataFrame({
        "description": [None if bad else f"a {kind}" for kind, bad in zip(pdf["kind"], failed)],
        "transcript": None, "ocr_text": None, "detected_objects": [[k] for k in pdf["kind"]],
        "status": ["error" if bad else "done" for bad in failed],
        "error": ["model failed" if bad else None for bad in failed], "model_used": "fake",
    })


class World:
    """The stored tables derived from one data folder, each written on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return adapters.table(self.spark, self.dir, name)

    @cached_property
    def events(self) -> ingest.Tables:
        return ingest.load(adapters.events_as_messages(self.spark, self.dir), "events", gap_hours=1.0)

    @cached_property
    def chats(self) -> ingest.Tables:
        return ingest.load(adapters.conversations_as_messages(self.spark, self.dir), "chats")

    @cached_property
    def by_source(self) -> ingest.Tables:
        return ingest.load(adapters.documents_as_messages(self.spark, self.dir), "sources")

    @cached_property
    def by_lang(self) -> ingest.Tables:
        return ingest.load(adapters.documents_as_messages(self.spark, self.dir, "lang"), "langs")

    @cached_property
    def pages(self) -> ingest.Tables:
        return ingest.load(adapters.pages_as_messages(self.spark, self.dir), "pages")

    @cached_property
    def lines(self) -> DataFrame:
        """Transcript lines as they would lie in text files."""
        lines = adapters.export_lines(self.spark, self.dir)
        return materialise(lines.repartition("file", block_of("line_no")), "lines")

    @cached_property
    def files(self) -> DataFrame:
        """The catalogue is written down: scanning real files reads their bytes."""
        return materialise(M.catalog_columns(adapters.media_files(self.spark, self.dir)), "files")

    @cached_property
    def bare_media(self) -> DataFrame:
        return materialise(M.media_rows(self.events.messages, self.files), "bare-media")

    @cached_property
    def media_cache(self) -> DataFrame:
        """Contents described earlier: the smaller k of the signups."""
        text = F.lit(None).cast("string")
        return adapters.table(self.spark, self.dir, "events").where("event_type = 'signup'").selectExpr(
            f"{adapters._K} AS k").where("k < 30").distinct().select(
            F.sha2(F.concat(F.lit("signup "), F.col("k").cast("string")).cast("binary"), 256).alias("content_hash"),
            F.concat(F.lit("known "), F.col("k").cast("string")).alias("description"), text.alias("transcript"),
            F.concat(F.lit("text "), F.col("k").cast("string")).alias("ocr_text"),
            F.array(F.lit("seen")).alias("detected_objects"), F.lit("cache").alias("model_used"))

    @cached_property
    def media(self) -> DataFrame:
        described, _ = M.enrich_media(self.bare_media, self.media_cache, fake_describe)
        return materialise(described, "media")

    @cached_property
    def named_media(self) -> DataFrame:
        return v_media(self.media, self.events.messages, self.events.participants)

    @cached_property
    def content(self) -> DataFrame:
        """Searchable content of the events chats, attachments included."""
        return materialise(v_searchable(self.events.messages, self.events.participants, self.media), "content",
                           ["archive_id", "msg_id"])

    def content_of(self, tables: ingest.Tables) -> DataFrame:
        return v_searchable(tables.messages, tables.participants)

    def named(self, tables: ingest.Tables) -> DataFrame:
        return v_messages(tables.messages, tables.participants)

    @cached_property
    def chunks(self) -> DataFrame:
        return materialise(R.chunk_table(R.build_chunks(self.content)), "chunks", ["archive_id", "chunk_id"])

    @cached_property
    def doc_chunks(self) -> DataFrame:
        return materialise(R.chunk_table(R.build_chunks(self.content_of(self.by_source))), "doc-chunks")

    @cached_property
    def doc_spans(self) -> DataFrame:
        return materialise(R.chunk_spans(self.doc_chunks), "doc-spans", ["archive_id", "id_block"])

    @cached_property
    def docs(self) -> DataFrame:
        return self.table("documents").selectExpr("0 AS archive_id", "doc_id", "text AS content")

    @cached_property
    def postings(self) -> DataFrame:
        """Each file of the index keeps the rows of a term together, so a query reads few pages of it."""
        return materialise(R.build_postings(self.docs), "postings", ["term", "doc_id"])

    @cached_property
    def index_blocks(self) -> DataFrame:
        return materialise(build_blocks(self.docs), "index-blocks", ["archive_id", "term", "doc_block"])

    @cached_property
    def index_stats(self) -> DataFrame:
        return materialise(R.index_stats(self.docs), "index-stats")


_worlds: dict[tuple, World] = {}


def _signature(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and dates of the input files; changed input means new stored tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)))


def world(spark: SparkSession, sf_dir: str) -> World:
    sf_dir = str(sf_dir).rstrip("/")
    key = (spark.sparkContext.applicationId, sf_dir, _signature(spark, sf_dir))
    if key not in _worlds:
        _worlds[key] = World(spark, sf_dir)
    found = _worlds[key]
    found.spark.conf.set("spark.sql.session.timeZone", "UTC")
    return found
