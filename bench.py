"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_QUERIES=all times every
registered query instead. Loading (parse, key, enrich, write) is timed on its own, as
``load_*``: reports read the stored tables. A query's time is the better of two runs.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = """
parse_messages parse_report merge_exports merge_counts resolve_participants sessionize sessions_at
leaderboard activity_heatmap timeline response_matrix top_words longest_streaks longest_silences overview dashboard
session_stats moments_funny moments_argument moments_deep session_excerpt award_fastest_replier award_longest_monologue
superlatives insights_report build_chunks chunk_table build_postings bm25_search keyword_like_search vector_search
rrf_fuse read_window get_context run_sql resolve_attachments media_rows pending_work reconcile doctor
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("parley-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from parley.registry import QUERIES
    from parley.registry.core import world

    def timed(fn) -> float:
        start = time.perf_counter()
        fn()
        return time.perf_counter() - start

    times = {}
    stored = world(spark, sf_dir)
    for name in ("events", "chats", "by_source", "by_lang", "lines", "media", "content", "chunks", "doc_chunks", "postings"):
        times[f"load_{name}"] = round(timed(lambda: getattr(stored, name)), 3)

    names = list(QUERIES) if os.environ.get("BENCH_QUERIES") == "all" else HEADLINE
    for name in names:
        run = lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # noqa: E731, B023
        times[name] = round(min(timed(run), timed(run)), 3)
    print(json.dumps({
        "metric": "total wall time of loading and headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cores": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
