"""Every registered query against its SQL twin."""

import compare
import pytest

import __spark_entry__ as entry
from parley.operators import ordered
from parley.registry import core

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare.difference(spark, con, SF, QUERIES[name], ORACLES[name]) in (None, "both empty")
    else:
        assert QUERIES[name](spark, SF).count() > 0


# Queries whose scans cross slice borders, once more with slices of a few rows.
SLICED = [
    "sessions_at", "award_longest_monologue", "session_excerpt", "read_window", "check_time_order",
    "chunk_table", "build_chunks", "media_rows", "parse_messages", "assign_keys", "reload_existing",
]


@pytest.mark.parametrize("name", SLICED)
def test_small_slices(spark, con, name, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 7)
    monkeypatch.setattr(core, "_worlds", {})
    assert compare.difference(spark, con, SF, QUERIES[name], ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
