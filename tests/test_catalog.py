"""Every query against its DuckDB twin, over whole tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, values
from taskloom.plans.catalog import QUERIES, UNCHECKED
from taskloom.plans.oracle import ORACLE

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(QUERIES) - UNCHECKED == set(ORACLE)
    assert QUERIES.items() <= queries().items() and ORACLE.items() <= oracle_sql().items()


@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, db, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), db.sql(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert len(got) > 0
    assert values(got, columns) == values(want, columns)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["id", "type_id", "sample_idx", "corpus_id", "prompt", "request_id"]
    assert df.count() == 120


# No check may pass because a branch never occurs.
BRANCHES = {
    "rule_filter": ("status", {"kept", "no_hint"}),
    "expand_funnel": ("status", {"kept", "empty"}),
    "execute_instrumented": ("output_matched", {True, False}),
    "pair_stats": ("route", {"2", "4", "5", "fallback", "skipped"}),
    "story_fields": ("story_origin", {"refined", "draft", None}),
    "run_funnel": ("run_status", {"done", "no_code", "fail", "success", "mismatch"}),
    "trace_join_funnel": ("trace_status", {"bad_story", "no_trace", "no_code", "matched"}),
    "taxonomy_valid": ("taxonomy_status", {"new", "bad_level1", "mismatch", "valid"}),
    "step_check": ("step_status", {"ok", "gap", "wrong_count"}),
    "parse_json_last_block": ("origin", {"whole", "block", "none"}),
    "code_join": ("code_status", {"no_code", "ready"}),
    "hint_vs_model": ("outcome", {"agreed", "dropped", "added"}),
    "trace_budget": ("over_budget", {True, False}),
    "instrument_readonly": ("read_only", {True, False}),
    "trace_plan_parity": ("plan_matches", {True, False}),
    "input_preserved": ("preserved", {True, False}),
    "length_gate": ("sendable", {True, False}),
    "test_suite_mix": ("mix_ok", {True, False}),
}


@pytest.mark.parametrize("name", list(BRANCHES))
def test_branches_occur(spark, name):
    column, expected = BRANCHES[name]
    found = {r[0] for r in QUERIES[name](spark, "/root/testdata/sf0.01").select(column).distinct().collect()}
    assert expected <= found
