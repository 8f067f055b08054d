"""Registered queries against their SQL counterparts, and what their plans must not hold."""

import collections
import os

import pytest

import __spark_entry__ as entry_module

SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")

COMPARED = [
    "check_repetition", "check_sensitive", "sections", "finding_fields", "case_normalization", "tracked_pairs",
    "suppress_diagnostics", "resolve_anchors", "format_rules_images", "incremental_refresh", "llm_issues", "ingest_blocks",
    "deep_sections", "aligned_rewrites", "change_samples", "refreshed_totals", "learned_profile", "profile_scan", "stored_feedback", "check_rewrites", "check_case",
]


def test_every_statement_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@needs_data
@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"create view {file.split('.')[0]} as select * from '{SF_DIR}/{file}'")
    df = entry_module.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(r) for r in df.select(*columns).collect())
    result = connection.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in result.description]
    expected = collections.Counter(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert sum(got.values()) > 0
    assert got == expected


@needs_data
@pytest.mark.parametrize("name", ["check_repetition", "check_hygiene", "sections", "deprecated_ngrams", "finding_fields", "tracked_pairs", "resolve_feedback"])
def test_native_queries_run_no_python_and_no_cross_join(spark, name):
    plan = entry_module.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for operator in ("ArrowEvalPython", "MapInPandas", "PythonUDF", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


@needs_data
@pytest.mark.parametrize("name", ["ngram_counts", "deprecated_ngrams", "change_profile"])
def test_word_runs_are_counted_where_they_are_made(spark, name):
    plan = entry_module.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(phrase" not in plan
    assert not [line for line in plan.splitlines() if "Exchange" in line and "phrase#" in line]
