"""The stages one after the other, and the registered statements against DuckDB."""

import collections
import os

import pytest

import corpus_pipeline
from redpen.llm import decontaminate, oracles, queries
from redpen.llm.common import table, written
from tests.llm.test_free import brute_components


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), "stage")
        seen[name] = (before, docs)
        if name != "token files":
            assert docs.columns == columns
    before, after = seen["near copies"]
    components = brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert {r.doc_id for r in after.collect()} == {comp for _, comp in components.values()}
    assert decontaminate.overlaps(seen["decontamination"][1], table(spark, sf_dir, "benchmark")).count() == 0
    assert seen["token files"][1].count() == seen["mixing"][1].count() > 0
    assert seen["toxicity"][1].count() <= seen["toxicity"][0].count()


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    connection = duckdb.connect()
    for file in os.listdir(sf_dir):
        connection.execute(f"create view {file.split('.')[0]} as select * from '{sf_dir}/{file}'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(r) for r in df.select(*columns).collect())
    result = connection.execute(oracles.ORACLES[name])
    names = [d[0] for d in result.description]
    assert got == collections.Counter(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())


def test_a_worker_lets_go_of_what_an_earlier_operation_held(monkeypatch):
    import sys

    import public_tokenizers

    from redpen.llm import token_files
    from redpen.llm.common import of_worker

    monkeypatch.setitem(sys.__dict__, "_redpen_held", {})
    of_worker(("decoder", "a"), lambda: object())
    encoder = token_files._encoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    assert list(sys.__dict__["_redpen_held"].values()) == [encoder]
    assert token_files._encoder(public_tokenizers.path("word_bpe_49k.json"), 2) is encoder
