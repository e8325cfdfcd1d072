"""What keeps the graph queries' work in proportion to their tables: plans, and pieces of what was one row or one task."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigraph.operators import context, evidence, paths, snapshots
from evigraph.plans import queries
from evigraph.sources import shared
from evigraph.sources.projection import PROFILE, trade_graph

DATA = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sources_are_attached_where_triples_lie_and_are_those_of_the_long_form(spark):
    g = trade_graph(spark, DATA)
    x = evidence.attach_sources(evidence.triples_of(g), g)
    names = ("triple_id", "source_id", "source_name", "source_type")
    assert "hashpartitioning(triple_id" not in _plan(x)
    assert sorted(map(tuple, x.select(*names).collect())) == sorted(map(tuple, evidence.attach_sources(g.triples, g).select(*names).collect()))
    for name in ("evidence_by_head", "endpoint_enrich", "context_markdown", "items_nested", "plain_listing"):
        assert "hashpartitioning(triple_id" not in _plan(queries.QUERIES[name](spark, DATA))


def test_names_are_attached_without_sorting_triples(spark):
    for name in ("endpoint_enrich", "copies_differ"):
        assert "SortMergeJoin" not in _plan(queries.QUERIES[name](spark, DATA))


def test_only_what_a_bucket_shows_is_named(spark):
    plan = _plan(queries.bucket_topk(spark, DATA))
    assert plan.index("Join [tail_id") < plan.index("Window ")  # a plan is printed from its end


def test_one_way_groups_are_not_looked_at_row_by_row(monkeypatch):
    rows = [(f"s{i:03}", "e", 1, 0, [f"s{i:03}", "e"], ["t"], "t") for i in range(500)] + [("t", "e", i, 0, ["t", f"m{i}", "e"], [str(i)], str(i)) for i in range(4)] + [("u", "e", 1, 0, ["u", "e"], ["t"], "t")]
    names = ["start", "end", "cost", "worst", "nodes", "triple_ids", "ids"]
    calls = []
    monkeypatch.setattr(paths, "needed", lambda *a, own=paths.needed: calls.append(a) or own(*a))
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    whole = paths._needed_rows(batch, 2, 0, [])
    assert len(calls) < 10 and whole.num_rows == 503 and whole.column("cost").to_pylist()[500:502] == [0, 1]
    held: list = []
    cut = [x for i in range(0, batch.num_rows, 3) for x in paths._needed_rows(batch.slice(i, 3), 2, 0, held).to_pylist()]
    assert cut == whole.to_pylist()


def test_edges_of_a_relation_are_not_one_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(queries.claims_by_path(spark, DATA))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"BroadcastHashJoin \[relation#\d+\]", plan) and not re.search(r"SortMergeJoin \[relation#\d+\]", plan)


@pytest.mark.parametrize("piece", [1, 3, 1024])
def test_a_document_made_of_pieces_is_that_of_whole_lists(spark, monkeypatch, piece):
    monkeypatch.setattr(context, "PIECE", piece)
    lean = spark.createDataFrame([("q", ("supplied_by", "has_brand")[i % 3 == 0], i * 7 % 20, f"t{i}", f"block {i}") for i in range(20)], "query_id string, relation_en string, ord long, triple_id string, block string")
    asked = spark.createDataFrame([("q",), ("none",), ("q",)], "query_id string")
    lines = spark.createDataFrame([("q", "- head\n- other"), ("none", "")], "query_id string, lines string")
    args = (asked, lean, lines, lines.where("query_id = 'q'"), PROFILE)
    assert sorted(map(tuple, context._documents(*args).collect())) == sorted(map(tuple, context._rendered(*args).collect()))
    assert "row_number()" in _plan(context._documents(*args))


def test_a_value_that_goes_on_in_the_next_column_is_a_change(spark, tmp_path):
    old, new = str(tmp_path / "a"), str(tmp_path / "b")
    snapshots.snapshot(spark.createDataFrame([("k", "a\x1fb", "c"), ("l", "x", None)], "key string, x string, y string"), "key", old, 4)
    snapshots.snapshot(spark.createDataFrame([("k", "a", "b\x1fc"), ("l", "x", "\x00")], "key string, x string, y string"), "key", new, 4)
    assert sorted(tuple(r) for r in snapshots.diff(spark, old, new, "key").select("key", "change", F.array_join("columns", ",")).collect()) == [("k", "changed", "x,y"), ("l", "changed", "y")]


@pytest.mark.parametrize("name", ["candidate_scores", "candidate_rank_top3"])
def test_tasks_grow_in_number_with_lines(spark, monkeypatch, name):
    want = sorted(map(tuple, queries.QUERIES[name](spark, DATA).collect()))
    n = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    monkeypatch.setattr(shared, "TASK_ROWS", n // 11)
    x = queries.QUERIES[name](spark, DATA)
    assert x.rdd.getNumPartitions() >= 11 and sorted(map(tuple, x.collect())) == want


@pytest.mark.parametrize("name", ["subgraph_edges", "shape_violations"])
def test_tasks_grow_in_number_with_triples(spark, monkeypatch, name):
    want = sorted(map(tuple, queries.QUERIES[name](spark, DATA).collect()))
    monkeypatch.setattr(shared, "TASK_ROWS", spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 11)
    x = queries.QUERIES[name](spark, DATA)
    assert x.rdd.getNumPartitions() >= 11 and sorted(map(tuple, x.collect())) == want
    assert trade_graph(spark, DATA).triples.rdd.getNumPartitions() > 11
