from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evigraph.operators import analytics as an
from evigraph.plans import queries

DATA = "/root/testdata/sf0.001"


def test_hops_end_in_cycles(spark):
    t = spark.createDataFrame([("A", "B", "r", "1"), ("B", "A", "r", "2"), ("B", "C", "s", "3")], "head_id string, tail_id string, relation_en string, triple_id string")
    got = an.hops(spark.createDataFrame([("A",)], "id string"), t, 5).select(F.array_join("nodes", ">")).collect()
    assert {r[0] for r in got} == {"A>B", "A>B>C"}


@pytest.mark.parametrize("seed,most,piece,rows", [(1, 1, 256, None), (2, 2, 1, None), (3, 3, 2, 1 << 22), (4, 4, 3, None)])
def test_hops_are_all_paths_one_by_one(spark, monkeypatch, seed, most, piece, rows):
    """Cycles, triples there and back, from a node to itself, twice or without an end; starts twice, unknown or null."""
    monkeypatch.setattr(an, "PIECE", piece)
    rng = random.Random(seed)
    name = lambda: rng.choice([None, *(f"n{i}" for i in range(7))])
    graph = [(name(), name(), rng.choice(["r", "s", None]), f"t{i:02}") for i in range(24)]
    graph += [(t, h, r, f"b{i}") for h, t, r, i in graph[:6]] + graph[:2] + [("hub", "n0", "r", "h0"), ("n0", "hub", "r", "h1")]
    starts = ["n0", "n1", "n1", "hub", "zz", None]
    at, want = [((s,), (), ()) for s in starts], []
    for _ in range(most):
        at = [((*nodes, t), (*rel, r), (*ids, i)) for nodes, rel, ids in at for h, t, r, i in graph if h is not None and t is not None and h == nodes[-1] and t not in nodes]
        want += [(n[0], n[-1], len(i), i, n, r) for n, r, i in at]
    t = spark.createDataFrame(graph, "head_id string, tail_id string, relation_en string, triple_id string").repartition(3)
    s = spark.createDataFrame([(x,) for x in starts], "id string")
    cols = ("start", "end", "n_hops", "triple_ids", "nodes", "relations")
    got = lambda df, *names: sorted(map(repr, (tuple(tuple(v) if isinstance(v, list) else v for v in map(r.__getitem__, names)) for r in df.collect())))
    assert got(an.hops(s, t, most, rows), *cols) == sorted(map(repr, want))
    assert got(an.hops(s, t, most, rows, (), True), *cols[:4]) == sorted(repr(x[:4]) for x in want)


def _sent(plan):
    """Rows that the shuffles of a plan that has run have written, those that are read again counted once."""
    kind = plan.getClass().getSimpleName()
    if kind == "ReusedExchangeExec":
        return 0
    if kind == "AdaptiveSparkPlanExec":
        return _sent(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _sent(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(_sent(plan.children().apply(i)) for i in range(plan.children().size()))


def test_ranked_paths_are_sent_as_triples_and_not_one_by_one(spark):
    rows = [(f"p{i}", f"s{j}", "by", f"{i}_{j}") for i in range(40) for j in range(30)] + [(f"s{j}", "hub", "at", f"l{j}") for j in range(30)] + [("hub", f"e{i}", "of", f"h{i}") for i in range(9)]
    t = spark.createDataFrame(rows, "head_id string, tail_id string, relation_en string, triple_id string")
    starts = spark.createDataFrame([(f"p{i}",) for i in range(40)], "id string")
    x = an.ranked_paths(an.hops(starts, t, 3, None, (), True))
    n = len(x.collect())
    assert n == 1200 * 11 and 2 * len(rows) < _sent(x._jdf.queryExecution().executedPlan()) < 4 * len(rows) < n / 2


def test_triples_are_sent_once_by_their_head_and_once_by_their_end(spark):
    x = queries.path_rank(spark, DATA)
    x.collect()
    n = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert n < _sent(x._jdf.queryExecution().executedPlan()) < 2.5 * n


def test_claims(spark):
    ev = spark.createDataFrame([("p", "s1", "n1"), ("q", "s2", "n1")], "h string, t string, g string")
    cl = spark.createDataFrame([("p", "s1", "n1"), ("p", "s3", "n1"), ("p", "s9", "n9"), ("z", "s1", "n1")], "h string, t string, g string")
    x = an.claim_status(cl, ev, "h", "t", "g")
    assert {(r["h"], r["t"]): r["status"] for r in x.collect()} == {("p", "s1"): "supported", ("p", "s3"): "partially_supported", ("p", "s9"): "unsupported", ("z", "s1"): "not_verifiable"}
    m = an.claim_metrics(x).first()
    assert abs(m["ucr"] - 1 / 3) < 1e-12 and m["n_not_verifiable"] == 1
    assert m["n_mapped"] == 4 and m["pcs"] == 1 / 4
    some = an.claim_metrics(x, mapped=F.col("h") != "z", consistent=F.col("status") != "unsupported").first()
    assert some["n_mapped"] == 3 and some["pcs"] == 2 / 3
    none = an.claim_metrics(x.where("status = 'not_verifiable'")).first()
    assert none["ucr"] is None


def test_versions_and_ranks(spark):
    d = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 1.0), ("a", 4, 0.0), ("b", 9, 1.0)], "g string, i int, s double")
    v = {(r["g"], r["i"]): (r["version_no"], r["is_current"], r["previous"]) for r in an.versions(d, "g", "i").collect()}
    assert v["a", 1] == (1, False, None) and v["a", 4] == (4, True, 3) and v["b", 9] == (1, True, None)
    assert [r["i"] for r in an.ranked(d, "g", "s", "i").where("g = 'a'").orderBy("rank_order").collect()] == [1, 2, 3]
