from __future__ import annotations

import random

from pyspark.sql import functions as F

from evigraph.operators import checks, snapshots


def rows(n=400):
    rng = random.Random(1)
    return {f"k{i}": (rng.choice([None, "a", "b", ""]), rng.randrange(5)) for i in range(n)}


def test_a_diff_lists_what_changed_and_reads_only_buckets_that_differ(spark, tmp_path):
    old = rows()
    new = {k: v for k, v in old.items() if k not in ("k3", "k77")} | {"k5": ("z", old["k5"][1]), "k6": (None if old["k6"][0] else "x", 9), "new": (None, 0)}
    for name, x in (("old", old), ("new", new), ("same", old)):
        snapshots.snapshot(spark.createDataFrame([(k, *v) for k, v in x.items()], "k string, a string, b int").repartition(3), "k", f"{tmp_path}/{name}", 200)
    path = lambda name: f"{tmp_path}/{name}"
    x = snapshots.diff(spark, path("old"), path("new"), "k")
    want = {("k3", "removed", ()), ("k77", "removed", ()), ("new", "added", ()), ("k5", "changed", ("a",)), ("k6", "changed", ("a", "b"))}
    assert {(r["k"], r["change"], tuple(r["columns"])) for r in x.collect()} == want
    which = snapshots.differing_buckets(spark, path("old"), path("new"))
    assert 3 <= len(which) <= 5
    plan = x._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [bucket" in plan.toString()
    files = spark.read.parquet(f"{path('old')}/rows").where(F.col("bucket").isin(which)).select(F.input_file_name()).distinct().count()
    assert files <= len(which) < 20 < spark.read.parquet(f"{path('old')}/rows").select("bucket").distinct().count()
    assert snapshots.differing_buckets(spark, path("old"), path("same")) == [] and snapshots.diff(spark, path("old"), path("same"), "k").collect() == []


def test_planted_violations_are_found(spark):
    cols = "triple_id string, head_id string, head_type string, relation_en string, tail_id string, tail_type string, evidence_text string"
    good = [(f"g{i}", f"d{i}", "Disease", "shows", f"f{i % 7}", "Feature", "") for i in range(200)] + [(f"m{i}", f"d{i % 40}", "Disease", "occurs", f"s{i}", "Site", "x") for i in range(100)]
    bad = [("b1", "x1", "Site", "shows", "f1", "Feature", ""), ("b2", "d1", "Disease", "occurs", "f1", "Feature", ""), ("b3", "d3", "Disease", "shows", "f4", "Feature", ""), ("b4", "d1", "Disease", "unheard", "f1", "Feature", "")]
    t, known = spark.createDataFrame(good + bad, cols), spark.createDataFrame(good, cols)
    got = {(r["triple_id"], r["violation"]) for r in checks.shape_violations(t, checks.shapes(known)).collect()}
    assert got == {("b1", "domain"), ("b2", "range"), ("b3", "cardinality"), ("g3", "cardinality"), ("b4", "relation")}
    assert got - {("b4", "relation")} == {(r["triple_id"], r["violation"]) for r in checks.shape_violations(t, checks.shapes(t)).collect()}
    assert checks.shape_violations(t.where("false"), checks.shapes(t)).collect() == [] and checks.shapes(t.where("false")).collect() == []


def test_the_cube_scans_once_and_sums_up(spark):
    t = spark.createDataFrame([(f"t{i}", "Disease", f"d{i}", ["a", "b", "a"][i % 3], "x") for i in range(7)], "triple_id string, head_type string, head_id string, relation_en string, evidence_text string")
    x = checks.status_cube(t, "head_type", "relation_en")
    total = {(r["head_type"], r["relation_en"], r["level"]): r["n"] for r in x.collect()}
    assert total[None, None, 3] == 7 and total["Disease", None, 1] == 7 and total[None, "b", 2] == 2
    assert x._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Expand") <= 2
