"""Every registered query of the graph against its SQL, at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from evigraph.plans import oracle, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def test_all_have_sql():
    assert set(queries.QUERIES) == set(oracle.SQL)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.sql(oracle.SQL[name])
    assert cols == sorted(want.columns)
    pick = [want.columns.index(c) for c in cols]
    got = sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))
    assert got == sorted(map(repr, (tuple(r[i] for i in pick) for r in want.fetchall())))


def test_plans_use_semi_joins_and_prune_columns(spark):
    plan = queries.missing_sources(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "l_quantity" not in plan and "CartesianProduct" not in plan


def test_ranked_paths_take_every_relation_and_more_than_one_hop(spark):
    x = queries.path_rank(spark, DATA)
    assert {r[0] for r in x.select(F.substring("triple_ids", 1, 2)).distinct().collect()} == {"TB", "TT", "TS"}
    assert {r["n_hops"] for r in x.select("n_hops").distinct().collect()} == {1, 2, 3}
    pairs = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().count()
    assert x.where("n_hops = 1").count() == pairs + 2 * spark.read.parquet(f"{DATA}/part.parquet").count()


def test_a_dangling_end_of_the_tables_is_found_and_no_other(spark, tmp_path):
    assert queries.dangling_nodes(spark, DATA).count() == 0
    for t in TABLES[:6] + ["lineitem"]:
        x = spark.read.parquet(f"{DATA}/{t}.parquet")
        if t == "customer":
            x = x.where("c_custkey <> 1").unionByName(x.where("c_custkey = 1").withColumn("c_mktsegment", F.lit(None).cast("string")))
        x.write.parquet(f"{tmp_path}/{t}.parquet")
    duck = duckdb.connect()
    for t in TABLES[:6] + ["lineitem"]:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(str, (tuple(r) for r in queries.dangling_nodes(spark, str(tmp_path)).select("triple_id", "side", "id").collect())))
    assert got == ["('TG1', 'tail', None)"] == sorted(map(str, duck.sql(oracle.SQL["dangling_nodes"]).fetchall()))
