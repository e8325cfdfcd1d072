from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evigraph.plans.runs import StagedRun, analysis, best_candidates
from evigraph.sources.graph import EvidenceGraph


def staged(spark, folder, calls, broken=()):
    def stage(name, of):
        def run(tables):
            calls.append(name)
            if name in broken:
                spark.range(3).write.parquet(f"{folder}/stages/{name}")  # what a lost driver may leave
                raise RuntimeError(name)
            return of(tables)

        return name, run

    return StagedRun(spark, str(folder), [stage("a", lambda t: spark.range(10)), stage("b", lambda t: t["a"].where("id > 4")), stage("c", lambda t: t["b"].join(t["a"], "id").agg(F.sum("id").alias("s")))])


def test_a_run_resumes_after_a_stage_is_killed_and_commits_once(spark, tmp_path):
    calls: list = []
    with pytest.raises(RuntimeError, match="b"):
        staged(spark, tmp_path / "r", calls, broken=("b",)).run()
    again = staged(spark, tmp_path / "r", calls)
    assert again.done() == ["a"] and not (tmp_path / "r" / "result").exists()
    assert [r["s"] for r in again.run().collect()] == [35] and calls == ["a", "b", "b", "c"]
    assert [(r["place"], r["stage"], r["n_rows"]) for r in again.manifest().orderBy("place").collect()] == [(0, "a", 10), (1, "b", 5), (2, "c", 1)]
    assert [r["s"] for r in staged(spark, tmp_path / "r", calls, broken=("a", "b", "c")).run().collect()] == [35] and len(calls) == 4


def test_a_lost_commit_is_made_again_from_the_stages(spark, tmp_path):
    calls: list = []
    staged(spark, tmp_path / "r", calls).run()
    (tmp_path / "r" / "result").rename(tmp_path / "r" / "result.part")  # written, but not in its place
    assert [r["s"] for r in staged(spark, tmp_path / "r", calls).run().collect()] == [35] and calls == ["a", "b", "c"]


def test_names_of_stages_differ(spark, tmp_path):
    with pytest.raises(ValueError):
        StagedRun(spark, str(tmp_path), [("a", lambda t: spark.range(1)), ("a", lambda t: spark.range(1))])


def test_cases_get_the_candidates_that_all_pairs_would_give(spark):
    rng = random.Random(5)
    links = {(f"E{rng.randrange(6)}", f"H{rng.randrange(40):02}") for _ in range(150)}
    named = [[(f"E{i}", "Brand") for i in rng.sample(range(6), n)] + [(f"H{i:02}", "Part") for i in rng.sample(range(40), m)] for n, m in [(1, 0), (0, 1), (2, 0), (2, 1), (3, 2), (1, 1), (4, 0), (6, 3)] for _ in range(4)]
    cases = {tuple(sorted(x)) for x in named}
    want = []
    for case in cases:
        score = Counter(h for e, _ in case for x, h in links if x == e)
        score.update(e for e, kind in case if kind == "Part")
        want += [(case, h, n, i) for i, (h, n) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:3], 1)]
    triples = spark.createDataFrame([(h, e) for e, h in links], "head_id string, tail_id string")
    got = best_candidates(spark.createDataFrame([(list(x),) for x in cases], "entities array<struct<entity_id: string, anchor_type: string>>"), triples, "Part", 3)
    assert sorted((tuple(map(tuple, r["entities"])), r["candidate"], r["score"], r["rank_order"]) for r in got.collect()) == sorted(want)


def test_an_analysis_makes_no_rows_for_each_query_and_head_of_an_entity(spark, tmp_path):
    entities = spark.createDataFrame([(f"P{i:03}", "Part", f"part no {i:03}", "", "", i) for i in range(60)] + [("B", "Brand", "acme", "", "", 99)], "id string, entity_type string, name_cn string, name_en string, alias string, ord long")
    triples = spark.createDataFrame([(f"T{i}", f"P{i:03}", "Part", "has_brand", "B", "is acme" if i % 2 else "") for i in range(60)], "triple_id string, head_id string, head_type string, relation_en string, tail_id string, evidence_text string")
    said = spark.createDataFrame([(f"q{i}", "it is acme") for i in range(50)], "query_id string, observation string")
    run = analysis(spark, str(tmp_path / "r"), said, EvidenceGraph(entities, triples, None, None), "Part")
    assert {tuple(r) for r in run.run().collect()} == {(f"q{i}", 1, "P000", 1, 3, 3, 1) for i in range(50)}
    rows = {r["stage"]: r["n_rows"] for r in run.manifest().collect()}
    assert rows["candidates"] == rows["evidence"] == rows["claims"] == 3
