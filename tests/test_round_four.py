"""What keeps documents, claims, paths, versions and anchors within memory, disk and time on larger tables."""

from __future__ import annotations

from evigraph.plans import queries

DATA = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_items_of_documents_are_sent_once_by_head_and_once_by_query(spark):
    for name in ("context_markdown", "context_research"):
        plan = _plan(queries.QUERIES[name](spark, DATA))
        assert "hashpartitioning(tail_id" not in plan and "hashpartitioning(s#" not in plan and plan.count("hashpartitioning(query_id#") <= 4
        assert "sort_array" not in plan and "array_join" not in plan


def test_claims_are_joined_once_and_walked_from_where_they_are_written(spark):
    plan = _plan(queries.claims_by_path(spark, DATA))
    assert "l_returnflag" not in plan and "o_custkey" not in plan and "claims-" in plan


def test_paths_are_sent_once(spark):
    plan = _plan(queries.evidence_paths_topk(spark, DATA)).split("== Initial Plan ==")[0]
    assert "hashpartitioning(start#" not in plan and "BroadcastHashJoin [end#" in plan


def test_version_two_has_the_whole_evidence_and_the_fields_of_each_heading(spark):
    text = queries.prompt_second(spark, DATA).where("query_id = 'PRT_1'").first()["prompt"]
    assert "## Suppliers\n- 证据路径：" in text and "## Sources\n" in text
    assert "- 用户观察与证据匹配\n  - 哪条观察：\n  - 是否相符：\n    - 证据路径：" in text and text.index("- 证据不足说明\n  - 缺什么：") < text.index("# Safety")
