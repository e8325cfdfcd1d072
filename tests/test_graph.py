from __future__ import annotations

import random

import graph_fixture as fx

import pytest
from pyspark.sql import functions as F

from evigraph.functions import text as tx
from evigraph.operators import checks, contain, context, evidence, observe, prompts, resolve
from evigraph.operators.profile import Profile
from evigraph.plans.service import EvidenceService
from evigraph.sources import graph as gr

P = Profile()


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    return gr.load_csv(spark, fx.write(tmp_path_factory.mktemp("kg"))).cached()


@pytest.fixture(scope="module")
def service(graph):
    return EvidenceService(graph)


def q(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query string")


def test_loader_keeps_rows_order_and_drops_blank_rows(graph):
    assert [r["id"] for r in graph.entities.orderBy("ord").collect()] == [e[0] for e in fx.ENTITIES]
    assert graph.triples.count() == 7 and graph.sources.columns == [*gr.SOURCE, "ord"]


def test_gb18030_and_missing_files(spark, tmp_path):
    old = spark.conf.get("spark.sql.legacy.javaCharsets", "false")
    g = gr.load_csv(spark, fx.write(tmp_path / "gb", "gb18030"))
    assert {r["name_cn"] for r in g.entities.collect()} >= {"甲症", "红斑"}
    assert [r["id"] for r in g.entities.orderBy("ord").collect()] == [e[0] for e in fx.ENTITIES]
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == old
    (tmp_path / "gb" / "triples.csv").write_bytes("triple_id,head_id\r\nT1,甲".encode("gb18030") + b"\xff\xff\r\n")
    with pytest.raises(gr.EvidenceError) as e:
        gr.load_csv(spark, str(tmp_path / "gb"))
    assert e.value.code == "KG_LOAD_FAILED" and spark.conf.get("spark.sql.legacy.javaCharsets", "false") == old
    (tmp_path / "gb" / "triples.csv").unlink()
    with pytest.raises(gr.EvidenceError) as e:
        gr.load_csv(spark, str(tmp_path / "gb"))
    assert e.value.code == "KG_FILE_NOT_FOUND" and "triples.csv" in e.value.message


def test_parquet_round_trip(spark, graph, tmp_path):
    gr.save_parquet(graph, str(tmp_path / "p"))
    again = gr.load_parquet(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, again.triples.collect())) == sorted(map(tuple, graph.triples.select(*gr.TRIPLE, "ord").collect()))


def test_graph_dir(monkeypatch):
    monkeypatch.setenv("KG_CSV_DIR", "here")
    assert gr.graph_dir(None, "/root") == "/root/here" and gr.graph_dir("/x") == "/x" and gr.graph_dir("s3://b/x") == "s3://b/x"


@pytest.mark.parametrize("name, ids", [("甲症", {"H1"}), (" ALPHA\t", {"H1"}), ("h1", {"H1"}), ("共名", {"H1", "H2"}), ("ax2", {"H1"}), ("甲", set()), ("", {"H3"}), ("　甲症　", {"H1"})])
def test_names_match_exactly(spark, graph, name, ids):
    got = resolve.resolve_all(q(spark, name), resolve.lookup_keys(graph.entities), "Disease")
    assert {r["id"] for r in got.collect()} == ids


def test_first_match_and_rank(spark, graph):
    assert resolve.resolve_first(q(spark, "共名"), resolve.lookup_keys(graph.entities)).first()["id"] == "H1"
    got = {(r["id"], r["method"]) for r in resolve.resolve_ranked(q(spark, "共名", "Alpha"), graph.entities).collect()}
    assert got == {("H1", "alias"), ("H2", "alias"), ("H1", "exact")}


def test_outcomes_tell_unknown_names_from_lack_of_evidence(spark, graph):
    keys = resolve.lookup_keys(graph.entities)
    f = resolve.feature_outcome(q(spark, "red", "Face", "nobody"), keys, graph.triples, "LesionFeature", "Disease")
    assert [r["outcome"] for r in f.orderBy("query_id").collect()] == ["OK", "KG_EVIDENCE_NOT_FOUND", "KG_ENTITY_NOT_FOUND"]
    h = resolve.head_outcome(q(spark, "Alpha", "空症", "red"), keys, graph.triples, "Disease")
    assert [r["outcome"] for r in h.orderBy("query_id").collect()] == ["OK", "KG_EVIDENCE_NOT_FOUND", "KG_DISEASE_NOT_FOUND"]


def test_the_last_source_wins_without_repeating_a_triple(graph):
    got = {r["triple_id"]: r["source_id"] for r in evidence.attach_sources(graph.triples, graph).collect()}
    assert got == {"T1": "R1", "T2": "R2", "T3": "R2", "T4": "R3", "T5": "R1", "T6": "", "T7": ""}


def test_end_points_fall_back_to_the_triples_copies(graph):
    got = {r["triple_id"]: (r["tail_name"], r["source_name"]) for r in evidence.enrich(graph.triples, graph).collect()}
    assert got["T1"] == ("红斑二", "指南") and got["T3"] == ("失踪", "原始") and got["T6"][1] == "原始"


def test_two_names_of_one_head_give_its_evidence_once(spark, graph):
    assert [r["triple_id"] for r in evidence.by_head(q(spark, "共名"), graph, "Disease").orderBy("ord").collect()] == ["T1", "T2", "T3", "T4", "T5", "T6", "T7"]


def test_sections_by_first_appearance_and_in_fixed_order(spark, graph):
    items = evidence.by_head(q(spark, "Alpha"), graph, "Disease")
    assert [r["section"] for r in context.first_appearance(items, P).orderBy("place").collect()] == ["主要皮损表现", "常见部位", "鉴别诊断"]
    assert {r["source_id"] for r in context.sources_of(items).collect()} == {"R1", "R2", "R3", ""}


def test_markdown_has_all_sections(service):
    text = service.context("Alpha")["markdown"].first()["context"]
    assert [x[3:] for x in text.split("\n") if x.startswith("## ")] == list(P.order)
    assert "- 甲症 / Alpha（H1）" in text and "## 伴随症状\n- 暂无相关证据。" in text and "evidence_text：未标注" in text and "(R2, Website)" in text
    assert service.research_context("nobody").startswith("## 候选疾病\n- 未查询到匹配疾病：nobody")


def test_research_texts_print_the_triples_own_copies(service):
    text = service.research_context("Alpha")
    assert "- 证据路径：甲症 — 表现 — 红斑\n  evidence_text：局部红斑明显\n  source：原始 (R1, Guideline)" in text and "红斑二" not in text
    assert text.endswith("## 证据来源\n- 原始 (R1, Guideline)\n- 原始 (R2, Website)\n- 原始 (R3)\n- 原始")
    assert "证据路径: 甲症 — 表现 — 红斑\n" in service.listing(service.evidence("al")) and "source: 原始 (R1, Guideline)" in service.listing(service.evidence("al"))
    shown = service.context("Alpha")["markdown"].first()["context"]
    assert "- 证据路径：甲症 — 表现 — 红斑二" in shown and "source：指南 (R1, Guideline)" in shown


def test_a_head_that_nothing_stands_for(spark, graph):
    row = ("T8", "H8", "丙症", "Disease", "表现", "has_manifestation", "F1", "红斑", "LesionFeature", "原始", "x", "", 99)
    more = graph.triples.unionByName(spark.createDataFrame([row], graph.triples.schema))
    g = gr.EvidenceGraph(graph.entities, more, graph.sources, graph.refs)
    items = evidence.by_feature(q(spark, "red"), g, "LesionFeature", "Disease")
    assert [r["triple_id"] for r in items.orderBy("ord").collect()] == ["T1", "T5", "T8"]
    rows = {r["triple_id"]: r["head_row"] for r in evidence.with_heads(items, g, "Disease").collect()}
    assert tuple(rows["T1"]) == ("H1", "甲症", "Alpha", "al") and rows["T8"] is None
    with pytest.raises(gr.EvidenceError) as e:
        EvidenceService(g).heads_by_feature("red")
    assert e.value.code == "KG_DISEASE_NOT_FOUND"


def test_a_hit_without_a_section_is_no_match(spark, graph):
    items = evidence.by_head(q(spark, "Alpha"), graph, "Disease")
    o = spark.createDataFrame([("q0", "见100%_斑")], "query_id string, observation string")
    hits = observe.match_items(o, items, P)
    assert [r["triple_id"] for r in hits.collect()] == ["T4"] and observe.match_order(hits, items, P).collect() == []
    assert observe.insufficient(o, hits, items, P).first()["no_match"]


def test_search_sources_subgraph_and_health(service):
    assert [r["id"] for r in service.search(" RED ").collect()] == ["F1", "F1"] and [r["id"] for r in service.search("al", "Disease").collect()] == ["H1"]
    assert service.search(" ").collect() == [] and service.search("%").collect()[0]["id"] == "F2"
    assert [r["source_id"] for r in service.sources().collect()] == ["R1", "R2", "R3"]
    assert [r["triple_id"] for r in service.source("R2")["triples"].collect()] == ["T2", "T3"]
    with pytest.raises(gr.EvidenceError):
        service.source("R9")
    near = {r["triple_id"]: r["n_hops"] for r in service.subgraph("Alpha").collect()}
    assert near == {"T1": 1, "T2": 1, "T3": 1, "T4": 1, "T6": 1, "T5": 2, "T7": 2}  # T6 and T7 are a cycle
    assert service.health()["status"] == "ok"


def test_sinks(spark, graph, tmp_path):
    gr.write_text(gr.as_json(graph.sources.orderBy("ord")), "json", str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 3 and any('"source_id":"R1"' in x for x in lines)
    (tmp_path / "r.csv").write_text('case_id,notes\nC1,"a, b"\nC2,\n')
    rows, texts = gr.read_results(spark, str(tmp_path / "r.csv"), str(tmp_path / "out"))
    assert [tuple(r) for r in rows.collect()] == [("C1", "a, b"), ("C2", None)] and texts.select("file_name").first()[0].startswith("part-")
    for kind in ("json", "csv"):
        gr.export(graph.sources, str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    assert {r["source_name"] for r in spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').collect()} == {"指南", None, "网站"}
    graph.views()
    assert spark.sql("SELECT count(*) FROM graph_triples").first()[0] == 7


def test_url_parts(spark):
    d = spark.createDataFrame([("a b/c+é!~*'()-_.",)], "x string")
    assert d.select(tx.url_part(F.col("x"))).first()[0] == "a%20b%2Fc%2B%C3%A9!~*'()-_."


def test_candidates_are_flagged_where_none_matched(spark):
    got = observe.candidates_or_all(spark.createDataFrame([("a", "H1")], "query_id string, entity_id string"), spark.createDataFrame([("a",), ("b",)], "query_id string"))
    assert {tuple(r) for r in got.collect()} == {("a", "H1", False), ("b", None, True)}


def test_service_errors(service):
    for call, code in ((lambda: service.evidence("nobody"), "KG_DISEASE_NOT_FOUND"), (lambda: service.evidence("空症"), "KG_EVIDENCE_NOT_FOUND"), (lambda: service.heads_by_feature("Face"), "KG_EVIDENCE_NOT_FOUND"), (lambda: service.heads_by_feature("x"), "KG_ENTITY_NOT_FOUND"), (lambda: service.context(" "), "ANALYSIS_INSUFFICIENT_INPUT"), (lambda: service.analysis("c"), "NOT_IMPLEMENTED")):
        with pytest.raises(gr.EvidenceError) as e:
            call()
        assert e.value.code == code


def test_service_answers(service):
    assert [r["entity_id"] for r in service.heads().collect()] == ["H1", "H2", "H3"] and service.heads().first()["label"] == "al"
    assert [r["triple_id"] for r in service.heads_by_feature("red").collect()] == ["T1", "T5"]
    assert [r["triple_id"] for r in service.evidence_of_relation("al", " HAS_manifestation").collect()] == ["T1", "T3"]
    assert "triple_id: T1" in service.listing(service.evidence("al")) and service.listing(service.evidence_of_relation("al", "none")) == tx.NO_RESULT
    s = service.status().first()
    assert (s["entity_count"], s["triple_count"], s["source_count"], s["head_count"]) == (7, 7, 3, 3) and len(s["warnings"]) == 4
    assert service.envelope(service.heads()).first()["request_id"].startswith("req_")
    assert evidence.nested(service.evidence("al")).select("head.entity_id", "tail.name_cn", "relation.relation_en").count() == 5


def test_explanations(service):
    x = service.explain("Alpha", " 面部有红斑二 ")
    assert [i["evidence_path"] for i in x["observation_evidence_matches"]] == ["甲症 — 表现 — 红斑二", "甲症 — 部位 — 面部"]
    assert len(x["supporting_evidence"]) == 3 and x["risk_warnings"] == [] and x["insufficient_evidence"] == [observe.LACKS_RISK]
    assert all(i["match_note"] == observe.MATCH_NOTE and i["observation"] == "面部有红斑二" for i in x["observation_evidence_matches"])
    assert service.patient_view("Alpha", "面部")["care_level"] in tx.ADVICE
    assert service.explain("Beta", "别的")["insufficient_evidence"] == [observe.LACKS_MATCH, observe.LACKS_RISK]


def test_observation_clauses(spark):
    row = spark.createDataFrame([("短句，局部红斑，x", "没有", "可见局部红斑明显"), ("局部红", "没有", "可见局部红斑"), ("a%b", "%", ""), ("ab", "", "")], "o string, t string, e string")
    hit = tx.observed(F.lower("o"), tx.clauses(F.col("o")), F.lower("t"), F.lower("e"))
    assert [r[0] for r in row.select(hit).collect()] == [True, False, True, False]


def test_labels(spark):
    c = F.col
    d = spark.createDataFrame([("n", "i", "t"), ("n", "", ""), ("", "i", ""), ("", "", "")], "n string, i string, t string")
    assert [r[0] for r in d.select(tx.source_label(c("n"), c("i"), c("t"))).collect()] == ["n (i, t)", "n", "i", "未标注"]
    assert [r[0] for r in d.select(tx.source_label_screen(c("n"), c("i"), c("t"))).collect()] == ["n（i，t）", "n", "未标注来源（i）", "未标注来源"]
    assert [r[0] for r in d.select(tx.source_plain(c("n"), c("i"), c("t"))).collect()] == ["n (i, t)", "n", "(i, )", ""]
    assert spark.range(1).select(tx.advice_level(F.lit("可能出血")), tx.advice_level(F.lit("去皮肤科")), tx.advice_level(F.lit("无"))).first()[:] == tx.ADVICE


def test_prompts(service, spark):
    for version in (prompts.V1, prompts.V2, "other"):
        text = service.prompt("Alpha", "红斑", version)["prompt_text"]
        assert prompts.MARKER in text and "红斑" in text and "证据路径" in text and "Alpha" in text
        assert "知识图谱证据上下文" in text and "不得输出处方、药物剂量" in text and "鉴别诊断：" in text
    for version, own in ((prompts.V1, True), (prompts.V2, True), ("other", False)):
        text = service.prompt(" Alpha\u3000", "\t红斑 ", version)["prompt_text"]
        assert "候选疾病：Alpha\n- 用户观察：红斑\n" in text and ("红斑二" not in text) == own
    one = spark.range(1)
    c = lambda v: one.select(prompts.render(v, F.lit(" x "), F.lit("\ty"), F.lit("ctx"))).first()[0]
    assert "候选疾病： x \n- 用户观察：\ty\n" in c(prompts.V2) and "候选疾病：x\n- 用户观察：y\n" in c(prompts.V1) and "就医/检查建议：" in c(None)
    assert "用户观察与证据匹配：（一行一条：证据路径 | evidence_text | source）\n支持证据：" in c(prompts.V2) and "候选疾病：\n用户观察" in c(prompts.V2)
    d = spark.createDataFrame([("不得输出患病概率",)], "x string")
    assert "# Safety" not in d.select(prompts.with_safety(F.col("x"))).first()[0]
    assert "# Safety" in d.select(prompts.with_safety(F.col("x"), F.lit(""))).first()[0]
    q2 = spark.createDataFrame([("a", " ", "o"), ("b", "c", "o")], "query_id string, candidate string, observation string")
    got = prompts.prompts(q2, spark.createDataFrame([("b", "ctx")], "query_id string, context string")).orderBy("query_id").collect()
    assert [r["outcome"] for r in got] == ["ANALYSIS_INSUFFICIENT_INPUT", "OK"] and got[0]["prompt"] is None


def test_checks(graph):
    assert {(r["triple_id"], r["side"]) for r in checks.dangling(graph).collect()} == {("T3", "tail")}
    assert {r["triple_id"] for r in checks.without_source(graph).collect()} == {"T6", "T7"}
    assert {r["id"] for r in checks.duplicates(graph.entities, "id").collect()} == {"F1"}
    assert {r["triple_id"] for r in checks.copies_differ(graph).collect()} == {"T1", "T5"}
    a, b = checks.checksum(graph.triples).first(), checks.checksum(graph.triples.orderBy(F.desc("ord"))).first()
    assert a == b and a != checks.checksum(graph.triples.union(graph.triples)).first()


def test_containing_takes_both_ways(spark):
    texts = spark.createDataFrame([(1, "x" * 1030 + "needle is here" + "y" * 2000), (2, "no"), (3, ""), (4, "abc")], "id int, text string")
    needles = spark.createDataFrame([("needle is here",), ("eedle",), ("no",), ("",), ("ab",), ("needle is hereX",)], "needle string")
    few = {tuple(r) for r in contain.containing(texts, needles).select("id", "needle").collect()}
    many = {tuple(r) for r in contain.containing(texts, needles, shard=15).select("id", "needle").collect()}
    grams = {tuple(r) for r in contain.containing(texts, needles, automata=0).select("id", "needle").collect()}
    assert few == many == grams == {(1, "needle is here"), (1, "eedle"), (2, "no"), (4, "ab")}


def test_containing_repeats_repeated_rows_both_ways(spark):
    long = "x" * 1020 + "needle" + "y" * 1020 + "needle" + "no" * 600
    texts = spark.createDataFrame([(1, long), (1, long), (2, "no needle"), (2, "no needle")], "id int, text string")
    needles = spark.createDataFrame([("needle",), ("needle",), ("no",), ("needle is here",)], "needle string")
    few = sorted(map(tuple, contain.containing(texts, needles).select("id", "needle").collect()))
    many = sorted(map(tuple, contain.containing(texts, needles, shard=5).select("id", "needle").collect()))
    grams = sorted(map(tuple, contain.containing(texts, needles, automata=0).select("id", "needle").collect()))
    assert few == many == grams == sorted([(1, "needle"), (2, "needle")] * 4 + [(1, "no"), (2, "no")] * 2)


def test_a_hundred_thousand_needles_and_a_text_of_fifty_megabytes(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    some = sorted({word(rng.randint(9, 40)) for _ in range(100_000)})
    long = " ".join(rng.sample(some, 50)) + word(999) * 50_000 + some[7]
    texts = spark.createDataFrame([(1, long), (2, some[3] + "é" + some[5][1:]), (3, None)], "id int, text string").repartition(2)
    needles = spark.createDataFrame([(x,) for x in some], "needle string")
    got = contain.containing(texts, needles).select("id", "needle")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(long) > 49_000_000 and "NestedLoop" not in plan and "Cartesian" not in plan
    parts = long[: 60 * 50] + long[-5_000:]  # the middle repeats itself
    assert {tuple(r) for r in got.collect()} == {(1, x) for x in some if x in parts or x in long[2_000:8_000]} | {(2, x) for x in some if x in some[3] or x in some[5][1:]}


def test_stream_static_match(spark, graph, tmp_path):
    from evigraph.streaming.observations import match_stream

    spark.createDataFrame([("q0", "面部发红")], "query_id string, observation string").write.parquet(str(tmp_path / "in"))
    gr.save_parquet(graph, str(tmp_path / "stored"))  # a stream's static side has to be a stored graph
    items = evidence.by_head(q(spark, "Alpha"), gr.load_parquet(spark, str(tmp_path / "stored")), "Disease")
    out = match_stream(spark.readStream.schema("query_id string, observation string").parquet(str(tmp_path / "in")), items, P)
    s = out.select("query_id", "triple_id").writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).start()
    s.processAllAvailable()
    s.stop()
    assert [tuple(r) for r in spark.table("hits").collect()] == [("q0", "T2")]
