"""The questions that one asks of a graph, one at a time. Each is a batch of one query; batches use the operators directly."""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import advice_level, request_id
from ..operators import analytics, checks, context, evidence, observe, prompts, resolve
from ..operators.profile import Profile
from ..sources.graph import EvidenceError, EvidenceGraph

# Fixed value: what stands under every explanation.
DISCLAIMER = "本结果仅用于辅助决策，不替代医生诊断；最终判断应由具备资质的医生结合面诊、皮肤镜、病理等临床信息作出。"
INSUFFICIENT = "ANALYSIS_INSUFFICIENT_INPUT"


class EvidenceService:
    """Answers are DataFrames, ordered as they are to be shown; outcomes other than an answer are EvidenceErrors."""

    def __init__(self, graph: EvidenceGraph, profile: Profile | None = None):
        self.graph, self.profile = graph, profile or Profile()
        self.spark = graph.entities.sparkSession

    @cached_property
    def keys(self) -> DataFrame:
        return resolve.lookup_keys(self.graph.entities)

    def _query(self, text: str, **more) -> DataFrame:
        cols = {"query_id": "q", "query": text} | more
        return self.spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols))

    def _need(self, *texts: str) -> None:
        if any(not (t or "").strip() for t in texts):
            raise EvidenceError(INSUFFICIENT, "all inputs are required", 400)

    def status(self) -> DataFrame:
        """Counts, where the graph lies, and warnings where counts are not what they should be."""
        counts = checks.status(self.graph, self.profile.head_type)
        said = checks.warnings(counts).agg(F.sort_array(F.collect_list("warning")).alias("warnings"))
        return counts.join(said, F.lit(True)).withColumns({"csv_dir": F.lit(self.graph.where), "loaded": F.lit(True)})  # one row each

    def find(self, name: str, entity_type: str | None = None) -> dict:
        """The first entity that bears a name."""
        got = resolve.resolve_first(self._query(name), self.keys, entity_type).first()
        if got is None:
            code = resolve.NO_HEAD if entity_type == self.profile.head_type else resolve.NO_ENTITY
            raise EvidenceError(code, f"not found: {name}", 404)
        return self.graph.entities.where(F.col("id") == got["id"]).orderBy("ord").first().asDict()

    def heads(self) -> DataFrame:
        return resolve.heads(self.graph.entities, self.profile.head_type).orderBy("ord").drop("ord")

    def evidence(self, head: str) -> DataFrame:
        self.find(head, self.profile.head_type)
        return self._some(evidence.by_head(self._query(head), self.graph, self.profile.head_type), head)

    def evidence_of_relation(self, head: str, relation: str) -> DataFrame:
        """Without outcomes: an unknown head or relation has no evidence."""
        return evidence.by_relation(self._query(head, relation=relation), self.graph, self.profile.head_type).orderBy("ord", "triple_id")

    def heads_by_feature(self, feature: str) -> DataFrame:
        """Evidence items of a feature, each with head_row (entity_id, name_cn, name_en, label), the head that it is of. A triple
        whose head nothing stands for is an error."""
        self.find(feature)
        items = self._some(evidence.by_feature(self._query(feature), self.graph, self.profile.feature_type, self.profile.head_type), feature)
        found = evidence.with_heads(items, self.graph, self.profile.head_type)
        if lost := found.where(F.col("head_row").isNull()).select("head_id").first():
            raise EvidenceError(resolve.NO_HEAD, f"not found: {lost['head_id']}", 404)
        return found.orderBy("ord", "triple_id")

    def search(self, words: str, entity_type: str | None = None) -> DataFrame:
        """Entities whose id, names or aliases hold the words."""
        x = resolve.search(self._query(words), self.graph.entities)
        return x.where(F.col("entity_type") == entity_type if entity_type else F.lit(True)).orderBy("ord").drop("query_id")

    def sources(self) -> DataFrame:
        return self.graph.sources.orderBy("ord").drop("ord")

    def source(self, source_id: str) -> dict:
        """A source with the triples that it speaks for; of sources that share an id the last."""
        got = self.graph.sources.where(F.col("source_id") == source_id).orderBy(F.desc("ord")).first()
        if got is None:
            raise EvidenceError("KG_SOURCE_NOT_FOUND", f"not found: {source_id}", 404)
        return got.asDict() | {"triples": self.graph.triples.join(self.graph.refs.where(F.col("source_id") == source_id).select("triple_id"), "triple_id", "left_semi").orderBy("ord")}

    def subgraph(self, head: str, most: int = 2) -> DataFrame:
        """The triples within so many hops of a head."""
        start = self.spark.createDataFrame([(self.find(head, self.profile.head_type)["id"],)], "id string")
        near = analytics.subgraph(start, self.graph.triples, most).drop("start")
        return self.graph.triples.join(near, "triple_id").orderBy("n_hops", "ord", "triple_id")

    def health(self) -> dict:
        """Whether the graph answers, with its counts."""
        s = self.status().first().asDict()
        return {"status": "ok" if s["entity_count"] and s["triple_count"] else "degraded", "graph": s}

    @staticmethod
    def _some(items: DataFrame, name: str) -> DataFrame:
        if items.isEmpty():
            raise EvidenceError(resolve.NO_EVIDENCE, f"no evidence: {name}", 404)
        return items.orderBy("ord", "triple_id")

    def context(self, head: str) -> dict:
        """head (a dict), items, sections in order of first appearance, sources, markdown, status."""
        self._need(head)
        entity, items = self.find(head, self.profile.head_type), self.evidence(head)
        heads = self.spark.createDataFrame([("q", entity["id"], entity["name_cn"], entity["name_en"])], "query_id string, id string, name_cn string, name_en string")
        return {
            "head": entity,
            "items": items,
            "sections": context.sectioned(items, self.profile).join(context.first_appearance(items, self.profile).select("section", "place"), "section").orderBy("place", "ord", "triple_id"),
            "sources": context.sources_of(items).orderBy("ord").drop("ord"),
            "markdown": context.markdown(self._query(head), items, heads, self.profile),
            "status": self.status(),
        }

    def research_context(self, head: str) -> str:
        q = self._query(head)
        items = evidence.by_head(q, self.graph, self.profile.head_type)
        return context.research_markdown(q, items, self.graph.entities, self.profile).first()["context"]

    def listing(self, items: DataFrame) -> str:
        from ..functions.text import NO_RESULT

        got = context.plain_listing(items).first()
        return got["listing"] if got else NO_RESULT

    def prompt(self, head: str, observation: str, version: str | None = prompts.V1) -> dict:
        """Versions 1 and 2 show the research context, with the triples' own names and sources by label, any other version the
        context of the service. Inputs are taken without blanks at their ends."""
        self._need(head, observation)
        c, version = self.context(head), version or prompts.V1
        q = self._query(head.strip(), candidate=head.strip(), observation=observation.strip())
        shown = c["markdown"]
        if version in (prompts.V1, prompts.V2):
            shown = context.research_markdown(q, evidence.by_head(q, self.graph, self.profile.head_type), self.graph.entities, self.profile)
        row = prompts.prompts(q.drop("query"), shown, version).first()
        parts = context.summary(c["items"], self.profile).first()
        sections = {r["section"]: r["n_items"] for r in context.section_counts(c["items"], self.profile).collect()}
        return {"prompt_text": row["prompt"], "candidate_disease": head.strip(), "prompt_version": version, "safety_constraints": list(prompts.SAFETY), "evidence_summary": {"section_count": parts["section_count"], "source_count": parts["source_count"], "sections": sections}}

    def explain(self, head: str, observation: str) -> dict:
        """The parts of a template explanation, as lists of {evidence_path, evidence_text, source} in order."""
        self._need(head, observation)
        items = self.evidence(head)
        o = self._query(head, observation=observation)
        hits = observe.match_items(o.drop("query"), items, self.profile)
        rows = lambda df: [{"evidence_path": r["evidence_path"], "evidence_text": r["shown_text"], "source": r["shown_source"]} for r in observe.shown(df).orderBy("place").collect()]  # noqa: E731  one head's evidence
        parts = observe.buckets(items, self.profile)
        out = {b: rows(parts.where(F.col("bucket") == b)) for b in ("supporting_evidence", "differential_diagnosis", "risk_warnings", "medical_advice_or_exams")}
        matched = [x | {"observation": observation.strip(), "match_note": observe.MATCH_NOTE} for x in rows(observe.match_order(hits, items, self.profile))]
        said = observe.insufficient(o, hits, items, self.profile).first()["messages"]
        return {"candidate_disease": head.strip(), "observation_evidence_matches": matched, **out, "insufficient_evidence": said, "disclaimer": DISCLAIMER, "generation_mode": "template"}

    def patient_view(self, head: str, observation: str) -> dict:
        """The first items of support and advice, and how soon to seek care."""
        x = self.explain(head, observation)
        level = self.spark.range(1).select(advice_level(F.lit(json.dumps(x, ensure_ascii=False))).alias("level")).first()["level"]
        return {"evidence": x["supporting_evidence"][:3] + x["medical_advice_or_exams"][:2], "care_level": level}

    def analysis(self, case_id: str) -> None:
        raise EvidenceError("NOT_IMPLEMENTED", f"analysis runs are not implemented: {case_id}", 501)

    @staticmethod
    def envelope(df: DataFrame) -> DataFrame:
        """(request_id, success, message, data): answers as JSON rows."""
        return df.select(request_id().alias("request_id"), F.lit(True).alias("success"), F.lit("ok").alias("message"), F.to_json(F.struct(*df.columns)).alias("data"))
