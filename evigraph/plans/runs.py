"""Staged runs: stages are written one by one, noted in a manifest, resumed after a failure, and committed once.

A run has a folder. A stage's table is written below it, then a row of the manifest says so; a stage that the manifest does not
name is done anew, whatever a lost driver has left of it. The result is written aside and takes its place by one rename, so
readers see all of it or nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import analytics, anchors
from ..sources.graph import EvidenceGraph
from ..sources.shared import delete

#: What a stage is given: the tables of all stages before it, by name.
Stage = Callable[[dict[str, DataFrame]], DataFrame]


class StagedRun:
    def __init__(self, spark: SparkSession, folder: str, stages: list[tuple[str, Stage]]):
        self.spark, self.folder, self.stages = spark, folder.rstrip("/"), stages
        if len({name for name, _ in stages}) < len(stages) or not stages:
            raise ValueError("a run has stages, of different names")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _exists(self, name: str) -> bool:
        p = self._path(name)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def done(self) -> list[str]:
        """The stages that the manifest names."""
        return [name for name, _ in self.stages if self._exists(f"manifest/{name}/_SUCCESS")]

    def manifest(self) -> DataFrame:
        """(place, stage, n_rows, at) of the stages that are done: a row each."""
        rows = [self.spark.read.parquet(f"{self.folder}/manifest/{name}") for name in self.done()]
        empty = self.spark.createDataFrame([], "place int, stage string, n_rows long, at timestamp")
        for x in rows:
            empty = empty.unionByName(x)
        return empty

    def run(self) -> DataFrame:
        """The last stage's rows, from the result if the run is committed, else by what is not done yet."""
        last = self.stages[-1][0]
        if not self._exists("result"):
            tables: dict[str, DataFrame] = {}
            done = set(self.done())
            for place, (name, stage) in enumerate(self.stages):
                path = f"{self.folder}/stages/{name}"
                if name not in done:
                    delete(self.spark, path)
                    delete(self.spark, f"{self.folder}/manifest/{name}")
                    stage(tables).write.parquet(path)
                tables[name] = self.spark.read.parquet(path)
                if name not in done:
                    note = tables[name].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(place).alias("place"), F.lit(name).alias("stage"), "n_rows", F.current_timestamp().alias("at"))
                    note.write.parquet(f"{self.folder}/manifest/{name}")
            self._commit(tables[last])
        return self.spark.read.parquet(f"{self.folder}/result")

    def _commit(self, result: DataFrame) -> None:
        aside, place = self._path("result.part"), self._path("result")
        delete(self.spark, f"{self.folder}/result.part")
        result.write.parquet(f"{self.folder}/result.part")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(aside, place) and not self._exists("result"):
            raise OSError(f"{self.folder}/result could not be put in its place")


def best_candidates(cases: DataFrame, triples: DataFrame, head_type: str, top: int) -> DataFrame:
    """(entities, candidate, score, rank_order): of each case, a set of (entity_id, anchor_type), the `top` heads that most of its
    entities are or are the tail of; ties go to the smaller head.

    An entity that very many heads have is not joined with all of them. A head of one of the case's entities alone is among the
    best only as one of the `top` smallest of that entity: those before it are heads too, and smaller. Heads of two or more are
    found from the heads' side, by the pairs of entities that both a head and a case have.
    """
    name = F.struct("entity_id", "anchor_type")
    element = cases.select("entities", F.explode("entities").alias("e")).select("entities", "e.entity_id", "e.anchor_type")
    known = element.select("entity_id", "anchor_type").distinct()
    tails = triples.select(F.col("tail_id").alias("entity_id"), F.col("head_id").alias("candidate")).distinct()
    own = known.where(F.col("anchor_type") == head_type).withColumn("candidate", F.col("entity_id"))
    links = tails.join(known, "entity_id").select("entity_id", "anchor_type", "candidate").unionByName(own).distinct()
    nth = F.row_number().over(Window.partitionBy("entity_id", "anchor_type").orderBy("candidate"))
    first = links.withColumn("nth", nth).where(F.col("nth") <= top).drop("nth")
    alone = element.join(first, ["entity_id", "anchor_type"]).select("entities", "candidate", "entity_id")
    pairs = lambda of: F.explode(F.flatten(F.transform(of, lambda a: F.transform(F.filter(of, lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    asked = cases.where(F.size("entities") > 1).select("entities", pairs(F.col("entities")).alias("pair"))
    several = known.join(asked.select(F.explode(F.array("pair.a", "pair.b")).alias("e")).select("e.entity_id", "e.anchor_type").distinct(), ["entity_id", "anchor_type"], "left_semi")
    heads = links.join(several, ["entity_id", "anchor_type"], "left_semi").groupBy("candidate").agg(F.sort_array(F.collect_list(name)).alias("of")).where(F.size("of") > 1)
    both = heads.select("candidate", pairs(F.col("of")).alias("pair")).join(asked, "pair").select("entities", "candidate", F.explode(F.array("pair.a.entity_id", "pair.b.entity_id")).alias("entity_id"))
    x = alone.unionByName(both).distinct().groupBy("entities", "candidate").agg(F.count(F.lit(1)).alias("score"))
    return analytics.ranked(x, "entities", "score", "candidate", top)


def analysis(spark: SparkSession, folder: str, observations: DataFrame, graph: EvidenceGraph, head_type: str, rules: tuple[anchors.Rule, ...] = (), top: int = 3, text: str = "observation") -> StagedRun:
    """The full analysis of observations (query_id, text): anchors, cases, candidates, evidence, claims, reports.

    Observations that name the same entities are one case, (query_id, entities), and all but reports is made a case. Candidates
    are heads that an anchor is, or that a triple links to one; their score is how many of the case's anchors these are, and the
    first `top` go on. Their triples are the evidence, each candidate's once. Each is a claim, supported where it has a text. A
    report is a row a query that named anything: n_anchors, candidate (the first one), score, n_candidates, n_items, n_supported.
    """
    triples = graph.triples

    def found(t):
        return anchors.anchors(observations, graph.entities, rules, text).where(F.col("entity_id").isNotNull())

    def cases(t):
        return t["anchors"].groupBy("query_id").agg(F.count(F.lit(1)).alias("n_anchors"), F.sort_array(F.collect_set(F.struct("entity_id", "anchor_type"))).alias("entities"))

    def candidates(t):
        of = t["cases"].select("entities").distinct()
        return best_candidates(of, triples.where(F.col("head_type") == head_type), head_type, top)

    def evidence(t):
        some = t["candidates"].select("candidate").distinct()
        return triples.select(F.col("head_id").alias("candidate"), "triple_id", "relation_en", "tail_id", "evidence_text").join(some.hint("shuffle_hash"), "candidate", "left_semi")

    def claims(t):
        status = F.when(F.col("evidence_text") != "", analytics.SUPPORTED).otherwise(analytics.NOT_VERIFIABLE)
        return t["evidence"].select("candidate", "triple_id", "relation_en", "tail_id", status.alias("status"))

    def reports(t):
        n = t["claims"].groupBy("candidate").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("status") == analytics.SUPPORTED).alias("n_supported"))
        c = t["candidates"].join(n, "candidate", "left").groupBy("entities").agg(F.min_by("candidate", "rank_order").alias("candidate"), F.max("score").alias("score"), F.count(F.lit(1)).alias("n_candidates"), F.sum("n_items").alias("n_items"), F.sum("n_supported").alias("n_supported"))
        none = lambda n: F.coalesce(F.col(n), F.lit(0)).alias(n)
        return t["cases"].join(c, "entities", "left").select("query_id", "n_anchors", "candidate", none("score"), none("n_candidates"), none("n_items"), none("n_supported"))

    return StagedRun(spark, folder, [("anchors", found), ("cases", cases), ("candidates", candidates), ("evidence", evidence), ("claims", claims), ("reports", reports)])
