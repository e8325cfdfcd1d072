"""Designed analytics over a graph: ranking of candidates, validation of claims with its metrics, paths, versions, timelines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dealt

SUPPORTED, PARTIAL, UNSUPPORTED, NOT_VERIFIABLE = "supported", "partially_supported", "unsupported", "not_verifiable"
#: Ways on that a first triple is sent with at once.
PIECE = 256


@dataclass(frozen=True)
class Weights:
    """Of features, sites, symptoms, coverage, and of conflicts, which count against. The formula is given, its weights aren't."""

    features: float = 0.4
    sites: float = 0.2
    symptoms: float = 0.2
    coverage: float = 0.2
    conflicts: float = 0.3


def score(w: Weights, features: Column, sites: Column, symptoms: Column, coverage: Column, conflicts: Column) -> Column:
    return w.features * features + w.sites * sites + w.symptoms * symptoms + w.coverage * coverage - w.conflicts * conflicts


def ranked(candidates: DataFrame, task: str, by: str, candidate: str, top: int = 3) -> DataFrame:
    """The best candidates of each task with rank_order; ties go to the smaller candidate."""
    x = candidates.withColumn("rank_order", F.row_number().over(Window.partitionBy(task).orderBy(F.desc(by), candidate)).cast("long"))
    return x.where(F.col("rank_order") <= top)


def claim_status(claims: DataFrame, evidence: DataFrame, head: str, tail: str, group: str) -> DataFrame:
    """Claims with status. evidence has head, tail and group, a coarser tail.

    The pair itself is evidence: supported. The head with another tail of the group: partially supported. The head at all:
    unsupported. Else not verifiable. Three graded joins on pre-aggregated evidence, so none repeats a claim.
    """
    flag = lambda cols, name: evidence.select(*cols).distinct().withColumn(name, F.lit(True))
    x = claims.join(flag([head, tail], "is_exact"), [head, tail], "left").join(flag([head, group], "is_near"), [head, group], "left").join(flag([head], "is_known"), [head], "left")
    status = F.when(F.col("is_exact"), SUPPORTED).when(F.col("is_near"), PARTIAL).when(F.col("is_known"), UNSUPPORTED).otherwise(NOT_VERIFIABLE)
    return x.withColumn("status", status).drop("is_exact", "is_near", "is_known")


def claim_metrics(claims: DataFrame, *by: str, mapped: Column | None = None, consistent: Column | None = None) -> DataFrame:
    """ucr: unsupported among verifiable claims; pcs: path-consistent among mapped ones; with their counts.

    mapped: whether a claim could be put as a path, by default all are; consistent: whether head, relation and tail of that path
    all agree with evidence, by default the supported ones.
    """
    mapped = F.lit(True) if mapped is None else mapped
    consistent = mapped & (F.col("status") == SUPPORTED if consistent is None else consistent)
    n = lambda s: F.count_if(F.col("status") == s)
    counts = claims.groupBy(*by).agg(n(SUPPORTED).alias("n_supported"), n(PARTIAL).alias("n_partial"), n(UNSUPPORTED).alias("n_unsupported"), n(NOT_VERIFIABLE).alias("n_not_verifiable"), F.count_if(mapped).alias("n_mapped"), F.count_if(consistent).alias("n_consistent"))
    checked = F.col("n_supported") + F.col("n_partial") + F.col("n_unsupported")
    return counts.withColumns({"ucr": F.try_divide(F.col("n_unsupported"), checked), "pcs": F.try_divide(F.col("n_consistent"), F.col("n_mapped"))})


def observation_hit_rate(anchors: DataFrame, matched: Column, *by: str) -> DataFrame:
    """oehr: matched among verifiable observation anchors."""
    return anchors.groupBy(*by).agg(F.count(F.lit(1)).alias("n_anchors"), F.try_divide(F.count_if(matched), F.count(F.lit(1))).alias("oehr"))


def coverage_rate(used: DataFrame, available: DataFrame, kind: str, *by: str) -> DataFrame:
    """ecr: evidence types used among those available."""
    a = available.groupBy(*by).agg(F.count_distinct(kind).alias("n_available"))
    u = used.groupBy(*by).agg(F.count_distinct(kind).alias("n_used"))
    return a.join(u, list(by), "left").withColumns({"n_used": F.coalesce("n_used", F.lit(0)), "ecr": F.try_divide(F.coalesce("n_used", F.lit(0)), F.col("n_available"))})


def hops(starts: DataFrame, triples: DataFrame, most: int, rows: int | None = None, more: tuple[str, ...] = ("nodes", "relations"), together: bool = False) -> DataFrame:
    """Paths of 1 to `most` triples from start nodes (id): start, end, n_hops, triple_ids, and more of nodes and relations.

    Nodes reached are gone on from once, however many paths lead there, and paths are put together from their ends: a path is a
    first triple and a way on, or none, from the node it leads to. So no hub gets all paths that pass it. No node is passed
    twice, so cycles end. rows: about how many triples there are; with it, what a task gets does not grow with them. together:
    paths are dealt by their start, where each first triple is sent once with each PIECE of its ways on.
    """
    c, deal = F.col, lambda x, key: dealt(x, rows, key) if rows else x.repartition(key)
    head, tail, relation, id_ = (c("t")[i] for i in range(4))
    # a triple is one value and its ends are there, so that all readers need the same columns and rows and read one exchange
    step = triples.where(c("head_id").isNotNull() & c("tail_id").isNotNull() & (c("head_id") != c("tail_id")))
    step = deal(step.select(F.array("head_id", "tail_id", "relation_en", "triple_id").alias("t")), head)
    at, walked = [starts.select(c("id").alias("node"), F.lit(None).cast("string").alias("only"))], []
    for _ in range(most):
        x = at[-1].join(step, c("node") == head).where(F.coalesce(tail != c("only"), F.lit(True))).select("t")
        walked.append(deal(x, tail))
        # what a single node leads to needs no way back to it
        by = walked[-1].groupBy(tail.alias("node")).agg(F.min(head).alias("a"), F.max(head).alias("b"))
        at.append(by.select("node", F.when(c("a") == c("b"), c("a")).alias("only")))
    way = {"end": c("node"), "nodes": F.array("node"), "relations": F.array().cast("array<string>"), "triple_ids": F.array().cast("array<string>")}
    ends = lambda n: at[n].select("node", *[v.alias(k) for k, v in way.items()])  # noqa: E731  no way on
    ways = ends(most)
    for n in range(most - 1, 0, -1):
        x = walked[n].join(ways, tail == c("node")).where(~F.array_contains("nodes", head))
        x = x.select(head.alias("node"), "end", F.concat(F.array(head), "nodes").alias("nodes"), F.concat(F.array(relation), "relations").alias("relations"), F.concat(F.array(id_), "triple_ids").alias("triple_ids"))
        ways = x.unionByName(ends(n))
    nth = F.row_number().over(Window.partitionBy("node").orderBy("triple_ids"))
    pieces = ways.withColumn("piece", F.floor((nth - 1) / PIECE)).groupBy("node", "piece").agg(F.collect_list(F.struct(*way)).alias("ways"))
    fit = F.filter("ways", lambda w: ~F.array_contains(w["nodes"], head))
    kept = F.transform(fit, lambda w: F.struct(*[w[k].alias(k) for k in way if k in ("end", "triple_ids", *more)]))
    x = walked[0].join(pieces, tail == c("node")).select(head.alias("start"), *[relation.alias("relation")] * ("relations" in more), id_.alias("triple_id"), kept.alias("ways"))
    x = (deal(x, "start") if together else x).withColumn("way", F.explode("ways"))
    before = {"nodes": "start", "relations": "relation", "triple_ids": "triple_id"}
    x = x.select("start", "way.end", *[F.concat(F.array(before[k]), f"way.{k}").alias(k) for k in (*more, "triple_ids")])
    return x.withColumn("n_hops", F.size("triple_ids").cast("long"))


def ranked_paths(paths: DataFrame) -> DataFrame:
    """Paths with retrieval_score, the inverse of their length, and path_rank within their start: high scores first."""
    x = paths.withColumn("retrieval_score", F.lit(1.0) / F.col("n_hops"))
    order = Window.partitionBy("start").orderBy(F.desc("retrieval_score"), F.array_join("triple_ids", "/"))
    return x.withColumn("path_rank", F.row_number().over(order).cast("long"))


def subgraph(starts: DataFrame, triples: DataFrame, most: int, rows: int | None = None) -> DataFrame:
    """(start, triple_id, n_hops): the triples within `most` hops of each start node, each with the fewest hops that reach it.

    A node is gone on from once for each start, when it is first reached, so the work is that of the subgraph's edges and not
    of its paths. rows: about how many triples there are; with it, what a task gets does not grow with them.
    """
    step = triples.select(F.col("head_id").alias("node"), F.col("tail_id").alias("to"), "triple_id")
    step = dealt(step, rows, "node") if rows else step
    at = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct()
    seen, out = at, None
    for n in range(1, most + 1):
        x = at.join(step, "node")
        now = x.select("start", "triple_id", F.lit(n).cast("long").alias("n_hops"))
        out = now if out is None else out.unionByName(now)
        at = x.select("start", F.col("to").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        seen = seen.unionByName(at)
    return (dealt(out, rows * most, "start") if rows else out).groupBy("start", "triple_id").agg(F.min("n_hops").alias("n_hops"))


def experiment_summary(runs: DataFrame, by: list[str], means: list[str], sums: list[str] = (), digits: int = 9) -> DataFrame:
    """Of each method or run, as `by` names them: n, the mean of each metric, null metrics apart, and sums."""
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), digits).alias(c) for c in means], *[F.sum(c).alias(c) for c in sums])


def versions(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Rows with version_no, is_current and previous (the version before it, null for the first)."""
    w = Window.partitionBy(group).orderBy(*order)
    last = F.count(F.lit(1)).over(Window.partitionBy(group))
    x = df.withColumn("version_no", F.row_number().over(w).cast("long"))
    return x.withColumns({"is_current": F.col("version_no") == last, "previous": F.lag("version_no").over(Window.partitionBy(group).orderBy("version_no"))})


def timeline(df: DataFrame, group: str, at: str, id_: str, kind: str) -> DataFrame:
    """Rows with the event before and after, and the seconds since the one before."""
    w = Window.partitionBy(group).orderBy(at, id_)
    return df.withColumns({"before": F.lag(kind).over(w), "after": F.lead(kind).over(w), "gap_s": (F.unix_timestamp(F.col(at).cast("timestamp")) - F.unix_timestamp(F.lag(F.col(at).cast("timestamp")).over(w)))})
