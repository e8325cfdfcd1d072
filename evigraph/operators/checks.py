"""Status of a graph and checks of its data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.graph import EvidenceGraph
from ..sources.shared import dealt, written

# What the shipped graph holds.
EXPECTED = {"entity_count": 70, "triple_count": 102, "source_count": 25, "head_count": 7}
NAMES = {"entity_count": "effective entities", "triple_count": "triples", "source_count": "sources", "head_count": "HAM10000 diseases"}


def status(graph: EvidenceGraph, head_type: str) -> DataFrame:
    """One row: entity_count, triple_count, source_count, head_count."""
    e = graph.entities.agg(F.count(F.lit(1)).alias("entity_count"), F.count_if(F.col("entity_type") == head_type).alias("head_count"))
    t = graph.triples.agg(F.count(F.lit(1)).alias("triple_count"))
    s = graph.sources.agg(F.count(F.lit(1)).alias("source_count"))
    return e.join(t, F.lit(True)).join(s, F.lit(True)).select("entity_count", "triple_count", "source_count", "head_count")  # one row each


def warnings(counts: DataFrame, expected: dict[str, int] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """(name, expected, actual, warning): counts that are not what they should be."""
    names = names or NAMES
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).cast("long").alias("expected"), F.col(k).alias("actual"), F.lit(names.get(k, k)).alias("shown")) for k, v in (expected or EXPECTED).items()])
    x = counts.select(F.explode(rows).alias("r")).select("r.*").where(F.col("expected") != F.col("actual"))
    said = F.concat(F.lit("Expected "), F.col("expected").cast("string"), F.lit(" "), F.col("shown"), F.lit(", got "), F.col("actual").cast("string"), F.lit("."))
    return x.select("name", "expected", "actual", said.alias("warning"))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """(key ..., n): keys that more than one row has."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def dangling(graph: EvidenceGraph) -> DataFrame:
    """(triple_id, side, id): end points of triples that no entity has."""
    ends = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("id")) for s in ("head", "tail")])
    return graph.triples.select("triple_id", F.explode(ends).alias("e")).select("triple_id", "e.*").join(graph.entities.select("id"), "id", "left_anti").select("triple_id", "side", "id")


def without_source(graph: EvidenceGraph) -> DataFrame:
    return graph.triples.join(graph.refs.join(graph.sources.select("source_id"), "source_id", "left_semi").select("triple_id"), "triple_id", "left_anti")


def copies_differ(graph: EvidenceGraph) -> DataFrame:
    """(triple_id, side): triples whose own copy of a name or type is not the entity's."""
    own = graph.entities.groupBy("id").agg(F.max_by(F.struct("name_cn", "entity_type"), "ord").alias("e")).select("id", "e.*")
    ends = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("id"), F.col(f"{s}_cn").alias("cn"), F.col(f"{s}_type").alias("type")) for s in ("head", "tail")])
    x = graph.triples.select("triple_id", F.explode(ends).alias("x")).select("triple_id", "x.*").join(own.hint("shuffle_hash"), "id")
    return x.where((F.col("cn") != F.col("name_cn")) | (F.col("type") != F.col("entity_type"))).select("triple_id", "side")


def checksum(df: DataFrame, *columns: str) -> DataFrame:
    """(n, checksum) of the rows in any order: their number and two sums of 60 bits of a digest each, so repeated rows show."""
    row = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns or df.columns]))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return df.agg(F.count(F.lit(1)).alias("n"), F.concat_ws("-", part(1), part(16)).alias("checksum"))


def relation_counts(triples: DataFrame) -> DataFrame:
    """(head_id, relation_en, n): evidence of each head by relation."""
    return triples.groupBy("head_id", "relation_en").agg(F.count(F.lit(1)).alias("n"))


def status_cube(triples: DataFrame, *by: str) -> DataFrame:
    """(by ..., n, n_heads, n_with_text, level): counts of triples by all subsets of the columns, in one pass over them. level is
    the grouping id: a set bit, from the first column down, is a column that is summed up."""
    return triples.cube(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("head_id").alias("n_heads"), F.count_if(F.col("evidence_text") != "").alias("n_with_text"), F.grouping_id().cast("long").alias("level")
    ).select(*by, "n", "n_heads", "n_with_text", "level")


def shapes(triples: DataFrame, share: float = 0.1, single: float = 0.99, rows: int | None = None) -> DataFrame:
    """(relation_en, heads, tails, n, functional): what a relation's ends are like, learnt from the triples themselves.

    heads and tails are the types that at least this share of the relation's triples have there; a relation is functional if at
    least `single` of its heads have one tail. rows: about how many triples there are; with it, tasks do not grow with them.
    """
    n = triples.groupBy("relation_en", "head_type", "tail_type").agg(F.count(F.lit(1)).alias("n"))
    side = lambda c: n.groupBy("relation_en", c).agg(F.sum("n").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("relation_en"))).where(F.col("n") >= share * F.col("all")).groupBy("relation_en").agg(F.sort_array(F.collect_list(c)).alias(f"{c}s"), F.first("all").alias("n"))
    tails = triples.select("relation_en", "head_id", "tail_id")
    tails = (dealt(tails, rows, "relation_en", "head_id") if rows else tails).distinct().groupBy("relation_en", "head_id").agg(F.count(F.lit(1)).alias("n"))
    one = tails.groupBy("relation_en").agg((F.count_if(F.col("n") == 1) >= single * F.count(F.lit(1))).alias("functional"))
    return side("head_type").join(side("tail_type").drop("n"), "relation_en").join(one, "relation_en").select("relation_en", F.col("head_types").alias("heads"), F.col("tail_types").alias("tails"), "n", "functional")


def shape_violations(triples: DataFrame, learnt: DataFrame, rows: int | None = None) -> DataFrame:
    """(triple_id, violation): triples against shapes() of these triples or of others: an unknown relation, a head or tail of
    another type, and, of a functional relation, every triple of a head with several tails.

    The shapes, a row a relation, are written once. The triples are passed over once for their types and once for heads with
    several tails. rows: as for shapes().
    """
    learnt = written(learnt.coalesce(1), "shapes")
    several = triples.join(learnt.where("functional").select("relation_en"), "relation_en", "left_semi").groupBy("relation_en", "head_id").agg((F.min("tail_id") != F.max("tail_id")).alias("several")).where("several")
    x = triples.select("triple_id", "relation_en", "head_id", "head_type", "tail_type")
    x = (dealt(x, rows, "relation_en", "head_id") if rows else x).join(learnt, "relation_en", "left").join(several, ["relation_en", "head_id"], "left")
    within = lambda c, allowed: F.coalesce(F.array_contains(allowed, F.col(c)), F.lit(False))
    known = F.col("n").isNotNull()
    found = {"relation": ~known, "domain": known & ~within("head_type", "heads"), "range": known & ~within("tail_type", "tails"), "cardinality": F.col("several")}
    return x.select("triple_id", F.explode(F.array(*[F.when(is_, F.lit(name)) for name, is_ in found.items()])).alias("violation")).where(F.col("violation").isNotNull())
