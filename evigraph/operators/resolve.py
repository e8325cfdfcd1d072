"""From free-form names to entities. Queries come as a table (query_id, query); one query is a table of one row.

Names match exactly after trimming and lower-casing, never in part. Every name of an entity becomes a row of a key table, so a
match is an equality join instead of a scan over alternatives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_item, norm, split_list
from .contain import containing

OK, NO_ENTITY, NO_HEAD, NO_EVIDENCE = "OK", "KG_ENTITY_NOT_FOUND", "KG_DISEASE_NOT_FOUND", "KG_EVIDENCE_NOT_FOUND"


def lookup_keys(entities: DataFrame) -> DataFrame:
    """(key, id, entity_type, ord): id, both names and every alias. Blank names are keys too; blank aliases are not."""
    keys = F.concat(F.array("id", "name_cn", "name_en"), split_list(F.col("alias")))
    return entities.select(F.explode(F.array_distinct(F.transform(keys, norm))).alias("key"), "id", "entity_type", "ord")


def resolve_all(queries: DataFrame, keys: DataFrame, entity_type: str | None = None) -> DataFrame:
    """(query_id, id, entity_type, ord): all entities that a query names."""
    keys = keys.where(F.col("entity_type") == entity_type) if entity_type else keys
    q = queries.select("query_id", norm(F.col("query")).alias("key"))
    return q.join(keys, "key").select("query_id", "id", "entity_type", "ord").distinct()


def resolve_first(queries: DataFrame, keys: DataFrame, entity_type: str | None = None) -> DataFrame:
    """(query_id, id, entity_type, ord): of several entities the first of the input."""
    found = resolve_all(queries, keys, entity_type)
    return found.groupBy("query_id").agg(F.min_by(F.struct("id", "entity_type", "ord"), F.struct("ord", "id")).alias("e")).select("query_id", "e.*")


def resolve_ranked(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, id, method): each match with the strongest way that it came about: exact id or name, then alias."""
    exact = entities.select(F.explode(F.array_distinct(F.transform(F.array("id", "name_cn", "name_en"), norm))).alias("key"), "id", F.lit("exact").alias("method"))
    alias = entities.select(F.explode(F.array_distinct(F.transform(split_list(F.col("alias")), norm))).alias("key"), "id", F.lit("alias").alias("method"))
    q = queries.select("query_id", norm(F.col("query")).alias("key"))
    return q.join(exact.unionByName(alias), "key").groupBy("query_id", "id").agg(F.max("method").alias("method"))


def head_outcome(queries: DataFrame, keys: DataFrame, triples: DataFrame, head_type: str) -> DataFrame:
    """(query_id, outcome) of a lookup by head: no such head, no evidence, or OK."""
    heads = resolve_all(queries, keys, head_type)
    with_evidence = heads.join(triples.select(F.col("head_id").alias("id")), "id", "left_semi").select("query_id").distinct().withColumn("has_evidence", F.lit(True))
    out = queries.select("query_id").join(heads.select("query_id").distinct().withColumn("known", F.lit(True)), "query_id", "left").join(with_evidence, "query_id", "left")
    return out.select("query_id", F.when(F.col("known").isNull(), NO_HEAD).when(F.col("has_evidence").isNull(), NO_EVIDENCE).otherwise(OK).alias("outcome"))


def feature_outcome(queries: DataFrame, keys: DataFrame, triples: DataFrame, feature_type: str, head_type: str) -> DataFrame:
    """(query_id, outcome) of a lookup by feature. An entity of any type must bear the name, a feature must have evidence."""
    known = resolve_all(queries, keys).select("query_id").distinct().withColumn("known", F.lit(True))
    own = resolve_all(queries, keys, feature_type).select("query_id", "id")
    tails = triples.where(F.col("head_type") == head_type).select(F.col("tail_id").alias("id"))
    hit = own.join(tails, "id", "left_semi").select("query_id").distinct().withColumn("hit", F.lit(True))
    out = queries.select("query_id").join(known, "query_id", "left").join(hit, "query_id", "left")
    return out.select("query_id", F.when(F.col("known").isNull(), NO_ENTITY).when(F.col("hit").isNull(), NO_EVIDENCE).otherwise(OK).alias("outcome"))


def heads(entities: DataFrame, head_type: str) -> DataFrame:
    """(entity_id, name_cn, name_en, label, ord): all heads; the label is the first alias."""
    return entities.where(F.col("entity_type") == head_type).select(F.col("id").alias("entity_id"), "name_cn", "name_en", first_item(F.col("alias")).alias("label"), "ord")


def search(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, id, entity_type, ord): entities with a name, an alias or an id that holds the query's words, literally and in
    any case. A blank query finds nothing."""
    keys = lookup_keys(entities)
    q = queries.select("query_id", norm(F.col("query")).alias("needle")).where(F.col("needle") != "")
    return containing(keys, q, "key", "needle").select("query_id", "id", "entity_type", "ord").distinct()
