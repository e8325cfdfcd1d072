"""Observations against evidence: which items an observation speaks of, and what an explanation is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import advice_level, clauses, observed, path, source_label, text_or_placeholder
from .context import sectioned
from .profile import Profile

# What is said where evidence is lacking, and where none is.
LACKS_MATCH = "给定证据不足：用户观察未能与当前图谱证据形成明确匹配。"
LACKS_DIFFERENTIAL = "给定证据不足：当前图谱未提供可用鉴别诊断证据。"
LACKS_RISK = "给定证据不足：当前图谱未提供可用风险提示证据。"
LACKS_NOTHING = "给定证据不足的内容：无。"
MATCH_NOTE = "用户描述与图谱证据中的实体或证据文本存在对应关系。"

def match_items(observations: DataFrame, items: DataFrame, profile: Profile) -> DataFrame:
    """Items that an observation speaks of. observations: (query_id, observation), items: (query_id, item ...).

    Both sides share query_id, so an observation meets only its own candidate's evidence. Lower-casing and clause splitting
    happen once a row, ahead of the join.
    """
    o = observations.select("query_id", "observation", F.lower("observation").alias("o_low"), clauses(F.col("observation"), profile.clause_separator).alias("o_parts"))
    x = items.withColumns({"t_low": F.lower("tail_name"), "e_low": F.lower("evidence_text")})
    x = o.join(x, "query_id").where(observed(F.col("o_low"), F.col("o_parts"), F.col("t_low"), F.col("e_low")))
    return x.drop("o_low", "o_parts", "t_low", "e_low")


def match_order(matches: DataFrame, items: DataFrame, profile: Profile) -> DataFrame:
    """Matches with place: by first appearance of their section, then by ord."""
    first = sectioned(items, profile).groupBy("query_id", "section").agg(F.min("ord").alias("first_ord"))
    x = sectioned(matches, profile).join(first, ["query_id", "section"])
    return x.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first_ord", "section", "ord", "triple_id")).cast("long"))


def shown(items: DataFrame) -> DataFrame:
    c = F.col
    return items.withColumns({"evidence_path": path(c("head_name"), c("relation_cn"), c("tail_name")), "shown_text": text_or_placeholder(c("evidence_text")), "shown_source": source_label(c("source_name"), c("source_id"), c("source_type"))})


def buckets(items: DataFrame, profile: Profile) -> DataFrame:
    """Items with bucket and place: supporting and advice evidence one section after the other, then differential and risk."""
    order = [("supporting_evidence", profile.supporting), ("differential_diagnosis", (profile.differential,)), ("risk_warnings", (profile.risk,)), ("medical_advice_or_exams", profile.advice)]
    table = items.sparkSession.createDataFrame([(s, b, i) for b, of in order for i, s in enumerate(of)], "section string, bucket string, part int")
    out = sectioned(items, profile).join(F.broadcast(table), "section")  # a row a section and bucket: a section may stand in several
    return out.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy("part", "ord", "triple_id")).cast("long")).drop("part")


def top_of_buckets(bucketed: DataFrame, most: dict[str, int]) -> DataFrame:
    """The first items of each named bucket."""
    limit = F.create_map(*[F.lit(x) for kv in most.items() for x in kv])
    return bucketed.where(F.col("bucket").isin(*most) & (F.col("place") <= F.element_at(limit, F.col("bucket"))))


def insufficient(queries: DataFrame, matches: DataFrame, items: DataFrame, profile: Profile) -> DataFrame:
    """(query_id, no_match, no_differential, no_risk, messages): what evidence is lacking, or one message that none is. Only items
    of a section count, matches too."""
    m = sectioned(matches, profile).groupBy("query_id").agg(F.count(F.lit(1)).alias("m"))
    s = sectioned(items, profile).groupBy("query_id").agg(F.count_if(F.col("section") == profile.differential).alias("d"), F.count_if(F.col("section") == profile.risk).alias("r"))
    x = queries.select("query_id").join(m, "query_id", "left").join(s, "query_id", "left")
    flags = {"no_match": F.coalesce("m", F.lit(0)) == 0, "no_differential": F.coalesce("d", F.lit(0)) == 0, "no_risk": F.coalesce("r", F.lit(0)) == 0}
    x = x.select("query_id", *[v.alias(k) for k, v in flags.items()])
    said = F.array_compact(F.array(*[F.when(F.col(k), F.lit(v)) for k, v in (("no_match", LACKS_MATCH), ("no_differential", LACKS_DIFFERENTIAL), ("no_risk", LACKS_RISK))]))
    return x.withColumn("messages", F.when(F.size(said) > 0, said).otherwise(F.array(F.lit(LACKS_NOTHING))))


def care_level(rows: DataFrame, *columns: str, **levels) -> DataFrame:
    """Rows with care_level, judged on the JSON of the given columns."""
    return rows.withColumn("care_level", advice_level(F.to_json(F.struct(*columns)), **levels))


def candidates_or_all(matched: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, entity_id, all_heads): the heads that a query matched; for a query that matched none one row without an entity
    that says so, as its candidates are all heads. Whoever shows these reads the list of heads page by page."""
    none = queries.select("query_id").join(matched, "query_id", "left_anti").select("query_id", F.lit(None).cast("string").alias("entity_id"), F.lit(True).alias("all_heads"))
    return matched.select("query_id", "entity_id", F.lit(False).alias("all_heads")).unionByName(none)
