"""The registered queries over the trade graph, and SQL that computes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import analytics, anchors, checks, contain, context, evidence, lineage, observe, paths, prompts, resolve, snapshots
from ..sources.graph import explode_refs
from ..sources.logs import cited_paths, log_items
from ..sources.projection import PROFILE, trade_graph
from ..sources.shared import dealt, new_path
from .runs import analysis

HEAD, FEATURE = PROFILE.head_type, PROFILE.feature_type


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _part_ids(spark, d):
    """Every part by its id."""
    x = _t(spark, d, "part").select(F.concat(F.lit("PRT_"), F.col("p_partkey").cast("string")).alias("query"))
    return x.select(F.col("query").alias("query_id"), "query")


def _part_names(spark, d):
    """Every part name; most are shared by several parts."""
    return _t(spark, d, "part").select("p_name").distinct().select(F.concat(F.lit("N:"), F.col("p_name")).alias("query_id"), F.upper("p_name").alias("query"))


def _mixed_names(spark, d):
    """Brands in disguise, nations, and words that name nothing."""
    brands = _t(spark, d, "part").select("p_brand").distinct().select(F.concat(F.lit("B:"), F.col("p_brand")).alias("query_id"), F.concat(F.lit("\t "), F.upper("p_brand"), F.lit("  ")).alias("query"))
    nations = _t(spark, d, "nation").select(F.concat(F.lit("C:"), F.col("n_name")).alias("query_id"), F.lower("n_name").alias("query"))
    unknown = _t(spark, d, "region").select(F.concat(F.lit("U:"), F.col("r_name")).alias("query_id"), F.concat(F.lit("no "), F.col("r_name")).alias("query"))
    return brands.unionByName(nations).unionByName(unknown)


def _items(spark, d):
    return evidence.by_head(_part_ids(spark, d), trade_graph(spark, d), HEAD)


def _observations(spark, d):
    """What was said of each part; a third names its brand, a third its type, the rest nothing."""
    c = F.col
    said = F.when(c("p_partkey") % 3 == 0, F.concat(F.lit("Seen with "), F.upper("p_brand"), F.lit(" on it"))).when(c("p_partkey") % 3 == 1, F.concat(c("p_name"), F.lit(" is "), c("p_type"), F.lit(", so they say"))).otherwise("nothing known, of it")
    return _t(spark, d, "part").select(F.concat(F.lit("PRT_"), c("p_partkey").cast("string")).alias("query_id"), said.alias("observation"))


def kg_entities(spark, d):
    e = trade_graph(spark, d).entities
    return e.select(F.col("id").alias("entity_id"), "entity_type", "name_cn", "name_en", tx.first_item(F.col("alias")).alias("label"), "ord")


def list_heads(spark, d):
    return resolve.heads(trade_graph(spark, d).entities, HEAD)


def alias_explode(spark, d):
    e = trade_graph(spark, d).entities
    return e.select("id", F.posexplode(tx.split_list(F.col("alias"))).alias("pos", "item")).select("id", F.col("pos").cast("long").alias("pos"), "item")


def lookup_keys(spark, d):
    return resolve.lookup_keys(trade_graph(spark, d).entities).select("key", "id", "entity_type")


def resolve_all(spark, d):
    return resolve.resolve_all(_mixed_names(spark, d), resolve.lookup_keys(trade_graph(spark, d).entities)).select("query_id", "id")


def resolve_first(spark, d):
    return resolve.resolve_first(_part_names(spark, d).unionByName(_mixed_names(spark, d)), resolve.lookup_keys(trade_graph(spark, d).entities)).select("query_id", "id", "entity_type")


def resolve_ranked(spark, d):
    return resolve.resolve_ranked(_mixed_names(spark, d), trade_graph(spark, d).entities)


def resolve_outcome(spark, d):
    g = trade_graph(spark, d)
    return resolve.feature_outcome(_mixed_names(spark, d), resolve.lookup_keys(g.entities), g.triples, FEATURE, HEAD)


def head_outcome(spark, d):
    g = trade_graph(spark, d)
    return resolve.head_outcome(_part_names(spark, d).unionByName(_mixed_names(spark, d)), resolve.lookup_keys(g.entities), g.triples, HEAD)


_ITEM = ("query_id", "triple_id", "head_id", "head_name", "relation_en", "tail_id", "tail_name", "tail_type", "evidence_text", "source_id", "source_name", "source_type", "ord")


def evidence_by_head(spark, d):
    return evidence.by_head(_part_names(spark, d), trade_graph(spark, d), HEAD).select(*_ITEM)


def evidence_by_relation(spark, d):
    q = _part_names(spark, d).withColumn("relation", F.lit(" Has_Brand "))
    return evidence.by_relation(q, trade_graph(spark, d), HEAD).select(*_ITEM)


def reverse_lookup(spark, d):
    return evidence.by_feature(_mixed_names(spark, d), trade_graph(spark, d), FEATURE, HEAD).select(*_ITEM)


def source_attach_last_wins(spark, d):
    g = trade_graph(spark, d)
    return evidence.attach_sources(evidence.triples_of(g), g).select("triple_id", "source_id", "source_name", "source_type")


def endpoint_enrich(spark, d):
    g = trade_graph(spark, d)
    return evidence.enrich(evidence.triples_of(g), g).select("triple_id", "head_name", "head_type", "tail_name", "tail_type", "source_name")


def section_counts(spark, d):
    return context.section_counts(_items(spark, d), PROFILE)


def context_summary(spark, d):
    return context.summary(_items(spark, d), PROFILE)


def section_first_appearance(spark, d):
    return context.first_appearance(_items(spark, d), PROFILE)


def section_fill(spark, d):
    x = context.filled(_part_ids(spark, d), context.section_counts(_items(spark, d), PROFILE), PROFILE)
    return x.select("query_id", "section", F.col("section_ord").cast("long").alias("section_ord"), F.coalesce("n_items", F.lit(0)).alias("n_items"))


def source_dedup_first(spark, d):
    return context.sources_of(_items(spark, d))


def source_dedup_text(spark, d):
    return context.sources_by_label(_items(spark, d))


def distinct_heads(spark, d):
    return context.distinct_heads(evidence.by_head(_part_names(spark, d), trade_graph(spark, d), HEAD))


def _heads(spark, d):
    e = trade_graph(spark, d).entities.where(F.col("entity_type") == HEAD)
    return e.select(F.col("id").alias("query_id"), "id", "name_cn", "name_en")


def context_markdown(spark, d):
    return context.markdown(_part_ids(spark, d), _items(spark, d), _heads(spark, d), PROFILE)


def context_research(spark, d):
    q = _part_ids(spark, d).unionByName(_mixed_names(spark, d))
    g = trade_graph(spark, d)
    return context.research_markdown(q, evidence.by_head(q, g, HEAD), g.entities, PROFILE)


def plain_listing(spark, d):
    return context.plain_listing(_items(spark, d))


def observation_match(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    needles = _t(spark, d, "benchmark").select("item_id", F.lower("text").alias("needle"))
    return contain.containing(docs, needles).select("doc_id", "item_id")


def clause_match(spark, d):
    parts = _t(spark, d, "documents").select(F.explode(tx.clauses(F.col("text"), "[,.]")).alias("clause")).distinct()
    texts = _t(spark, d, "benchmark").select("item_id", F.lower("text").alias("text"))
    return contain.containing(texts, parts, "text", "clause").select("clause", "item_id")


def observed_evidence(spark, d):
    items = _items(spark, d)
    hits = observe.match_items(_observations(spark, d), items, PROFILE)
    return observe.match_order(hits, items, PROFILE).select("query_id", "triple_id", "place")


def buckets_union(spark, d):
    return observe.buckets(_items(spark, d), PROFILE).select("query_id", "bucket", "place", "triple_id")


def bucket_topk(spark, d):
    g = trade_graph(spark, d)
    first = observe.top_of_buckets(observe.buckets(evidence.triples_by_head(_part_ids(spark, d), g, HEAD), PROFILE), {"supporting_evidence": 3, "medical_advice_or_exams": 2})
    return observe.shown(evidence.items_of(first, g, "bucket", "place")).select("query_id", "bucket", "place", "evidence_path", "shown_text", "shown_source")


def insufficient_flags(spark, d):
    items, q = _items(spark, d), _part_ids(spark, d)
    x = observe.insufficient(q, observe.match_items(_observations(spark, d), items, PROFILE), items, PROFILE)
    return x.select("query_id", "no_match", "no_differential", "no_risk", F.array_join("messages", "\n").alias("messages"))


def candidates_or_all(spark, d):
    g = trade_graph(spark, d)
    q = _mixed_names(spark, d)
    return observe.candidates_or_all(evidence.by_feature(q, g, FEATURE, HEAD).select("query_id", F.col("head_id").alias("entity_id")).distinct(), q)


def entity_search(spark, d):
    """Every brand's digits and every region's name, each in other case and with blanks."""
    brands = _t(spark, d, "part").select("p_brand").distinct().select(F.concat(F.lit("B:"), F.col("p_brand")).alias("query_id"), F.concat(F.lit(" BRAND#"), F.regexp_replace("p_brand", "[^0-9]", "")).alias("query"))
    regions = _t(spark, d, "region").select(F.concat(F.lit("R:"), F.col("r_name")).alias("query_id"), F.concat(F.lower("r_name"), F.lit(" ")).alias("query"))
    return resolve.search(brands.unionByName(regions), trade_graph(spark, d).entities).select("query_id", "id", "entity_type")


def source_list(spark, d):
    """Sources with how many triples each speaks for."""
    g = trade_graph(spark, d)
    n = g.refs.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_triples"))
    return g.sources.join(n, "source_id", "left").select("source_id", "source_name", "source_type", F.coalesce("n_triples", F.lit(0)).alias("n_triples"))


def reverse_heads(spark, d):
    """The reverse lookup with the head row of each item."""
    g = trade_graph(spark, d)
    x = evidence.with_heads(evidence.by_feature(_mixed_names(spark, d), g, FEATURE, HEAD), g, HEAD)
    return x.select("query_id", "triple_id", "head_row.entity_id", "head_row.name_cn", "head_row.name_en", "head_row.label")


def items_nested(spark, d):
    x = evidence.nested(evidence.by_head(_part_names(spark, d), trade_graph(spark, d), HEAD))
    return x.select("query_id", "triple_id", *[F.to_json(c).alias(c) for c in ("head", "relation", "tail")], "source")


def refs_by_list(spark, d):
    """The exploded lists of sources whose lists are written with irregular separators."""
    s = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("s")).groupBy("k").agg(F.array_join(context.in_order(F.concat(F.lit("T"), F.col("s").cast("string")), "s"), " ， ").alias("used_for_triples"))
    s = s.select(F.concat(F.lit("SRC_"), F.col("k").cast("string")).alias("source_id"), F.concat(F.lit(","), F.col("used_for_triples"), F.lit("; |")).alias("used_for_triples"), F.col("k").cast("long").alias("ord"))
    return explode_refs(s)


def care_level(spark, d):
    x = observe.care_level(_t(spark, d, "events").select("event_id", "event_type", "props"), "event_type", "props", urgent="purchase|refund", consult="click|view", levels=("high", "medium", "low"))
    return x.select("event_id", "care_level")


def labels_rendered(spark, d):
    g = trade_graph(spark, d)
    c = F.col
    x = evidence.attach_sources(evidence.triples_of(g), g)
    return x.select(
        "triple_id", tx.path(c("head_cn"), c("relation_cn"), c("tail_cn"), " → ").alias("arrow_path"), tx.source_label(c("source_name"), c("source_id"), c("source_type")).alias("label"),
        tx.source_label_screen(c("source_name"), c("source_id"), c("source_type")).alias("screen_label"), tx.source_line(c("source_name"), c("source_id"), c("source_type")).alias("line"),
        tx.source_plain(c("source"), c("source_id"), c("source_type")).alias("plain"), tx.text_or_placeholder(c("evidence_text")).alias("shown_text"),
    )


def head_labels(spark, d):
    x = list_heads(spark, d)
    return x.select("entity_id", tx.head_label(F.col("name_cn"), F.col("name_en"), F.col("label")).alias("shown"), tx.url_part(F.col("name_en")).alias("encoded"))


def graph_status(spark, d):
    return checks.status(trade_graph(spark, d), HEAD)


def expectation_warnings(spark, d):
    return checks.warnings(checks.status(trade_graph(spark, d), HEAD))


def relation_counts(spark, d):
    return checks.relation_counts(trade_graph(spark, d).triples)


def dup_check(spark, d):
    return checks.duplicates(resolve.lookup_keys(trade_graph(spark, d).entities), "key")


def dangling_nodes(spark, d):
    """Of the graph as it is; tests plant dangling ends."""
    return checks.dangling(trade_graph(spark, d))


def missing_sources(spark, d):
    return checks.without_source(trade_graph(spark, d)).select("triple_id", "relation_en")


def copies_differ(spark, d):
    """Of the graph as it is; tests plant copies that differ."""
    return checks.copies_differ(trade_graph(spark, d))


def status_cube(spark, d):
    g = trade_graph(spark, d)
    return checks.status_cube(evidence.attach_sources(evidence.triples_of(g), g), "head_type", "relation_en", "source_type")


def shape_violations(spark, d):
    """Of the graph as it is: what a tenth of a relation's triples have is its shape, so suppliers are too few to be located."""
    t, n = trade_graph(spark, d).triples, _t(spark, d, "lineitem").count()
    return checks.shape_violations(t, checks.shapes(t, rows=n), n)


def version_diff(spark, d):
    """A later version of the graph, in which parts are dropped, said to be otherwise, or come in, against the graph as it is."""
    c = F.col
    t, old, new = trade_graph(spark, d).triples, new_path(spark, "version"), new_path(spark, "version")
    snapshots.snapshot(t, "triple_id", old)
    t = spark.read.parquet(f"{old}/rows").select(*t.columns)  # as written: the graph is made once
    number = F.when(c("head_id").startswith("PRT_"), F.substring("head_id", 5, 20).cast("long"))
    later = t.where(~F.coalesce(number % 97 == 0, F.lit(False))).withColumns({"evidence_text": F.when(number % 89 == 0, F.concat("evidence_text", F.lit("."))).otherwise(c("evidence_text")), "note": F.when(number % 178 == 0, "later").otherwise(c("note"))})
    more = t.where((number % 83 == 0) & (c("relation_en") == "has_type")).withColumn("triple_id", F.concat(F.lit("X"), c("triple_id")))
    snapshots.snapshot(later.unionByName(more), "triple_id", new)
    return snapshots.diff(spark, old, new, "triple_id").select("triple_id", "change", F.array_join("columns", ",").alias("columns"))


def graph_checksum(spark, d):
    return checks.checksum(trade_graph(spark, d).triples)


def _asked(spark, d):
    c = F.col
    return _observations(spark, d).withColumn("candidate", F.when(c("query_id").endswith("7"), F.lit(" \t")).otherwise(F.concat(F.lit(" "), c("query_id"), F.lit(" "))))


def _prompted(spark, d, version):
    c, q = F.col, _asked(spark, d)
    marks = context.section_counts(_items(spark, d), PROFILE).groupBy("query_id").agg(F.array_join(context.in_order(F.concat(c("section"), F.lit(" "), c("n_items").cast("string")), "section"), "\n").alias("context"))
    return prompts.prompts(q, marks, version)


def _research(spark, d):
    """Every part's evidence as version 2's builder takes it."""
    g, q = trade_graph(spark, d), _part_ids(spark, d)
    return context.research_markdown(q, evidence.by_head(q, g, HEAD), g.entities, PROFILE)


def prompt_render(spark, d):
    return _prompted(spark, d, prompts.V1)


def prompt_second(spark, d):
    """Version 2 over the whole evidence of each part."""
    return prompts.prompts(_asked(spark, d), _research(spark, d), prompts.V2)


def prompt_general(spark, d):
    return _prompted(spark, d, "no such version")


def safety_supplement(spark, d):
    """User turns as prompts; a rule list is added where one lacks the marker."""
    x = _t(spark, d, "conversations")
    return x.select("conv_id", "turn", tx.numbered(F.array(F.lit("a"), F.lit("b"))).alias("listed"), F.sha2(prompts.with_safety(F.col("text"), None, "the"), 256).alias("prompt_sha256"))


def forbidden_phrase_check(spark, d):
    return prompts.check_phrases(_t(spark, d, "documents").select("doc_id", "text"), ["worthless", "trash", "disgusting"]).select("doc_id", "clean")


def candidate_scores(spark, d):
    """Customers as tasks, brands as candidates: how much of what a customer bought, paid and kept bears a brand."""
    c = F.col
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    n = lines.count()
    x = dealt(lines, n, "l_orderkey").join(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey")).select("o_custkey", "l_partkey", "l_quantity", "l_returnflag")
    x = dealt(x, n, "l_partkey").join(_t(spark, d, "part").select("p_partkey", "p_brand", "p_size"), c("l_partkey") == c("p_partkey")).select("o_custkey", "p_brand", "p_size", "l_quantity", "l_returnflag")
    x = dealt(x, n, "o_custkey").groupBy("o_custkey", "p_brand").agg(F.count(F.lit(1)).alias("mf"), F.count_if(c("p_size") > 25).alias("ml"), F.count_if(c("l_quantity") > 25).alias("ms"), F.count_distinct("l_returnflag").alias("kinds"), F.count_if(c("l_returnflag") == "R").alias("cf"))
    s = analytics.score(analytics.Weights(), c("mf"), c("ml"), c("ms"), c("kinds") / F.lit(3.0), c("cf"))
    return x.withColumn("score", F.round(s, 6))


def candidate_rank_top3(spark, d):
    return analytics.ranked(candidate_scores(spark, d), "o_custkey", "score", "p_brand").select("o_custkey", "p_brand", "mf", "ml", "ms", "cf", "score", "rank_order")


def _claims(spark, d):
    c = F.col
    at = _t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    x = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag").join(at, c("l_suppkey") == c("s_suppkey"))
    x = x.select(c("l_partkey").alias("part"), c("l_suppkey").alias("supplier"), c("s_nationkey").alias("nation"), "l_returnflag")
    claims = x.where(c("l_returnflag") == "R").select("part", "supplier", "nation").distinct()
    return claims, x.where(c("l_returnflag") != "R").select("part", "supplier", "nation")


def claim_status(spark, d):
    claims, others = _claims(spark, d)
    return analytics.claim_status(claims, others, "part", "supplier", "nation")


def oehr_ucr_pcs_ecr(spark, d):
    """Per nation: claims as above; anchors are its suppliers, matched ones support a claim; evidence types are return flags."""
    c = F.col
    claims, others = _claims(spark, d)
    status = analytics.claim_status(claims, others, "part", "supplier", "nation")
    m = analytics.claim_metrics(status, "nation")
    good = status.where(c("status") == analytics.SUPPORTED).select("supplier").distinct().withColumn("hit", F.lit(True))
    anchors = _t(spark, d, "supplier").select(c("s_suppkey").alias("supplier"), c("s_nationkey").alias("nation")).join(good, "supplier", "left")
    o = analytics.observation_hit_rate(anchors, F.coalesce(c("hit"), F.lit(False)), "nation")
    kinds = _t(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity").join(_t(spark, d, "supplier").select("s_suppkey", c("s_nationkey").alias("nation")), c("l_suppkey") == c("s_suppkey"))
    e = analytics.coverage_rate(kinds.where(c("l_quantity") >= 50), kinds, "l_returnflag", "nation")
    x = o.join(m, "nation", "left").join(e, "nation", "left")
    return x.select("nation", "n_anchors", *[F.round(k, 9).alias(k) for k in ("oehr", "ucr", "pcs", "ecr")], "n_supported", "n_partial", "n_unsupported", "n_not_verifiable", "n_mapped")


def _starts(spark, d):
    return trade_graph(spark, d).entities.where(F.col("entity_type") == HEAD).select("id")


def paths_2hop(spark, d):
    t = trade_graph(spark, d).triples.where(F.col("relation_en").isin("supplied_by", "located_in"))
    x = analytics.hops(_starts(spark, d), t, 2, _t(spark, d, "lineitem").count())
    return x.select("start", "end", "n_hops", F.array_join("nodes", ">").alias("nodes"), F.array_join("relations", ">").alias("relations"), F.array_join("triple_ids", ">").alias("triple_ids"))


def path_rank(spark, d):
    """Every path from a part over every relation: the longest ends in a region, three hops away."""
    n = _t(spark, d, "lineitem").count()
    x = analytics.ranked_paths(analytics.hops(_starts(spark, d), trade_graph(spark, d).triples, 3, n, (), True))
    return x.select("start", "end", "n_hops", F.array_join("triple_ids", ">").alias("triple_ids"), F.round("retrieval_score", 9).alias("retrieval_score"), "path_rank")


def _costed(spark, d):
    """The triples with whole costs; what is located or supplied somewhere without a text is background or missing evidence."""
    c = F.col
    cost = F.when(c("relation_en") == "supplied_by", 20 + c("ord") % 11).when(c("relation_en") == "has_brand", 10).when(c("relation_en") == "has_type", 12).otherwise(5 + c("ord") % 3)
    kind = F.when(c("evidence_text") != "", "support").when(c("relation_en") == "supplied_by", "missing").otherwise("background")
    return trade_graph(spark, d).triples.select("head_id", "tail_id", "triple_id", cost.alias("cost"), kind.alias("support_type"))


def evidence_paths_topk(spark, d):
    """The two cheapest paths of up to three hops from every part to everything it leads to."""
    x = paths.best_paths(_starts(spark, d), _costed(spark, d), 2, 3)
    return x.select("start", "end", "path_rank", "cost", "n_hops", F.array_join("nodes", ">").alias("nodes"), F.array_join("triple_ids", ">").alias("triple_ids"), "support_type")


def _customer_claims(spark, d):
    """Of each returned line: that its supplier's part comes from where the customer is. A third says nothing of the way, a third
    that the nation is, and a third, with any last step, that the region is."""
    c = F.col
    at = _t(spark, d, "supplier").select("s_suppkey", c("s_nationkey").alias("supplied_from"))
    home = _t(spark, d, "orders").select("o_orderkey", "o_custkey").join(_t(spark, d, "customer").select("c_custkey", c("c_nationkey").alias("nation")), c("o_custkey") == c("c_custkey"))
    x = _t(spark, d, "lineitem").where(c("l_returnflag") == "R").select("l_orderkey", "l_partkey", "l_suppkey").join(home, c("l_orderkey") == c("o_orderkey")).join(at, c("l_suppkey") == c("s_suppkey"))
    x = x.select(c("l_partkey").alias("part"), c("l_suppkey").alias("supplier"), "nation").distinct().join(_t(spark, d, "nation").select(c("n_nationkey").alias("nation"), "n_regionkey"), "nation")
    sequence = lambda *names: F.array(*map(F.lit, names)).cast("array<string>")
    kind = c("part") % 3
    x = x.withColumns({
        "head": F.concat(F.lit("PRT_"), c("part").cast("string")), "relations": F.when(kind == 0, sequence()).when(kind == 1, sequence("supplied_by", "located_in")).otherwise(sequence("supplied_by", "located_in", paths.ANY)),
        "tail": F.when(kind == 2, F.concat(F.lit("REG_"), c("n_regionkey").cast("string"))).otherwise(F.concat(F.lit("NAT_"), c("nation").cast("string"))),
    })
    return paths.path_consistent(x, trade_graph(spark, d).triples)


def claims_by_path(spark, d):
    return _customer_claims(spark, d).select("part", "supplier", "nation", "tail", "mapped", "consistent")


def pcs_by_path(spark, d):
    """Claims of a nation that stand as paths, beside those that a line not returned speaks for."""
    c = F.col
    at = _t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    others = _t(spark, d, "lineitem").where(c("l_returnflag") != "R").select("l_partkey", "l_suppkey").join(at, c("l_suppkey") == c("s_suppkey")).select(c("l_partkey").alias("part"), c("l_suppkey").alias("supplier"), c("s_nationkey").alias("nation"))
    x = analytics.claim_metrics(analytics.claim_status(_customer_claims(spark, d), others, "part", "supplier", "nation"), "nation", mapped=c("mapped"), consistent=c("consistent"))
    return x.select("nation", "n_supported", "n_unsupported", "n_mapped", "n_consistent", F.round("pcs", 9).alias("pcs"))


def anchor_spans(spark, d):
    """What the observations name."""
    x = anchors.anchors(_observations(spark, d), trade_graph(spark, d).entities, text="observation")
    return x.select("query_id", F.col("start").cast("long").alias("start"), "raw_text", "anchor_type", "entity_id", "method", "confidence", "n_entities")


ANCHOR_RULES = (anchors.Rule(r"brand no\. (\d+)", r"brand#\1", "Brand", 0.8), anchors.Rule(r"(?:see|size) no\. (\d+)", r"size \1", "Part", 0.6))


def anchor_rules(spark, d):
    """Labels that only rules can read, beside names that they leave alone; a third of the brands is none."""
    c = F.col
    kind, number = c("p_partkey") % 3, F.regexp_replace("p_brand", "[^0-9]", "")
    said = F.when(kind == 0, F.concat(F.lit("See "), c("p_brand"), F.lit(" by its label brand no. "), number)).when(kind == 1, F.concat(F.lit("Size no. "), c("p_size"), F.lit(" of Brand no. "), number, F.lit("9"))).otherwise(F.concat(c("p_type"), F.lit(", see no. "), c("p_size")))
    x = _t(spark, d, "part").select(F.concat(F.lit("PRT_"), c("p_partkey").cast("string")).alias("query_id"), said.alias("text"))
    x = anchors.anchors(x, trade_graph(spark, d).entities, ANCHOR_RULES)
    return x.select("query_id", F.col("start").cast("long").alias("start"), "raw_text", "anchor_type", "entity_id", "method", "confidence", "n_entities")


def _logs(spark, d):
    """A log a part: a title, the part, and its evidence, numbered; every fifth cites paths with another word between."""
    c = F.col
    fields = F.concat(F.lit("\n\n* 证据路径："), tx.path(c("head_cn"), F.when(F.substring("query_id", 5, 20).cast("long") % 5 == 0, "goes with").otherwise(c("relation_cn")), c("tail_cn"), " — "), F.lit("\n* evidence_text："), tx.text_or_placeholder(c("evidence_text")))
    x = _items(spark, d).groupBy("query_id").agg(context.in_order(fields, "ord", "triple_id").alias("said"))
    body = F.array_join(F.transform("said", lambda t, i: F.concat((i + 1).cast("string"), F.lit("."), t)), "\n\n")
    return x.select(c("query_id").alias("case_id"), F.concat(F.lit("# "), c("query_id"), F.lit("\n\n候选： "), c("query_id"), F.lit("\n\n支持证据：\n"), body, F.lit("\n")).alias("text"))


def log_rows(spark, d):
    return log_items(_logs(spark, d)).select("case_id", "section", F.col("item").cast("long").alias("item"), "field", "value")


def log_metrics(spark, d):
    return cited_paths(log_items(_logs(spark, d)), trade_graph(spark, d).triples)


def analysis_run(spark, d):
    """The full analysis of what was said of each part, stage by stage in a folder of its own."""
    return analysis(spark, new_path(spark, "run"), _observations(spark, d), trade_graph(spark, d), HEAD).run()


def report_lineage(spark, d):
    """Orders as versions of a customer's report: every fourth goes back to the first one, and no fourth number is used."""
    c = F.col
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumns({"nth": F.row_number().over(w), "before": F.lag("o_orderkey").over(w), "first": F.first("o_orderkey").over(w)})
    x = x.select("o_orderkey", F.when(c("nth") == 1, F.lit(None)).when(c("nth") % 4 == 0, c("first")).otherwise(c("before")).alias("parent"), (c("nth") + F.when(c("nth") > 3, 1).otherwise(0)).alias("version_no"))
    x = lineage.lineage(x, "o_orderkey", "parent", "version_no")
    return x.select("id", "root", "depth", "is_leaf", "current", "is_current", "n_versions", "n_forks", "n_gaps", "orphan", "cyclic")


def subgraph_edges(spark, d):
    """What lies within two hops of each part."""
    return analytics.subgraph(_starts(spark, d), trade_graph(spark, d).triples, 2, _t(spark, d, "lineitem").count())


def current_version(spark, d):
    x = analytics.versions(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")
    return x.select("o_custkey", "o_orderkey", "version_no", "is_current", F.coalesce("previous", F.lit(0)).cast("long").alias("previous"))


def timeline_lag(spark, d):
    x = analytics.timeline(_t(spark, d, "events"), "user_id", "ts", "event_id", "event_type")
    return x.select("event_id", "before", "after", F.coalesce("gap_s", F.lit(-1)).cast("long").alias("gap_s"))


def experiment_summary(spark, d):
    c = F.col
    x = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    return analytics.experiment_summary(x.withColumnRenamed("n_chars", "chars"), ["source", "lang"], ["quality", "toxic"], ["chars"])


QUERIES = {
    f.__name__: f
    for f in (
        kg_entities, list_heads, alias_explode, lookup_keys, resolve_all, resolve_first, resolve_ranked, resolve_outcome, head_outcome, evidence_by_head, evidence_by_relation, reverse_lookup,
        source_attach_last_wins, endpoint_enrich, section_counts, context_summary, section_first_appearance, section_fill, source_dedup_first, source_dedup_text, distinct_heads, context_markdown,
        context_research, plain_listing, observation_match, clause_match, observed_evidence, buckets_union, bucket_topk, insufficient_flags, candidates_or_all, entity_search, source_list, reverse_heads, items_nested, refs_by_list, care_level, labels_rendered, head_labels,
        graph_status, expectation_warnings, relation_counts, dup_check, dangling_nodes, missing_sources, copies_differ, status_cube, shape_violations, version_diff, graph_checksum, prompt_render, prompt_second, prompt_general, safety_supplement,
        forbidden_phrase_check, candidate_scores, candidate_rank_top3, claim_status, oehr_ucr_pcs_ecr, paths_2hop, path_rank, evidence_paths_topk, claims_by_path, pcs_by_path, anchor_spans, anchor_rules, analysis_run, log_rows, log_metrics, report_lineage, subgraph_edges, current_version, timeline_lag, experiment_summary,
    )
}
