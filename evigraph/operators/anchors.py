"""Anchors: what free text names of the graph, span by span.

Names and aliases are looked for by the automata of `contain`. Of what is found the leftmost span counts, of several there the
longest, then the next one after it. A span that begins or ends with an ASCII letter or digit does not touch another one, so
short aliases are not found within words; other scripts have no such edges. Then rules have their turn, in order, in what is
left of the text. A span becomes the entity that its name resolves to: by an exact name before an alias, then the first of the
input. All entities of a name are counted, and only one row of each name is joined, so common names do not repeat spans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm, split_list
from .contain import SHARD, Automaton, Found, found_in, shards_of

EXACT, ALIAS, RULE = "exact", "alias", "rule"
#: How sure a way of mapping is. These are no probabilities.
CONFIDENCE = {EXACT: 1.0, ALIAS: 0.9}


@dataclass(frozen=True)
class Rule:
    """A pattern over lower-cased text, the name that its match stands for, in which \\1 and so on are its groups, the type of the
    anchor where no entity has that name, and how sure the rule is."""

    pattern: str
    name: str
    anchor_type: str
    confidence: float = 0.5


def folded(text: str) -> str:
    """Lower case, character by character where that would change the length, so that places stay the text's own."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(y if len(y := x.lower()) == 1 else x for x in text)


def _edge(text: str, at: int) -> bool:
    """Whether no ASCII word goes on over this place."""
    return not (0 < at < len(text) and text[at - 1].isascii() and text[at - 1].isalnum() and text[at].isascii() and text[at].isalnum())


def longest(automaton: Automaton, text: str) -> list[dict]:
    """The longest name at each start, as starts and names."""
    x, best = folded(text), {}
    for start, name in automaton.hits(x):
        if len(name) > len(best.get(start, "")) and _edge(x, start) and _edge(x, start + len(name)):
            best[start] = name
    return [{"start": s, "name": n} for s, n in sorted(best.items())]


def chosen(text: str, found: list[dict], rules: tuple[Rule, ...]) -> list[dict]:
    """Spans that do not overlap: leftmost and longest names, then each rule's matches where nothing has been taken."""
    out, end = [], 0
    for x in sorted(found, key=lambda x: (x["start"], -len(x["name"]))):
        if x["start"] >= end:
            end = x["start"] + len(x["name"])
            out.append({"start": x["start"], "stop": end, "name": x["name"], "rule": None})
    low = folded(text) if rules else ""
    for i, rule in enumerate(rules):
        free, k = sorted(out, key=lambda x: x["start"]), 0
        for m in re.finditer(rule.pattern, low):
            while k < len(free) and free[k]["stop"] <= m.start():
                k += 1
            if m.end() > m.start() and (k == len(free) or free[k]["start"] >= m.end()):
                out.append({"start": m.start(), "stop": m.end(), "name": m.expand(rule.name), "rule": i})
    return sorted(out, key=lambda x: x["start"])


_FOUND = Found(longest, pa.struct([("start", pa.int32()), ("name", pa.string())]), "struct<start: int, name: string>", all_texts=True)
_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("name", pa.string()), ("rule", pa.int32())])


def _choose(rules: tuple[Rule, ...]):
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                spans = [chosen(t.as_py(), f.as_py(), rules) for t, f in zip(part.column("text"), part.column("needles_found"))]
                yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("text"), pa.array(spans, pa.list_(_SPAN))], ["query_id", "text", "spans"])

    return run


def dictionary(entities: DataFrame) -> DataFrame:
    """(name, entity, method, n_entities) of each name: the entity that it stands for, and how many have it."""
    exact = entities.select("id", "entity_type", "name_cn", "name_en", "ord", F.explode(F.array_distinct(F.transform(F.array("id", "name_cn", "name_en"), norm))).alias("name"), F.lit(0).alias("way"))
    alias = entities.select("id", "entity_type", "name_cn", "name_en", "ord", F.explode(F.array_distinct(F.transform(split_list(F.col("alias")), norm))).alias("name"), F.lit(1).alias("way"))
    best = F.min_by(F.struct("id", "entity_type", "name_cn", "name_en", "way"), F.struct("way", "ord", "id"))
    x = exact.unionByName(alias).where(F.col("name") != "").groupBy("name").agg(best.alias("entity"), F.count_distinct("id").alias("n_entities"))
    return x.select("name", "entity", F.when(F.col("entity.way") == 0, EXACT).otherwise(ALIAS).alias("method"), "n_entities")


def anchors(texts: DataFrame, entities: DataFrame, rules: tuple[Rule, ...] = (), text: str = "text", shard: int = SHARD) -> DataFrame:
    """(query_id, start, raw_text, anchor_type, entity_id, name_cn, name_en, method, confidence, n_entities) of every anchor.

    start counts code points from 0. Repeated rows of one query and text are one observation. Nothing is found in a null or
    empty text. A rule's match whose name no entity has is an anchor without entity.
    """
    known = dictionary(entities)
    t = texts.where(F.char_length(text) > 0).select("query_id", F.col(text).alias("text")).distinct()
    x = found_in(t, known, "text", "name", _FOUND, shard)
    if shards_of(known, "name", shard) > 1:  # each automaton has found its own
        x = x.groupBy("query_id", "text").agg(F.flatten(F.collect_list("needles_found")).alias("needles_found"))
    key = next(f.dataType.simpleString() for f in t.schema.fields if f.name == "query_id")
    x = x.mapInArrow(_choose(tuple(rules)), f"query_id {key}, text string, spans array<struct<start: int, stop: int, name: string, rule: int>>")
    x = x.select("query_id", "text", F.explode("spans").alias("s")).select("query_id", "s.*", F.substring("text", F.col("s.start") + 1, F.col("s.stop") - F.col("s.start")).alias("raw_text"))
    of_rule = lambda pick: F.element_at(F.array(*[F.lit(pick(r)) for r in rules]), F.col("rule") + 1) if rules else F.lit(None)
    x = x.join(known, "name", "left")
    by_rule = F.col("rule").isNotNull()
    sure = F.when(by_rule, of_rule(lambda r: r.confidence)).otherwise(F.when(F.col("method") == EXACT, CONFIDENCE[EXACT]).otherwise(CONFIDENCE[ALIAS]))
    return x.select(
        "query_id", "start", "raw_text", F.coalesce("entity.entity_type", of_rule(lambda r: r.anchor_type)).alias("anchor_type"), F.col("entity.id").alias("entity_id"), "entity.name_cn", "entity.name_en",
        F.when(by_rule, RULE).otherwise(F.col("method")).alias("method"), sure.alias("confidence"), F.coalesce("n_entities", F.lit(0)).alias("n_entities"),
    )
