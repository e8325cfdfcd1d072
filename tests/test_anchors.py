from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from evigraph.operators import anchors as an
from evigraph.operators.anchors import Rule

ENTITIES = [
    ("H1", "Disease", "甲症", "Alpha", "al; first alias；AX", 1),
    ("H2", "Disease", "乙症", "Alpha Beta", "be，al", 2),
    ("F1", "Feature", "红斑", "Red Patch", "red|甲症", 3),
    ("F2", "Feature", "红斑疹", "Patch 7", "", 4),
    ("S1", "Site", "İstanbul", "", "", 5),
]
RULES = (Rule(r"no\. (\d+)", r"patch \1", "feature", 0.7), Rule(r"red|on the (\w+)", r"\1", "site", 0.3))


def entities(spark):
    return spark.createDataFrame(ENTITIES, "id string, entity_type string, name_cn string, name_en string, alias string, ord long")


def brute(text, rules=()):
    """Every place, every name."""
    names = {}
    for id_, kind, cn, en, alias, ord_ in ENTITIES:
        for n in {id_.lower(), cn.lower(), en.lower()} - {""}:
            names.setdefault(n, []).append((0, ord_, id_, kind))
        for n in {a.strip().lower() for a in re.split("[;；，|]", alias)} - {""}:
            names.setdefault(n, []).append((1, ord_, id_, kind))
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    word = lambda c: c.isascii() and c.isalnum()
    edge = lambda i: not (0 < i < len(low) and word(low[i - 1]) and word(low[i]))
    out, i = [], 0
    while i < len(low):
        fit = [n for n in names if low.startswith(n, i) and edge(i) and edge(i + len(n))]
        if fit:
            n = max(fit, key=len)
            way, _, id_, kind = min(names[n])
            out.append((i, text[i : i + len(n)], kind, id_, ("exact", "alias")[way], (1.0, 0.9)[way], len({x[2] for x in names[n]})))
            i += len(n)
        else:
            i += 1
    for r in rules:
        taken = [(o[0], o[0] + len(o[1])) for o in out]
        for m in re.finditer(r.pattern, low):
            if m.end() > m.start() and all(m.end() <= a or z <= m.start() for a, z in taken):
                n = m.expand(r.name)
                best = min(names[n]) if n in names else None
                out.append((m.start(), text[m.start() : m.end()], best[3] if best else r.anchor_type, best[2] if best else None, "rule", r.confidence, len({x[2] for x in names.get(n, [])})))
    return sorted(out)


def texts():
    rng = random.Random(1)
    parts = ["alpha", "Alpha Beta", "al", "normal", "AX2", "ax", "红斑", "红斑疹", "甲症", " ", ", ", "no. 7", "no. 8", "on the face", "red", "İ", "x", "patch 7", "7", "H1"]
    return ["", None, "Alpha beta", "alphabeta", "İ alpha", "al" * 30, "红斑疹红斑甲症", "see no. 7 and no. 9 red"] + ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(300)]


def test_anchors_are_those_of_brute_force_in_one_automaton_and_in_several(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    d = spark.createDataFrame(rows, "query_id long, text string")
    for rules in ((), RULES):
        want = sorted((i, *x) for i, t in rows for x in brute(t or "", rules))
        for shard in (an.SHARD, 12):
            got = an.anchors(d.unionByName(d.limit(5)), entities(spark), rules, shard=shard)
            got = got.select("query_id", "start", "raw_text", "anchor_type", "entity_id", "method", "confidence", "n_entities")
            assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_anchors_of_no_entities_and_no_texts(spark):
    d = spark.createDataFrame([(1, "alpha no. 7")], "query_id long, text string")
    assert an.anchors(d.where("false"), entities(spark), RULES).collect() == []
    assert [(r["raw_text"], r["entity_id"], r["anchor_type"]) for r in an.anchors(d, entities(spark).where(F.lit(False)), RULES).collect()] == [("no. 7", None, "feature")]
