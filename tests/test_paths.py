from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evigraph.operators import analytics as an
from evigraph.operators import lineage, paths


def graph(seed, nodes=9, edges=34):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}", f"t{i:02}", rng.choice([0, 1, 1, 2, 5, None]), rng.choice(paths.SUPPORT_TYPES)) for i in range(edges)]


TRIPLE = "head_id string, tail_id string, triple_id string, cost long, support_type string"


def all_paths(rows, starts, k, most):
    """Every path that passes no node twice, ranked."""
    found, at = {}, [((s,), (), 0, 0) for s in starts]
    for n in range(1, most + 1):
        at = [((*nodes, t), (*ids, i), c + cost, max(w, paths.SUPPORT_TYPES.index(kind))) for nodes, ids, c, w in at for h, t, i, cost, kind in rows if h == nodes[-1] and cost is not None and t not in nodes]
        for nodes, ids, c, w in at:
            found.setdefault((nodes[0], nodes[-1]), []).append((c, n, "/".join(ids), nodes, paths.SUPPORT_TYPES[w]))
    return {(s, e, i + 1, *x) for (s, e), all_ in found.items() for i, x in enumerate(sorted(all_)[:k])}


@pytest.mark.parametrize("seed,k,most", [(1, 1, 4), (2, 2, 4), (3, 3, 3), (4, 1, 5), (5, 40, 3)])
def test_best_paths_are_the_first_of_all(spark, seed, k, most):
    rows = graph(seed)
    starts = spark.createDataFrame([("n0",), ("n1",), ("n1",), ("zz",)], "id string")
    x = paths.best_paths(starts, spark.createDataFrame(rows, TRIPLE).repartition(3), k, most)
    got = {(r["start"], r["end"], r["path_rank"], r["cost"], r["n_hops"], "/".join(r["triple_ids"]), tuple(r["nodes"]), r["support_type"]) for r in x.collect()}
    assert got == all_paths(rows, ["n0", "n1", "zz"], k, most)


def test_what_is_kept_grows_with_nodes_and_not_with_paths():
    """Of a ladder of 12 rungs with 40 ways between any two, 40 ** n paths lead to a node; few of them are needed."""
    kept, k = [frozenset({"s", "v"})], 2
    for i in range(40):
        for j in range(40):
            own = frozenset({"s", f"a{i}", f"b{j}", "v"})
            if paths.needed(kept, own, k, 2):
                kept.append(own)
    assert len(kept) <= k * (1 + 4 + 16)


def test_costs_are_sums_of_logarithms_of_weights(spark):
    x = spark.createDataFrame([(1.0,), (0.5,), (0.25,)], "w double").select(paths.cost_of(F.col("w")).alias("c"))
    assert [r["c"] for r in x.collect()] == [0, 693147, 1386294]


def test_claims_stand_as_paths_or_not(spark):
    rows = [("p", "s", "by", "1"), ("p", "q", "by", "2"), ("s", "n", "at", "3"), ("q", "m", "at", "4"), ("n", "p", "back", "5"), ("p", "n", "at", "6")]
    t = spark.createDataFrame(rows, "head_id string, tail_id string, relation_en string, triple_id string")
    claims = [("p", ["by"], "s"), ("p", ["by", "at"], "n"), ("p", ["by", "at"], "s"), ("p", ["by", "at", "back", "by"], "q"), ("p", ["*", "at"], "m"), ("p", ["*", "back"], "p"), ("s", ["by"], "s"), ("p", [], "s"), ("p", None, "s"), ("x", ["by"], "s"), (None, ["by"], "s"), ("p", ["no such"], "s"), ("p", ["by"], "s")]
    got = paths.path_consistent(spark.createDataFrame([(i, *c) for i, c in enumerate(claims)], "i int, head string, relations array<string>, tail string"), t)
    want = {0, 1, 3, 4, 5, 12}
    assert {r["i"]: (r["mapped"], r["consistent"]) for r in got.collect()} == {i: (bool(c[1]), i in want) for i, c in enumerate(claims)}
    assert not [r for r in paths.path_consistent(got.select("i", "head", "relations", "tail").where("i = 7"), t).collect() if r["mapped"] or r["consistent"]]
    m = an.claim_metrics(got.withColumn("status", F.lit(an.SUPPORTED)), mapped=F.col("mapped"), consistent=F.col("consistent")).first()
    assert (m["n_mapped"], m["n_consistent"], m["n_supported"]) == (11, 6, 13)


def families(rows):
    """Brute force: one step after the other."""
    best = {}
    for i, up, v in rows:
        if i is not None:
            best[i] = max(best.get(i, (-1, -1)), (v, -1 if up is None else up))
    up = {i: (u if u in best else None) for i, (_, u) in best.items()}
    orphan = {i for i, (_, u) in best.items() if u != -1 and u not in best}
    root, depth = {}, {}
    for i in best:
        j, n = i, 0
        while up[j] is not None and n <= len(best):
            j, n = up[j], n + 1
        root[i], depth[i] = (j, n) if n <= len(best) else (None, None)
    out = {}
    for i in best:
        kids = [j for j in best if up[j] == i]
        fam = [j for j in best if root[i] is not None and root[j] == root[i]]
        has = {best[j][0] for j in fam}
        leaves = [j for j in fam if not any(up[x] == j for x in best)]
        current = max(leaves, key=lambda j: (best[j][0], j)) if leaves else None
        out[i] = (root[i], depth[i], not kids, current, current == i, len(fam) or None, sum(1 for j in fam if sum(up[x] == j for x in best) > 1) if fam else None, max(has) - min(has) + 1 - len(has) if fam else None, i in orphan, root[i] is None)
    return out


def test_lineages_are_those_of_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, *range(max(0, i - 6), i)]) if i else None, rng.randrange(1, 30)) for i in range(60)]
    rows += [(70, 72, 1), (71, 70, 2), (72, 71, 3), (73, 72, 4), (74, 74, 1), (80, 999, 7), (81, 80, 9), (5, 3, 0), (5, 4, 50), (5, 2, 50), (None, 3, 1)]
    d = spark.createDataFrame(rows, "i long, p long, v long")
    got = {r["id"]: tuple(r)[1:] for r in lineage.lineage(d, "i", "p", "v").collect()}
    assert got == families(rows)
    assert lineage.lineage(d.where("false"), "i", "p", "v").collect() == []


def test_a_chain_of_ten_thousand(spark):
    d = spark.range(10_000).select(F.col("id").alias("i"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p"), (F.col("id") + 1).alias("v"))
    x = lineage.lineage(d, "i", "p", "v").cache()
    assert x.where("root = 0 and depth = id and current = 9999 and n_versions = 10000 and n_gaps = 0 and n_forks = 0 and not cyclic").count() == 10_000
    assert [r["id"] for r in x.where("is_current").collect()] == [9_999]
    ring = d.withColumn("p", F.coalesce("p", F.lit(9_999)))
    assert lineage.lineage(ring, "i", "p", "v").where("cyclic and root is null").count() == 10_000
