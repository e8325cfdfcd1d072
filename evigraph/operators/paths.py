"""The best evidence paths between nodes, and claims held against whole paths."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import SENT_ROWS, sent, written

#: A path is what its worst triple is, in this order.
SUPPORT_TYPES = ("support", "background", "missing", "conflict")
#: The relation of a claim that any relation fits.
ANY = "*"
#: Between the nodes and triples of a path while it grows: as texts they are cheaper to hand on than lists. No id holds it.
_SEP = "\x00"


def cost_of(weight: Column) -> Column:
    """Millionths of the negative logarithm: sums of costs are products of weights, and whole, so they are added exactly."""
    return F.round(-F.ln(weight) * 1_000_000).cast("long")


def needed(better: list[frozenset], own: frozenset, k: int, left: int) -> bool:
    """Whether a way on of `left` nodes at most, none of them in own, passes all but k - 1 of the better paths by.

    If so, this path may go on where too few of the better ones can, as no node is passed twice. Such a way has to hit one of
    any k of them, so it is looked for node by node along the first k.
    """
    if len(better) < k:
        return True
    if not left:
        return False
    return any(needed([x for x in better if node not in x], own, k, left - 1) for node in set().union(*better[:k]) - own)


def _needed_rows(batch: pa.RecordBatch, k: int, left: int, held: list) -> pa.RecordBatch:
    """Of rows that come sorted by start, end, cost and ids those that are needed; held is the group that goes on.

    The first k rows of a group are needed whatever they are, so only groups of more, and those that the batch's ends cut, are
    looked at row by row; the others, which are nearly all where most nodes are reached one way, pass as they are.
    """
    n = batch.num_rows
    if not n:
        return batch
    names = [batch.column(c) for c in ("start", "end")]
    new = np.ones(n, bool)
    new[1:] = ~np.logical_and(*[pc.equal(x.slice(1), x.slice(0, n - 1)).to_numpy(zero_copy_only=False) for x in names])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    looked_at = (size > k) | (first == 0) | (first + size == n)
    fit = np.ones(n, bool)
    for at, many in zip(first[looked_at].tolist(), size[looked_at].tolist()):
        group = tuple(x[at].as_py() for x in names)
        if held[:1] != [group]:
            held[:] = [group, []]
        for i, nodes in enumerate(batch.column("nodes").slice(at, many).to_pylist(), at):
            own = frozenset(nodes.split(_SEP) if isinstance(nodes, str) else nodes)
            fit[i] = needed(held[1], own, k, left)
            if fit[i]:
                held[1].append(own)
    return batch if fit.all() else batch.filter(pa.array(fit))


def _fewer(k: int, n: int, left: int):
    """Rows come sorted by start, end, cost, hops and ids; of those of n hops the ones that are needed stay, and all others."""

    def run(batches):
        held: list = []
        for b in batches:
            new = pc.equal(b.column("n_hops"), n)
            yield b.filter(pc.invert(new))
            yield _needed_rows(b.filter(new), k, left, held)

    return run


def _first(k: int):
    """Of rows that come so sorted the first k of a start and an end, with path_rank."""

    def run(batches):
        last, seen = None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            names = [b.column(c) for c in ("start", "end")]
            new = np.ones(n, bool)
            new[1:] = ~np.logical_and(*[pc.equal(x.slice(1), x.slice(0, n - 1)).to_numpy(zero_copy_only=False) for x in names])
            rank = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
            if tuple(x[0].as_py() for x in names) == last:
                rank[: np.append(np.flatnonzero(new), n)[1]] += seen
            last, seen = tuple(x[n - 1].as_py() for x in names), int(rank[-1])
            x = pa.RecordBatch.from_arrays([*b.columns, pa.array(rank.astype(np.int64))], [*b.schema.names, "path_rank"])
            yield x.filter(pa.array(rank <= k))

    return run


def _ways(step: DataFrame) -> DataFrame | None:
    """(end, ways) of the nodes that triples both lead to and go on from, where these nodes and their triples are few."""
    tails = step.select(F.col("to").alias("end")).distinct()
    if tails.limit(SENT_ROWS + 1).count() > SENT_ROWS:
        return None
    on = written(step.join(F.broadcast(tails), "end", "left_semi"), "ways")
    if on.limit(SENT_ROWS + 1).count() > SENT_ROWS:
        return None
    return F.broadcast(on.groupBy("end").agg(F.collect_list(F.struct("to", "triple_id", "more", "bad")).alias("ways")))


def best_paths(starts: DataFrame, triples: DataFrame, k: int, most: int) -> DataFrame:
    """(start, end, path_rank, cost, n_hops, nodes, triple_ids, support_type): for every start (id) and every node that it leads
    to the k paths of the least cost, of 1 to `most` triples; ties go to the smaller list of triple ids.

    triples have a cost (a whole number, 0 or more) and a support_type; a triple without cost is not walked. No path passes a
    node twice. The walk keeps, hop by hop, for a start and a node k paths and those that can go on where these cannot; of
    their number before the last hop, k * sum((k * hops) ** i for i up to the hops that are left) is a bound whatever the graph. So what is kept
    grows with starts and nodes reached, not with paths, and the result is that of ranking all paths.

    Paths are dealt by start once. Where the ways on of inner nodes are few they are sent to the paths, which stay where they lie
    and are put in order there; otherwise paths are sent to the ways and back.
    """
    c = F.col
    worst = F.array_position(F.array(*map(F.lit, SUPPORT_TYPES)), c("support_type")).cast("int") - 1
    step = triples.where(c("cost").isNotNull()).select(c("head_id").alias("end"), c("tail_id").alias("to"), "triple_id", c("cost").cast("long").alias("more"), F.greatest(worst, F.lit(0)).alias("bad"))
    x = starts.select(c("id").alias("end")).distinct().join(step, "end").where(c("end") != c("to")).repartition("end")
    x = x.select(c("end").alias("start"), c("to").alias("end"), c("more").alias("cost"), c("bad").alias("worst"), F.concat_ws(_SEP, "end", "to").alias("nodes"), c("triple_id").alias("triple_ids"), F.lit(1).cast("long").alias("n_hops"))
    ways = _ways(step) if most > 1 else None
    on = lambda w: F.struct(c("start"), w["to"].alias("end"), (c("cost") + w["more"]).alias("cost"), F.greatest(c("worst"), w["bad"]).alias("worst"), F.concat_ws(_SEP, "nodes", w["to"]).alias("nodes"), F.concat_ws(_SEP, "triple_ids", w["triple_id"]).alias("triple_ids"))
    around = lambda x: F.concat(F.lit(_SEP), x, F.lit(_SEP))
    passed = lambda to: F.contains(around(c("nodes")), around(to))
    state = "start string, end string, cost long, worst int, nodes string, triple_ids string, n_hops long"
    in_order = lambda x: x.withColumn("ids", F.replace("triple_ids", F.lit(_SEP), F.lit("/"))).sortWithinPartitions("start", "end", "cost", "n_hops", "ids").drop("ids")
    for n in range(2, most + 1):
        if n == 2:  # single triples of a start and an end pass the same nodes, so the first k are all that is needed
            nth = F.row_number().over(Window.partitionBy("start", "end").orderBy("cost", "triple_ids"))
            x = x.withColumn("nth", nth).where(c("nth") <= k).drop("nth")
        else:
            x = in_order(x).mapInArrow(_fewer(k, n - 1, most - n + 1), state)
        if ways is None:
            more = x.where(c("n_hops") == n - 1).join(step, "end").where(~passed(c("to")))
            more = more.select(on({w: c(w) for w in ("to", "more", "bad", "triple_id")}).alias("p")).select("p.*", F.lit(n).cast("long").alias("n_hops"))
            x = x.unionByName(more).repartition("start")
            continue
        own = F.struct("start", "end", "cost", "worst", "nodes", "triple_ids")
        fit = F.filter("ways", lambda w: ~passed(w["to"]))
        further = F.when((c("n_hops") == n - 1) & c("ways").isNotNull(), F.transform(fit, on))
        x = x.join(ways, "end", "left").select("n_hops", F.posexplode(F.concat(F.array(own), F.coalesce(further, F.filter(F.array(own), lambda _: F.lit(False))))).alias("at", "p"))
        x = x.select("p.*", F.when(c("at") > 0, n).otherwise(c("n_hops")).cast("long").alias("n_hops"))
    x = in_order(x).mapInArrow(_first(k), f"{state}, path_rank long")
    return x.select("start", "end", "path_rank", "cost", "n_hops", *[F.split(x_, _SEP).alias(x_) for x_ in ("nodes", "triple_ids")], F.element_at(F.array(*map(F.lit, SUPPORT_TYPES)), c("worst") + 1).alias("support_type"))


def path_consistent(claims: DataFrame, triples: DataFrame) -> DataFrame:
    """claims (head, relations, tail, ...) with mapped and consistent: whether the graph has a path from head to tail whose
    relations are those claimed, in their order; ANY fits each. A claim without relations is not mapped, and not consistent.

    The claims' sequences are one automaton, whose states are their beginnings, so claims that begin alike are walked once. The
    frontier has a row for each head, state and node, however many paths lead there. It is written at each hop, and only edges of
    the relations asked for there, and of the nodes where these are few, are joined to it.
    """
    claims = written(claims, "claims")  # joined by the caller; read for the automaton and for the answer
    c = written(claims.where(F.size("relations") > 0).select("head", "relations", "tail").distinct(), "claimed")
    mapped = F.coalesce(F.size("relations") > 0, F.lit(False))
    longest = c.agg(F.max(F.size("relations"))).first()[0] or 0
    if not longest:
        return claims.withColumns({"mapped": mapped, "consistent": F.lit(False)})
    ways = c.select("head", "relations").repartition("head")
    at = ways.select("head", F.col("head").alias("node"), F.array().cast("array<string>").alias("state")).distinct()
    ends = []
    for i in range(longest):
        here = [F.slice("relations", 1, i).alias("state"), F.col("relations")[i].alias("relation"), F.slice("relations", 1, i + 1).alias("next")]
        moves = ways.where(F.size("relations") > i).select("head", *here, (F.size("relations") == i + 1).alias("whole")).groupBy("head", "state", "relation", "next").agg(F.max("whole").alias("whole"))
        moves = moves.groupBy("head").agg(F.collect_list(F.struct("state", "relation", "next", "whole")).alias("moves"))
        x = at.join(moves, "head").select("head", "node", F.explode(F.filter("moves", lambda m: m["state"] == F.col("state"))).alias("m"))
        x = written(x.select("head", "node", "m.relation", "m.next", "m.whole"), "frontier")
        x = x.join(_edges(x, triples), ["node", "relation"]).select("head", F.col("to").alias("node"), F.col("next").alias("state"), "whole").repartition("head").distinct()
        if i < longest - 1:
            x = written(x, "reached")
        at = x.drop("whole")
        ends.append(x.where("whole").select("head", F.col("state").alias("relations"), F.col("node").alias("tail")))
    hit = reduce(DataFrame.unionByName, ends).join(c, ["head", "relations", "tail"], "left_semi").distinct().withColumn("hit", F.lit(True))
    x = claims.join(hit, ["head", "relations", "tail"], "left")
    return x.withColumns({"mapped": mapped, "consistent": F.coalesce("hit", F.lit(False))}).select(*claims.columns, "mapped", "consistent")


#: Relations up to which a filter names them.
_NAMED = 1000


def _edges(frontier: DataFrame, triples: DataFrame) -> DataFrame:
    """(node, relation, to): the triples that a frontier (node, relation) asks for, ANY among its relations."""
    used = frontier.select("relation").distinct()
    names = [r[0] for r in used.limit(_NAMED + 1).collect()]
    if ANY not in names and len(names) <= _NAMED:
        triples = triples.where(F.col("relation_en").isin(names))  # no triples of others are made
    e = triples.select(F.col("head_id").alias("node"), F.explode(F.array("relation_en", F.lit(ANY))).alias("relation"), F.col("tail_id").alias("to"))
    e = e.join(F.broadcast(used), "relation", "left_semi")  # a row a relation; joined by relation the triples of one would be one task's
    near = frontier.select("node").distinct()
    if near.limit(SENT_ROWS + 1).count() > SENT_ROWS:
        return e
    return sent(e.join(F.broadcast(near), "node", "left_semi"))
