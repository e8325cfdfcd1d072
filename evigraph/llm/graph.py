"""Connected components of an edge table, without bringing any of it to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_few_files, written

#: Tasks that share the larger neighbours of one node, so that the centre of a very large component is no single task's work.
SALTS = 16
#: Edges that are contracted at once.
_CHUNK = 200_000
_EDGES = "u long, v long, open boolean"


class Union:
    """Union-find over whatever it is asked about; the top of a set is its least member."""

    def __init__(self):
        self.up: dict = {}

    def top(self, x):
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a, b) -> bool:
        """Whether they were apart."""
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _batch(u, v, open_) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(open_, pa.bool_())], ["u", "v", "open"])


def _contract(batches):
    """The edges of a task as stars, chunk by chunk: after it a node has one smaller neighbour a chunk at most."""
    for b in batches:
        for i in range(0, b.num_rows, _CHUNK):
            union = Union()
            for a, z in zip(b.column(0).slice(i, _CHUNK).to_pylist(), b.column(1).slice(i, _CHUNK).to_pylist()):
                union.join(a, z)
            u = list(union.up)
            yield _batch(u, [union.top(x) for x in u], [True] * len(u))


def _closer(batches):
    """Links a node and all its neighbours to the least of them.

    Rows are sorted by key (a node), salt and side: smaller neighbours (side 0), of which each salt has all, come before the
    larger ones (side 1) of that salt. The least is that of the first row, and is carried on from batch to batch. An edge is
    open where its node has two smaller neighbours, or smaller and larger ones: a graph without such nodes is one of stars.
    """
    last, least, smaller = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        key, salt, side, other = (b.column(c).to_numpy() for c in ("key", "salt", "side", "other"))
        new = np.concatenate([[last != (key[0], salt[0])], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
        start = np.flatnonzero(np.concatenate([[True], new[1:]]))
        run = np.cumsum(np.concatenate([[True], new[1:]])) - 1
        low = np.minimum(key[start], other[start])
        n = np.add.reduceat(side == 0, start)
        if not new[0]:
            low[0], n[0] = min(low[0], least), n[0] + smaller
        last, least, smaller = (key[-1], salt[-1]), int(low[-1]), int(n[-1])
        m, many = low[run], n[run]
        # a smaller neighbour is reported by one salt only, a larger one by the salt that it is in
        mine = (side == 1) | (salt == 0)
        open_ = np.where(side == 1, many > 0, many > 1)
        u = np.concatenate([other[mine], key[mine & (side == 0)]])
        v = np.concatenate([m[mine], m[mine & (side == 0)]])
        o = np.concatenate([open_[mine], open_[mine & (side == 0)]])
        fit = u != v
        yield _batch(u[fit], v[fit], o[fit])


def stars(edges: DataFrame, a: str = "a", b: str = "b", contract: bool = True) -> DataFrame:
    """(node, component) of each node that is not its component's least: that is the least node that links lead to.

    Edges of a node with itself or with null count for nothing. The number of rounds grows with the logarithm of the longest
    path; each is two exchanges. Edges are contracted first, task by task, so that no node has very many smaller neighbours;
    where edges are known to have none, contract=False saves that. An edge table without edges gives no rows.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    e = e.mapInArrow(_contract, _EDGES) if contract else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    row = lambda key, other, side, salt: F.struct(F.col(key).alias("key"), F.col(other).alias("other"), F.lit(side).alias("side"), salt.cast("int").alias("salt"))
    below = F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: row("u", "v", 0, s))
    above = F.array(row("v", "u", 1, F.pmod(F.xxhash64("u"), F.lit(SALTS))))
    old = None
    while True:
        x = e.select(F.explode(F.concat(below, above)).alias("x")).select("x.*").repartition("key", "salt").sortWithinPartitions("key", "salt", "side", "other")
        e = written(in_few_files(x.mapInArrow(_closer, _EDGES).groupBy("u", "v").agg(F.max("open").alias("open"))), "edges")
        if old is not None:
            discard(old)
        if e.where("open").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        old = e


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node of edges can reach, itself included; see stars()."""
    e = stars(edges, a, b)
    return e.unionByName(e.select(F.col("component").alias("node"), "component").distinct())
