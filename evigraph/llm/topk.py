"""Exact top-k inner-product search by a three-phase uniform threshold.

Vectors are cut into `lists` groups of dimensions; a row's partial sum over one group is its score in that list, and its total
score the sum over lists.

1. Every block of rows gathers, for each query, the best of each local list, and resolves the totals of these only. The k-th
   best of all these totals is a safe cutoff t: at least k rows reach it.
2. The cutoffs go back to all blocks. A total of t or more needs a partial sum of t / lists or more in some list, so entries that
   reach this uniform threshold in a list are sufficient, and are collected.
3. Their totals are resolved exactly; those below t go, ties at t stay, and each block gives out k a query at most.

Queries are a stated set, and a table like the rows: each goes to every block of rows, where STEP of them are multiplied at
once. Neither rows nor queries nor cutoffs come to the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import clean_vector, written

#: Rows of a block, and queries that are multiplied with them at once.
ROWS, STEP = 16_384, 256
#: Components are clamped here, and scores beyond a long are the nearest long.
_MOST, _LONG = 2.0**62, 2**63 - 1


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, x): each component as floor(scale * x). Rows with no id, or whose vector is null, empty or not finite, are left out."""
    d = vectors.select(F.col(id_col).cast("long").alias("id"), clean_vector(vec_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return d.select("id", F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(_MOST)), F.lit(-_MOST))).cast("long")).alias("x"))


def _parts(width: int, lists: int) -> list[slice]:
    edges = np.linspace(0, width, min(lists, width) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _products(rows: np.ndarray, q: np.ndarray, lists: int) -> list[np.ndarray]:
    """(rows, queries) partial sums by list, exactly: as doubles where no sum of absolute products reaches 2 ** 53, else as
    integers, of any size where they need be."""
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(q).max(initial=0)) * rows.shape[1]
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object
    a, b = rows.astype(kind), q.astype(kind).T
    return [a[:, p] @ b[p] for p in _parts(rows.shape[1], lists)]


def _heads(k: int, lists: int):
    """The k best of each local list, with their totals."""

    def found(ids, rows, q_ids, q, cuts):
        partial = _products(rows, q, lists)
        some = [np.argpartition(-s, min(k, len(s)) - 1, axis=0)[:k] if len(s) > k else np.repeat(np.arange(len(s))[:, None], len(q), 1) for s in partial]
        at = np.sort(np.concatenate(some), axis=0)
        once = np.concatenate([np.ones((1, len(q)), bool), at[1:] != at[:-1]]) & (ids[at] != q_ids)
        r, c = np.nonzero(once)
        at = at[r, c]
        return c, at, reduce(np.add, [s[at, c] for s in partial])

    return found


def _sufficient(k: int, lists: int):
    """The entries that reach the uniform threshold of their query's cutoff in a list; of these the k best totals."""

    def found(ids, rows, q_ids, q, cuts):
        partial = _products(rows, q, lists)
        open_ = np.array([x is None for x in cuts])
        cut = np.array([0 if x is None else int(x) for x in cuts], dtype=object if partial[0].dtype == object else np.int64)
        enough = reduce(np.logical_or, [s * len(partial) >= cut for s in partial]) if partial[0].dtype == object else reduce(np.logical_or, [s >= cut / len(partial) - 1 for s in partial])
        c, at = np.nonzero((enough | open_).T)
        total = reduce(np.add, [s[at, c] for s in partial])
        fit = ((total >= cut[c]) | open_[c]) & (ids[at] != q_ids[c])
        c, at, total = c[fit], at[fit], total[fit]
        order = np.lexsort((ids[at], -total, c))
        c, at, total = c[order], at[order], total[order]
        start = np.searchsorted(c, np.arange(len(q)))
        best = np.arange(len(c)) - start[c] < k
        return c[best], at[best], total[best]

    return found


def _by_block(find):
    """find() for the rows and queries of each block and width. Blocks come sorted, rows (side 0) before queries (side 1)."""

    def matrix(b: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
        return b.column("x").take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)

    def run(batches):
        now, held = None, {}
        for b in batches:
            block, side, id_ = (b.column(c).to_numpy() for c in ("block", "side", "id"))
            width = np.diff(b.column("x").offsets.to_numpy())
            edges = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (side[1:] != side[:-1])])) if len(block) else []
            for a, z in zip(edges, np.append(edges[1:], len(block))):
                if block[a] != now:
                    now, held = block[a], {}
                for w in np.unique(width[a:z]):
                    at = a + np.flatnonzero(width[a:z] == w)
                    if side[a] == 0:
                        ids, rows = held.get(w, (id_[:0], np.zeros((0, w), np.int64)))
                        held[w] = np.concatenate([ids, id_[at]]), np.concatenate([rows, matrix(b, at)])
                        continue
                    ids, rows = held.get(w, (id_[:0], None))
                    for i in range(0, len(at) if len(ids) else 0, STEP):
                        some = at[i : i + STEP]
                        c, r, total = find(ids, rows, id_[some], matrix(b, some), b.column("cut").take(pa.array(some)).to_pylist())
                        total = np.array([max(-_LONG - 1, min(_LONG, int(x))) for x in total], np.int64) if total.dtype == object else total.astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(id_[some][c]), pa.array(ids[r]), pa.array(total)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, lists: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of every vector whose id is divisible by `every`, exactly.

    Rows with no id, or whose vector is null, empty or holds a null or non-finite component, are neither queries nor
    candidates. A query's candidates are the rows of other ids and of its own length, all of them where there are fewer than
    k. Rows repeated in full count once; so do queries. Ties go to the smaller vec_id. Scaled components beyond 2 ** 62 count
    as that, scores beyond a long as the nearest long. An empty table gives no rows.
    """
    rows = written(quantised(vectors, id_col, vec_col, scale).distinct(), "quantised")
    blocks = max(1, -(-rows.count() // ROWS))
    held = rows.select(F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), "id", "x", F.lit(None).cast("long").alias("cut"))
    queries = rows.where(F.col("id") % every == 0)

    def against(asked: DataFrame, find) -> DataFrame:
        asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "id", "x", "cut")
        x = held.unionByName(asked).repartition("block").sortWithinPartitions("block", "side")
        return x.mapInArrow(_by_block(find), "query_id long, vec_id long, score long")

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    heads = against(queries.withColumn("cut", F.lit(None).cast("long")), _heads(k, lists))
    cuts = heads.withColumn("rank", place).where(F.col("rank") <= k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("cut"))
    found = against(queries.join(cuts, "id", "left"), _sufficient(k, lists))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
