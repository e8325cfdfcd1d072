"""Clustering by integer centroids with partial-distance search.

Components are whole numbers, so distances, sums and centroids are exact and do not depend on how rows are dealt. A row's
squared differences are summed over the dimensions of the highest variance first. What it has after the first of them picks a
likely centroid, whose full distance is the first bound; from then on a centroid is dropped as soon as its partial sum is
strictly above the best full distance, and what survives has all dimensions summed, so ties are seen and go to the smaller number.

Every round is one pass over the written vectors and brings the driver counts and sums of the centroids alone: so many rows a
centroid, whatever the table's size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_vector, discard, written

#: Dimensions that are summed between two looks at which centroids can still be nearest.
STEP = 8
#: Rows of a matrix.
_ROWS = 4_096
#: Whole components beyond this are an error: squared distances of 64 dimensions would not fit 64 bits.
MOST = 1 << 27


def whole(vectors: DataFrame, width: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, q): the rows that take part, as whole numbers."""
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), clean_vector(vec_col).alias("v")).where(F.size("v") == width)
    q = F.transform("v", lambda c: F.floor(c * scale))
    fit = F.forall("v", lambda c: F.abs(c * scale) <= MOST)
    return x.select("vec_id", F.when(fit, q).otherwise(F.raise_error(F.lit(f"components have to be within {MOST} / {scale}"))).cast("array<int>").alias("q"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width).astype(np.int64)


def by_variance(vectors: DataFrame, width: int) -> np.ndarray:
    """The dimensions, that of the highest variance first. Only the order of summing depends on it, so floats will do."""

    def run(batches):
        n, s, t = 0, np.zeros(width), np.zeros(width)
        for b in batches:
            q = _matrix(b.column("q"), width).astype(float)
            n, s, t = n + len(q), s + q.sum(0), t + (q * q).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n)), pa.array(s), pa.array(t)], ["at", "n", "s", "t"])

    rows = vectors.select("q").mapInArrow(run, "at int, n long, s double, t double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    spread = np.zeros(width)
    for r in rows:
        spread[r["at"]] = r["t"] / max(1, r["n"]) - (r["s"] / max(1, r["n"])) ** 2
    return np.argsort(-spread, kind="stable")


def nearest(q: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, distance) of each row of q, and the squared differences that were computed."""
    n, k = len(q), len(centroids)
    q, c = q[:, order], centroids[:, order]
    part = ((q[:, None, :step] - c[None, :, :step]) ** 2).sum(2)
    likely = part.argmin(1)
    best = ((q - c[likely]) ** 2).sum(1)
    done = n * k * min(step, q.shape[1]) + q.size
    row, cen = np.nonzero(part <= best[:, None])
    part = part[row, cen]
    for at in range(step, q.shape[1], step):
        part = part + ((q[row, at : at + step] - c[cen, at : at + step]) ** 2).sum(1)
        done += len(row) * min(step, q.shape[1] - at)
        open_ = part <= best[row]
        row, cen, part = row[open_], cen[open_], part[open_]
    np.minimum.at(best, row, part)
    # the survivors have all dimensions; those at the bound are nearest, and stand in order of their numbers
    tie = part == best[row]
    row, cen = row[tie], cen[tie]
    first = np.unique(row, return_index=True)[1]
    return cen[first], best, done


def _chunks(b: pa.RecordBatch, width: int, centroids: np.ndarray, order: np.ndarray):
    for i in range(0, b.num_rows, _ROWS):
        part = b.slice(i, _ROWS)
        q = _matrix(part.column("q"), width)
        yield part, q, *nearest(q, centroids, order)[:2]


def _sums(width: int, centroids: np.ndarray, order: np.ndarray):
    """(cluster, dimension, rows, sum) of a task's rows."""

    def run(batches):
        k = len(centroids)
        n, s = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches:
            for _, q, cluster, _ in _chunks(b, width, centroids, order):
                n += np.bincount(cluster, minlength=k)
                for c in np.unique(cluster):
                    s[c] += q[cluster == c].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k, dtype=np.int32), width)), pa.array(np.tile(np.arange(width, dtype=np.int32), k)), pa.array(np.repeat(n, width)), pa.array(s.ravel())], ["cluster", "at", "n", "s"])

    return run


def _assigned(width: int, centroids: np.ndarray, order: np.ndarray):
    def run(batches):
        for b in batches:
            for part, _, cluster, distance in _chunks(b, width, centroids, order):
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): the centroid nearest to every row that takes part.

    Rows take part whose vector has exactly `width` components, none null or non-finite; each component x becomes
    floor(scale * x), where a size of more than MOST is an error. The first centroids are the k rows of the smallest sha256 of
    `seed:vec_id`, of equal ids that of the smaller vector; fewer rows make fewer centroids. Each round assigns every row to the
    nearest centroid, ties to the smaller number, and puts the componentwise floor of its rows' mean in a centroid's place;
    one without rows stays. Then all are assigned once more. Repeated rows count each; a row without id is assigned, and
    begins no centroid as long as others can. Other columns are not looked at. An empty table gives no rows.
    """
    q = written(whole(vectors, width, scale, id_col, vec_col), "whole-vectors")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = np.array([r["q"] for r in q.orderBy(rank.asc_nulls_last(), "q").limit(k).select("q").collect()], np.int64).reshape(-1, width)  # k rows
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<int>"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], out)
    order = by_variance(q, width)
    for _ in range(rounds):
        for r in q.select("q").mapInArrow(_sums(width, centroids, order), "cluster int, at int, n long, s long").groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # k * width rows
            if r["n"]:
                centroids[r["cluster"], r["at"]] = r["s"] // r["n"]
    x = written(q.mapInArrow(_assigned(width, centroids, order), "vec_id long, cluster int, distance long"), "assigned")
    discard(q)
    sums = {r["cluster"]: r["s"] for r in x.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    of = vectors.sparkSession.createDataFrame([(i, s, sum(sums.values()), centroids[i].tolist()) for i, s in sums.items()], "c int, cluster_inertia long, inertia long, centroid array<int>")
    return x.join(F.broadcast(of), F.col("cluster") == F.col("c")).drop("c")  # k rows


def centroid_sha256(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
