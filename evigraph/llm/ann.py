"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform) turns a unit vector, and the nearest of the 2 d
signed axes is its hash. A table joins as many hashes as keep its mean bucket at a few hundred rows, so a code of `hashes` axes
is the bucket. A query probes the codes of the largest sums of its own rotated components along their axes: those that a near
vector most likely has. What it meets in any table is a candidate once, and is reranked by its exact inner product.

Equal vectors are one candidate, with the ids that can come into a result, and one query. So copies of one vector cost no more
than one. Codes of rows and of queries are sorted together, and what a query meets is gathered into lists, by blocks of BLOCK
rows; a query goes to the blocks that hold any of its own, where the vectors are. A bucket of more than FULL rows, as very many
near copies make, is dealt over several tasks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import clean_vector, runs, written

TABLES, BLOCK, FULL, SEED = 48, 4_096, 4_096, 20_240_607
#: Share of the nearest rows that the probes are made for.
RECALL = 0.905
#: Candidates that a task gathers before it gives out lists.
_GATHERED = 2_000_000
#: Rows of a mean bucket beyond which a table takes a further hash.
_BUCKET = 256


def scheme(width: int, rows: int, exact: bool = False, tables: int = TABLES, probes: int | None = None, k: int = 20) -> tuple[int, int, int]:
    """(tables, hashes a table, codes that a query probes in each) for so many different vectors of a width.

    Probes are as many as random unit vectors need, which are the hardest, see needed_probes(), and at least as many as meet 4 k
    rows. exact puts all rows in one bucket; so do 4 k rows at most, of which a query has to get k whatever lies near.
    """
    if exact or rows <= 4 * k:
        return 1, 0, 1
    d = padded(width)
    hashes = 2
    while (2 * d) ** hashes * _BUCKET < rows and (2 * d) ** (hashes + 1) < 2**62:
        hashes += 1
    if probes is None:
        probes = max(needed_probes(width, int(float(f"{rows:.1e}")), hashes, tables, k), -(-4 * k * (2 * d) ** hashes // (tables * rows)))
    return tables, hashes, min(probes, (2 * d) ** hashes)


def near_cosines(width: int, rows: int, k: int, n: int, rng) -> np.ndarray:
    """(n, k) cosines between n random vectors and their k nearest of `rows` random ones, from the cosines' distribution."""
    t = np.linspace(-1, 1, 200_001)
    density = (1 - t * t) ** ((max(width, 3) - 3) / 2)
    tail = np.cumsum(density[::-1]) / density.sum()
    share = np.cumsum(rng.exponential(size=(n, k)), axis=1) / max(rows, k)
    return np.interp(np.log(share), np.log(np.maximum(tail, 1e-300)), t[::-1])


def codes_before(width: int, rows: int, hashes: int, tables: int, k: int, seed: int) -> np.ndarray:
    """How many codes of a table come before that of a near vector in a query's order, in the best table, for the k nearest of
    random queries among `rows` random unit vectors. The tables' own rotations are tried."""
    d = padded(width)
    rng = np.random.default_rng(seed)
    n = int(np.clip(64_000_000 // ((2 * d) ** (hashes - 1) * d), 12, 64))
    c = near_cosines(width, rows, k, n, rng)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    q, z = unit(rng.normal(size=(n, width))), rng.normal(size=(n, k, width))
    z = unit(z - (z @ q[:, :, None]) * q[:, None])
    x = (c[:, :, None] * q[:, None] + np.sqrt(1 - c * c)[:, :, None] * z).reshape(n * k, width)
    signs = rotations(width, tables * hashes)
    before = np.full((n, k), np.inf)
    for t in range(tables):
        of = signs[t * hashes : (t + 1) * hashes]
        sides, own = [axes(rotate(q, s)) for s in of], [nearest_axis(rotate(x, s)).reshape(n, k) for s in of]
        for i in range(n):
            total = sum(side[i][at[i]] for side, at in zip(sides, own))
            sums = np.zeros(1)
            for side in sides[:-1]:
                sums = (sums[:, None] + side[i]).ravel()
            sums.sort()
            larger = len(sums) - np.searchsorted(sums, total[:, None] - sides[-1][i], side="right")
            before[i] = np.minimum(before[i], larger.sum(1))
    return before


@lru_cache(maxsize=64)
def needed_probes(width: int, rows: int, hashes: int, tables: int, k: int, recall: float = RECALL) -> int:
    """Codes to probe in each table so that this share of the k nearest of random unit vectors is met in any; more by one and a
    half standard errors, the more the fewer of them could be tried."""
    before = codes_before(width, rows, hashes, tables, k, seed=1)
    return int(np.quantile(before, recall + 1.5 * np.sqrt(recall * (1 - recall) / before.size))) + 1


def padded(width: int) -> int:
    """The next power of two."""
    return 1 << max(1, (width - 1).bit_length())


def rotations(width: int, n: int, seed: int = SEED) -> np.ndarray:
    """(n, 3, d) random signs."""
    return np.random.default_rng([seed, width]).choice([-1.0, 1.0], (n, 3, padded(width)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths: as the product of two smaller ones, along the two
    sides of a row laid out as a rectangle."""
    n, d = x.shape
    if d <= 16:
        h = np.ones((1, 1))
        while len(h) < d:
            h = np.block([[h, h], [h, -h]])
        return x @ h / np.sqrt(d)
    a = 1 << (d.bit_length() - 1) // 2
    y = hadamard(x.reshape(n * (d // a), a)).reshape(n, d // a, a)
    y = hadamard(np.ascontiguousarray(y.transpose(0, 2, 1)).reshape(n * a, d // a))
    return np.ascontiguousarray(y.reshape(n, a, d // a).transpose(0, 2, 1)).reshape(n, d)


def rotate(v: np.ndarray, signs: np.ndarray) -> np.ndarray:
    x = np.zeros((len(v), signs.shape[1]))
    x[:, : v.shape[1]] = v
    for s in signs:
        x = hadamard(x * s)
    return x


def axes(rotated: np.ndarray) -> np.ndarray:
    """(n, 2 d) components along the signed axes: i < d is +axis i, d + i is -axis i."""
    return np.hstack([rotated, -rotated])


def nearest_axis(rotated: np.ndarray) -> np.ndarray:
    """argmax of axes(), without building them."""
    at = np.abs(rotated).argmax(1)
    return at + np.where(rotated[np.arange(len(at)), at] < 0, rotated.shape[1], 0)


def best_codes(components: list[np.ndarray], most: int) -> np.ndarray:
    """(n, most) codes of the largest sums of one component of each array, best first.

    Of two lists in falling order, the pair of places i and j has i * j better ones before it, so only pairs of
    i * j <= most are looked at.
    """
    sums = codes = None
    for c in components:
        at = np.argsort(-c, axis=1, kind="stable")[:, :most].astype(np.int64)
        own = np.take_along_axis(c, at, 1)
        if sums is None:
            sums, codes = own, at
            continue
        i = np.repeat(np.arange(sums.shape[1]), np.minimum(own.shape[1], most // (np.arange(sums.shape[1]) + 1)))
        j = np.arange(len(i)) - np.repeat(np.flatnonzero(np.append(True, i[1:] != i[:-1])), np.bincount(i)[np.unique(i)])
        both, code = sums[:, i] + own[:, j], codes[:, i] * c.shape[1] + at[:, j]
        top = np.argsort(-both, axis=1, kind="stable")[:, :most]
        sums, codes = np.take_along_axis(both, top, 1), np.take_along_axis(code, top, 1)
    return codes


def _vectors(column: pa.Array) -> np.ndarray:
    """Of one width, as the caller has grouped them."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_width(batches):
    for b in batches:
        widths = np.diff(b.column("v").offsets.to_numpy())
        for w in np.unique(widths):
            yield int(w), b if (widths == w).all() else b.filter(pa.array(widths == w))


_CODES = "width int, tab int, code long, "


def _code_rows(width: int, tab: int, code: np.ndarray, key: pa.Array, name: str) -> pa.RecordBatch:
    n = len(code)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, tab, np.int32)), pa.array(code.astype(np.int64)), key], ["width", "tab", "code", name])


def _index(schemes: dict):
    def run(batches):
        for width, b in _by_width(batches):
            v, (tables, hashes, _) = _vectors(b.column("v")), schemes[width]
            signs = rotations(width, tables * hashes)
            for t in range(tables):
                code = np.zeros(len(v), np.int64)
                for s in signs[t * hashes : (t + 1) * hashes]:
                    code = code * 2 * signs.shape[2] + nearest_axis(rotate(v, s))
                yield _code_rows(width, t, code, b.column("rep"), "rep")

    return run


def _probe(schemes: dict):
    def run(batches):
        for width, b in _by_width(batches):
            tables, hashes, probes = schemes[width]
            if not hashes:
                yield _code_rows(width, 0, np.zeros(b.num_rows), b.column("rep"), "query")
                continue
            signs = rotations(width, tables * hashes)
            step = max(1, min(256, 200_000 // probes))
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                v = _vectors(part.column("v"))
                for t in range(tables):
                    codes = best_codes([axes(rotate(v, s)) for s in signs[t * hashes : (t + 1) * hashes]], probes)
                    yield _code_rows(width, t, codes.ravel(), part.column("rep").take(pa.array(np.repeat(np.arange(len(v)), codes.shape[1]))), "query")

    return run


def _in_order(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of q with the rows of v, summed from the first component to the last: equal vectors tie, in any block."""
    return np.cumsum(v * q, axis=1)[:, -1]


def _rerank(most: int, once: bool):
    """Blocks come sorted, vectors (side 0) before queries (side 1). Emits the `most` best of each query in each block; more
    where an id may have several vectors, so that `most` ids are among them."""

    def best(scores, ids):
        edge = min(most, len(scores)) if once else None
        if once:
            least = np.partition(scores, len(scores) - edge)[-edge]
        else:
            top: dict = {}
            for s, i in sorted(zip(scores.tolist(), ids.tolist()), reverse=True):
                top.setdefault(i, s)
                if len(top) == most:
                    break
            least = min(top.values())
        # products of a matrix may be a little off
        return np.flatnonzero(scores >= least - 1e-9 * max(1.0, abs(least)))

    def run(batches):
        for t, edges in runs(batches, "block"):
            for a, z in zip(edges.tolist(), edges[1:].tolist()):
                held: dict = {}
                for b in t.slice(a, z - a).to_batches():
                    for width, part in _by_width([b]):
                        v, side, rep, id_ = _vectors(part.column("v")), part.column("side").to_numpy(), part.column("rep").to_numpy(), part.column("id").to_numpy()
                        own = np.flatnonzero(side == 0)
                        if len(own):
                            old = held.get(width, (rep[:0], v[:0], id_[:0]))
                            held[width] = tuple(np.concatenate([x, y]) for x, y in zip(old, (rep[own], v[own], id_[own])))
                        asked = np.flatnonzero(side == 1)
                        if not len(asked):
                            continue
                        reps, vecs, ids = held[width]
                        order = np.argsort(reps, kind="stable")
                        place = reps[order]
                        out = []
                        for i in asked:
                            at = order[np.searchsorted(place, np.asarray(part.column("found")[int(i)].values))]
                            at = at[best(vecs[at] @ v[i], ids[at])]
                            out.append((rep[i], reps[at], ids[at], _in_order(v[i], vecs[at])))
                        n = [len(x[1]) for x in out]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in out], n)), *[pa.array(np.concatenate([x[j] for x in out])) for j in (1, 2, 3)]], ["query", "rep", "least", "score"])

    return run


def different(vectors: DataFrame, every: int, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rep, id, v) of every row that takes part, and (rep, id, v, asked) of each different vector with the least of its ids."""
    d = vectors.select(F.col(id_col).cast("long").alias("id"), clean_vector(vec_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    d = d.where(F.exists("v", lambda x: x != 0)).select("id", "v", F.xxhash64("v").alias("rep"))
    each = d.groupBy("rep").agg(F.min(F.struct("id", "v")).alias("x"), F.max((F.col("id") % every == 0).cast("int")).alias("asked"))
    return d, written(each.select("rep", "x.id", "x.v", "asked"), "ann-vectors")


_KEYS = ("width", "tab", "code", "piece")


def _meet(batches):
    """Lists of candidates of each query by block, from rows sorted by bucket and side: rows (side 0) before queries (side 1)."""

    def given(found):
        q, block, rep = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((rep, block, q))
        q, block, rep = q[order], block[order], rep[order]
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (block[1:] != block[:-1])])
        fit = new | np.concatenate([[True], rep[1:] != rep[:-1]])  # met in several tables
        start = np.flatnonzero(new[fit])
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, fit.sum()).astype(np.int32)), pa.array(rep[fit]))
        return pa.RecordBatch.from_arrays([pa.array(q[fit][start]), pa.array(block[fit][start]), lists], ["query", "block", "found"])

    held, found, n = None, [], 0
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy() for c in (*_KEYS, "side", "rep", "block")]
        if held is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
        *keys, side, rep, block = cols
        new = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in keys])])
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rows = np.add.reduceat(side == 0, start)
        asked = np.flatnonzero(side == 1)
        asked = asked[rows[group[asked]] > 0]
        last = start[-1]  # the last bucket may go on in the next batch: its rows are held, its queries are done with
        keep = np.append(np.zeros(last, bool), side[last:] == 0)
        held = [c[keep] for c in cols]
        many = np.cumsum(rows[group[asked]])
        for part in np.split(asked, np.searchsorted(many, np.arange(_GATHERED, many[-1], _GATHERED))) if len(asked) else []:
            size = rows[group[part]]
            ends = np.cumsum(size)
            at = np.repeat(start[group[part]] - (ends - size), size) + np.arange(size.sum())
            found.append((np.repeat(rep[part], size), block[at], rep[at]))
            n += len(at)
            if n >= _GATHERED:
                yield given(found)
                found, n = [], 0
    if n:
        yield given(found)


def candidates(each: DataFrame, schemes: dict) -> DataFrame:
    """(query, block, found): the different vectors that each query meets in its tables' buckets, by blocks."""
    blocks = max(1, -(-each.count() // BLOCK))
    block = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block")
    index = written(each.select("rep", "v").mapInArrow(_index(schemes), _CODES + "rep long").select("width", "tab", "code", F.lit(0).alias("side"), "rep", block), "ann-index")
    probed = each.where("asked = 1").select("rep", "v").mapInArrow(_probe(schemes), _CODES + "query long").select("width", "tab", "code", F.lit(1).alias("side"), F.col("query").alias("rep"), F.lit(0).alias("block"))
    buckets = [*_KEYS[:3]]
    full = written(index.groupBy(*buckets).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FULL).withColumn("pieces", F.ceil(F.col("n") / FULL).cast("int")).drop("n"), "ann-full-buckets")
    if full.isEmpty():
        both = index.unionByName(probed).withColumn("piece", F.lit(0))
    else:
        own = F.coalesce(F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("pieces")), F.lit(0)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))
        both = index.join(full, buckets, "left").withColumn("piece", own).unionByName(probed.join(full, buckets, "left").withColumn("piece", every)).drop("pieces")
    found = both.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "side").mapInArrow(_meet, "query long, block int, found array<long>")
    return found.groupBy("query", "block").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, tables: int = TABLES, probes: int | None = None, exact: bool = False, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found of every vector whose id is divisible by `every`.

    Nearness is the inner product, in double precision, summed from the first component to the last; vectors are taken to be
    of about equal length, as the hash sees only their direction. Every row is in every table's index, whatever the table's
    size (4 k rows at most are one bucket, as a query has to get k of them); exact compares every query with every row instead, and is never taken unasked. The probes are so many that RECALL of
    the 20 nearest of random unit vectors, which are the hardest, are met. What that costs, as codes met over all rows, before
    those met twice are put together: of 64 dimensions 0.3 at 500 rows, 0.06 at 20,000 and 0.02 at 1,000,000; of 256
    dimensions 0.3 and 0.2; of 384 dimensions 0.5 at 20,000 and 0.2 at 1,000,000, of 768 dimensions 0.7 and 0.4, where exact is
    hardly dearer. Tests hold the tables to a recall of 0.9 in these and larger sizes, and whole searches of given rows.

    Rows with no id, or whose vector is null, empty, zero or holds a null or non-finite component, take no part. Candidates
    are the rows of other ids and of the query's length. Rows of one id count once for a query, by the best score. Ties go to
    the smaller vec_id. An empty table gives no rows.
    """
    d, each = different(vectors, every, id_col, vec_col)
    # of equal vectors the k + 1 least ids can come into a result
    ids = d.select("rep", "id").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("nth") <= k + 1).drop("nth")
    rows = {r["width"]: r["n"] for r in each.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a width
    if not rows:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    once = d.select("id", "rep").distinct().groupBy("id").count().where("count > 1").isEmpty()
    schemes = {w: scheme(w, n, exact, tables, probes, k) for w, n in rows.items()}
    found = candidates(each, schemes)
    block = F.pmod(F.xxhash64("rep"), F.lit(-(-sum(rows.values()) // BLOCK))).cast("int").alias("block")
    asked = found.join(each.select(F.col("rep").alias("query"), "id", "v"), "query").select("block", F.lit(1).alias("side"), F.col("query").alias("rep"), "id", "v", "found")
    held = each.select(block, F.lit(0).alias("side"), "rep", "id", "v", F.lit(None).cast("array<long>").alias("found"))
    x = held.unionByName(asked).repartition("block").sortWithinPartitions("block", "side").mapInArrow(_rerank(k + 1, once), "query long, rep long, least long, score double")
    if once:  # of equal scores the vectors with the least ids
        x = x.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least"))).where(F.col("nth") <= k + 1).drop("nth")
    queries = d.where(F.col("id") % every == 0).select(F.col("rep").alias("query"), F.col("id").alias("query_id")).distinct()
    x = x.join(ids.withColumnRenamed("id", "vec_id"), "rep").join(queries, "query").where(F.col("query_id") != F.col("vec_id"))
    x = x.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return x.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
