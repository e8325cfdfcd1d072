"""MinHash near-dedup with an LSH forest.

Documents of one shingle set are one set. Every set has a signature of HASHES values and stands in TREES sorted orders: the
order of tree t sorts by the signature's values from the t-th group on, as a path of up to LEVELS levels.

1. Neighbours. In the first orders each set is compared with those of the longest common prefix. How deep that is adapts to the
   place: a run of sets that share SHALLOW levels is cut, wherever it holds more than NEAR sets, at the shortest prefix that two
   neighbours share there, again and again. So a sparse place is compared at two levels, a dense one at as many as it takes. The
   last set of a piece stands in the next one too. Sets are compared in full, within their piece.
2. The rest. What has been joined counts as one component. Sets that share a path's first DEPTH levels form a region of a tree;
   in each region of every tree that holds several components, all pairs of sets from different ones are candidates, those
   within a component need no look. One-bit sketches drop what is far below the threshold, and full sets decide.

A pair of the threshold's similarity s shares DEPTH levels of a tree with probability s ** DEPTH, so at 0.8 and 24 trees about
3 pairs of a million that nothing else links are missed. A set is sent once for each region in which it has such a partner,
which are TREES at most; regions of more than BLOCK_HASHES hashes are worked off in blocks, and only links that join components
come out of a block. No step takes all pairs of a group of alike sets, and no step holds a whole group.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, in_few_files, runs, spare, written
from .graph import Union, stars
from .shingles import WordHashes, _mix, bits, multipliers, set_key, shingles, signature

HASHES, TREES, DEPTH, LEVELS, SHALLOW = 128, 24, 4, 8, 2
#: Orders whose nearest neighbours are compared first, and sets that are compared there at once.
FIRST_TREES, NEAR = 3, 64
#: Hashes of a block's sets that are compared with those of another one.
BLOCK_HASHES = 1 << 19
#: Rows of a region that are looked at pair by pair to leave out those without any partner; rows that are held for that.
_PAIRWISE, _CARRY = 512, 100_000


@lru_cache(maxsize=1)
def _words() -> WordHashes:
    return WordHashes()


def most_bits(percent: int, hashes: int = HASHES) -> int:
    """Differing sketch bits at which a pair is out: 5.6 standard deviations above the mean at the threshold."""
    p = (1 - percent / 100) / 2
    return int(np.ceil(hashes * p + 5.6 * np.sqrt(hashes * p * (1 - p))))


def _sketch(width: int):
    by = multipliers(HASHES)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1_000):
                rows = []
                for text in b.column("text").slice(i, 1_000).to_pylist():
                    x = shingles(text or "", width, _words())
                    rows.append((len(x), *set_key(x), signature(x, by).tobytes()))
                n, k1, k2, sig = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 1_000), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n", "k1", "k2", "sig"])

    return run


def _sets(width: int):
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 200):
                found = [shingles(t or "", width, _words()).view(np.int64) for t in b.column("text").slice(i, 200).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("rep").slice(i, 200), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))], ["rep", "hashes"])

    return run


def paths(sig: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """The path of each signature in a tree: 16 bits a level, four levels a number."""
    at = (tree * DEPTH + np.arange(LEVELS)) % sig.shape[1]
    v = _mix(sig[:, at].astype(np.uint64) + np.uint64(1)) & np.uint64(0xFFFF)
    shift = np.array([48, 32, 16, 0], dtype=np.uint64)
    return tuple((v[:, i : i + 4] << shift).sum(1, dtype=np.uint64).view(np.int64) for i in (0, 4))


_FOREST = "tree int, p1 long, p2 long, rep long, n int, s1 long, s2 long"


def _forest(batches):
    names = [x.split()[0] for x in _FOREST.split(", ")]
    for b in batches:
        for i in range(0, b.num_rows, 2_000):
            part = b.slice(i, 2_000)
            sig = np.stack([np.frombuffer(x.as_py(), np.uint32) for x in part.column("sig")])
            s, n = bits(sig).view(np.int64), part.column("n").cast(pa.int32())
            for t in range(TREES):
                p1, p2 = paths(sig, t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), pa.array(p1), pa.array(p2), part.column("rep"), n, *[pa.array(np.ascontiguousarray(s[:, j])) for j in range(2)]], names)


def _apart(s: np.ndarray, a, b) -> np.ndarray:
    """Differing bits of the sketches of rows a and b."""
    return np.bitwise_count(s[a] ^ s[b]).sum(-1)


def common_levels(p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """Levels that each row's path shares with the row before; 0 for the first row."""
    out = np.zeros(len(p1), np.int64)
    for i in range(LEVELS):
        p, shift = (p1, p2)[i // 4].view(np.uint64), np.uint64(48 - 16 * (i % 4))
        out[1:] += (p[1:] >> shift == p[:-1] >> shift) & (out[1:] == i)
    return out


def pieces(lcp: np.ndarray, most: int = NEAR) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a run of rows; lcp holds the levels that each row shares with the one before.

    A run of more than `most` rows is cut in its second half where the fewest levels are shared. Each piece but the first
    begins with the last row of the piece before, its nearest neighbour beyond the cut.
    """
    out, at, n = [], 0, len(lcp)
    while n - at > most:
        cut = at + most // 2 + int(np.argmin(lcp[at + most // 2 : at + most]))
        out.append((at, cut))
        at = cut - 1
    return [*out, (at, n)]


def _partners(most: int):
    """From rows in forest order those that have a partner in their region (piece 0), and the pieces that nearest neighbours are
    compared in, numbered by a hash of their first row.

    A region at the edge of a task's rows, or one larger than is looked at pair by pair, keeps all its rows.
    """

    def look(tree, p1, p2, rep, s, first: bool, last: bool):
        n = len(rep)
        alive = np.zeros(n, bool)
        new = np.concatenate([[True], (tree[1:] != tree[:-1]) | (p1[1:] != p1[:-1])])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, n))
        region = np.cumsum(new) - 1
        if first:
            alive[: size[0]] = True
        if last:
            alive[start[-1] :] = True
        alive |= (size > _PAIRWISE)[region]
        rest = np.flatnonzero((size > 1)[region] & (size <= _PAIRWISE)[region])
        for o in range(1, int(size[size <= _PAIRWISE].max(initial=1))):
            b = rest[rest >= o]
            b = rest = b[region[b - o] == region[b]]  # what has no region-mate so far back has none farther back
            fit = _apart(s, b - o, b) <= most
            alive[b[fit] - o] = True
            alive[b[fit]] = True
        # neighbours of a shorter prefix count too, where their sketches are near
        lcp = np.where(np.concatenate([[False], tree[1:] == tree[:-1]]), common_levels(p1, p2), 0)
        near = np.concatenate([[False], _apart(s, np.arange(n - 1), np.arange(1, n)) <= most])
        some = (tree < FIRST_TREES) & (alive | ((lcp >= SHALLOW) & near) | np.append(((lcp >= SHALLOW) & near)[1:], False))
        found, at = [], np.flatnonzero(some)
        if len(at):
            begins = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (lcp[at[1:]] < SHALLOW)]))
            for a, z in zip(begins, np.append(begins[1:], len(at))):
                if z - a > 1:
                    found += [at[a + i : a + j] for i, j in pieces(np.append(99, lcp[at[a + 1 : z]]))]
        return np.flatnonzero(alive), found

    names = ["piece", "tree", "p1", "rep", "n", "s1", "s2"]

    def run(batches):
        for (tree, p1, p2, rep, n, s), first, last in _regions(batches, ("tree", "p1", "p2", "rep", "n")):
            alive, found = look(tree, p1, p2, rep, s, first, last)
            head = np.array([x[0] for x in found], np.int64)
            keys = _mix(_mix(rep[head].view(np.uint64)) ^ _mix(p1[head].view(np.uint64)) + tree[head].astype(np.uint64)).view(np.int64) | 1
            at = np.concatenate([alive, *found]).astype(np.int64)
            if len(at):
                piece = np.concatenate([np.zeros(len(alive), np.int64), np.repeat(keys, [len(x) for x in found])])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (piece, tree[at], p1[at], rep[at], n[at], s[at, 0].view(np.int64), s[at, 1].view(np.int64))], names)

    return run


def _regions(batches, names: tuple[str, ...]):
    """((the named columns, sketches), whether the first region may have begun before, whether the last may go on) of whole
    regions from sorted rows. names starts with tree and p1."""
    held, first = None, True
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy() for c in names]
        cols.append(np.stack([b.column(c).to_numpy() for c in ("s1", "s2")], axis=1).view(np.uint64))
        now = cols if held is None else [np.concatenate([x, y]) for x, y in zip(held, cols)]
        tree, p1 = now[0], now[1]
        cut = int(np.argmax((tree == tree[-1]) & (p1 == p1[-1])))  # the last region may go on in the next batch
        if cut and cut >= len(tree) - _CARRY:
            yield [x[:cut] for x in now], first, False
            held, first = [x[cut:] for x in now], False
        elif len(tree) > _CARRY:
            yield now, True, True  # a region larger than is held
            held, first = None, True
        else:
            held = now
    if held is not None:
        yield held, first, True


def _sketch_columns(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(c).to_numpy() for c in ("s1", "s2")], axis=1).view(np.uint64)


_BLOCK = ("tree", "p1", "block", "other")


def _near_rows(most: int, percent: int):
    """The rows of each block that have a partner of another component on the other side, by sketch and size."""

    def run(batches):
        for t, edges in runs(batches, *_BLOCK):
            side, comp, n, s = t.column("side").to_numpy(), t.column("component").to_numpy(), t.column("n").to_numpy(), _sketch_columns(t)
            keep = np.zeros(t.num_rows, bool)
            for a, z in zip(edges, edges[1:]):
                left, right = a + np.flatnonzero(side[a:z] == 0), a + np.flatnonzero(side[a:z] == 1)
                for i in range(0, len(right), 256):
                    r = right[i : i + 256]
                    for j in range(0, len(left), 4_096):
                        c = left[j : j + 4_096]
                        fit = (comp[r][:, None] != comp[c][None]) & _alike(n[r][:, None], n[c][None], percent)
                        fit &= np.bitwise_count(s[r][:, None] ^ s[c][None]).sum(2) <= most
                        keep[r[fit.any(1)]] = True
                        keep[c[fit.any(0)]] = True
            if keep.any():
                yield from t.filter(pa.array(keep)).to_batches()

    return run


def _alike(n, m, percent: int):
    """Whether sets of such sizes can reach the threshold at all."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _full_sets(keys: tuple[str, ...], most: int, percent: int):
    """Links (a, b) that the full sets of a group confirm: each joins two components that were apart, and all that can be joined
    are. A row of side 1 meets those of side 0; where all rows are of side 1, each meets the rows before it."""

    def links(rep, comp, side, n, s, flat, offsets):
        union = Union()
        left = np.flatnonzero(side == 0)
        top = comp.copy()
        for i in np.flatnonzero(side == 1):
            own = flat[offsets[i] : offsets[i + 1]]
            c = left if len(left) else np.arange(i)
            c = c[(top[c] != top[i]) & _alike(n[c], n[i], percent)]
            far = np.bitwise_count(s[c] ^ s[i]).sum(1)
            c, far = c[far <= most], far[far <= most]
            c = c[np.argsort(far, kind="stable")]
            step = 1  # the nearest first: where it is linked, most others need no look
            while len(c):
                some, c = c[:step], c[step:]
                values = np.concatenate([flat[offsets[j] : offsets[j + 1]] for j in some])
                hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
                both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(n[some])[:-1]]))
                for j in some[100 * both >= percent * (n[i] + n[some] - both)]:
                    if union.join(int(comp[i]), int(comp[j])):
                        yield rep[i], rep[j]
                        was = {int(top[i]), int(top[j])}
                        now = min(was)
                        top[np.isin(top, list(was))] = now
                c = c[top[c] != top[i]]
                step = min(4 * step, 256)

    def run(batches):
        for t, edges in runs(batches, *keys):
            rep, comp, side, s = t.column("rep").to_numpy(), t.column("component").to_numpy(), t.column("side").to_numpy(), _sketch_columns(t)
            out = []
            for a, z in zip(edges.tolist(), edges[1:].tolist()):
                if z - a > 1:
                    column = t.column("hashes").slice(a, z - a).combine_chunks()
                    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
                    flat, offsets = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy().astype(np.int64)
                    offsets = offsets - offsets[0]
                    out += links(rep[a:z], comp[a:z], side[a:z], np.diff(offsets), s[a:z], flat, offsets)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _confirmed(rows: DataFrame, sets: DataFrame, keys: tuple[str, ...], most: int, percent: int) -> DataFrame:
    x = rows.join(sets, "rep").select(*keys, "rep", "component", "side", "s1", "s2", "hashes")
    return x.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(_full_sets(keys, most, percent), "a long, b long")


def mixed_blocks(rows: DataFrame, of: DataFrame, block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """Rows of the regions that hold several components, with component, block, other and side.

    Side 0 has all rows of a region, side 1 those outside its largest component. A row goes to its own block of its side, with
    each block of the other side; a region of up to block_hashes hashes is one block.
    """
    x = rows.join(of, rows["rep"] == of["node"], "left").select("tree", "p1", "rep", "n", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    n = x.groupBy("tree", "p1", "component").agg(F.sum("n").alias("h"))
    n = n.groupBy("tree", "p1").agg(F.max_by("component", F.struct("h", "component")).alias("main"), F.sum("h").alias("h"), F.max("h").alias("h_main"), F.count(F.lit(1)).alias("parts")).where(F.col("parts") > 1)
    blocks = lambda c: F.ceil(c / F.lit(block_hashes)).cast("int")
    # as a table of its own both sides of the join are plain exchanges, which Spark can split where one region is very large
    regions = written(in_few_files(n.select("tree", "p1", "main", blocks(F.col("h")).alias("blocks"), blocks(F.col("h") - F.col("h_main")).alias("others"))), "regions")
    x = x.join(regions, ["tree", "p1"])
    own = lambda of: F.pmod(F.xxhash64("rep"), F.col(of)).cast("int")
    each = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    at = lambda side, block, other: F.struct(F.lit(side).alias("side"), block.alias("block"), other.alias("other"))
    left = F.transform(each("others"), lambda o: at(0, own("blocks"), o))
    right = F.when(F.col("component") != F.col("main"), F.transform(each("blocks"), lambda b: at(1, b, own("others")))).otherwise(F.array().cast("array<struct<side:int,block:int,other:int>>"))
    return x.select("tree", "p1", "rep", "n", "s1", "s2", "component", F.explode(F.concat(left, right)).alias("at")).select("*", "at.*").drop("at")


def _shared_ids(some: DataFrame) -> DataFrame:
    """Links (a, b) between an id that has several sets and the least id of each of them."""
    twice = some.groupBy("doc_id").agg(F.min("k1").alias("least"), F.max("k1").alias("most")).where(F.col("least") != F.col("most")).select("doc_id")
    own = some.select("doc_id", "k1", "k2").join(twice, "doc_id", "left_semi").distinct()
    rep = some.groupBy("k1", "k2").agg(F.min("doc_id").alias("b"))
    return own.join(rep, ["k1", "k2"]).where(F.col("doc_id") != F.col("b")).select(F.col("doc_id").alias("a"), "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    Documents are linked if the Jaccard similarity of their sets of distinct `width`-word shingles is percent / 100 or more;
    component_id is the least id that links lead to, kept whether it is the document's own. A text of fewer words is one
    shingle; one without words, or a null, has no shingles and is linked with nothing. A row without id takes no part: its
    component_id is null and it is kept. Rows of one id are one document, which has the links of each of its texts. Other
    columns are not looked at. An empty table gives no rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    most = most_bits(percent)
    sketches = written(d.mapInArrow(_sketch(width), "doc_id long, n long, k1 long, k2 long, sig binary"), "sketches")
    some = sketches.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = some.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n", "sig")).alias("r")).select(F.col("r")["doc_id"].alias("rep"), F.col("r")["n"].alias("n"), F.col("r")["sig"].alias("sig"))
    order = ["tree", "p1", "p2", "rep"]
    forest = reps.mapInArrow(_forest, _FOREST).repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    found = written(forest.mapInArrow(_partners(most), "piece long, tree int, p1 long, rep long, n int, s1 long, s2 long"), "forest")
    involved = found.select(F.col("rep").alias("doc_id")).distinct()
    sets = written(d.join(involved, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text").mapInArrow(_sets(width), "rep long, hashes array<long>"), "sets")
    near = found.where(F.col("piece") != 0).withColumns({"component": F.col("rep"), "side": F.lit(1)})
    of = stars(_confirmed(near, sets, ("piece",), most, percent), contract=False)  # a set has few pieces and regions
    blocks = mixed_blocks(found.where(F.col("piece") == 0), of)
    blocks = blocks.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(_near_rows(most, percent), blocks.schema)
    more = _confirmed(blocks, sets, _BLOCK, most, percent).unionByName(_shared_ids(some))
    of = stars(of.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), contract=False)
    discard(found, sets)
    # a table of its own, so that Spark can split the join below at a set that very many documents have
    keys = some.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")).join(of.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), F.coalesce("component", "rep").alias("component_id"))
    keys = written(in_few_files(keys), "set-components")
    x = sketches.select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2")
    x = x.join(keys, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    x = x.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return x.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all columns of docs: that of the least id.

    Rows of one id are one document, of which the row of the least text hash stays. Rows without id all stay, and so do texts
    that are null or without words. Other columns may have any names. An empty table gives no rows.
    """
    id_, rank = spare(docs, "lost_id"), spare(docs, "rank")
    lost = near_duplicates(docs, width, percent, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(id_)).distinct()
    twice = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(id_)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(id_)
    if twice.isEmpty():  # no row but the lost ones has to go, so no text has to be put in order
        return docs.join(lost, F.col(id_col) == F.col(id_), "left_anti")
    twice = written(twice, "repeated-ids")
    once = docs.join(lost.unionByName(twice).distinct(), F.col(id_col) == F.col(id_), "left_anti")
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col)))
    again = docs.join(twice.join(lost, id_, "left_anti"), F.col(id_col) == F.col(id_), "left_semi")
    return once.unionByName(again.withColumn(rank, first).where(F.col(rank) == 1).drop(rank))
