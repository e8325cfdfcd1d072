"""SimHash near-dedup with vantage-point trees over whole fingerprints.

Equal fingerprints are one, with the least id of their documents. A tree is grown over a sample of fingerprints: a node has a
vantage point and a radius, and holds what is within the radius on one side, the rest on the other. Every fingerprint has one
leaf as its home. Two fingerprints at distance `most` or less part at one node at most; there the nearer one, which the triangle
bound puts within `most` of the radius, is sent to the other side as a query as well, and goes on wherever the bounds leave
room for the other one. So each leaf, on its own, sees every pair that it is due to see, and all pairs are exact.

A leaf's rows are worked off in blocks of BLOCK homes, each with a tree of its own; rows that ask are streamed past it. Of the
pairs found only those go out that join what was apart, so no block gives more links than it has rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_few_files, written
from .graph import Union, stars

#: Fingerprints that a block holds as homes; sampled fingerprints a block of the table, and at most; a leaf of the sample has so
#: many at least.
BLOCK, SAMPLED, MOST_SAMPLED, LEAF = 1 << 15, 64, 1 << 20, 32
#: Vantage points tried at a node, each on so many fingerprints; more rows than this share sent to both sides and a node is a leaf.
_TRIES, _TRIED, _BOTH = 16, 512, 0.7
#: Homes that are compared one by one; queries that go through a block's tree at once.
_ENDS, _ASKED = 256, 8_192
_PIECE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _words(data: bytes):
    """Lists of words of pieces of the text, so that no list grows with it."""
    at = 0
    while at < len(data):
        cut = _BLANK.search(data, at + _PIECE)
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """64 bits: each is set in over half of the XXH64 of all shingles of `width` words, repeats included; of the whole text if
    it has fewer words. A-Z are lower-cased and words are runs of `[^\\x20\\x09-\\x0D]`. A text without words has 0."""
    bits, n, held = np.zeros(64, np.int64), 0, []

    def count(shingled: list[bytes]) -> int:
        h = np.array([xxhash.xxh64_intdigest(x, seed) for x in shingled], np.uint64)
        for i in range(0, len(h), 8_192):
            bits[:] += np.unpackbits(h[i : i + 8_192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        return len(h)

    for words in _words(text.encode().lower()):
        words = held + words
        n += count([b" ".join(x) for x in zip(*(words[i:] for i in range(width)))])
        held = words[max(0, len(words) - width + 1) :]
    if not n and held:
        n = count([b" ".join(held)])
    return int.from_bytes(np.packbits(2 * bits > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp as the signed number of the same bits. A null text has 0."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                fp = np.array([fingerprint(x.as_py() or "", width) for x in b.column("text").slice(i, 256)], np.uint64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 256), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _far(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _split(points: np.ndarray, most: int, rng) -> tuple[np.uint64, int] | None:
    """The vantage point, of some of the points, and radius that send the fewest to both sides; None where that is too many."""
    some = points if len(points) <= _TRIED else rng.choice(points, _TRIED, replace=False)
    best = None
    for v in rng.choice(some, min(_TRIES, len(some)), replace=False):
        d = _far(some, v)
        for r in {int(np.quantile(d, x, method="lower")) for x in (0.3, 0.4, 0.5, 0.6, 0.7)}:
            inner = (d <= r).mean()
            both = ((d > r - most) & (d <= r + most)).mean()
            if 0.2 <= inner <= 0.8 and (best is None or both < best[0]):
                best = (both, v, r)
    return None if best is None or best[0] > _BOTH else best[1:]


class Tree:
    """Nodes in rows of arrays: vantage point, radius, and the rows of the inner and outer side; leaves are numbered."""

    def __init__(self, points: np.ndarray, leaf: int, most: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.most, self.nodes, self.leaves = most, [], 0
        self.root = self._grow(np.unique(points), leaf, rng)

    def _grow(self, points: np.ndarray, leaf: int, rng) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        cut = _split(points, self.most, rng) if len(points) > leaf else None
        if cut is None:
            self.nodes[at] = (self.leaves,)
            self.leaves += 1
        else:
            v, r = cut
            inner = _far(points, v) <= r
            self.nodes[at] = (v, r, self._grow(points[inner], leaf, rng), self._grow(points[~inner], leaf, rng))
        return at

    def deal(self, fp: np.ndarray, ask: bool):
        """(leaf, rows, whether they only ask) of rows in all leaves that they go to; with ask none has a home."""
        todo = [(self.root, np.arange(len(fp)), ask)]
        while todo:
            at, rows, asking = todo.pop()
            if not len(rows):
                continue
            node = self.nodes[at]
            if len(node) == 1:
                yield node[0], rows, asking
                continue
            v, r, inner, outer = node
            d = _far(fp[rows], v)
            if asking:
                todo += [(inner, rows[d <= r + self.most], True), (outer, rows[d > r - self.most], True)]
            else:
                todo += [(inner, rows[d <= r], False), (outer, rows[d > r], False), (outer, rows[(d <= r) & (d > r - self.most)], True)]


def _dealt(tree: Tree):
    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for leaf, rows, asking in tree.deal(fp, False):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf, np.int32)), pa.array(np.full(len(rows), int(asking), np.int32)), b.column("fp").take(at), b.column("rep").take(at)], ["leaf", "side", "fp", "rep"])

    return run


class _Block:
    """Homes of one block. Links that join what was apart among all that has been asked."""

    def __init__(self, fp: np.ndarray, rep: np.ndarray, most: int):
        self.most, self.union = most, Union()
        tree = Tree(fp if len(fp) <= 1 << 14 else fp[:: len(fp) // (1 << 14)], _ENDS // 2, most)
        self.tree = tree
        leaf_of = np.empty(len(fp), np.int64)
        for leaf, rows, asking in tree.deal(fp, False):
            if not asking:
                leaf_of[rows] = leaf
        order = np.argsort(leaf_of, kind="stable")
        self.fp, self.rep = fp[order], rep[order]
        self.edges = np.searchsorted(leaf_of[order], np.arange(tree.leaves + 1))

    def ask(self, fp: np.ndarray, rep: np.ndarray):
        for i in range(0, len(fp), _ASKED):
            f, p = fp[i : i + _ASKED], rep[i : i + _ASKED]
            for leaf, rows, _ in self.tree.deal(f, True):
                homes = slice(self.edges[leaf], self.edges[leaf + 1])
                yield from self._pairs(f[rows], p[rows], self.fp[homes], self.rep[homes])

    def _pairs(self, f, p, g, q):
        at, step, wide = 0, 16, max(1, (1 << 21) // max(1, len(g)))
        while at < len(f):  # few at first: later rows are asked of what is joined by then
            a, b = np.nonzero(_far(f[at : at + min(step, wide), None], g[None]) <= self.most)
            if len(a):
                home, of = np.unique(b, return_inverse=True)
                top = np.array([self.union.top(x) for x in q[home].tolist()], np.int64)[of]
                order = np.lexsort((top, a))
                a, b, top = a[order], b[order], top[order]
                fit = np.concatenate([[True], (a[1:] != a[:-1]) | (top[1:] != top[:-1])])
                for x, y in zip(p[at + a[fit]].tolist(), q[b[fit]].tolist()):
                    if self.union.join(x, y):
                        yield x, y
            at, step = at + min(step, wide), 4 * step


def _linked(most: int):
    """Rows come sorted by leaf, block and side: homes (side 0), then those that ask. A home asks in its own block, too."""

    def run(batches):
        now, homes, block = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            leaf, part, side = (b.column(c).to_numpy() for c in ("leaf", "block", "side"))
            fp, rep = b.column("fp").to_numpy().view(np.uint64), b.column("rep").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1]), [True]]))
            found = []
            for i, j in zip(edges, edges[1:]):
                if now != (leaf[i], part[i]):
                    if homes and block is None:
                        found += _own(homes, most)[1]
                    now, homes, block = (leaf[i], part[i]), [], None
                if side[i] == 0:
                    homes.append((fp[i:j], rep[i:j]))
                    continue
                if block is None and homes:
                    block, own = _own(homes, most)
                    found += own
                if block is not None:
                    found += block.ask(fp[i:j], rep[i:j])
            if found:
                yield _links(found)
        if homes and block is None and (found := _own(homes, most)[1]):
            yield _links(found)

    return run


def _own(homes: list, most: int) -> tuple[_Block, list]:
    fp, rep = (np.concatenate(x) for x in zip(*homes))
    block = _Block(fp, rep, most)
    return block, list(block.ask(fp, rep))


def _links(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def links(reps: DataFrame, most: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): links between the ids of different fingerprints, rows (fp, rep), that join all that are linked."""
    spark = reps.sparkSession
    n = reps.count()
    sampled = max(1, min(MOST_SAMPLED, -(-n * SAMPLED // block)))
    sample = np.array([r["fp"] for r in reps.orderBy(F.xxhash64("fp")).limit(sampled).collect()], np.int64)  # MOST_SAMPLED numbers
    tree = Tree(sample.view(np.uint64), max(LEAF, SAMPLED // 2), most)
    x = written(reps.mapInArrow(_dealt(tree), "leaf int, side int, fp long, rep long"), "leaves")
    # a row a leaf, which are fewer than the sample; as a table both sides of the join are plain exchanges, so Spark can split it
    blocks = written(in_few_files(x.where("side = 0").groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))), "leaf-blocks")
    x = x.join(blocks, "leaf")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    at = lambda side, b: F.struct(F.lit(side).alias("side"), b.alias("block"))
    before = lambda end: F.when(end > 0, F.transform(F.sequence(F.lit(0), end - 1), lambda b: at(1, b)))
    none = F.array().cast("array<struct<side:int,block:int>>")
    # a home goes to its own block and asks in those before it, one that only asks does so in all
    to = F.when(F.col("side") == 0, F.concat(F.array(at(0, own)), F.coalesce(before(own), none))).otherwise(before(F.col("blocks")))
    x = x.select("leaf", "fp", "rep", F.explode(to).alias("to")).select("leaf", "to.block", "to.side", "fp", "rep")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes and much work: not merged by their bytes
    return x.repartition(parts, "leaf", "block").sortWithinPartitions("leaf", "block", "side").mapInArrow(_linked(most), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 3, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs; fp as fingerprints() has it.

    Documents whose fingerprints differ in `most` bits at most are linked; component_id is the least id that links lead to.
    Texts that are null or without words have the fingerprint 0, which is linked like any other. A row without id takes no
    part: its component_id is null. Rows of one id are one document, which has the links of each of its texts. Other columns
    are not looked at. An empty table gives no rows.
    """
    d = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    some = d.where(F.col("doc_id").isNotNull())
    reps = written(some.groupBy("fp").agg(F.min("doc_id").alias("rep")), "different-fingerprints")
    # an id with several fingerprints links them: each one's least id with it
    twice = some.groupBy("doc_id").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where(F.col("least") != F.col("most")).select("doc_id")
    shared = some.join(twice, "doc_id", "left_semi").distinct().join(reps, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    of = stars(links(reps, most, block).unionByName(shared))
    # a table of its own, so that Spark can split the join below at a fingerprint that very many documents have
    top = reps.join(of.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("fp").alias("f"), F.coalesce("component", "rep").alias("component_id"))
    top = written(in_few_files(top), "fingerprint-components")
    discard(reps)
    x = d.join(top, (F.col("fp") == F.col("f")) & F.col("doc_id").isNotNull(), "left")
    return x.select("doc_id", "fp", "component_id")
