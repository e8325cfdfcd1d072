"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by the set of sources that they belong to. From each such pattern tokens flow to the quotas of its
sources; the first use of a pattern's tokens is free, each further one costs more, so repetition is spread as thin as it can
be. The flow is a small graph of patterns and sources. What it takes from a pattern is then turned into documents: all of them
for each full use, and for the rest those that come first by a seeded hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spare, written

SEED, SHARE, REPEATS = 17, 1.5, 2
#: Sets of sources up to which what is decided about them is broadcast; beyond that it is joined by a shuffle.
BROADCAST_PATTERNS = 100_000
#: Bits of a document's hash, and bits that are looked at in one pass.
_HASH, _BITS = 60, 10
_WORDS = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def quotas(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Shares of total by weight; none above most times its size, the excess goes to the others by weight."""
    out, open_ = {}, dict(weights)
    left = total
    while open_:
        whole = sum(open_.values())
        full = [s for s in open_ if left * open_[s] / whole > most * sizes[s]]
        if not full:
            return out | {s: left * w / whole for s, w in open_.items()}
        for s in full:
            out[s] = float(most * sizes[s])
            del open_[s]
        left = total - sum(out.values())
    return out


def _levels(served: dict, room: dict, left: dict) -> tuple[dict, dict] | None:
    """Steps from the patterns with room to patterns and to sources, as far as the nearest sources with quota left; None if none can
    be reached. From a pattern one gets to its sources, and from a source to the patterns that serve it."""
    patterns: dict[tuple, int] = {p: 0 for p, n in room.items() if n > 0}
    sources: dict = {}
    front, depth = list(patterns), 0
    while front:
        reached = list(dict.fromkeys(s for p in front for s in p if s not in sources))
        sources.update(dict.fromkeys(reached, depth + 1))
        if any(left[s] > 0 for s in reached):
            return patterns, sources
        depth += 2
        front = list(dict.fromkeys(p for s in reached for p in served[s] if p not in patterns))
        patterns.update(dict.fromkeys(front, depth))
    return None


def _fill(flow: dict, served: dict, room: dict, left: dict, levels: tuple[dict, dict]) -> None:
    """Sends tokens along all paths that go up one step at a time, until each is blocked. Of every pattern and source the arcs that lead
    nowhere are passed over once, so the work is that of the arcs and not of the arcs for each path."""
    patterns, sources = levels
    arcs: dict[tuple, int] = {}
    givers: dict = {}  # source -> the patterns left to try, last first

    def path_from(start: tuple) -> list | None:
        """pattern, source, pattern that gives back, source ..., to a source with quota left."""
        path: list = [start]
        while path:
            if len(path) % 2:
                p = path[-1]
                i, up = arcs.get(p, 0), patterns[p] + 1
                while i < len(p) and sources.get(p[i]) != up:
                    i += 1
                arcs[p] = i
                if i < len(p):
                    path.append(p[i])
                    continue
                path.pop()
                if path:
                    givers[path[-1]].pop()
            else:
                s = path[-1]
                if left[s] > 0:
                    return path
                if s not in givers:
                    givers[s] = [p for p in served[s] if patterns.get(p) == sources[s] + 1][::-1]
                rest = givers[s]
                while rest and flow[rest[-1]][s] <= 0:
                    rest.pop()
                if rest:
                    path.append(rest[-1])
                    continue
                path.pop()
                arcs[path[-1]] += 1
        return None

    for start in [p for p, n in room.items() if n > 0]:
        while room[start] > 0 and (path := path_from(start)) is not None:
            gets = list(zip(path[::2], path[1::2]))
            gives = list(zip(path[2::2], path[1::2]))
            step = min([room[start], left[path[-1]], *[flow[p][s] for p, s in gives]])
            for p, s in gets:
                flow[p][s] += step
                served[s][p] = None
            for p, s in gives:
                flow[p][s] -= step
                if not flow[p][s]:
                    del served[s][p]
            room[start] -= step
            left[path[-1]] -= step


def route(patterns: dict[tuple, int], targets: dict, repeats: int) -> dict[tuple, dict]:
    """pattern -> source -> tokens: a cheapest flow of the most tokens.

    Use r of a pattern costs r - 1 a token, which is convex. Costs only rise with the use, so one use of all patterns is used up
    before the next is looked at: each is a largest flow on top of what is there, by blocking flows along shortest paths. A path may
    take a pattern's tokens back from one source to give them to another. A round of blocking flow costs the arcs of patterns to
    sources, and rounds are as many as there are lengths of paths: one where each pattern has one source.
    """
    flow: dict[tuple, dict] = {p: dict.fromkeys(p, 0) for p in patterns}
    served: dict = {s: {} for s in targets}  # source -> the patterns that serve it
    left = {s: int(t + 0.5) for s, t in targets.items()}
    for _ in range(repeats):
        room = dict(patterns)
        while (levels := _levels(served, room, left)) is not None:
            _fill(flow, served, room, left, levels)
    return flow


@dataclass
class Mix:
    """sources: (source, size, target); uses: (pattern, full uses, last hash of a document used once more)."""

    sources: list[tuple]
    uses: list[tuple]


def _lean(docs: DataFrame, member: Column, id_col: str, text_col: str, seed: int) -> DataFrame:
    """(doc_id, sources, size, h); h ranks a document within its pattern, the same in every run."""
    return docs.select(F.col(id_col).alias("doc_id"), member.alias("sources"), words(F.col(text_col)).alias("size"), _hash(seed, F.col(id_col), F.col(text_col)).alias("h"))


def _hash(seed: int, id_: Column, text: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), id_.cast("string"), text)), 1, _HASH // 4), 16, 10).cast("long")


def _pattern_key(sources: Column) -> Column:
    """A string that tells sets of sources apart, null members too."""
    return F.to_json(F.struct(sources.alias("s")), {"ignoreNullFields": "false"})


def _decided(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A row a pattern, for a join with documents."""
    x = spark.createDataFrame(rows, schema)
    return F.broadcast(x) if len(rows) <= BROADCAST_PATTERNS else x


def _last_hash(lean: DataFrame, wanted: dict[str, int]) -> dict[str, int]:
    """Pattern -> the hash up to which documents come nearest to the tokens wanted.

    The hash's leading bits are counted first, then the next bits within the bucket in which the sum is reached, so that only
    about a millionth of a pattern's documents is ever put in order.
    """
    spark = lean.sparkSession
    todo = {p: (n, 0, 0) for p, n in wanted.items() if n > 0}  # tokens still wanted, prefix, its bits
    for bits in (_BITS, 2 * _BITS):
        if not todo:
            return {}
        state = _decided(spark, [(p, n, prefix) for p, (n, prefix, _) in todo.items()], "pattern string, wanted long, prefix long")
        x = lean.join(state, "pattern").withColumn("bucket", F.shiftright(F.col("h"), _HASH - bits))
        x = x.where(F.shiftright(F.col("h"), _HASH - bits + _BITS) == F.col("prefix")) if bits > _BITS else x
        x = x.groupBy("pattern", "bucket").agg(F.sum("size").alias("n"), F.first("wanted").alias("wanted"))
        x = x.withColumn("sum", F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket")))
        cut = x.where((F.col("sum") >= F.col("wanted")) & (F.col("sum") - F.col("n") < F.col("wanted"))).select("pattern", "bucket", (F.col("wanted") - F.col("sum") + F.col("n")).alias("rest")).collect()
        todo = {r["pattern"]: (r["rest"], r["bucket"], bits) for r in cut}
    if not todo:
        return {}
    state = _decided(spark, [(p, n, prefix) for p, (n, prefix, _) in todo.items()], "pattern string, wanted long, prefix long")
    x = lean.join(state, "pattern").where(F.shiftright(F.col("h"), _HASH - 2 * _BITS) == F.col("prefix"))
    x = x.groupBy("pattern", "h").agg(F.sum("size").alias("n"), F.first("wanted").alias("wanted"))
    x = x.withColumn("sum", F.sum("n").over(Window.partitionBy("pattern").orderBy("h")))
    # before the first of the bucket, or at the document that comes nearest; where both are as near, before
    near = x.groupBy("pattern").agg(F.min_by("h", F.struct(F.abs(F.col("sum") - F.col("wanted")), "h")).alias("h"), F.min(F.abs(F.col("sum") - F.col("wanted"))).alias("off"), F.first("wanted").alias("wanted")).collect()
    out = {r["pattern"]: r["h"] for r in near if r["off"] < r["wanted"]}
    for r in near:  # nothing of this bucket: up to the last hash before it
        if r["pattern"] not in out:
            prefix = todo[r["pattern"]][1]
            if prefix > 0:
                out[r["pattern"]] = (prefix << (_HASH - 2 * _BITS)) - 1
    return out


def plan(docs: DataFrame, member: Column, weights, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Mix]:
    """The documents' lean table and the mix.

    member: the distinct sources of a document, sorted; weights: of the sorted list of all sources, nulls last, gives theirs.
    What comes to the driver is a row a set of sources, with its tokens, and later two numbers of it: nothing grows with the
    documents of a set. Documents don't come to the driver.
    """
    lean = written(_lean(docs, member, id_col, text_col, seed).withColumn("pattern", _pattern_key(F.col("sources"))), "mix-lean")
    patterns = lean.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("n")).collect()
    by = {tuple(r["sources"]): r["n"] for r in patterns}
    key = {tuple(r["sources"]): r["pattern"] for r in patterns}
    sizes: dict = {}
    for p, n in by.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = quotas(sizes, dict(zip(names, weights(names))), share * sum(by.values()), repeats)
    flow = route(by, targets, repeats)
    taken = {p: sum(f.values()) for p, f in flow.items()}
    full = {p: min(repeats, taken[p] // n) if n else 0 for p, n in by.items()}
    last = _last_hash(lean, {key[p]: taken[p] - full[p] * n for p, n in by.items()})
    uses = [(key[p], int(full[p]), last.get(key[p])) for p in by]
    return lean, Mix([(s, sizes[s], float(targets[s])) for s in names], uses)


def _copies(full: Column, last: Column, h: Column) -> Column:
    return full + F.coalesce(h <= last, F.lit(False)).cast("int")


def _uses(spark: SparkSession, m: Mix) -> DataFrame:
    return _decided(spark, m.uses, "use_pattern string, full int, last long")


def taken(lean: DataFrame, m: Mix) -> DataFrame:
    """(doc_id, sources, size, copies, taken): every document and what the mix takes of it."""
    x = lean.join(_uses(lean.sparkSession, m), F.col("pattern") == F.col("use_pattern"), "left")
    x = x.withColumn("copies", F.coalesce(_copies(F.col("full"), F.col("last"), F.col("h")), F.lit(0)))
    return x.select("doc_id", "sources", "size", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def cycle(*weights: float):
    return lambda names: [weights[i % len(weights)] for i in range(len(names))]


def mix_by_source(docs: DataFrame, weights=cycle(5, 2, 1), share: float = SHARE, repeats: int = REPEATS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row of docs, where each row has one source.

    A null source is a source, the last in order; a null text has size 0 and so takes nothing. Rows that repeat an id and a
    text go in or stay out together. Documents are used whole, so a source misses its target by half a document at the cut. An
    empty table gives no rows.
    """
    lean, m = plan(docs, F.array(F.col(source_col)), weights, share, repeats, seed, id_col, text_col)
    sources = _decided(docs.sparkSession, m.sources, "s string, source_size long, target double")
    x = taken(lean, m).withColumn("source", F.get("sources", F.lit(0)))
    return x.join(sources, F.col("source").eqNullSafe(F.col("s")), "left").select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed(docs: DataFrame, weights=cycle(5, 2, 1), share: float = SHARE, repeats: int = REPEATS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix uses it, with docs' columns, whatever their names.

    Cases are those of mix_by_source(): a null source is a source, a null text has no size and goes with its hash, an empty
    table gives no rows.
    """
    _, m = plan(docs, F.array(F.col(source_col)), weights, share, repeats, seed, id_col, text_col)
    h = _hash(seed, docs[id_col], docs[text_col])
    uses = _uses(docs.sparkSession, m).select(F.struct("*").alias("use"))
    x = docs.join(uses, _pattern_key(F.array(docs[source_col])) == uses["use"]["use_pattern"])
    once = spare(docs, "copy")
    return x.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), _copies(uses["use"]["full"], uses["use"]["last"], h))).alias(once)).drop(once)
