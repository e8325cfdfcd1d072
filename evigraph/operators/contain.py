"""Which needles stand literally in which texts, and where.

Needles go into automata of up to SHARD code points (a trie with failure links), which find all needles of a text in one pass over
it, however many they are. Needles of one automaton are sent to the tasks as they are; more are dealt to several automata, and
a text is sent once to each. Beyond AUTOMATA of them texts are not sent to needles any more: hashes of their runs are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Code points of an automaton's needles, which bound its memory, and automata up to which each text is sent to all of them.
SHARD, AUTOMATA = 1 << 20, 16
_GRAM, _WINDOW, _ROWS = 8, 1_024, 512


class Automaton:
    """Finds all of its needles in a text."""

    def __init__(self, needles: list[str]):
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        for x in needles:
            self.trie.add_word(x, x)
        if needles:  # without any there is nothing to walk
            self.trie.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, str]]:
        """(start, needle) of every occurrence."""
        return ((end - len(x) + 1, x) for end, x in self.trie.iter(text)) if len(self.trie) else iter(())

    def needles(self, text: str) -> list[str]:
        """Each once, in the order of their first ends."""
        return list(dict.fromkeys(x for _, x in self.hits(text)))


def _needles_of(automaton: Automaton, text: str) -> list:
    return automaton.needles(text)


@dataclass(frozen=True)
class Found:
    """What is kept of a text and an automaton: a function to a list of values, and its type in Arrow's and in SQL's words; and
    whether texts in which nothing is found are kept."""

    of: Callable[[Automaton, str], list]
    arrow: pa.DataType
    sql: str
    all_texts: bool = False


NEEDLES = Found(_needles_of, pa.string(), "string")


def _with_found(automaton: Automaton, batch: pa.RecordBatch, column: str, found: Found) -> Iterator[pa.RecordBatch]:
    """The rows with anything found, with the list of it as their last column."""
    for i in range(0, batch.num_rows, _ROWS):
        part = batch.slice(i, _ROWS)
        lists = [found.of(automaton, x.as_py()) if x.is_valid else [] for x in part.column(column)]
        rows = [j for j, x in enumerate(lists) if x or found.all_texts]
        if rows:
            kept = part.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([lists[j] for j in rows], pa.list_(found.arrow))], [*part.schema.names, "needles_found"])


def _one(needles: list[str], column: str, found: Found):
    def run(batches):
        automaton = Automaton(needles)
        for b in batches:
            yield from _with_found(automaton, b, column, found)

    return run


_DEALT = ("needle_shard", "needle_slice", "needle_side")


def _many(column: str, found: Found):
    """Rows come sorted by shard, slice and side: needles (side 0), in the texts' column, then texts. One automaton is held at a time."""

    def run(batches):
        now, needles, automaton = None, [], None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in _DEALT)))
            i = 0
            while i < b.num_rows:
                j = i
                while j < b.num_rows and keys[j] == keys[i]:
                    j += 1
                if now != keys[i][:2]:
                    now, needles, automaton = keys[i][:2], [], None
                piece = b.slice(i, j - i).drop_columns(list(_DEALT))
                if keys[i][2] == 0:
                    needles += piece.column(column).to_pylist()
                else:
                    automaton = automaton or Automaton(needles)
                    yield from _with_found(automaton, piece, column, found)
                i = j

    return run


def shards_of(needles: DataFrame, needle: str, shard: int = SHARD) -> int:
    """Automata that the needles are dealt to."""
    return -(-(needles.agg(F.sum(F.char_length(needle).cast("long"))).first()[0] or 0) // shard)


def found_in(texts: DataFrame, needles: DataFrame, text: str, needle: str, found: Found = NEEDLES, shard: int = SHARD) -> DataFrame:
    """Rows of texts in which any of the distinct needles stand, with needles_found, a list of what is kept of them. A text that
    several automata find anything in has a row for each."""
    n = needles.where(F.char_length(needle) > 0).select(F.col(needle).alias(text)).distinct()
    shards = shards_of(n, text, shard)
    out = StructType([*texts.schema.fields, *StructType.fromDDL(f"needles_found array<{found.sql}>").fields])
    if shards <= 1:
        return texts.mapInArrow(_one([r[0] for r in n.collect()], text, found), out)  # `shard` code points
    slices = max(1, -(-int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    every = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    own = lambda c, most: F.pmod(F.xxhash64(c), F.lit(most)).cast("int")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in texts.schema.fields if f.name != text]
    dealt = n.select(text, *blank, own(text, shards).alias("needle_shard"), every(slices).alias("needle_slice"), F.lit(0).alias("needle_side"))
    asked = texts.select("*", every(shards).alias("needle_shard"), own(text, slices).alias("needle_slice"), F.lit(1).alias("needle_side"))
    return dealt.unionByName(asked).repartition(*_DEALT[:2]).sortWithinPartitions(*_DEALT).select(*texts.columns, *_DEALT).mapInArrow(_many(text, found), out)


def containing(texts: DataFrame, needles: DataFrame, text: str = "text", needle: str = "needle", shard: int = SHARD, automata: int = AUTOMATA) -> DataFrame:
    """Pairs of rows where the needle stands literally in the text. Empty needles stand in none, and nothing in a null. Repeated
    rows give repeated pairs."""
    n = needles.where(F.char_length(needle) > 0)
    if shards_of(n.select(needle).distinct(), needle, shard) > automata:
        return by_grams(texts, n, text, needle)
    x = found_in(texts, n, text, needle, shard=shard).withColumn("needle_found", F.explode("needles_found")).drop("needles_found")
    return x.join(n, F.col("needle_found") == F.col(needle)).drop("needle_found")


def by_grams(texts: DataFrame, n: DataFrame, text: str, needle: str) -> DataFrame:
    """The same pairs, for more needles than automata are made for.

    Texts are cut into all their runs of _GRAM code points, of which the first _GRAM of a needle must be one; shorter needles are
    sought under runs of their own length. Runs and needles meet by hashes of their texts; a text is sent once, to the pairs
    that it is in.
    """
    n = n.withColumns({"needle_key": F.xxhash64(needle), "gram_len": F.least(F.char_length(needle), F.lit(_GRAM))})
    t = texts.where(F.char_length(text) > 0).withColumn("text_key", F.xxhash64(text))
    lengths = sorted(r["gram_len"] for r in n.select("gram_len").distinct().collect())  # _GRAM values at most
    # windows first: the place of a code point is found by counting from a string's start
    windows = F.transform(F.sequence(F.lit(0), F.char_length(text), F.lit(_WINDOW)), lambda i: F.substring(F.col(text), i + 1, F.lit(_WINDOW + _GRAM - 1)))
    cut = t.select("text_key", F.explode(windows).alias("gram_window"))

    def parts(k: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.char_length("gram_window") - k + 1, F.lit(1)))
        return F.when(F.char_length("gram_window") >= k, F.transform(places, lambda i: F.substring(F.col("gram_window"), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    cut = cut.select("text_key", F.explode(F.array_distinct(F.flatten(F.array(*[parts(k) for k in lengths])))).alias("gram")).distinct()
    grams = n.select("needle_key", F.expr(f"substring(`{needle}`, 1, gram_len)").alias("gram")).distinct()
    pairs = cut.join(grams, "gram").select("text_key", "needle_key").distinct()
    hit = t.join(pairs, "text_key").join(n.drop("gram_len"), "needle_key").where(F.contains(F.col(text), F.col(needle)))
    return hit.drop("text_key", "needle_key")
