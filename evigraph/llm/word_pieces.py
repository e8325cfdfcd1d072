"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces are counted in one pass over a word's bytes. The vocabulary is a trie; where no edge fits, a
failure link leads to the state that is left after the longest matches so far have been popped, and a number computed
beforehand says how many they are. No piece is ever built.
"""

from __future__ import annotations

import base64
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts a worker remembers before it starts anew, and the longest that it remembers.
REMEMBERED, LONGEST = 400_000, 64


class Automaton:
    """heads: pieces that can begin a word; tails: pieces that can follow another."""

    def __init__(self, heads, tails):
        self.next: list[dict[int, int]] = [{}, {}]  # 0: root of heads, 1: root of tails
        self.ends = [False, False]
        for root, pieces in ((0, heads), (1, tails)):
            for piece in pieces:
                if piece:
                    at = root
                    for c in piece:
                        if c not in self.next[at]:
                            self.next[at][c] = len(self.next)
                            self.next.append({})
                            self.ends.append(False)
                        at = self.next[at][c]
                    self.ends[at] = True
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            at = queue.popleft()
            for c, to in self.next[at].items():
                queue.append(to)
                if self.ends[to]:  # the whole path is a piece
                    self.fail[to], self.popped[to] = 1, 1
                    continue
                # else the parent's pops, and those met on the way to a state that has an edge c
                z, n = self.fail[at], self.popped[at]
                while z >= 0 and c not in self.next[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[to], self.popped[to] = self.next[z][c], n

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1, for an unknown word, where greedy matching gets stuck; 0 for an empty one."""
        if not word:
            return 0
        edges, fail, popped = self.next, self.fail, self.popped
        at, n = 0, 0
        for c in word:
            while (to := edges[at].get(c, -1)) < 0:
                if fail[at] < 0:
                    return 1
                n += popped[at]
                at = fail[at]
            at = to
        while at != 1:
            if fail[at] < 0:
                return 1
            n += popped[at]
            at = fail[at]
        return n


def pieces_of_ranks(path: str) -> tuple[list[bytes], list[bytes]]:
    """Word pieces from a rank file: tokens after a blank begin words, tokens without blanks go on; all single bytes do both."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f]
    blanks = set(b" \t\n\x0b\x0c\r")
    bare = [t for t in tokens if not blanks & set(t)]
    heads = [t[1:] for t in tokens if t[:1] == b" " and not blanks & set(t[1:])]
    single = [bytes([c]) for c in range(256) if c not in blanks]
    return heads + single, bare + single


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= LONGEST:
            self[word] = n
        return n


@lru_cache(maxsize=1)
def counter(path: str) -> _Counts:
    """One per worker. The rank file is part of an installed package, so every machine has it at the same place."""
    return _Counts(Automaton(*pieces_of_ranks(path)))


def token_counts(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_pieces, longest_word_pieces) of every row of docs.

    Words are runs of `[^\\x20\\x09-\\x0D]`, matched by their UTF-8 bytes; each is counted from its own beginning. A null or
    empty text has no words. Texts and words of any length are counted whole, a word's bytes in one pass. Repeated rows stay
    repeated. Other columns are not looked at. An empty table gives no rows.
    """

    def run(batches):
        of = counter(ranks_path)
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                counts = list(map(of.__getitem__, (text or "").encode().split()))
                out.append((len(counts), sum(counts), max(counts, default=0)))
            n = np.array(out, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(n[:, i]) for i in range(3)]], ["doc_id", "n_words", "n_pieces", "longest_word_pieces"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id long, n_words long, n_pieces long, longest_word_pieces long")
