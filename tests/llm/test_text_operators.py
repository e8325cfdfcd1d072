from __future__ import annotations

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evigraph.llm import bpe, line_dedup, near_dedup, word_pieces
from evigraph.llm.shingles import WordHashes, shingles

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
BLANKS = " \t\n\x0b\x0c\r"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components(texts, width, percent):
    """Brute force: every pair of sets."""
    sets = []
    for t in texts:
        w = low(t or "").encode().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    top = list(range(len(texts)))
    for _ in texts:
        before = list(top)
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                    top[i] = top[j] = min(top[i], top[j])
        if top == before:
            break
    return top, [len(s) for s in sets]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_are_those_of_brute_force(documents, texts, width):
    top, sizes = components(texts, width, 80)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(documents, width).collect()}
    assert len(got) == len(texts)
    assert [got[i]["component_id"] for i in range(len(texts))] == top
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_duplicates_of_rows_without_id_and_repeated_rows(spark, empty):
    d = spark.createDataFrame([(None, "a b c"), (None, None), (5, "a b c"), (5, "a b c"), (3, "A B C"), (3, "x y z"), (9, "x y z"), (1, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(d, 2).collect()), key=str)
    assert got == sorted([(None, None, True), (None, None, True), (5, 3, False), (5, 3, False), (3, 3, True), (3, 3, True), (9, 3, False), (1, 1, True)], key=str)
    assert Counter(r["doc_id"] for r in near_dedup.without_near_duplicates(d, 2).collect()) == Counter({None: 2, 3: 1, 1: 1})
    assert near_dedup.near_duplicates(empty).collect() == []


def test_an_id_links_all_its_texts(spark):
    d = spark.createDataFrame([(3, "a b c"), (5, "a b c"), (5, "x y z"), (9, "x y z"), (7, "p q r"), (8, "p q r"), (8, "s t u"), (9, "s t u"), (6, "v w")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(d, 2).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (7, 3, False), (8, 3, False), (6, 6, True)}
    assert sorted(r["doc_id"] for r in near_dedup.without_near_duplicates(d, 2).collect()) == [3, 6]


def test_one_dense_group_of_varied_copies(spark):
    rng = np.random.default_rng(8)
    base, texts = [f"w{i}" for i in range(80)], []
    for i in range(260):
        t = list(base)
        for j in rng.integers(0, 80, rng.integers(0, 30)):
            t[j] = f"v{rng.integers(10**6)}"
        texts.append(" ".join(t))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    top, _ = components(texts, 2, 80)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(d, 2).collect()}
    assert [got[i] for i in range(len(texts))] == top and 1 < len(set(top)) < len(texts)


def test_a_chain_of_boilerplate_is_bounded(spark):
    """2,000 texts, each like the next by 0.6 or so, so that all are one chain of candidates: nothing is linked, and a set is
    sent once for each region of a tree at most, whatever the chain's length."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 10**9, 60)]
    texts = []
    for _ in range(2_000):
        for j in rng.choice(60, 14, replace=False):
            words[j] = f"w{rng.integers(10**9)}"
        texts.append(" ".join(words))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = [set(zip(t.split(), t.split()[1:])) for t in texts]
    alike = [len(a & b) / len(a | b) for a, b in zip(s, s[1:])]
    assert 0.35 < np.mean(alike) < 0.7
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(d, 2).collect()}
    top, _ = chain(s)
    assert [got[i] for i in range(len(texts))] == top
    sketches = d.mapInArrow(near_dedup._sketch(2), "doc_id long, n long, k1 long, k2 long, sig binary").withColumnRenamed("doc_id", "rep")
    rows = sketches.mapInArrow(near_dedup._forest, near_dedup._FOREST)
    none = spark.createDataFrame([], "node long, component long")
    blocks = near_dedup.mixed_blocks(rows, none)
    a, b = blocks.where("side = 0").count(), blocks.where("side = 1").count()
    assert a <= near_dedup.TREES * len(texts) and b <= near_dedup.TREES * len(texts) and blocks.agg(F.max("other"), F.max("block")).first()[:] == (0, 0)
    # the same rows in smaller blocks: both sides meet in each pair of blocks
    assert near_dedup.mixed_blocks(rows, none, block_hashes=100).agg(F.max("block")).first()[0] > 0


def chain(sets):
    """Components where only neighbours can be linked."""
    top = list(range(len(sets)))
    for i in range(1, len(sets)):
        if 100 * len(sets[i] & sets[i - 1]) >= 80 * len(sets[i] | sets[i - 1]):
            top[i] = top[i - 1]
    return top, None


def test_pieces_are_cut_at_the_shortest_prefix():
    lcp = np.array([0, 5, 5, 2, 6, 6, 3, 7, 7, 7])
    assert near_dedup.pieces(lcp, 64) == [(0, 10)]
    found = near_dedup.pieces(lcp, 4)
    assert found[0] == (0, 3) and all(z - a <= 4 for a, z in found) and [a for a, _ in found[1:]] == [z - 1 for _, z in found[:-1]] and found[-1][1] == 10
    p1 = np.array([0x0001_0002_0003_0004, 0x0001_0002_0003_0004, 0x0001_0002_0003_0005, 0x0001_0009_0003_0005])
    assert near_dedup.common_levels(p1, np.array([7 << 48, 7 << 48, 0, 0])).tolist() == [0, 8, 3, 1]


def test_shingles_take_ascii_case_and_blanks_only():
    w = WordHashes()
    assert (shingles("A\x0bb\x1cC", 1, w) == shingles("a B\x1cc", 1, w)).all() and len(shingles("É é", 1, w)) == 2
    assert len(shingles("a b", 5, w)) == 1 and not len(shingles(BLANKS, 2, w))


def dedup(rows, min_chars, min_docs):
    key = lambda line: low(line.strip(BLANKS))
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                docs[key(line)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(docs.get(key(x), ())) < min_docs or max(docs[key(x)]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_is_that_of_brute_force(documents, texts):
    got = sorted(tuple(r) for r in line_dedup.dedup_lines(documents).collect())
    assert got == sorted(dedup(list(enumerate(texts)), 40, 5)) and sum(r[2] for r in got) == 8


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.one_of(st.none(), st.lists(st.sampled_from(["aa", "AA ", "bb", "É", "", "c"]), max_size=6).map("\n".join))), max_size=8))
def test_line_dedup_of_any_rows(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(repr, map(tuple, line_dedup.dedup_lines(d, min_chars=2, min_docs=2).collect()))) == sorted(map(repr, dedup(rows, 2, 2)))


def test_line_dedup_streams_over_one_sorted_exchange(spark):
    """Executed plan: hashes are exchanged once, by range, and sorted by hash, document and position below the windows; a very
    common line is dealt over several tasks and found all the same."""
    d = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat_ws("\n", F.md5(F.col("id").cast("string")), F.when(F.col("id") % 3 == 0, F.lit("a very common line")), F.md5((F.col("id") % 500).cast("string"))).alias("text"))
    spread = line_dedup.line_hashes(d, min_chars=10)
    assert line_dedup._dealt(spread, 8)[1] and not line_dedup._dealt(line_dedup.line_hashes(d, min_chars=20), 8)[1]
    x = line_dedup._dealt(spread, 8)[0].where("dealt").groupBy("part").count().collect()
    assert len(x) > 1 and max(r["count"] for r in x) < 700
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    assert sorted(map(tuple, line_dedup.dedup_lines(d, min_chars=10, min_docs=4).collect())) == sorted(dedup(rows, 10, 4))
    y = line_dedup.lost_lines(line_dedup.line_hashes(d, min_chars=20), 4)
    y.collect()
    plan = y._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    nodes = [x.lstrip("+- :*()0123456789") for x in plan.split("\n")]
    sort = next(x for x in nodes if x.startswith("Sort ["))
    assert [x.split("#")[0].strip(" [") for x in sort[5:].split(",")[:5]] == ["part", "h1", "h2", "doc_id", "pos"]
    assert sum(x.startswith("Exchange") for x in nodes) == 1 and "shufflepartitionidpassthrough" in plan and sum(x.startswith("Window") for x in nodes) == 2


def test_line_dedup_keeps_other_columns_and_uses_no_python(documents, empty):
    x = line_dedup.marked(documents.withColumn("keep", F.lit(1)).withColumn("line_dedup", F.lit(2)))
    assert x.columns == [*documents.columns, "keep", "line_dedup", "line_dedup_"] and x.where("line_dedup = 2").count() == x.count() and x.count() == documents.count()
    assert "Python" not in line_dedup.dedup_lines(documents)._jdf.queryExecution().executedPlan().toString()
    assert line_dedup.dedup_lines(empty).collect() == []
    runs = {r["doc_id"]: r["keep"] for r in line_dedup.keep_bitmaps(documents).collect()}
    assert len(runs) == 8 and all([tuple(x) for x in r] == [(0, 1), (2, 1)] for r in runs.values())


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_is_that_of_the_library(documents, texts, reference, empty):
    more = documents.select("doc_id", "text").unionByName(documents.sparkSession.createDataFrame([(None, "<|endoftext|> né"), (None, "x" * 9_000)], "doc_id long, text string"))
    want = Counter((i, np.array(reference.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in [*enumerate(texts), (None, "<|endoftext|> né"), (None, "x" * 9_000)])
    for chunk in (4_000, 10**6):  # stitched, and whole
        got = Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.encode(more, RANKS, P.PATTERN, chunk=chunk, overlap=64).collect())
        assert got == want
    # a text whose chunks meet everywhere, one with a piece longer than the overlap, and a repeated row
    long = [(1, "ab cd, ef " * 4_000), (2, "ab " * 3_000 + "x" * 9_000 + " cd" * 2_000), (1, "ab cd, ef " * 4_000), (None, "né \U0001f600\n" * 3_000)]
    got = bpe.encode(documents.sparkSession.createDataFrame(long, "doc_id long, text string"), RANKS, P.PATTERN, chunk=3_000, overlap=64)
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got.collect()) == Counter((i, np.array(reference.encode_ordinary(t), "<u4").tobytes(), t.encode()) for i, t in long)
    back = bpe.decode(bpe.encode(documents, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(empty, RANKS, P.PATTERN).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'restdlvm 1\n\té.!", max_size=300), st.integers(17, 60), st.integers(17, 40))
def test_chunks_stitch_to_the_whole(text, chunk, overlap):
    t = bpe.tokenizer(RANKS, P.PATTERN)
    parts = [(a, x, t.pieces(x)) for a, x in bpe.chunks(text, chunk, overlap)]
    assert bpe.stitch(parts, t.pieces) == t.pieces(text)


def greedy(word, heads, tails):
    n = i = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in (tails if i else heads)), None)
        if j is None:
            return 1
        i, n = j, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=4).map(lambda b: bytes(97 + c % 3 for c in b)), max_size=12), st.sets(st.binary(min_size=1, max_size=4).map(lambda b: bytes(97 + c % 3 for c in b)), max_size=12), st.lists(st.sampled_from([97, 98, 99]), max_size=12))
def test_automaton_counts_like_greedy_matching(heads, tails, word):
    assert word_pieces.Automaton(heads, tails).count(bytes(word)) == greedy(bytes(word), heads, tails)


def test_token_counts(documents, texts, empty):
    heads, tails = map(set, word_pieces.pieces_of_ranks(RANKS))
    got = {r["doc_id"]: tuple(r)[1:] for r in word_pieces.token_counts(documents, RANKS).collect()}
    longest = max(map(len, heads | tails))
    known: dict = {}

    def pieces(word):
        if word not in known:
            n = i = 0
            while i < len(word):
                i, n = next(j for j in range(min(len(word), i + longest), i, -1) if word[i:j] in (tails if i else heads)), n + 1
            known[word] = n
        return known[word]

    for i, t in enumerate(texts):  # whole texts, the very long one too
        n = [pieces(w) for w in (t or "").encode().split()]
        assert got[i] == (len(n), sum(n), max(n, default=0))
    assert max(x[0] for x in got.values()) == 30_000
    long = documents.sparkSession.createDataFrame([(1, "ab" * 50_000 + " é" + "\n" * 99)], "doc_id long, text string")
    assert tuple(word_pieces.token_counts(long, RANKS).first()) == (1, 2, pieces(b"ab" * 50_000) + pieces("é".encode()), pieces(b"ab" * 50_000))
    assert word_pieces.token_counts(empty, RANKS).collect() == []
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
