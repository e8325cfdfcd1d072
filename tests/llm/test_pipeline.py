"""The pipeline stage by stage against brute force, and the registered queries against their SQL."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_other_operators import naive_scores
from test_text_operators import components, dedup

import __spark_entry__ as entry
import corpus_pipeline as cp
from evigraph.llm import common, mixing, quality, queries
from evigraph.llm.common import written

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out.append((name, docs, docs := written(stage(spark, docs, DATA), "test-stage")))
    return out


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_columns_and_order(stages):
    assert [s[0] for s in stages] == ["quality classifier", "line dedup", "near-dedup", "source mix", "byte-level BPE"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage_keeps_rows_as_they_are(spark, stages):
    _, before, after = stages[0]
    a, b = rows(before), rows(after)
    m = quality.fit(before, spark.read.parquet(f"{DATA}/labels.parquet").where(~queries.held_out()))
    naive = dict(zip(a, naive_scores(m, [r["text"] for r in a.values()])))
    assert all((i in b) == (s >= queries.QUALITY_CUT) for i, s in naive.items() if abs(s - queries.QUALITY_CUT) > 1e-4)
    assert all(a[i] == r for i, r in b.items()) and 0.6 * len(a) < len(b) < len(a)
    y = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert np.mean([(i in b) == (q == 1) for i, q in y.items()]) >= 0.9


def test_line_stage(stages):
    _, before, after = stages[1]
    want = {r[0]: r[3] for r in dedup([(i, r["text"]) for i, r in rows(before).items()], 40, 5)}
    assert {i: r["text"] for i, r in rows(after).items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows(after).values())


def test_near_stage(stages):
    _, before, after = stages[2]
    a = rows(before)
    ids = sorted(a)
    top, _ = components([a[i]["text"] for i in ids], 5, 80)
    assert rows(after) == {i: a[i] for k, i in enumerate(ids) if top[k] == k}


def test_mix_stage(stages):
    _, before, after = stages[3]
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_by_source(before).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in after.collect()) == want


def test_token_stage(spark, stages):
    _, before, after = stages[4]
    assert Counter(r["doc_id"] for r in after.collect()) == Counter(r["doc_id"] for r in before.collect())
    token = common._made.set(made := [])  # what is noted outside any block is what is left
    try:
        assert sorted(map(tuple, cp.run(spark, DATA).collect())) == sorted(map(tuple, after.collect()))
    finally:
        common._made.reset(token)
    assert len(made) <= 2  # the last stage's documents, and its own tables


def odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, ties, and columns with clashing names."""
    base = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    some = [(None, None, None, None, None), (None, base[0][1], None, "s", 1), (10**6, None, "en", "s", None), (10**6 + 1, "", "en", None, 0), (10**6 + 2, " \n ", None, None, 3), (10**6 + 3, base[1][1] * 400, "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    d = spark.createDataFrame(base + base[:5] + [(base[7][0], base[8][1], "xx", "s", 2)] + some, schema)
    clash = ("score", "keep", "line_dedup", "copy", "use", "rank", "rep", "node", "component", "lost_id", "row_key", "h", "pattern", "size", "sources", "tree", "kept_sha256", "ids", "y")
    return d.withColumns({c: F.lit(i) for i, c in enumerate(clash)}), len(base) + 12


def test_every_stage_takes_odd_rows(spark):
    docs, n = odd_rows(spark)
    assert docs.count() == n
    for (name, stage), last in zip(cp.STAGES, [False] * 4 + [True]):
        after = written(stage(spark, docs, DATA), "odd-stage")
        got, had = after.collect(), docs.collect()
        if not last:
            assert after.columns == docs.columns
            ids = Counter(r["doc_id"] for r in had)
            assert all(r["doc_id"] in ids for r in got)
        if name == "quality classifier":
            assert Counter(map(repr, got)) <= Counter(map(repr, had))  # rows go or stay as they are
        if name == "line dedup":
            assert Counter(r["doc_id"] for r in got) == ids and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in got)
        if name == "near-dedup":
            assert max(Counter(r["doc_id"] for r in got if r["doc_id"] is not None).values()) == 1 and Counter(map(repr, got)) <= Counter(map(repr, had))
            assert sum(r["doc_id"] is None for r in got) == sum(r["doc_id"] is None for r in had)
        if name == "source mix":
            assert max(Counter(map(repr, got)).values()) <= 2 * max(Counter(map(repr, had)).values())
        if last:
            assert Counter(r["doc_id"] for r in got) == ids
        docs, ids = after, Counter(r["doc_id"] for r in got)


def test_every_stage_takes_an_empty_table_and_one_of_nulls(spark):
    docs, _ = odd_rows(spark)
    for docs in (docs.where("false"), spark.createDataFrame([(None, None, None, None, None)] * 2, "doc_id long, text string, lang string, source string, n_chars long")):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, DATA)
            assert name == "byte-level BPE" or out.columns == docs.columns
            assert out.count() <= 2 * docs.count()


def test_mix_stage_takes_what_targets_say(stages):
    """Against the quotas and the order of the hash, written anew."""
    _, before, after = stages[3]
    rows = [(r["source"], len((r["text"] or "").encode().split()), int(hashlib.md5(f"17|{r['doc_id']}|{r['text']}".encode()).hexdigest()[:15], 16), r["doc_id"]) for r in before.collect()]
    size = Counter()
    for s, n, _, _ in rows:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    caps: dict = {}
    while True:
        rest = 1.5 * sum(size.values()) - sum(caps.values())
        whole = sum(w for s, w in weight.items() if s not in caps)
        over = [s for s in names if s not in caps and rest * weight[s] / whole > 2 * size[s]]
        if not over:
            break
        caps |= {s: 2 * size[s] for s in over}
    want = Counter()
    for s in names:
        target = caps.get(s, rest * weight[s] / whole)
        taken = min(2 * size[s], int(target + 0.5))
        full, left = divmod(taken, size[s])
        own = sorted((h, n, i) for x, n, h, i in rows if x == s)
        sums = np.concatenate([[0], np.cumsum([n for _, n, _ in own])])
        k = int(np.argmin(np.abs(sums - left)))
        for j, (_, _, i) in enumerate(own):
            if full + (j < k):
                want[i] = full + (j < k)
    assert Counter(r["doc_id"] for r in after.collect()) == want


def test_token_stage_is_the_librarys(stages):
    _, before, after = stages[4]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in before.collect():
        ids = np.array(library.encode_ordinary(r["text"]), "<u4").tobytes()
        want[r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after.collect()) == want


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    want, cols = c.sql(entry.oracle_sql()[name]), sorted(df.columns)
    assert cols == sorted(want.columns)
    pick = [want.columns.index(x) for x in cols]
    assert sorted(map(repr, (tuple(r[x] for x in cols) for r in df.collect()))) == sorted(map(repr, (tuple(r[i] for i in pick) for r in want.fetchall())))


def test_all_queries_are_registered():
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries.QUERIES} and "pipeline" in entry.queries()


def test_a_run_deletes_its_own_tables_and_no_other_threads(spark, tmp_path):
    import os
    import threading

    from evigraph.llm.common import discard, spent, written

    barrier, seen = threading.Barrier(2, timeout=120), {}

    def work(name):
        with spent(spark) as result:
            lost, kept = written(spark.range(3), f"{name}-lost"), written(spark.range(5), f"{name}-kept")
            barrier.wait()  # both have written
            result.append(kept)
        barrier.wait()  # both have deleted
        seen[name] = (os.path.exists(lost.written_to), kept.count())

    threads = [threading.Thread(target=work, args=(n,)) for n in ("a", "b")]
    outside = written(spark.range(7), "outside")
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert seen == {"a": (False, 5), "b": (False, 5)} and outside.count() == 7
    with spent(spark) as outer:
        with spent(spark, outside) as inner:
            inner.append(written(spark.range(2), "inner"))
        assert not os.path.exists(outside.written_to) and inner[0].count() == 2
        one = written(spark.range(1), "one")
        discard(one)
    assert not os.path.exists(inner[0].written_to) and outer == []
