from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from evigraph.llm import alignment, centroids, queries, simhash
from evigraph.llm.graph import components

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


# Centroids


def clustered(rows, k=16, rounds=3):
    """Brute force in Python's whole numbers."""
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [q for _, q in first]
    near = lambda q: min((sum((x - y) ** 2 for x, y in zip(q, z)), i) for i, z in enumerate(c))
    for _ in range(rounds):
        at = [near(q)[1] for _, q in kept]
        groups = [[q for (_, q), j in zip(kept, at) if i == j] for i in range(len(c))]
        c = [[sum(x) // len(g) for x in zip(*g)] if g else old for g, old in zip(groups, c)]
    return [(i, near(q)[1], near(q)[0], tuple(c[near(q)[1]])) for i, q in kept]


def vectors(n=300):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(n, 64)) * rng.choice([0.01, 1.0], 64)).astype(np.float32)
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)]
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]  # ties, repeated ids, no id
    return rows + [(n + 2, None), (n + 3, []), (n + 4, [1.0] * 63), (n + 5, [1.0] * 63 + [None]), (n + 6, [1.0] * 63 + [float("nan")]), (n + 7, [float("inf")] * 64), (n + 8, [0.0] * 64), (n + 9, [-0.5] * 64)]


@pytest.mark.parametrize("n", [300, 10, 1])
def test_clusters_are_those_of_brute_force(spark, n):
    rows = vectors()[-n:] if n < 300 else vectors()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, q int")
    got = [(r["vec_id"], r["cluster"], r["distance"], tuple(r["centroid"])) for r in centroids.cluster(df).collect()]
    want = clustered(rows)
    assert Counter(got) == Counter(want)
    for r in centroids.cluster(df).collect():
        assert r["inertia"] == sum(w[2] for w in want) and r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"])


def test_clusters_of_no_rows_and_of_components_beyond_exact_sums(spark):
    df = spark.createDataFrame([(1, [1.0] * 3)], "vec_id long, embedding array<float>")
    assert centroids.cluster(df).collect() == [] and centroids.cluster(df.where("false")).collect() == []
    with pytest.raises(Exception, match="components have to be within"):
        centroids.cluster(spark.createDataFrame([(1, [3e30] * 64)], "vec_id long, embedding array<float>")).collect()


def test_partial_distances_give_all_of_them_and_sum_less():
    rng = np.random.default_rng(1)
    c = rng.integers(-60, 60, (16, 64))
    c[9] = c[4]
    q = c[rng.integers(0, 16, 2_000)] + rng.integers(-9, 9, (2_000, 64))
    full = ((q[:, None] - c[None]) ** 2).sum(2)
    at, d, done = centroids.nearest(q, c, np.argsort(-q.var(0)))
    assert (at == full.argmin(1)).all() and (d == full.min(1)).all() and done < full.size * 64 / 2
    same = np.tile(c[4], (50, 1))
    assert (centroids.nearest(same, c, np.arange(64))[0] == 4).all()


def test_the_digest_of_a_centroid(spark, tmp_path):
    spark.createDataFrame(vectors(40), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    by = {i: c for i, _, _, c in clustered(vectors(40))}
    for r in queries.op11_centroids(spark, str(tmp_path)).where("vec_id <> 7").collect():
        assert r["centroid_sha256"] == centroids.centroid_sha256(by[r["vec_id"]])


# SimHash


def simple_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, most=3):
    top = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = top[i], top[j]
                top = [min(a, b) if t in (a, b) else t for t in top]
    return top


def test_simhash_groups_are_those_of_brute_force(documents, texts):
    fps = [simple_fingerprint(t) for t in texts]
    top = linked(fps)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents).collect()}
    assert len(got) == len(texts)
    assert [got[i]["fp"] % 2**64 for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == top


def test_spark_hashes_shingles_alike(spark):
    x = spark.createDataFrame([("ab cd é",)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash.fingerprint("ab CD é") == x % 2**64


def test_words_of_long_texts_are_cut_at_blanks(monkeypatch, texts):
    want = [simhash.fingerprint(t or "") for t in texts]
    monkeypatch.setattr(simhash, "_PIECE", 7)
    assert [simhash.fingerprint(t or "") for t in texts if len(t or "") < 2_000] == [w for w, t in zip(want, texts) if len(t or "") < 2_000]


def near_fingerprints(n, seed=2):
    """Random ones, chains of few bits, and a dense group."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n).tolist()
    out = list(base)
    for x in base[: n // 3]:
        for _ in range(3):
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
            out.append(x)
    out += [base[0] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (n // 3, 2)) if a != b]
    return sorted(set(out))


@pytest.mark.parametrize("block", [1 << 15, 40])
def test_links_join_all_pairs_within_three_bits(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "_ENDS", 16)
    fps = near_fingerprints(400)
    top = linked(fps)
    rows = [(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)]
    x = simhash.links(spark.createDataFrame(rows, "fp long, rep long"), block=block)
    found = x.collect()
    assert all((fps[r["a"]] ^ fps[r["b"]]).bit_count() <= 3 for r in found)
    of = {r["node"]: r["component"] for r in components(x).collect()}
    assert [of.get(i, i) for i in range(len(fps))] == top


def test_the_tree_sends_every_pair_together_once():
    fps = np.array(near_fingerprints(600, 3), np.uint64)
    tree = simhash.Tree(fps, 16, 3)
    assert tree.leaves > 8
    seen = {}
    for leaf, rows, asking in tree.deal(fps, False):
        for r in rows.tolist():
            seen.setdefault(r, set()).add((leaf, asking))
    assert all(sum(not a for _, a in s) == 1 for s in seen.values())
    home = {r: leaf for r, s in seen.items() for leaf, asking in s if not asking}
    for i in range(len(fps)):
        for j in np.flatnonzero(simhash._far(fps[:i], fps[i]) <= 3).tolist():
            assert home[i] in {x for x, _ in seen[j]} or home[j] in {x for x, _ in seen[i]}


def test_a_dense_group_gives_no_more_links_than_rows(spark):
    fps = sorted({(1 << a) | (1 << b) | (1 << c) for a in range(24) for b in range(24) for c in range(24)})
    x = simhash.links(spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long"), block=300)
    n = x.count()
    assert n < 12 * len(fps) and components(x).select("component").distinct().count() == 1


def test_simhash_of_rows_without_id_repeated_rows_and_no_rows(spark, empty):
    d = spark.createDataFrame([(None, "a b c d"), (None, None), (5, "a b c d"), (5, "a b c d"), (3, "A B C D"), (3, "x y z"), (9, "x y z"), (7, ""), (8, None), (2, "q")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(d).collect())
    assert got == Counter({(None, None): 2, (5, 3): 2, (3, 3): 2, (9, 3): 1, (7, 7): 1, (8, 7): 1, (2, 2): 1})
    assert simhash.near_duplicates(empty).collect() == []


# Alignment

ODD = [None, "", " ", "  ", "a", " a", "One two", "it's 12 o'clock\n\n  so", "<|endoftext|> <s>x</s> <0x41>", "a▁b", "é日本語 ünï 🙂🙂", "\x00\t\r\n", "x" * 300, "aa bb " * 40, "　全角 ﬁ１", "One two"]


def reference(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A_PATH)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    chars = alignment._bytes_of_chars()
    rows = []
    for text in texts:
        if not text:
            rows.append(None)
            continue
        a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        ab = [bytes(chars[c] for c in t.id_to_token(i)) for i in a]
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        rows.append((a, b, ab, bb) if b"".join(ab) == b"".join(bb) == (" " + text).encode() else None)
    out, count = [], Counter()
    for row in rows:
        groups, links = [], []
        if row:
            a, b, ab, bb = row
            at_a, at_b = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
            last = 0
            for end in sorted(set(at_a) & set(at_b)):
                groups.append(",".join(str(i) for i, e in zip(a, at_a) if last < e <= end) + "|" + ",".join(str(i) for i, e in zip(b, at_b) if last < e <= end))
                links.append((a[at_a.index(end)], b[at_b.index(end)]))
                last = end
            count.update(links)
        out.append((len(row[0]) if row else 0, len(row[1]) if row else 0, groups, links))
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    return [(na, nb, len(g), len(k), sum(count[x] == most[x[1]] for x in k), sum(count[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for na, nb, g, k in out]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_alignments_are_those_of_brute_force(spark, texts, most):
    some = ODD + [t for t in texts if t and len(t) < 2_000]
    d = spark.createDataFrame([(None if i == 4 else i, t, "x", 2) for i, t in enumerate(some)], "doc_id long, text string, k1 string, n int")
    got = sorted(alignment.align(d, A_PATH, B_PATH, most=most).collect(), key=lambda r: 4 if r["doc_id"] is None else r["doc_id"])
    assert [tuple(r)[1:] for r in got] == reference(some)
    assert alignment.align(d.where("false"), A_PATH, B_PATH).collect() == []


def test_parts_of_a_text_are_encoded_as_the_whole(texts):
    for t in [x for x in ODD if x] + ["word " * 500 + "End  of. it's A  b " * 50 + "日本 x" * 40]:
        for kind, path in ((alignment.ByteLevel, A_PATH), (alignment.Pieces, B_PATH)):
            assert (alignment.encoded(kind, path, t, 10) == alignment.encoded(kind, path, t, 1 << 30)).all()
    assert len(list(alignment.parts("word " * 500, 10))) > 100


def test_every_code_point_is_its_own_bytes_but_for_the_mark_of_blanks():
    e = alignment.encoder(alignment.Pieces, B_PATH)
    assert e.encode(" a▁b") is None and len(alignment.encoded(alignment.Pieces, B_PATH, "x a▁b")) == 0
    some = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c != 0x2581 and (c < 0x3000 or c % 37 == 0)]
    assert [c for c in some if e.encode(f" {chr(c)}e\u0301 {chr(c)}") is None] == []
    assert len(alignment.encoder(alignment.ByteLevel, A_PATH).bytes_of) < 1 << 16 and len(e.bytes_of) < 1 << 15


def test_token_rows_are_not_sent_and_texts_are_encoded_once(spark, documents, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    with alignment._kept_apart(spark, 4):
        x = alignment.aligned(alignment.texts(spark.read.parquet(f"{tmp_path}/documents.parquet"), A_PATH, B_PATH), A_PATH, B_PATH)
        x.collect()
        plan = x._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 2 and plan.count("MapInArrow") == 1 and "Broadcast" not in plan
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("SortMergeJoin") == 2  # one exchange, read three times
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_cuts_are_collected_in_the_order_of_the_join(spark, documents):
    with alignment._kept_apart(spark, 4):
        x = alignment.aligned(alignment.texts(documents, A_PATH, B_PATH), A_PATH, B_PATH)
        plan = x._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan and "ObjectHashAggregate" not in plan and "lambdafunction" not in plan
