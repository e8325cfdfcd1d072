"""The corpus operators' queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe, centroids, line_dedup, mixing, near_dedup, quality, simhash, topk, url_rules, warc, word_pieces
from .common import new_path, table

QUALITY_CUT = 0.7
#: (verdict, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def held_out() -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held_out()))
    x = quality.score(docs, model)
    return x.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def token_digests(x: DataFrame) -> DataFrame:
    return x.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_pieces.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    x = warc.captures(warc.read(spark, path, payloads=False))
    x = warc.resolved(x, warc.field(F.col("metadata")["head"], "page").cast("long"))
    return x.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)
    return x.select("page_id", "host", "path", "rule", "verdict")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return x.withColumn("centroid_sha256", F.sha2(F.array_join("centroid", ",").cast("binary"), 256)).drop("centroid")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return x.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_source_mix": op4_source_mix,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_cross_polytope": op6_cross_polytope,
    "op7_token_counts": op7_token_counts,
    "op8_warc": op8_warc,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_url_rules": op10_url_rules,
    "op11_centroids": op11_centroids,
    "op12_simhash": op12_simhash,
    "op13_alignment": op13_alignment,
}

_OP1 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
k AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS k, min(doc_id) AS rep, any_value(s) AS s FROM s WHERE len(s) > 0 GROUP BY 1),
t AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM k),
i AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT a, b FROM i WHERE 100 * c >= 80 * (na + nb - c)),
l AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e),
r(node, top) AS (SELECT rep, rep FROM k UNION SELECT l.v, r.top FROM r JOIN l ON r.node = l.u),
c AS (SELECT node, min(top) AS top FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.top, s.doc_id) AS component_id, s.doc_id = coalesce(c.top, s.doc_id) AS kept
FROM s LEFT JOIN k ON len(s.s) > 0 AND md5(array_to_string(list_sort(s.s), chr(10))) = k.k LEFT JOIN c ON c.node = k.rep
"""

_OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rn, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos, len(lines) AS n FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS lost FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, CAST(max(n) AS BIGINT) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY rn, doc_id
"""

#: Of single sources the flow is what the targets say. Caps that hold are those of the least size by weight; cuts are where the sum
#: of sizes in the order of the hash comes nearest to what is left after whole uses.
_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(concat_ws('|', '17', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, CAST(1.5 AS DOUBLE) * sum(n) OVER () AS total, coalesce(sum(2 * n) OVER (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, row_number() OVER (ORDER BY 2 * n / w, source NULLS LAST) AS place FROM s),
f AS (SELECT min(place) AS place, arg_min(total - before, place) AS rest, arg_min(open, place) AS open FROM o WHERE NOT (total - before) * w / open > 2 * n),
t AS (SELECT source, n, CASE WHEN f.place IS NULL OR o.place < f.place THEN CAST(2 * n AS DOUBLE) ELSE f.rest * w / f.open END AS target FROM o, f),
u AS (SELECT *, least(2 * n, CAST(floor(target + 0.5) AS BIGINT)) AS taken FROM t),
v AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(2, taken // n) END AS whole FROM u),
c AS (SELECT v.source, x.h, v.taken - v.whole * v.n AS wanted, sum(x.size) OVER (PARTITION BY v.source ORDER BY x.h) AS upto FROM (SELECT source, h, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY ALL) x JOIN v ON x.source IS NOT DISTINCT FROM v.source),
e AS (SELECT source, h, wanted, row_number() OVER (PARTITION BY source ORDER BY abs(upto - wanted), h) AS r, abs(upto - wanted) AS off FROM c WHERE wanted > 0),
k AS (SELECT source, h AS last FROM e WHERE r = 1 AND off < wanted)
SELECT d.doc_id, d.size, v.n AS source_size, v.target, CAST(d.size * (v.whole + CASE WHEN d.h <= k.last THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""

_OP9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

#: Bytes are written in hex. Each word is matched step by step: of the pieces that it goes on with the longest.
_OP7 = r"""
WITH RECURSIVE v AS (SELECT hex(from_base64(t)) AS x FROM read_csv('{path}', delim = ' ', header = false, quote = '', escape = '', columns = {{'t': 'VARCHAR', 'r': 'BIGINT'}})),
one AS (SELECT printf('%02X', i) AS x FROM range(256) AS g(i) WHERE i <> 32 AND i NOT BETWEEN 9 AND 13),
clean AS (SELECT x FROM v WHERE NOT list_has_any(regexp_extract_all(x, '..'), ['20', '09', '0A', '0B', '0C', '0D'])),
p AS (SELECT DISTINCT true AS head, substr(x, 3) AS x FROM v WHERE starts_with(x, '20') AND length(x) > 2 AND NOT list_has_any(regexp_extract_all(substr(x, 3), '..'), ['20', '09', '0A', '0B', '0C', '0D']) UNION SELECT true, x FROM one UNION SELECT false, x FROM clean UNION SELECT false, x FROM one),
longest AS (SELECT max(length(x)) // 2 AS n FROM p),
d AS (SELECT row_number() OVER () AS rn, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
u AS (SELECT rn, hex(unnest(words)) AS w FROM d),
r(w, pos, n) AS (
  SELECT DISTINCT w, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM u
  UNION ALL
  SELECT w, pos + max(length(x)), n + 1 FROM (SELECT w, pos, n, substr(w, pos + 1, 2 * l) AS part FROM (SELECT w, pos, n, unnest(range(1, least((SELECT n FROM longest), (length(w) - pos) // 2) + 1)) AS l FROM r WHERE pos < length(w)) y) z
  JOIN p ON p.x = z.part AND p.head = (z.pos = 0) GROUP BY w, pos, n
),
c AS (SELECT w, max(n) AS n FROM r GROUP BY w),
k AS (SELECT rn, count(*) AS n_words, sum(n) AS n_pieces, max(n) AS longest FROM u JOIN c USING (w) GROUP BY rn)
SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_pieces, 0) AS BIGINT) AS n_pieces, coalesce(k.longest, 0) AS longest_word_pieces FROM d LEFT JOIN k USING (rn)
""".format(path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))

_OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, upper(sha1(h)) AS x FROM p),
b AS (SELECT page_id, n, list_transform(range(0, 8), lambda i: list_reduce(list_transform(range(1, 6), lambda j: CAST(strpos('0123456789ABCDEF', x[5 * i + j]) - 1 AS BIGINT)), lambda a, y: a * 16 + y)) AS g FROM d),
e AS (SELECT page_id, n, list_aggregate(list_transform(g, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> s) & 31) + 1]), '')), 'string_agg', '') AS digest FROM b),
f AS (SELECT digest AS fd, max(page_id) AS first FROM e GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM e JOIN f ON digest = fd
"""

#: Rules are mined by listing all sets of tokens that 20 block pages have, in the order of their tokens.
_OP10 = r"""
WITH RECURSIVE u AS (SELECT row_number() OVER () AS rn, page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
a AS (SELECT rn, page_id, url, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1) AS h, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
c AS (SELECT rn, page_id, url, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM a),
t AS (SELECT rn, page_id, host, path, list_sort(list_distinct(list_concat(
  CASE WHEN strpos(url, '://') > 1 THEN ['s:' || substr(url, 1, strpos(url, '://') - 1)] ELSE [] END,
  list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
  list_transform(list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda x: x <> ''), lambda x: 'p:' || x),
  list_transform(list_filter(list_transform(string_split(regexp_extract(coalesce(url, ''), '\?([^#]*)', 1), '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> ''), lambda x: 'q:' || x),
  CASE WHEN url LIKE '%#%' THEN ['f:'] ELSE [] END))) AS tok FROM c),
k AS (SELECT doc_id, max(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS block FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
l AS (SELECT rn, tok, block FROM t JOIN k ON page_id = doc_id),
n AS (SELECT count(*) AS total, count(*) FILTER (block) AS blocked FROM l),
i AS (SELECT x, count(*) AS hits FROM (SELECT unnest(tok) AS x FROM l WHERE block) GROUP BY x HAVING count(*) >= 20),
s(items) AS (SELECT [x] FROM i UNION ALL SELECT list_append(items, x) FROM s JOIN i ON x > items[-1] WHERE (SELECT count(*) FROM l WHERE block AND list_has_all(tok, list_append(items, x))) >= 20),
f AS (SELECT items, (SELECT count(*) FROM l WHERE block AND list_has_all(tok, items)) AS hits, (SELECT count(*) FROM l WHERE list_has_all(tok, items)) AS freq FROM s),
r AS (SELECT items FROM f, n WHERE hits >= 20 AND hits / freq >= 0.6 AND hits / freq >= 1.5 * blocked / total),
m AS (SELECT DISTINCT rn FROM t JOIN r ON list_has_all(tok, items)),
g(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
b AS (SELECT rn, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM t JOIN g ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rn)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN m.rn IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM t LEFT JOIN b ON b.rn = t.rn LEFT JOIN m ON m.rn = t.rn
"""

_DISTANCE = "CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
_NEAREST = f"""SELECT v.rn, arg_min(c.k, ({_DISTANCE}, c.k)) AS k, min({_DISTANCE}) AS d FROM v, c{{0}} c GROUP BY v.rn"""
_ROUND = """a{0} AS MATERIALIZED (""" + _NEAREST + """),
m{0} AS MATERIALIZED (SELECT a.k, u.i, CAST(sum(u.x) AS BIGINT) AS s, count(*) AS n FROM a{0} a JOIN u ON u.rn = a.rn GROUP BY ALL),
c{1} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{0} c LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM m{0} GROUP BY k) m ON m.k = c.k)"""
_OP11 = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
u AS MATERIALIZED (SELECT rn, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM v),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS k, q FROM v ORDER BY sha256('1:' || vec_id), q LIMIT 16),
{", ".join(_ROUND.format(i, i + 1) for i in range(3))},
z AS ({_NEAREST.format(3)})
SELECT vec_id, CAST(z.k AS INTEGER) AS cluster, z.d AS distance, CAST(sum(z.d) OVER (PARTITION BY z.k) AS BIGINT) AS cluster_inertia, CAST(sum(z.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM z JOIN v ON v.rn = z.rn JOIN c3 ON c3.k = z.k
"""

SQL = {"op1_near_dedup": _OP1, "op3_line_dedup": _OP3, "op4_source_mix": _OP4, "op7_token_counts": _OP7, "op8_warc": _OP8, "op9_exact_top_k": _OP9, "op10_url_rules": _OP10, "op11_centroids": _OP11}
