"""SQL for the registered queries, over the raw tables: written apart from the operators, to hold them to account."""

from __future__ import annotations

# Texts that rows have to show, and the order of sections.
_NOT_STATED, _NO_SOURCE, _NO_LINE = "未标注", "未标注来源", "- 暂无相关证据。"
_LACKS = ("给定证据不足：用户观察未能与当前图谱证据形成明确匹配。", "给定证据不足：当前图谱未提供可用鉴别诊断证据。", "给定证据不足：当前图谱未提供可用风险提示证据。")
_SECTIONS = ("Candidate", "Type", "Brand", "Suppliers", "Recalls", "Sources")
_SAFETY = """1. 仅用于辅助决策，不替代医生诊断。
2. 不得把候选疾病表述为确诊。
3. 不得输出处方、药物剂量或具体用药方案。
4. 不得虚构知识图谱之外的证据。
5. 证据不足时必须明确写“给定证据不足”。
6. 不得输出患病概率。
7. V1.0 不实现图片分类。"""
_ASKED = """# 任务
请只凭下面的证据，说明观察与候选疾病有什么关系。读者据此了解情况，不据此确诊或用药。

# 输入
- 候选疾病：{candidate}
- 用户观察：{observation}

# 知识图谱证据上下文
{context}

# 要求
"""
_KEEP = "每句话都要能在证据里找到出处；证据没有谈到的，写“给定证据不足”，不要用别处的知识去补。不开处方，不谈剂量，不把候选当成结论。"
_PROMPTS = {
    1: _ASKED + _KEEP + "\n\n# 回答的栏目，不增不减\n候选疾病：\n支持证据：\n鉴别诊断：\n风险提示：\n就医建议：\n\n# Safety\n" + _SAFETY,
    2: _ASKED + _KEEP + """观察要逐条对照证据，每一条都写明它的证据路径、evidence_text、source；措辞留有余地。

# 回答的栏目，不增不减
候选疾病：
用户观察与证据匹配：（一行一条：证据路径 | evidence_text | source）
支持证据：（一行一条：证据路径 | evidence_text | source）
鉴别诊断：（一行一条：证据路径 | evidence_text | source）
风险提示：（一行一条：证据路径 | evidence_text | source）
就医建议：（一行一条：证据路径 | evidence_text | source）
证据不足说明：

# 各栏逐条填写的字段
- 候选疾病
  - 中文名：
  - 英文名：
  - 编号：
  - 怎样措辞：
- 用户观察与证据匹配
  - 哪条观察：
  - 是否相符：
    - 证据路径：
    - evidence_text：
    - source：
- 支持证据
  - 证据路径：
  - evidence_text：
  - source：
- 鉴别诊断
  - 要与什么区分：
    - 证据路径：
    - evidence_text：
    - source：
- 风险提示
  - 有什么风险：
    - 证据路径：
    - evidence_text：
    - source：
- 就医建议
  - 建议做什么：
    - 证据路径：
    - evidence_text：
    - source：
- 证据不足说明
  - 缺什么：
  - 为何缺：

# Safety
""" + _SAFETY,
    None: _ASKED + _SAFETY + "\n\n# 回答的栏目，不增不减\n候选疾病：\n用户观察与证据匹配：\n支持证据：\n鉴别诊断：\n风险提示：\n就医/检查建议：\n证据不足说明：\n免责声明：",
}


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x{{3000}}]+|[\s\x{{3000}}]+$', '', 'g')"


def _norm(x: str) -> str:
    return f"lower({_strip(x)})"


def _items(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '[;；，|,]'), lambda v: {_strip('v')}), lambda v: v <> '')"


_NUM = "regexp_replace({0}, '[^0-9]', '', 'g')"
_PB = _NUM.format("p_brand")
_BASE = rf"""
WITH ent AS (
  SELECT 'PRT_' || p_partkey AS id, 'Part' AS entity_type, p_name AS name_cn, p_name || ' ' || p_type AS name_en, p_brand || '; ' || p_type || '；size ' || p_size AS alias, CAST(p_partkey AS BIGINT) AS ord FROM part
  UNION ALL SELECT DISTINCT 'BRD_' || {_PB}, 'Brand', p_brand, lower(p_brand), 'b' || {_PB} || '|brand ' || {_PB}, 1000000000000 + CAST({_PB} AS BIGINT) FROM part
  UNION ALL SELECT DISTINCT 'TYP_' || replace(p_type, ' ', '_'), 'PartType', p_type, '', '', 2000000000000 FROM part
  UNION ALL SELECT 'NAT_' || n_nationkey, 'Nation', n_name, '', '', 3000000000000 + n_nationkey FROM nation
  UNION ALL SELECT 'REG_' || r_regionkey, 'Region', r_name, '', '', 4000000000000 + r_regionkey FROM region
  UNION ALL SELECT 'SUP_' || s_suppkey, 'Supplier', s_name, '', '', 5000000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 'CUS_' || c_custkey, 'Customer', c_name, '', '', 6000000000000 + c_custkey FROM customer
  UNION ALL SELECT DISTINCT 'SEG_' || c_mktsegment, 'Segment', c_mktsegment, '', '', 7000000000000 FROM customer
), keys AS (
  SELECT DISTINCT k AS key, id, entity_type, ord FROM (SELECT id, entity_type, ord, unnest(list_concat([{_norm('id')}, {_norm('name_cn')}, {_norm('name_en')}], list_transform({_items('alias')}, lambda v: lower(v)))) AS k FROM ent)
), pair AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem
), tri AS (
  SELECT 'TB' || p_partkey AS triple_id, 'PRT_' || p_partkey AS head_id, p_name AS head_cn, 'Part' AS head_type, 'has brand' AS relation_cn, 'has_brand' AS relation_en, 'BRD_' || {_PB} AS tail_id, p_brand AS tail_cn, 'Brand' AS tail_type, p_name || ' carries ' || p_brand AS evidence_text, p_partkey * 1000000000 + 4 * (p_partkey % 7) + 1 AS ord FROM part
  UNION ALL SELECT 'TT' || p_partkey, 'PRT_' || p_partkey, p_name, 'Part', 'has type', 'has_type', 'TYP_' || replace(p_type, ' ', '_'), p_type, 'PartType', p_name || ' is ' || p_type, p_partkey * 1000000000 + 4 * (p_partkey % 5) + 3 FROM part
  UNION ALL SELECT 'TS' || p || '_' || s, 'PRT_' || p, p_name, 'Part', 'supplied by', 'supplied_by', 'SUP_' || s, s_name, 'Supplier', CASE WHEN s % 10 = 0 THEN '' ELSE p_name || ' is supplied by ' || s_name END, p * 1000000000 + 4 * s + 2 FROM pair JOIN part ON p = p_partkey JOIN supplier ON s = s_suppkey
  UNION ALL SELECT 'TL' || s_suppkey, 'SUP_' || s_suppkey, s_name, 'Supplier', 'located in', 'located_in', 'NAT_' || n_nationkey, n_name, 'Nation', '', 100000000000000000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'TC' || c_custkey, 'CUS_' || c_custkey, c_name, 'Customer', 'located in', 'located_in', 'NAT_' || n_nationkey, n_name, 'Nation', '', 200000000000000000 + c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'TG' || c_custkey, 'CUS_' || c_custkey, c_name, 'Customer', 'in segment', 'in_segment', 'SEG_' || c_mktsegment, c_mktsegment, 'Segment', '', 300000000000000000 + c_custkey FROM customer
  UNION ALL SELECT 'TR' || n_nationkey, 'NAT_' || n_nationkey, n_name, 'Nation', 'part of', 'part_of', 'REG_' || r_regionkey, r_name, 'Region', '', 400000000000000000 + n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
), src AS (
  SELECT 'SRC_' || n_nationkey AS source_id, 'Registry of ' || n_name AS source_name, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'Registry' END AS source_type FROM nation
  UNION ALL SELECT 'AUD_' || r_regionkey, 'Audit of ' || r_name, 'Audit' FROM region
), best AS (
  SELECT 'TS' || p || '_' || s AS triple_id, CASE WHEN p % 3 = 0 THEN 'AUD_' || n_regionkey ELSE 'SRC_' || n_nationkey END AS source_id FROM pair JOIN supplier ON s = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), att AS (
  SELECT tri.*, coalesce(src.source_id, '') AS source_id, coalesce(src.source_name, '') AS own_name, coalesce(src.source_name, 'trade records') AS source_name, coalesce(src.source_type, '') AS source_type, 'trade records' AS source
  FROM tri LEFT JOIN best ON tri.triple_id = best.triple_id LEFT JOIN src ON best.source_id = src.source_id
), partq AS (SELECT 'PRT_' || p_partkey AS query_id FROM part
), nameq AS (SELECT DISTINCT 'N:' || p_name AS query_id, upper(p_name) AS query FROM part
), mixq AS (
  SELECT DISTINCT 'B:' || p_brand AS query_id, chr(9) || ' ' || upper(p_brand) || '  ' AS query FROM part
  UNION ALL SELECT 'C:' || n_name, lower(n_name) FROM nation UNION ALL SELECT 'U:' || r_name, 'no ' || r_name FROM region
), item AS (SELECT head_id AS query_id, * FROM att WHERE head_type = 'Part'
), sec AS (SELECT item.*, CASE relation_en WHEN 'supplied_by' THEN 'Suppliers' WHEN 'has_brand' THEN 'Brand' ELSE 'Type' END AS section FROM item
)
"""


def _found(q: str, kind: str | None = None) -> str:
    return f"SELECT DISTINCT query_id, id FROM {q} JOIN keys ON key = {_norm('query')}" + (f" WHERE entity_type = '{kind}'" if kind else "")


_COLS = "query_id, triple_id, head_id, head_cn AS head_name, relation_en, tail_id, tail_cn AS tail_name, tail_type, evidence_text, source_id, source_name, source_type, ord"
_PATH = "head_cn || ' — ' || relation_cn || ' — ' || tail_cn"
_EXTRAS = "concat_ws('{sep}', nullif(source_id, ''), nullif(source_type, ''))"


def _label(name: str) -> str:
    e = _EXTRAS.format(sep=", ")
    return f"CASE WHEN {name} <> '' AND {e} <> '' THEN {name} || ' (' || {e} || ')' ELSE coalesce(nullif({name}, ''), nullif({e}, ''), '{_NOT_STATED}') END"


_SCREEN = f"CASE WHEN {_EXTRAS.format(sep='，')} <> '' THEN coalesce(nullif(own_name, ''), '{_NO_SOURCE}') || '（' || {_EXTRAS.format(sep='，')} || '）' ELSE coalesce(nullif(own_name, ''), '{_NO_SOURCE}') END"
def _block(name: str) -> str:
    return f"'- 证据路径：' || {_PATH} || chr(10) || '  evidence_text：' || coalesce(nullif(evidence_text, ''), '{_NOT_STATED}') || chr(10) || '  source：' || {_label(name)}"


_ORDER = "(VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(_SECTIONS)) + ") AS o(section, section_ord)"
_KEY = "coalesce(nullif(source_id, ''), nullif(source_name, ''))"


def _document(q: str, items: str, head: str, sources: str, name: str) -> str:
    return f"""{_BASE}, it AS ({items}), body AS (
  SELECT query_id, CASE relation_en WHEN 'supplied_by' THEN 'Suppliers' WHEN 'has_brand' THEN 'Brand' ELSE 'Type' END AS section, string_agg({_block(name)}, chr(10) ORDER BY ord, triple_id) AS lines FROM it GROUP BY ALL
  UNION ALL {head} UNION ALL {sources}
) SELECT q.query_id, string_agg('## ' || o.section || chr(10) || coalesce(lines, '{_NO_LINE}'), chr(10) || chr(10) ORDER BY section_ord) AS context
FROM {q} q CROSS JOIN {_ORDER} LEFT JOIN body ON body.query_id = q.query_id AND body.section = o.section GROUP BY q.query_id"""


_BUCKETS = f"""{_BASE}, b AS (
  SELECT *, CASE section WHEN 'Suppliers' THEN 'medical_advice_or_exams' WHEN 'Type' THEN 'supporting_evidence' END AS bucket, 0 AS part FROM sec WHERE section <> 'Brand'
  UNION ALL SELECT *, 'supporting_evidence', 1 FROM sec WHERE section = 'Brand' UNION ALL SELECT *, 'risk_warnings', 0 FROM sec WHERE section = 'Brand'
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY part, ord, triple_id) AS place FROM b)
"""
_OBS = r""", obs AS (SELECT 'PRT_' || p_partkey AS query_id, CASE p_partkey % 3 WHEN 0 THEN 'Seen with ' || upper(p_brand) || ' on it' WHEN 1 THEN p_name || ' is ' || p_type || ', so they say' ELSE 'nothing known, of it' END AS observation FROM part
), hit AS (SELECT s.* FROM sec s JOIN obs o ON s.query_id = o.query_id WHERE contains(lower(observation), lower(tail_cn)) OR (evidence_text <> '' AND len(list_filter(string_split_regex(lower(observation), '[,.]'), lambda c: length(c) >= 4 AND contains(lower(evidence_text), c))) > 0))
"""
_CLAIMS = """WITH x AS (SELECT l_partkey AS part, l_suppkey AS supplier, s_nationkey AS nation, l_returnflag AS f FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
c AS (SELECT DISTINCT part, supplier, nation FROM x WHERE f = 'R'), e AS (SELECT * FROM x WHERE f <> 'R'),
st AS (SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.part = c.part AND e.supplier = c.supplier) THEN 'supported' WHEN EXISTS (SELECT 1 FROM e WHERE e.part = c.part AND e.nation = c.nation) THEN 'partially_supported'
  WHEN EXISTS (SELECT 1 FROM e WHERE e.part = c.part) THEN 'unsupported' ELSE 'not_verifiable' END AS status FROM c)
"""
_SCORES = """WITH x AS (SELECT o_custkey, p_brand, p_size, l_quantity, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
g AS (SELECT o_custkey, p_brand, count(*) AS mf, count(*) FILTER (p_size > 25) AS ml, count(*) FILTER (l_quantity > 25) AS ms, count(DISTINCT l_returnflag) AS kinds, count(*) FILTER (l_returnflag = 'R') AS cf FROM x GROUP BY ALL),
s AS (SELECT *, round(CAST(0.4 AS DOUBLE) * mf + CAST(0.2 AS DOUBLE) * ml + CAST(0.2 AS DOUBLE) * ms + CAST(0.2 AS DOUBLE) * (kinds / CAST(3 AS DOUBLE)) - CAST(0.3 AS DOUBLE) * cf, 6) AS score FROM g)
"""


_RECURSIVE = _BASE.replace("WITH", "WITH RECURSIVE", 1)
_PATHS = """h1 AS (SELECT p.id AS start, tail_id AS "end", 1::BIGINT AS n_hops, p.id || '>' || tail_id AS nodes, triple_id AS ids, {0} FROM (SELECT id FROM ent WHERE entity_type = 'Part') p JOIN {2} AS t ON t.head_id = p.id),
h2 AS (SELECT start, tail_id AS "end", 2::BIGINT AS n_hops, nodes || '>' || tail_id AS nodes, ids || '/' || triple_id AS ids, {1} FROM h1 h JOIN {2} AS t ON t.head_id = h."end" WHERE NOT list_contains(string_split(nodes, '>'), tail_id)),
h3 AS (SELECT start, tail_id AS "end", 3::BIGINT AS n_hops, nodes || '>' || tail_id AS nodes, ids || '/' || triple_id AS ids, {1} FROM h2 h JOIN {2} AS t ON t.head_id = h."end" WHERE NOT list_contains(string_split(nodes, '>'), tail_id)),
h AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)"""
_CUSTOMER_CLAIMS = """WITH x AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supplier, c_nationkey AS nation, n_regionkey AS region FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'),
f AS (SELECT DISTINCT l_partkey AS part, s_nationkey AS nation, n_regionkey AS region FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT *, CASE WHEN part % 3 = 2 THEN 'REG_' || region ELSE 'NAT_' || nation END AS tail, part % 3 <> 0 AS mapped,
  CASE part % 3 WHEN 0 THEN false WHEN 1 THEN EXISTS (SELECT 1 FROM f WHERE f.part = x.part AND f.nation = x.nation) ELSE EXISTS (SELECT 1 FROM f WHERE f.part = x.part AND f.region = x.region) END AS consistent FROM x)
"""
#: Every place of every text against names of every length; spans are walked from one to the next.
_ANCHORS = f"""nm AS (SELECT unnest([{_norm('id')}, {_norm('name_cn')}, {_norm('name_en')}]) AS name, id, entity_type, ord, 0 AS way FROM ent UNION ALL SELECT lower(unnest({_items('alias')})), id, entity_type, ord, 1 FROM ent),
known AS (SELECT name, arg_min({{'id': id, 'kind': entity_type, 'way': way}}, (way, ord, id)) AS e, count(DISTINCT id) AS n_entities FROM nm WHERE name <> '' GROUP BY name),
place AS (SELECT query_id, lower(t) AS low, unnest(range(1, length(t) + 1)) AS p FROM said),
size AS (SELECT DISTINCT length(name) AS n FROM known),
cand AS (SELECT query_id, p, max(n) AS n FROM (SELECT *, substr(low, p, n) AS part FROM place JOIN size ON p + n - 1 <= length(low)) x JOIN known ON name = part
  WHERE (p = 1 OR NOT regexp_matches(substr(low, p - 1, 2), '^[a-z0-9][a-z0-9]$')) AND NOT regexp_matches(substr(low, p + n - 1, 2), '^[a-z0-9][a-z0-9]$') GROUP BY ALL),
nxt AS (SELECT c.query_id, c.p, min(o.p) AS q FROM cand c JOIN cand o ON o.query_id = c.query_id AND o.p >= c.p + c.n GROUP BY ALL),
walk(query_id, p) AS (SELECT query_id, min(p) FROM cand GROUP BY query_id UNION ALL SELECT w.query_id, n.q FROM walk w JOIN nxt n ON n.query_id = w.query_id AND n.p = w.p),
span AS (SELECT w.query_id, w.p - 1 AS start, substr(t, w.p, c.n) AS raw_text, e.kind AS anchor_type, e.id AS entity_id, CASE WHEN e.way = 0 THEN 'exact' ELSE 'alias' END AS method, CASE WHEN e.way = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS confidence, n_entities
  FROM walk w JOIN cand c ON c.query_id = w.query_id AND c.p = w.p JOIN said s ON s.query_id = w.query_id JOIN known ON name = lower(substr(t, w.p, c.n)))"""


def _prompt(version: int | None) -> str:
    """A pinned text with its three places filled in; candidates whose id ends in 7 are blank."""
    quoted = "'" + _PROMPTS[version].replace("'", "''") + "'"
    candidate = "' ' || o.query_id || ' '" if version == 2 else "o.query_id"
    for place, value in (("candidate", candidate), ("observation", "observation"), ("context", "coalesce(context, '')")):
        quoted = quoted.replace("{" + place + "}", f"' || {value} || '")
    if version == 2:  # over the whole evidence of each part
        whole = _document("partq", "SELECT * FROM item", "SELECT id, 'Candidate', '- ' || name_cn || ' / ' || name_en || '（' || id || '）' FROM ent WHERE entity_type = 'Part'",
            f"SELECT query_id, 'Sources', string_agg('- ' || label, chr(10) ORDER BY o, label) FROM (SELECT query_id, {_label('source')} AS label, min(ord) AS o FROM it GROUP BY ALL) GROUP BY query_id", "source")
        return f"""{_BASE}{_OBS} SELECT o.query_id, CASE WHEN NOT ends_with(o.query_id, '7') THEN {quoted} END AS prompt, CASE WHEN ends_with(o.query_id, '7') THEN 'ANALYSIS_INSUFFICIENT_INPUT' ELSE 'OK' END AS outcome FROM obs o LEFT JOIN ({whole}) m ON o.query_id = m.query_id"""
    return f"""{_BASE}{_OBS}, marks AS (SELECT query_id, string_agg(section || ' ' || n, chr(10) ORDER BY section) AS context FROM (SELECT query_id, section, count(*) AS n FROM sec GROUP BY ALL) GROUP BY query_id)
SELECT o.query_id, CASE WHEN NOT ends_with(o.query_id, '7') THEN {quoted} END AS prompt, CASE WHEN ends_with(o.query_id, '7') THEN 'ANALYSIS_INSUFFICIENT_INPUT' ELSE 'OK' END AS outcome FROM obs o LEFT JOIN marks m ON o.query_id = m.query_id"""


_URL_PART = "url_encode(name_en)"
for _code, _char in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
    _URL_PART = f"replace({_URL_PART}, '{_code}', '{_char}')"
_ROW = "concat_ws(chr(31), triple_id, head_id, head_cn, head_type, relation_cn, relation_en, tail_id, tail_cn, tail_type, 'trade records', evidence_text, '', CAST(ord AS VARCHAR))"

SQL = {
    "kg_entities": f"{_BASE} SELECT id AS entity_id, entity_type, name_cn, name_en, coalesce({_items('alias')}[1], '') AS label, ord FROM ent",
    "list_heads": f"{_BASE} SELECT id AS entity_id, name_cn, name_en, coalesce({_items('alias')}[1], '') AS label, ord FROM ent WHERE entity_type = 'Part'",
    "alias_explode": f"{_BASE}, a AS (SELECT id, {_items('alias')} AS l FROM ent) SELECT id, CAST(pos - 1 AS BIGINT) AS pos, item FROM (SELECT id, unnest(l) AS item, generate_subscripts(l, 1) AS pos FROM a)",
    "lookup_keys": f"{_BASE} SELECT key, id, entity_type FROM keys",
    "resolve_all": f"{_BASE} {_found('mixq')}",
    "resolve_first": f"{_BASE}, q AS (SELECT * FROM nameq UNION ALL SELECT * FROM mixq), f AS (SELECT query_id, id, entity_type, row_number() OVER (PARTITION BY query_id ORDER BY ord, id) AS r FROM q JOIN keys ON key = {_norm('query')}) SELECT query_id, id, entity_type FROM f WHERE r = 1",
    "resolve_ranked": f"""{_BASE}, x AS (SELECT unnest([{_norm('id')}, {_norm('name_cn')}, {_norm('name_en')}]) AS key, id, 'exact' AS method FROM ent UNION ALL SELECT lower(unnest({_items('alias')})), id, 'alias' FROM ent)
SELECT query_id, id, max(method) AS method FROM mixq JOIN x ON key = {_norm('query')} GROUP BY ALL""",
    "resolve_outcome": f"""{_BASE}, known AS ({_found('mixq')}), hit AS (SELECT DISTINCT query_id FROM ({_found('mixq', 'Brand')}) f JOIN tri ON tail_id = f.id AND head_type = 'Part')
SELECT query_id, CASE WHEN query_id NOT IN (SELECT query_id FROM known) THEN 'KG_ENTITY_NOT_FOUND' WHEN query_id NOT IN (SELECT query_id FROM hit) THEN 'KG_EVIDENCE_NOT_FOUND' ELSE 'OK' END AS outcome FROM mixq""",
    "head_outcome": f"""{_BASE}, q AS (SELECT * FROM nameq UNION ALL SELECT * FROM mixq), known AS ({_found('q', 'Part')}), hit AS (SELECT query_id FROM known JOIN tri ON head_id = id)
SELECT query_id, CASE WHEN query_id NOT IN (SELECT query_id FROM known) THEN 'KG_DISEASE_NOT_FOUND' WHEN query_id NOT IN (SELECT query_id FROM hit) THEN 'KG_EVIDENCE_NOT_FOUND' ELSE 'OK' END AS outcome FROM q""",
    "evidence_by_head": f"{_BASE} SELECT {_COLS} FROM att JOIN ({_found('nameq', 'Part')}) f ON head_id = f.id",
    "evidence_by_relation": f"{_BASE} SELECT {_COLS} FROM att JOIN ({_found('nameq', 'Part')}) f ON head_id = f.id WHERE relation_en = 'has_brand'",
    "reverse_lookup": f"{_BASE} SELECT {_COLS} FROM att JOIN ({_found('mixq', 'Brand')}) f ON tail_id = f.id WHERE head_type = 'Part'",
    "source_attach_last_wins": f"{_BASE} SELECT triple_id, source_id, own_name AS source_name, source_type FROM att",
    "endpoint_enrich": f"{_BASE} SELECT triple_id, head_cn AS head_name, head_type, tail_cn AS tail_name, tail_type, source_name FROM att",
    "section_counts": f"{_BASE} SELECT query_id, section, count(*) AS n_items FROM sec GROUP BY ALL",
    "context_summary": f"{_BASE} SELECT query_id, count(DISTINCT section) AS section_count, count(DISTINCT {_KEY}) AS source_count, count(section) AS item_count FROM sec GROUP BY ALL",
    "section_first_appearance": f"{_BASE}, f AS (SELECT query_id, section, min(ord) AS first_ord FROM sec GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_ord, section) AS place FROM f",
    "section_fill": f"{_BASE} SELECT q.query_id, o.section, CAST(section_ord AS BIGINT) AS section_ord, count(triple_id) AS n_items FROM partq q CROSS JOIN {_ORDER} LEFT JOIN sec s ON s.query_id = q.query_id AND s.section = o.section GROUP BY ALL",
    "source_dedup_first": f"{_BASE}, r AS (SELECT query_id, source_id, source_name, source_type, ord, row_number() OVER (PARTITION BY query_id, {_KEY} ORDER BY ord, triple_id) AS r FROM item) SELECT query_id, source_id, source_name, source_type, ord FROM r WHERE r = 1",
    "source_dedup_text": f"{_BASE} SELECT query_id, {_label('source')} AS label, min(ord) AS ord FROM item GROUP BY ALL",
    "distinct_heads": f"{_BASE} SELECT query_id, head_id, head_cn AS head_name, min(ord) AS ord FROM att JOIN ({_found('nameq', 'Part')}) f ON head_id = f.id GROUP BY ALL",
    "context_markdown": _document("partq", "SELECT * FROM item", "SELECT id, 'Candidate', '- ' || name_cn || ' / ' || name_en || '（' || id || '）' FROM ent WHERE entity_type = 'Part'",
        f"SELECT query_id, 'Sources', string_agg('- ' || source_name || ' (' || source_id || ', ' || source_type || ')', chr(10) ORDER BY ord, source_id) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, {_KEY} ORDER BY ord, triple_id) AS r FROM item) WHERE r = 1 GROUP BY query_id", "source_name"),
    "context_research": _document("(SELECT query_id, query_id AS query FROM partq UNION ALL SELECT query_id, query FROM mixq)",
        f"SELECT f.query_id, att.* FROM att JOIN (SELECT query_id, id FROM (SELECT query_id, query_id AS id FROM partq UNION ALL {_found('mixq', 'Part')})) f ON head_id = f.id",
        """SELECT q.query_id, 'Candidate', coalesce(h.lines, '- 未查询到匹配疾病：' || q.query) FROM (SELECT query_id, query_id AS query FROM partq UNION ALL SELECT query_id, query FROM mixq) q LEFT JOIN
    (SELECT query_id, string_agg('- ' || head_cn || ' / ' || name_en || '（' || head_id || '）', chr(10) ORDER BY o, head_id) AS lines FROM (SELECT query_id, head_id, head_cn, min(ord) AS o FROM it GROUP BY ALL) JOIN (SELECT id, name_en FROM ent WHERE entity_type = 'Part') e ON e.id = head_id GROUP BY query_id) h ON h.query_id = q.query_id""",
        f"SELECT query_id, 'Sources', string_agg('- ' || label, chr(10) ORDER BY o, label) FROM (SELECT query_id, {_label('source')} AS label, min(ord) AS o FROM it GROUP BY ALL) GROUP BY query_id", "source"),
    "plain_listing": f"""{_BASE} SELECT query_id, string_agg('triple_id: ' || triple_id || chr(10) || '证据路径: ' || {_PATH} || chr(10) || 'relation_en: ' || relation_en || chr(10) || 'source: ' || CASE WHEN source_id <> '' OR source_type <> '' THEN source || ' (' || source_id || ', ' || source_type || ')' ELSE source END
  || chr(10) || 'evidence_text: ' || evidence_text || chr(10) || 'note: ', chr(10) || chr(10) ORDER BY ord, triple_id) AS listing FROM item GROUP BY query_id""",
    "observation_match": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(lower(d.text), lower(b.text))",
    "clause_match": "WITH c AS (SELECT DISTINCT clause FROM (SELECT unnest(string_split_regex(lower(text), '[,.]')) AS clause FROM documents) WHERE length(clause) >= 4) SELECT clause, item_id FROM c JOIN benchmark b ON contains(lower(b.text), clause)",
    "observed_evidence": f"{_BASE}{_OBS}, f AS (SELECT query_id, section, min(ord) AS first_ord FROM sec GROUP BY ALL) SELECT h.query_id, triple_id, row_number() OVER (PARTITION BY h.query_id ORDER BY first_ord, h.section, ord, triple_id) AS place FROM hit h JOIN f ON f.query_id = h.query_id AND f.section = h.section",
    "buckets_union": f"{_BUCKETS} SELECT query_id, bucket, place, triple_id FROM r",
    "bucket_topk": f"{_BUCKETS} SELECT query_id, bucket, place, {_PATH} AS evidence_path, coalesce(nullif(evidence_text, ''), '{_NOT_STATED}') AS shown_text, {_label('source_name')} AS shown_source FROM r WHERE (bucket = 'supporting_evidence' AND place <= 3) OR (bucket = 'medical_advice_or_exams' AND place <= 2)",
    "insufficient_flags": f"""{_BASE}{_OBS}, x AS (SELECT query_id, query_id NOT IN (SELECT query_id FROM hit) AS no_match, true AS no_differential, query_id NOT IN (SELECT query_id FROM sec WHERE section = 'Brand') AS no_risk FROM partq)
SELECT *, concat_ws(chr(10), CASE WHEN no_match THEN '{_LACKS[0]}' END, '{_LACKS[1]}', CASE WHEN no_risk THEN '{_LACKS[2]}' END) AS messages FROM x""",
    "candidates_or_all": f"{_BASE}, m AS (SELECT DISTINCT query_id, head_id AS entity_id FROM tri JOIN ({_found('mixq', 'Brand')}) f ON tail_id = f.id WHERE head_type = 'Part') SELECT query_id, entity_id, false AS all_heads FROM m UNION ALL SELECT query_id, NULL, true FROM mixq WHERE query_id NOT IN (SELECT query_id FROM m)",
    "entity_search": f"""{_BASE}, q AS (SELECT DISTINCT 'B:' || p_brand AS query_id, 'brand#' || {_PB} AS words FROM part UNION ALL SELECT 'R:' || r_name, lower(r_name) FROM region)
SELECT DISTINCT query_id, id, entity_type FROM q JOIN keys ON contains(key, words)""",
    "source_list": f"""{_BASE}, r AS (SELECT 'SRC_' || s_nationkey AS source_id, count(*) AS n FROM pair JOIN supplier ON s = s_suppkey GROUP BY 1 UNION ALL SELECT 'AUD_' || n_regionkey, count(*) FROM pair JOIN supplier ON s = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE p % 3 = 0 GROUP BY 1)
SELECT src.source_id, source_name, source_type, coalesce(n, 0) AS n_triples FROM src LEFT JOIN r ON r.source_id = src.source_id""",
    "reverse_heads": f"{_BASE} SELECT query_id, triple_id, e.id AS entity_id, e.name_cn, e.name_en, e.label FROM att JOIN ({_found('mixq', 'Brand')}) f ON tail_id = f.id JOIN (SELECT id, name_cn, name_en, coalesce({_items('alias')}[1], '') AS label FROM ent WHERE entity_type = 'Part') e ON e.id = head_id WHERE head_type = 'Part'",
    "items_nested": f"""{_BASE} SELECT query_id, triple_id, CAST(to_json({{'entity_id': head_id, 'name_cn': head_cn, 'entity_type': head_type}}) AS VARCHAR) AS head, CAST(to_json({{'relation_cn': relation_cn, 'relation_en': relation_en}}) AS VARCHAR) AS relation,
  CAST(to_json({{'entity_id': tail_id, 'name_cn': tail_cn, 'entity_type': tail_type}}) AS VARCHAR) AS tail, source FROM att JOIN ({_found('nameq', 'Part')}) f ON head_id = f.id""",
    "refs_by_list": "SELECT 'T' || s_suppkey AS triple_id, 'SRC_' || s_nationkey AS source_id, CAST(s_nationkey AS BIGINT) AS ord FROM supplier",
    "care_level": "SELECT event_id, CASE WHEN regexp_matches(event_type || coalesce(props, ''), 'purchase|refund') THEN 'high' WHEN regexp_matches(event_type || coalesce(props, ''), 'click|view') THEN 'medium' ELSE 'low' END AS care_level FROM events",
    "labels_rendered": f"""{_BASE} SELECT triple_id, head_cn || ' → ' || relation_cn || ' → ' || tail_cn AS arrow_path, {_label('own_name')} AS label, {_SCREEN} AS screen_label, '- ' || own_name || ' (' || source_id || ', ' || source_type || ')' AS line,
  CASE WHEN source_id <> '' OR source_type <> '' THEN 'trade records (' || source_id || ', ' || source_type || ')' ELSE 'trade records' END AS plain, coalesce(nullif(evidence_text, ''), '{_NOT_STATED}') AS shown_text FROM att""",
    "head_labels": f"{_BASE} SELECT id AS entity_id, name_cn || '（' || name_en || ' / ' || {_items('alias')}[1] || '）' AS shown, {_URL_PART} AS encoded FROM ent WHERE entity_type = 'Part'",
    "graph_status": f"{_BASE} SELECT (SELECT count(*) FROM ent) AS entity_count, (SELECT count(*) FROM tri) AS triple_count, (SELECT count(*) FROM src) AS source_count, (SELECT count(*) FROM part) AS head_count",
    "expectation_warnings": f"""{_BASE}, c AS (SELECT 'entity_count' AS name, 70 AS expected, (SELECT count(*) FROM ent) AS actual, 'effective entities' AS shown UNION ALL SELECT 'triple_count', 102, (SELECT count(*) FROM tri), 'triples' UNION ALL SELECT 'source_count', 25, (SELECT count(*) FROM src), 'sources' UNION ALL SELECT 'head_count', 7, (SELECT count(*) FROM part), 'HAM10000 diseases')
SELECT name, CAST(expected AS BIGINT) AS expected, actual, 'Expected ' || expected || ' ' || shown || ', got ' || actual || '.' AS warning FROM c WHERE expected <> actual""",
    "relation_counts": f"{_BASE} SELECT head_id, relation_en, count(*) AS n FROM tri GROUP BY ALL",
    "dup_check": f"{_BASE} SELECT key, count(*) AS n FROM keys GROUP BY key HAVING count(*) > 1",
    "dangling_nodes": f"{_BASE}, e AS (SELECT triple_id, 'head' AS side, head_id AS id FROM tri UNION ALL SELECT triple_id, 'tail', tail_id FROM tri) SELECT triple_id, side, id FROM e WHERE NOT EXISTS (SELECT 1 FROM ent WHERE ent.id = e.id)",
    "missing_sources": f"{_BASE} SELECT triple_id, relation_en FROM att WHERE source_id = ''",
    "copies_differ": f"""{_BASE}, own AS (SELECT id, arg_max({{'cn': name_cn, 'kind': entity_type}}, ord) AS e FROM ent GROUP BY id),
x AS (SELECT triple_id, 'head' AS side, head_id AS id, head_cn AS cn, head_type AS kind FROM tri UNION ALL SELECT triple_id, 'tail', tail_id, tail_cn, tail_type FROM tri) SELECT triple_id, side FROM x JOIN own ON own.id = x.id WHERE cn <> e.cn OR x.kind <> e.kind""",
    "prompt_render": _prompt(1),
    "prompt_second": _prompt(2),
    "prompt_general": _prompt(None),
    "safety_supplement": "SELECT conv_id, turn, '1. a' || chr(10) || '2. b' AS listed, sha256(CASE WHEN contains(text, 'the') THEN text ELSE text || chr(10) || chr(10) || '# Safety' || chr(10) || '" + _SAFETY + "' END) AS prompt_sha256 FROM conversations",
    "forbidden_phrase_check": "SELECT doc_id, NOT (contains(text, 'worthless') OR contains(text, 'trash') OR contains(text, 'disgusting')) AS clean FROM documents",
    "candidate_scores": _SCORES + "SELECT * FROM s",
    "candidate_rank_top3": _SCORES + ", r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, p_brand) AS rank_order FROM s) SELECT o_custkey, p_brand, mf, ml, ms, cf, score, rank_order FROM r WHERE rank_order <= 3",
    "claim_status": _CLAIMS + "SELECT part, supplier, nation, status FROM st",
    "oehr_ucr_pcs_ecr": _CLAIMS + """, m AS (SELECT nation, count(*) FILTER (status = 'supported') AS n_supported, count(*) FILTER (status = 'partially_supported') AS n_partial, count(*) FILTER (status = 'unsupported') AS n_unsupported, count(*) FILTER (status = 'not_verifiable') AS n_not_verifiable, count(*) AS n_mapped FROM st GROUP BY nation),
a AS (SELECT s_nationkey AS nation, count(*) AS n_anchors, count(*) FILTER (s_suppkey IN (SELECT supplier FROM st WHERE status = 'supported')) AS hits FROM supplier GROUP BY 1),
k AS (SELECT s_nationkey AS nation, count(DISTINCT l_returnflag) AS av, count(DISTINCT l_returnflag) FILTER (l_quantity >= 50) AS us FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
SELECT a.nation, n_anchors, round(hits / n_anchors, 9) AS oehr, round(n_unsupported / nullif(n_supported + n_partial + n_unsupported, 0), 9) AS ucr, round(n_supported / n_mapped, 9) AS pcs, round(us / av, 9) AS ecr, n_supported, n_partial, n_unsupported, n_not_verifiable, n_mapped
FROM a LEFT JOIN m ON a.nation = m.nation LEFT JOIN k ON a.nation = k.nation""",
    "paths_2hop": f"""{_BASE}, t AS (SELECT * FROM tri WHERE relation_en IN ('supplied_by', 'located_in'))
SELECT head_id AS start, tail_id AS "end", 1::BIGINT AS n_hops, head_id || '>' || tail_id AS nodes, relation_en AS relations, triple_id AS triple_ids FROM t WHERE head_type = 'Part'
UNION ALL SELECT a.head_id, b.tail_id, 2, a.head_id || '>' || a.tail_id || '>' || b.tail_id, a.relation_en || '>' || b.relation_en, a.triple_id || '>' || b.triple_id FROM t a JOIN t b ON a.tail_id = b.head_id WHERE a.head_type = 'Part'""",
    "path_rank": f"""{_BASE}, h1 AS (SELECT p.id AS start, tail_id AS "end", 1::BIGINT AS n_hops, p.id || '>' || tail_id AS nodes, triple_id AS ids FROM (SELECT id FROM ent WHERE entity_type = 'Part') p JOIN tri ON head_id = p.id),
h2 AS (SELECT start, tail_id AS "end", 2::BIGINT AS n_hops, nodes || '>' || tail_id AS nodes, ids || '/' || triple_id AS ids FROM h1 JOIN tri ON head_id = h1."end" WHERE NOT list_contains(string_split(nodes, '>'), tail_id)),
h3 AS (SELECT start, tail_id AS "end", 3::BIGINT AS n_hops, nodes || '>' || tail_id AS nodes, ids || '/' || triple_id AS ids FROM h2 JOIN tri ON head_id = h2."end" WHERE NOT list_contains(string_split(nodes, '>'), tail_id))
SELECT start, "end", n_hops, replace(ids, '/', '>') AS triple_ids, round(CAST(1 AS DOUBLE) / n_hops, 9) AS retrieval_score, row_number() OVER (PARTITION BY start ORDER BY n_hops, ids) AS path_rank FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)""",
    "evidence_paths_topk": f"""{_BASE}, cost AS (SELECT *, CAST(CASE relation_en WHEN 'supplied_by' THEN 20 + ord % 11 WHEN 'has_brand' THEN 10 WHEN 'has_type' THEN 12 ELSE 5 + ord % 3 END AS BIGINT) AS more, CASE WHEN evidence_text <> '' THEN 0 WHEN relation_en = 'supplied_by' THEN 2 ELSE 1 END AS bad FROM tri),
{_PATHS.format("more AS cost, bad AS worst", "cost + more AS cost, greatest(worst, bad) AS worst", "cost")}, r AS (SELECT *, row_number() OVER (PARTITION BY start, "end" ORDER BY cost, n_hops, ids) AS path_rank FROM h)
SELECT start, "end", path_rank, cost, n_hops, nodes, replace(ids, '/', '>') AS triple_ids, (['support', 'background', 'missing'])[worst + 1] AS support_type FROM r WHERE path_rank <= 2""",
    "claims_by_path": _CUSTOMER_CLAIMS + "SELECT part, supplier, nation, tail, mapped, consistent FROM c",
    "pcs_by_path": _CUSTOMER_CLAIMS + """, e AS (SELECT l_partkey AS part, l_suppkey AS supplier, s_nationkey AS nation FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag <> 'R'),
s AS (SELECT *, EXISTS (SELECT 1 FROM e WHERE e.part = c.part AND e.supplier = c.supplier) AS pair, EXISTS (SELECT 1 FROM e WHERE e.part = c.part AND e.nation = c.nation) AS near, EXISTS (SELECT 1 FROM e WHERE e.part = c.part) AS head FROM c)
SELECT nation, count(*) FILTER (pair) AS n_supported, count(*) FILTER (NOT pair AND NOT near AND head) AS n_unsupported, count(*) FILTER (mapped) AS n_mapped, count(*) FILTER (consistent) AS n_consistent, round(count(*) FILTER (consistent) / nullif(count(*) FILTER (mapped), 0), 9) AS pcs FROM s GROUP BY nation""",
    "anchor_spans": f"{_RECURSIVE}{_OBS}, said AS (SELECT query_id, observation AS t FROM obs), {_ANCHORS} SELECT * FROM span",
    "anchor_rules": f"""{_RECURSIVE}, said AS (SELECT 'PRT_' || p_partkey AS query_id, CASE p_partkey % 3 WHEN 0 THEN 'See ' || p_brand || ' by its label brand no. ' || {_PB} WHEN 1 THEN 'Size no. ' || p_size || ' of Brand no. ' || {_PB} || '9' ELSE p_type || ', see no. ' || p_size END AS t FROM part), {_ANCHORS},
rule AS (SELECT query_id, t, regexp_extract(t, '[Bb]rand no[.] [0-9]+') AS raw_text, 'brand#' || regexp_extract(t, '[Bb]rand no[.] ([0-9]+)', 1) AS name, 'Brand' AS kind, CAST(0.8 AS DOUBLE) AS confidence FROM said UNION ALL SELECT query_id, t, regexp_extract(t, '([Ss]ee|[Ss]ize) no[.] [0-9]+'), 'size ' || regexp_extract(t, '([Ss]ee|[Ss]ize) no[.] ([0-9]+)', 2), 'Part', CAST(0.6 AS DOUBLE) FROM said)
SELECT * FROM span UNION ALL SELECT query_id, strpos(t, raw_text) - 1, raw_text, coalesce(e.kind, kind), e.id, 'rule', confidence, coalesce(n_entities, 0) FROM rule LEFT JOIN known ON known.name = rule.name WHERE raw_text <> ''""",
    "log_rows": f"""{_BASE}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord, triple_id) AS item, CASE WHEN CAST(substr(query_id, 5) AS BIGINT) % 5 = 0 THEN 'goes with' ELSE relation_cn END AS rel FROM item)
SELECT query_id AS case_id, query_id AS section, 1::BIGINT AS item, '候选' AS field, query_id AS value FROM (SELECT DISTINCT query_id FROM c) UNION ALL SELECT query_id, '支持证据', item, '证据路径', head_cn || ' — ' || rel || ' — ' || tail_cn FROM c
UNION ALL SELECT query_id, '支持证据', item, 'evidence_text', coalesce(nullif(evidence_text, ''), '{_NOT_STATED}') FROM c""",
    "log_metrics": f"""{_BASE}, c AS (SELECT DISTINCT query_id, CAST(substr(query_id, 5) AS BIGINT) % 5 = 0 AS other, {_PATH} AS path FROM item) SELECT query_id AS case_id, CASE WHEN any_value(other) THEN count(DISTINCT replace(replace(replace(path, ' — has brand — ', ' — x — '), ' — has type — ', ' — x — '), ' — supplied by — ', ' — x — ')) ELSE count(*) END AS n_paths, count(*) FILTER (NOT other) AS n_known FROM c GROUP BY query_id""",
    "analysis_run": f"""{_RECURSIVE}{_OBS}, said AS (SELECT query_id, observation AS t FROM obs), {_ANCHORS},
a AS (SELECT DISTINCT query_id, entity_id FROM span),
c AS (SELECT query_id, candidate, count(*) AS score FROM (SELECT query_id, entity_id, head_id AS candidate FROM a JOIN tri ON tail_id = entity_id WHERE head_type = 'Part' UNION SELECT query_id, entity_id, entity_id FROM a WHERE starts_with(entity_id, 'PRT_')) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate) AS r FROM c),
chosen AS (SELECT query_id, min(candidate) FILTER (r = 1) AS candidate, max(score) AS score, count(*) AS n_candidates FROM k WHERE r <= 3 GROUP BY query_id),
m AS (SELECT query_id, count(*) AS n_items, count(*) FILTER (evidence_text <> '') AS n_supported FROM k JOIN tri ON head_id = candidate WHERE r <= 3 GROUP BY query_id)
SELECT n.query_id, n_anchors, candidate, coalesce(score, 0) AS score, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_items, 0) AS n_items, coalesce(n_supported, 0) AS n_supported
FROM (SELECT query_id, count(*) AS n_anchors FROM span GROUP BY query_id) n LEFT JOIN chosen ON chosen.query_id = n.query_id LEFT JOIN m ON m.query_id = n.query_id""",
    "report_lineage": """WITH RECURSIVE n AS (SELECT o_custkey, o_orderkey AS id, row_number() OVER w AS nth, lag(o_orderkey) OVER w AS before, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
v AS (SELECT id, CASE WHEN nth = 1 THEN NULL WHEN nth % 4 = 0 THEN first ELSE before END AS up, nth + CASE WHEN nth > 3 THEN 1 ELSE 0 END AS version_no FROM n),
r(id, root, depth) AS (SELECT id, id, CAST(0 AS BIGINT) FROM v WHERE up IS NULL UNION ALL SELECT v.id, r.root, r.depth + 1 FROM r JOIN v ON v.up = r.id),
k AS (SELECT up, count(*) AS n FROM v WHERE up IS NOT NULL GROUP BY up),
x AS (SELECT r.*, version_no, coalesce(k.n, 0) AS kids FROM r JOIN v ON v.id = r.id LEFT JOIN k ON k.up = r.id),
f AS (SELECT root, count(*) AS n_versions, count(*) FILTER (kids > 1) AS n_forks, max(version_no) - min(version_no) + 1 - count(DISTINCT version_no) AS n_gaps, arg_max(id, (version_no, id)) FILTER (kids = 0) AS current FROM x GROUP BY root)
SELECT x.id, x.root, x.depth, kids = 0 AS is_leaf, current, current = x.id AS is_current, n_versions, n_forks, n_gaps, false AS orphan, false AS cyclic FROM x JOIN f ON f.root = x.root""",
    "subgraph_edges": f"""{_BASE}, h AS (SELECT head_id AS start, tail_id, triple_id, 1::BIGINT AS n FROM tri WHERE head_type = 'Part'), g AS (SELECT start, triple_id, n FROM h UNION ALL SELECT h.start, t.triple_id, 2 FROM h JOIN tri t ON t.head_id = h.tail_id)
SELECT start, triple_id, min(n) AS n_hops FROM g GROUP BY ALL""",
    "status_cube": f"""{_BASE} SELECT head_type, relation_en, source_type, count(*) AS n, count(DISTINCT head_id) AS n_heads, count(*) FILTER (evidence_text <> '') AS n_with_text, CAST(grouping_id(head_type, relation_en, source_type) AS BIGINT) AS level FROM att GROUP BY CUBE (head_type, relation_en, source_type)""",
    "shape_violations": f"""{_BASE}, n AS (SELECT relation_en, count(*) AS n FROM tri GROUP BY 1),
h AS (SELECT relation_en, head_type FROM tri JOIN n USING (relation_en) GROUP BY ALL HAVING count(*) >= 0.1 * max(n)), t AS (SELECT relation_en, tail_type FROM tri JOIN n USING (relation_en) GROUP BY ALL HAVING count(*) >= 0.1 * max(n)),
d AS (SELECT relation_en, head_id, count(DISTINCT tail_id) AS tails FROM tri GROUP BY ALL), f AS (SELECT relation_en FROM d GROUP BY 1 HAVING count(*) FILTER (tails = 1) >= 0.99 * count(*))
SELECT triple_id, 'domain' AS violation FROM tri WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.relation_en = tri.relation_en AND h.head_type = tri.head_type) UNION ALL SELECT triple_id, 'range' FROM tri WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.relation_en = tri.relation_en AND t.tail_type = tri.tail_type)
UNION ALL SELECT triple_id, 'cardinality' FROM tri JOIN d USING (relation_en, head_id) WHERE tails > 1 AND relation_en IN (SELECT relation_en FROM f)""",
    "version_diff": f"""{_BASE}, x AS (SELECT *, CASE WHEN head_type = 'Part' THEN CAST(substr(head_id, 5) AS BIGINT) END AS number FROM tri)
SELECT triple_id, 'removed' AS change, '' AS columns FROM x WHERE number % 97 = 0 UNION ALL SELECT 'X' || triple_id, 'added', '' FROM x WHERE number % 83 = 0 AND relation_en = 'has_type'
UNION ALL SELECT triple_id, 'changed', CASE WHEN number % 178 = 0 THEN 'evidence_text,note' ELSE 'evidence_text' END FROM x WHERE number % 89 = 0 AND number % 97 <> 0""",
    "graph_checksum": f"{_BASE} SELECT count(*) AS n, sum(CAST('0x' || substr(md5({_ROW}), 1, 15) AS BIGINT)) || '-' || sum(CAST('0x' || substr(md5({_ROW}), 16, 15) AS BIGINT)) AS checksum FROM tri",
    "current_version": "WITH v AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_no, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey, version_no, version_no = n AS is_current, version_no - 1 AS previous FROM v",
    "timeline_lag": "SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, coalesce(CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) AS BIGINT), -1) AS gap_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "experiment_summary": "SELECT source, lang, count(*) AS n, round(avg(quality), 9) AS quality, round(avg(toxic), 9) AS toxic, CAST(sum(n_chars) AS BIGINT) AS chars FROM labels JOIN documents USING (doc_id) GROUP BY ALL",
}
