from __future__ import annotations

from evigraph.sources.logs import cited_paths, log_items

LOG = """# Case 9：甲症

## 输入信息

候选疾病：甲症

## 输出

候选疾病：

* 中文名称：甲症
* 结论表述：可能：不确定

匹配：

* 观察 1：红

  * 证据路径：甲症 — 表现 — 红斑
  * source：

* 观察 2：面部

  * 证据路径：甲症 — 部位 — 面部

支持证据：
1.

* 证据路径：甲症 — 表现 — 红斑
* evidence_text：局部：明显

2. - 证据路径：甲症 — 表现 — 没有
   - evidence_text：无

没有冒号的一行而且它很长很长很长很长很长很长很长很长：还是一行
"""


def test_logs_become_sections_items_and_fields(spark):
    d = spark.createDataFrame([("c9", LOG.replace("\n", "\r\n")), ("c1", None), ("c2", ""), ("c3", "x：y")], "case_id string, text string")
    got = [tuple(r)[:5] for r in log_items(d).orderBy("case_id", "line").collect()]
    assert got == [
        ("c3", "", 1, "x", "y"),
        ("c9", "输入信息", 1, "候选疾病", "甲症"),
        ("c9", "候选疾病", 1, "中文名称", "甲症"), ("c9", "候选疾病", 1, "结论表述", "可能：不确定"),
        ("c9", "匹配", 1, "观察", "红"), ("c9", "匹配", 1, "证据路径", "甲症 — 表现 — 红斑"), ("c9", "匹配", 1, "source", ""),
        ("c9", "匹配", 2, "观察", "面部"), ("c9", "匹配", 2, "证据路径", "甲症 — 部位 — 面部"),
        ("c9", "支持证据", 1, "证据路径", "甲症 — 表现 — 红斑"), ("c9", "支持证据", 1, "evidence_text", "局部：明显"),
        ("c9", "支持证据", 2, "证据路径", "甲症 — 表现 — 没有"), ("c9", "支持证据", 2, "evidence_text", "无"),
        ("c9", "支持证据", 2, "", "没有冒号的一行而且它很长很长很长很长很长很长很长很长：还是一行"),
    ]
    t = spark.createDataFrame([("甲症", "表现", "红斑"), ("甲症", "部位", "面部")], "head_cn string, relation_cn string, tail_cn string")
    assert [tuple(r) for r in cited_paths(log_items(d), t).collect()] == [("c9", 3, 2)]
