"""Prompt texts from evidence contexts.

A prompt has four parts: what is asked, the inputs, the evidence, and the headings to answer under. What the answer has to keep
to is said in prose, in our own words; only what others look for or parse is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_none_of, numbered, strip

# The safety rules, the phrase whose absence calls for them, the version names, the heading that evidence stands
# under, the phrase for lacking evidence, the headings of an answer and the three fields that trace an item to its evidence.
SAFETY = (
    "仅用于辅助决策，不替代医生诊断。",
    "不得把候选疾病表述为确诊。",
    "不得输出处方、药物剂量或具体用药方案。",
    "不得虚构知识图谱之外的证据。",
    "证据不足时必须明确写“给定证据不足”。",
    "不得输出患病概率。",
    "V1.0 不实现图片分类。",
)
MARKER = "不得输出患病概率"
V1, V2 = "doctor_kg_rag_v1", "doctor_kg_rag_v2"
EVIDENCE = "知识图谱证据上下文"
LACKING = "给定证据不足"
CANDIDATE, SUPPORT, DIFFERENTIAL, RISK, ADVICE = "候选疾病", "支持证据", "鉴别诊断", "风险提示", "就医建议"
MATCHED, MISSING, EXAMS, DISCLAIMED = "用户观察与证据匹配", "证据不足说明", "就医/检查建议", "免责声明"
TRACE = ("证据路径", "evidence_text", "source")

_TASK = "# 任务\n请只凭下面的证据，说明观察与候选疾病有什么关系。读者据此了解情况，不据此确诊或用药。"
_GROUNDS = f"每句话都要能在证据里找到出处；证据没有谈到的，写“{LACKING}”，不要用别处的知识去补。不开处方，不谈剂量，不把候选当成结论。"
_TRACED = f"观察要逐条对照证据，每一条都写明它的{'、'.join(TRACE)}；措辞留有余地。"

#: version -> (what an answer keeps to, its headings, those whose every line is an item with its trace)
_FORMS: dict[str | None, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    V1: (_GROUNDS, (CANDIDATE, SUPPORT, DIFFERENTIAL, RISK, ADVICE), ()),
    V2: (_GROUNDS + _TRACED, (CANDIDATE, MATCHED, SUPPORT, DIFFERENTIAL, RISK, ADVICE, MISSING), (MATCHED, SUPPORT, DIFFERENTIAL, RISK, ADVICE)),
    None: ("", (CANDIDATE, MATCHED, SUPPORT, DIFFERENTIAL, RISK, EXAMS, MISSING, DISCLAIMED), ()),
}

#: What version 2 asks of an item below each heading; what traces it is one step further in.
_FIELDS: dict[str, tuple[str, ...]] = {
    CANDIDATE: ("中文名", "英文名", "编号", "怎样措辞"), MATCHED: ("哪条观察", "是否相符", *TRACE), SUPPORT: TRACE,
    DIFFERENTIAL: ("要与什么区分", *TRACE), RISK: ("有什么风险", *TRACE), ADVICE: ("建议做什么", *TRACE), MISSING: ("缺什么", "为何缺"),
}


def _fields() -> str:
    lines = []
    for heading, fields in _FIELDS.items():
        lines.append(f"- {heading}")
        lines += [("    - " if f in TRACE and len(fields) > len(TRACE) else "  - ") + f"{f}：" for f in fields]
    return "\n".join(lines)


def _outline(headings: tuple[str, ...], traced: tuple[str, ...]) -> str:
    """A line a heading; where items are traced it says what a line of them holds."""
    return "\n".join(f"{h}：" + (f"（一行一条：{' | '.join(TRACE)}）" if h in traced else "") for h in headings)


def render(version: str | None, candidate: Column, observation: Column, context: Column) -> Column:
    """The text of a version; an unknown one gets the general form, whose rules are the safety rules.

    Version 2 takes candidate and observation as they are, the others without blanks at both ends; a text of version 2 has no
    blanks at its ends.
    """
    known = version if version in _FORMS else None
    keep, headings, traced = _FORMS[known]
    own = (lambda c: c) if known == V2 else strip
    inputs = F.concat(F.lit("# 输入\n- 候选疾病："), own(candidate), F.lit("\n- 用户观察："), own(observation))
    rules = F.lit(f"# 要求\n{keep}") if keep else F.concat(F.lit("# 要求\n"), numbered(F.array(*[F.lit(x) for x in SAFETY])))
    text = F.concat_ws("\n\n", F.lit(_TASK), inputs, F.concat(F.lit(f"# {EVIDENCE}\n"), context), rules, F.lit(f"# 回答的栏目，不增不减\n{_outline(headings, traced)}"), *([F.lit(f"# 各栏逐条填写的字段\n{_fields()}")] if known == V2 else []))
    return strip(text) if known == V2 else text


def with_safety(prompt: Column, own_text: Column | None = None, marker: str = MARKER, rules=SAFETY) -> Column:
    """Adds the safety rules to a prompt without the marker phrase.

    own_text, the part of the prompt that the user has no hand in, is what is searched; without it the whole prompt is, so that
    a user's words can hold the rules back.
    """
    listed = numbered(F.array(*[F.lit(x) for x in rules]))
    return F.when(F.contains(prompt if own_text is None else own_text, F.lit(marker)), prompt).otherwise(F.concat(prompt, F.lit("\n\n# Safety\n"), listed))


def prompts(queries: DataFrame, contexts: DataFrame, version: str | None = V1) -> DataFrame:
    """(query_id, prompt, outcome) for queries (query_id, candidate, observation). In every version, version 2 included, a null or
    blank input gets no prompt but an outcome, as single questions do."""
    x = queries.join(contexts, "query_id", "left")
    blank = (strip(F.col("candidate")) == "") | (strip(F.col("observation")) == "") | F.col("candidate").isNull() | F.col("observation").isNull()
    own = render(version, F.lit("-"), F.lit("-"), F.coalesce("context", F.lit("")))
    text = with_safety(render(version, F.col("candidate"), F.col("observation"), F.coalesce("context", F.lit(""))), own)
    return x.select("query_id", F.when(~blank, text).alias("prompt"), F.when(blank, "ANALYSIS_INSUFFICIENT_INPUT").otherwise("OK").alias("outcome"))


def check_phrases(texts: DataFrame, phrases: list[str], column: str = "text") -> DataFrame:
    """Rows with clean: whether none of the phrases stands in the text."""
    return texts.withColumn("clean", has_none_of(F.col(column), F.array(*[F.lit(p) for p in phrases])))
