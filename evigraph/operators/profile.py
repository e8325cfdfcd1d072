"""What a graph's types and relations mean to the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import CLAUSE_SEPARATOR

# Relations with their section titles, and the order of sections in a rendered context.
SECTIONS = (
    ("has_manifestation", "主要皮损表现"),
    ("commonly_occurs_at", "常见部位"),
    ("has_symptom", "伴随症状"),
    ("recommended_examination", "建议检查"),
    ("differential_diagnosis", "鉴别诊断"),
    ("has_risk_warning", "风险提示"),
    ("has_medical_advice", "就医建议"),
)
ORDER = ("候选疾病", *[title for _, title in SECTIONS], "证据来源")


@dataclass(frozen=True)
class Profile:
    """head_type: of entities that evidence is about; feature_type: of those that heads are looked up by; sections: (relation,
    title); order: all titles as rendered, that of the head first and that of the sources last."""

    head_type: str = "Disease"
    feature_type: str = "LesionFeature"
    sections: tuple[tuple[str, str], ...] = SECTIONS
    order: tuple[str, ...] = ORDER
    supporting: tuple[str, ...] = ("主要皮损表现", "常见部位", "伴随症状")
    differential: str = "鉴别诊断"
    risk: str = "风险提示"
    advice: tuple[str, ...] = ("建议检查", "就医建议")
    clause_separator: str = CLAUSE_SEPARATOR

    def section_table(self, spark: SparkSession) -> DataFrame:
        """(relation_en, section, section_ord): a fixed table of a few rows."""
        at = {title: i for i, title in enumerate(self.order)}
        return spark.createDataFrame([(r, t, at[t]) for r, t in self.sections], "relation_en string, section string, section_ord int")
