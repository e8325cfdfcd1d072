"""A small invented graph that holds the traps: ambiguous aliases, repeated ids and references, dangling ends, blanks."""

from __future__ import annotations

from evigraph.sources.graph import ENTITY, SOURCE, TRIPLE

ENTITIES = [
    # id, entity_type, name_cn, name_en, alias
    ("H1", "Disease", "甲症", "Alpha", "al; first alias；AX|ax2,共名"),
    ("H2", "Disease", "乙症", "Beta", "be，共名"),
    ("H3", "Disease", "空症", "", ""),
    ("F1", "LesionFeature", "红斑", "Red Patch", "red"),
    ("F2", "LesionFeature", "100%_斑", "Pct", ""),
    ("S1", "AnatomicalSite", "面部", "Face", ""),
    ("F1", "LesionFeature", "红斑二", "Red Patch Two", "red2"),
]
TRIPLES = [
    # triple_id, head_id, head_cn, head_type, relation_cn, relation_en, tail_id, tail_cn, tail_type, source, evidence_text
    ("T1", "H1", "甲症", "Disease", "表现", "has_manifestation", "F1", "红斑", "LesionFeature", "原始", "局部红斑明显"),
    ("T2", "H1", "甲症", "Disease", "部位", "commonly_occurs_at", "S1", "面部", "AnatomicalSite", "原始", ""),
    ("T3", "H1", "甲症", "Disease", "表现", "has_manifestation", "F9", "失踪", "LesionFeature", "原始", "缺失实体"),
    ("T4", "H1", "甲症", "Disease", "别的", "unknown_relation", "F2", "100%_斑", "LesionFeature", "原始", "x"),
    ("T5", "H2", "乙症", "Disease", "表现", "has_manifestation", "F1", "红斑", "LesionFeature", "原始", "亦见红斑"),
    ("T6", "H1", "甲症", "Disease", "鉴别", "differential_diagnosis", "H2", "乙症", "Disease", "原始", "需鉴别"),
    ("T7", "H2", "乙症", "Disease", "鉴别", "differential_diagnosis", "H1", "甲症", "Disease", "原始", ""),
]
SOURCES = [
    ("R1", "指南", "Guideline", "T1, T2,T5"),
    ("R2", "", "Website", "T2 ，T3"),
    ("R3", "网站", "", "T4"),
]


def _csv(head, rows, width) -> str:
    quote = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') else v
    return "\r\n".join(",".join(map(quote, [*r, *[""] * (width - len(r))])) for r in [head, *rows]) + "\r\n"


def write(folder, encoding: str = "utf-8-sig") -> str:
    folder.mkdir(parents=True, exist_ok=True)
    blank = [("", "", "", "", "")]
    (folder / "entity_nodes.csv").write_text(_csv(ENTITY, ENTITIES + blank, 7), encoding=encoding, newline="")
    (folder / "triples.csv").write_text(_csv(TRIPLE, TRIPLES, 12), encoding=encoding, newline="")
    (folder / "source_references.csv").write_text(_csv([*SOURCE, ""], SOURCES, 5), encoding=encoding, newline="")
    return str(folder)
