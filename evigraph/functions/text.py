"""Text expressions: normalising, list fields, rendering and predicates. All stay in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All code points that count as blank.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Separators of a list field; the clause separator and the least length of a clause; placeholders; advice words
# from the most to the least urgent class.
LIST_SEPARATORS = "[;；，|,]"
CLAUSE_SEPARATOR = "，"
CLAUSE_CHARS = 4
NOT_STATED = "未标注"
SOURCE_NOT_STATED = "未标注来源"
NO_EVIDENCE_LINE = "- 暂无相关证据。"
NO_RESULT = "未查询到相关结果。"
NONE_SELECTED = "未选择候选疾病"
ADVICE_URGENT = "出血|破溃|快速|恶性|活检|进一步评估|尽快"
ADVICE_CONSULT = "皮肤科|检查|评估|诊断不明确"
ADVICE = ("建议尽快就医评估", "建议预约皮肤科评估", "需常规关注")


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends, not only U+0020."""
    return F.btrim(c, F.lit(BLANKS))


def norm(c: Column) -> Column:
    return F.lower(strip(c))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def or_else(c: Column, other: Column) -> Column:
    """An empty string counts as missing."""
    return F.coalesce(blank_to_null(c), other)


def split_list(c: Column, separators: str = LIST_SEPARATORS) -> Column:
    """The non-blank items of a delimited list."""
    return F.filter(F.transform(F.split(c, separators), strip), lambda x: x != "")


def first_item(c: Column) -> Column:
    return F.coalesce(F.get(split_list(c), F.lit(0)), F.lit(""))


def path(head: Column, relation: Column, tail: Column, arrow: str = " — ") -> Column:
    return F.concat_ws(arrow, head, relation, tail)


def source_label(name: Column, id_: Column, type_: Column) -> Column:
    """`name (id, type)` without its blank parts; a placeholder if all are blank."""
    extras = F.concat_ws(", ", blank_to_null(id_), blank_to_null(type_))
    both = F.when((name != "") & (extras != ""), F.concat(name, F.lit(" ("), extras, F.lit(")")))
    return F.coalesce(both, blank_to_null(name), blank_to_null(extras), F.lit(NOT_STATED))


def source_label_screen(name: Column, id_: Column, type_: Column) -> Column:
    """The label as screens show it: full-width marks, and the placeholder stands for a blank name only."""
    extras = F.concat_ws("，", blank_to_null(id_), blank_to_null(type_))
    shown = or_else(name, F.lit(SOURCE_NOT_STATED))
    return F.when(extras != "", F.concat(shown, F.lit("（"), extras, F.lit("）"))).otherwise(shown)


def source_line(name: Column, id_: Column, type_: Column) -> Column:
    """A line of the source summary; blank parts leave their commas."""
    return F.concat(F.lit("- "), name, F.lit(" ("), id_, F.lit(", "), type_, F.lit(")"))


def source_plain(source: Column, id_: Column, type_: Column) -> Column:
    """The label as the plain listing prints it: blank parts are kept once either is there."""
    return F.when((id_ != "") | (type_ != ""), strip(F.concat(source, F.lit(" ("), id_, F.lit(", "), type_, F.lit(")")))).otherwise(source)


def text_or_placeholder(c: Column) -> Column:
    return or_else(c, F.lit(NOT_STATED))


def head_label(name: Column, name_alt: Column, label: Column) -> Column:
    extras = F.concat_ws(" / ", blank_to_null(name_alt), blank_to_null(label))
    return F.when(name.isNull(), F.lit(NONE_SELECTED)).when(extras != "", F.concat(name, F.lit("（"), extras, F.lit("）"))).otherwise(name)


def clauses(observation: Column, separator: str = CLAUSE_SEPARATOR, least: int = CLAUSE_CHARS) -> Column:
    """Lower-cased clauses of at least `least` code points, untrimmed."""
    return F.filter(F.split(F.lower(observation), separator), lambda x: F.char_length(x) >= least)


def observed(observation_low: Column, parts: Column, tail_low: Column, evidence_low: Column) -> Column:
    """Whether an observation speaks of a piece of evidence. All arguments are lower-cased once, before any join.

    The tail's name stands in the observation, or a clause of it stands in the evidence text; both are literal.
    """
    named = (tail_low != "") & F.contains(observation_low, tail_low)
    return named | ((evidence_low != "") & F.exists(parts, lambda p: F.contains(evidence_low, p)))


def advice_level(text: Column, urgent: str = ADVICE_URGENT, consult: str = ADVICE_CONSULT, levels: tuple[str, str, str] = ADVICE) -> Column:
    return F.when(text.rlike(urgent), F.lit(levels[0])).when(text.rlike(consult), F.lit(levels[1])).otherwise(F.lit(levels[2]))


def numbered(items: Column) -> Column:
    """`1. first` and so on, a line each."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def item_block(item_path: Column, text: Column, source: Column) -> Column:
    """Three lines of a piece of evidence in a rendered section."""
    return F.concat(F.lit("- 证据路径："), item_path, F.lit("\n  evidence_text："), text_or_placeholder(text), F.lit("\n  source："), source)


def section_block(title: Column, lines: Column) -> Column:
    return F.concat(F.lit("## "), title, F.lit("\n"), F.coalesce(blank_to_null(lines), F.lit(NO_EVIDENCE_LINE)))


def has_none_of(text: Column, phrases: Column) -> Column:
    """Whether a text is free of all given phrases."""
    return ~F.exists(phrases, lambda p: F.contains(text, p))


def url_part(c: Column) -> Column:
    """A text as part of a URL: all but letters, digits and `- _ . ! ~ * ' ( )` percent-encoded."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def request_id() -> Column:
    return F.concat(F.lit("req_"), F.replace(F.uuid(), F.lit("-"), F.lit("")))
