"""The corpus pipeline: documents through five operators of evigraph.llm.

Every stage takes nulls in any column, empty and very long texts, repeated rows and ids, an empty table, and further columns of
any names, which it hands on; what becomes of such rows is said at each stage.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns documents again; the last
returns their tokens. Stages are written and reread, so a lost executor never costs more than its own stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import bpe, line_dedup, mixing, near_dedup, quality
from evigraph.llm.common import spent, table, written
from evigraph.llm.queries import QUALITY_CUT, held_out, token_digests


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labels that op2_quality learns from. A text that is
    null or empty scores the labels' mean, so it stays where that reaches the cut; without any label every score is 0.5."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return quality.keep_good(docs, model, QUALITY_CUT)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that five or more of them share; n_chars is that of the new text. No row goes; a null text
    becomes an empty one, and so does one that loses all its lines."""
    x = line_dedup.marked(docs).select(*docs.columns)
    return x.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in x.columns else x


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike by 0.8 or more. Rows of one id are one document; rows
    without id, and texts without words, are in no group and stay."""
    return near_dedup.without_near_duplicates(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as it uses them, none more than twice. A null source is a source of its own, a
    text without words takes nothing from its target, and rows that repeat an id and a text go in or stay out together."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts, a row for each row; a null text counts as empty."""
    return token_digests(bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [("quality classifier", good), ("line dedup", fresh_lines), ("near-dedup", distinct_documents), ("source mix", mixed), ("byte-level BPE", tokens)]

#: The classifier, the hash order of the mix and the merges of the tokenizer have no SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with spent(spark, docs) as result:  # a stage's own tables, and what it has read, go once it is written
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            result.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
