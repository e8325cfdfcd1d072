"""The evidence graph as tables, and its loaders and sinks.

All attributes are strings without nulls; `ord` carries the order of the input, which results keep.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_list, strip

# The files of a graph and their columns.
FILES = {"entities": "entity_nodes.csv", "triples": "triples.csv", "sources": "source_references.csv"}
ENTITY = ("id", "entity_type", "name_cn", "name_en", "alias", "source", "note")
TRIPLE = ("triple_id", "head_id", "head_cn", "head_type", "relation_cn", "relation_en", "tail_id", "tail_cn", "tail_type", "source", "evidence_text", "note")
SOURCE = ("source_id", "source_name", "source_type", "used_for_triples")


class EvidenceError(Exception):
    """An outcome that a caller has to tell apart by its code."""

    def __init__(self, code: str, message: str, status: int = 400):
        super().__init__(message)
        self.code, self.message, self.status = code, message, status


@dataclass(frozen=True)
class EvidenceGraph:
    """entities, triples and sources; refs (triple_id, source_id, ord) says which source speaks for which triple.

    Where a triple's references are at hand, referred has the triples with refs, a list of (source_id, ord): then a triple's source
    is known in place, and nothing is joined by triple. Where it is known which entities triples lead to, tails has these only.
    """

    entities: DataFrame
    triples: DataFrame
    sources: DataFrame
    refs: DataFrame
    where: str = ""
    referred: DataFrame | None = None
    tails: DataFrame | None = None

    def cached(self) -> EvidenceGraph:
        """For a session that asks many questions of a graph that fits its memory."""
        return replace(self, **{k: getattr(self, k).cache() for k in ("entities", "triples", "sources", "refs")}, referred=None, tails=None)

    def views(self) -> None:
        """Registers the tables for spark.sql."""
        for k in ("entities", "triples", "sources", "refs"):
            getattr(self, k).createOrReplaceTempView(f"graph_{k}")


def explode_refs(sources: DataFrame) -> DataFrame:
    """(triple_id, source_id, ord): a row for each triple that a source's list names."""
    return sources.select(F.explode(split_list(F.col("used_for_triples"))).alias("triple_id"), "source_id", "ord")


def clean(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Trims headers and values, turns nulls into empty strings, drops rows without any value and unnamed columns."""
    by = {c.strip().lstrip("﻿"): c for c in df.columns}
    cols = [F.coalesce(strip(F.col(f"`{by[c]}`").cast("string")), F.lit("")).alias(c) if c in by else F.lit("").alias(c) for c in columns]
    out = df.select(*cols, *([F.col("ord")] if "ord" in df.columns else []))
    return out.where(F.concat(*[F.col(c) for c in columns]) != "")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def is_utf8(spark: SparkSession, path: str) -> bool:
    """A file's bytes are looked at before it is read: Spark would replace bad ones without a word."""
    return spark.read.format("binaryFile").load(path).select(F.is_valid_utf8(F.col("content").cast("string")).alias("ok")).first()["ok"]


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...], encoding: str | None = None) -> DataFrame:
    """A CSV file with a header and quoted fields, in its order. Files that are not UTF-8 are read as GB18030.

    The file is one task's work, as a quoted field may hold a line end; graphs that outgrow that are kept as Parquet.
    """
    if encoding is None:
        encoding = "UTF-8" if is_utf8(spark, path) else "GB18030"
    if encoding != "UTF-8":
        path = _as_utf8(spark, path, encoding)
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    return clean(raw.withColumn("ord", F.monotonically_increasing_id()), columns)


def _as_utf8(spark: SparkSession, path: str, encoding: str) -> str:
    """A copy of a file in UTF-8, in the shared folder; bytes that the encoding doesn't have are an error. Only while it is
    written is Spark set to take other charsets than its own."""
    name, old = "spark.sql.legacy.javaCharsets", spark.conf.get("spark.sql.legacy.javaCharsets", "false")
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="evigraph-")
    out = f"{folder.rstrip('/')}/evigraph/utf8-{uuid.uuid4().hex}"
    spark.conf.set(name, "true")
    try:
        bytes_, text = F.col("content"), F.decode("content", encoding)
        x = spark.read.format("binaryFile").load(path).select(text.alias("text"), (F.encode(text, encoding) == bytes_).alias("same"))
        x.select(F.when(F.col("same"), F.col("text")).otherwise(F.raise_error(F.lit(f"neither UTF-8 nor {encoding}: {path}")))).write.text(out)
    finally:
        spark.conf.set(name, old)
    return out


def graph_dir(given: str | None = None, root: str | None = None) -> str:
    """Where the graph lies: as given, or as KG_CSV_DIR says; relative to root, or to the working directory."""
    path = given or os.environ.get("KG_CSV_DIR") or "kg/csv"
    return path if "://" in path or Path(path).is_absolute() else str(Path(root or os.getcwd()) / path)


def load_csv(spark: SparkSession, folder: str | None = None, root: str | None = None) -> EvidenceGraph:
    """The graph of a folder's three files; names every missing one if any is."""
    folder = graph_dir(folder, root)
    missing = [f for f in FILES.values() if not _exists(spark, f"{folder}/{f}")]
    if missing:
        raise EvidenceError("KG_FILE_NOT_FOUND", f"missing in {folder}: {', '.join(missing)}", 500)
    try:
        e, t, s = (read_csv(spark, f"{folder}/{FILES[k]}", c) for k, c in (("entities", ENTITY), ("triples", TRIPLE), ("sources", SOURCE)))
    except Exception as error:
        raise EvidenceError("KG_LOAD_FAILED", str(error).splitlines()[0], 500) from error
    return EvidenceGraph(e, t, s, explode_refs(s), folder)


def save_parquet(graph: EvidenceGraph, folder: str) -> None:
    """Triples are laid out by relation, so that a filter on it reads only its part."""
    graph.entities.write.mode("overwrite").parquet(f"{folder}/entities")
    graph.triples.write.mode("overwrite").partitionBy("relation_en").parquet(f"{folder}/triples")
    graph.sources.write.mode("overwrite").parquet(f"{folder}/sources")
    graph.refs.write.mode("overwrite").parquet(f"{folder}/refs")


def load_parquet(spark: SparkSession, folder: str) -> EvidenceGraph:
    e, t, s, r = (spark.read.parquet(f"{folder}/{k}") for k in ("entities", "triples", "sources", "refs"))
    return EvidenceGraph(e, t.select(*TRIPLE, "ord"), s, r, folder)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def export(df: DataFrame, path: str, kind: str = "json") -> None:
    """Results as files of JSON lines, or of CSV with a header and all strings quoted."""
    w = df.write.mode("overwrite")
    w.json(path) if kind == "json" else w.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_results(spark: SparkSession, table: str, logs: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """A CSV of case results with the texts of the logs, one row a file."""
    rows = spark.read.csv(table, header=True, multiLine=True, quote='"', escape='"')
    texts = spark.read.text(logs, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value") if logs else None
    return rows, texts
