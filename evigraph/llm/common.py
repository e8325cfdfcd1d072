"""What the corpus operators share: tables, the shared folder, hashing and vector columns."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, new_path

#: Code points that `[\x20\x09-\x0D]` names.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor costs no recomputation before it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if (made := _made.get()) is not None:
        made.append(path)
    return out


def in_few_files(df: DataFrame) -> DataFrame:
    """For tables of a few numbers a document, a hundredth of the documents' bytes: an eighth of the shuffle partitions."""
    return df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


#: Paths of the tables that written() has made within the innermost spent() of this thread, and discard() has not deleted.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() whose readers have been written themselves."""
    for t in tables:
        delete(t.sparkSession, t.written_to)
        if (made := _made.get()) is not None and t.written_to in made:
            made.remove(t.written_to)


@contextmanager
def spent(spark: SparkSession, *too: DataFrame) -> Iterator[list[DataFrame]]:
    """Deletes at the end the tables that written() made within, and those of `too`, but for what is put into the list given. Other
    threads' tables, and those made before or outside, are left alone; what is kept belongs to the block around this one."""
    made: list[str] = []
    outer, result = _made.get(), []
    token = _made.set(made)
    try:
        yield result
    finally:
        _made.reset(token)
    kept = {x.written_to for x in result}
    for path in [*made, *[p for x in too if (p := getattr(x, "written_to", None))]]:
        if path not in kept:
            delete(spark, path)
            if outer is not None and path in outer:
                outer.remove(path)
    if outer is not None:
        outer += [p for p in made if p in kept]


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches whose rows of one group follow each other, with the groups' first rows and the end.

    keys are columns of integers without nulls. Only a group that goes on in the next batch is held back.
    """
    held: pa.Table | None = None
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        now = held if batch is None else pa.Table.from_batches([batch])
        if batch is not None and held is not None:
            now = pa.concat_tables([held, now])
        if now is None:
            return
        at = [now.column(k).to_numpy() for k in keys]
        edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in at])) + 1
        if batch is None:
            yield now, np.concatenate([[0], edges, [now.num_rows]])
        elif len(edges):
            yield now.slice(0, int(edges[-1])), np.concatenate([[0], edges])
            held = now.slice(int(edges[-1]))
        else:
            held = now


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() is exact, and much faster, where all is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def strip_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def row_key(*cols: str) -> Column:
    """Tells rows that share an id, or have none, apart by their content."""
    return F.xxhash64(*[F.col(c).isNull() for c in cols], *cols)


def clean_vector(c: str) -> Column:
    """The vector as doubles, or null where it is null, empty or holds a null or non-finite component."""
    v = F.col(c).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull() & (F.size(v) > 0) & ~bad, v)


def spare(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name
