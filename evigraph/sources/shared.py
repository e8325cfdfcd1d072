"""Tables that a query writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a task where dealt() sets the number of tasks.
TASK_ROWS = 1 << 18
#: Rows up to which a table is sent to all tasks by sent().
SENT_ROWS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is named, a temporary folder will do in local mode, as
    in tests; on a cluster it would be another disk on each machine, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="evigraph-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/evigraph/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table: its lineage ends there, and a lost executor costs no recomputation before it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of about so many rows, dealt by keys. Where these are more than a task of TASK_ROWS for each core, the tasks' number grows
    with them: Spark merges partitions by compressed bytes, and of keys and flags a task would get millions of rows to sort and hash."""
    n = -(-rows // TASK_ROWS)
    if n <= df.sparkSession.sparkContext.defaultParallelism:
        return df.repartition(*keys)
    return df.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def sent(df: DataFrame) -> DataFrame:
    """df, sent to all tasks by the join that it goes into where it has few rows, so that the other side stays where it lies."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() whose readers have been written themselves."""
    for t in tables:
        delete(t.sparkSession, t.written_to)
