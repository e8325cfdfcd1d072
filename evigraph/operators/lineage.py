"""Versions that name their parents: roots, depths, current leaves, forks, cycles and gaps, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, written


def _ancestors(nodes: DataFrame) -> DataFrame:
    """(id, top, depth, done): the farthest ancestor found, how far it is, and whether it is a root.

    Each round doubles the distance, so a chain of n versions takes log2(n) of them; a round is a join of what is not done yet
    with the table of the round before. Both are written, so Spark can split the join at an ancestor that very many versions
    share. What has gone more steps than there are rows goes round a cycle.
    """
    x = written(nodes.select("id", F.coalesce("up", "id").alias("top"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("up").isNull().alias("done")), "lineage")
    n, reach = x.count(), 1
    while reach <= n and not x.where(~F.col("done")).isEmpty():
        far = x.select(F.col("id").alias("top"), F.col("top").alias("farther"), F.col("depth").alias("more"), F.col("done").alias("at_root"))
        open_ = x.where(~F.col("done")).join(far, "top").select("id", F.col("farther").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), F.col("at_root").alias("done"))
        new = written(x.where("done").unionByName(open_), "lineage")
        discard(x)
        x, reach = new, 2 * reach
    return x


def lineage(versions: DataFrame, id_: str, parent: str, version: str) -> DataFrame:
    """(id, root, depth, is_leaf, current, is_current, n_versions, n_forks, n_gaps, orphan, cyclic) of every version.

    root is the first version of the family and depth the steps to it; current is the family's leaf of the largest version
    number, ties to the larger id. Of the family: how many versions, how many of these have several children, and how many
    numbers between the least and the largest are not there. A parent that is not in the table makes its child a root and an
    orphan. Versions on a cycle, or below one, are cyclic and have no root, depth or family. Of rows that share an id that of the
    largest version number counts, of these that of the largest parent. Rows without id take no part.
    """
    v = versions.select(F.col(id_).alias("id"), F.col(parent).alias("up"), F.col(version).cast("long").alias("version_no")).where(F.col("id").isNotNull())
    v = v.groupBy("id").agg(F.max(F.struct("version_no", "up")).alias("v")).select("id", "v.*")
    v = v.join(v.select(F.col("id").alias("up"), F.lit(True).alias("known")), "up", "left")
    v = written(v.select("id", "version_no", F.when(F.col("known"), F.col("up")).alias("up"), (F.col("up").isNotNull() & F.col("known").isNull()).alias("orphan")), "versions")
    children = v.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    x = v.join(_ancestors(v), "id").join(children, "id", "left")
    x = written(x.select("id", "version_no", "orphan", F.when(F.col("done"), F.col("top")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"), F.coalesce("n_children", F.lit(0)).alias("n_children"), (~F.col("done")).alias("cyclic")), "versions")
    leaf = F.col("n_children") == 0
    last = F.max(F.when(leaf, F.struct("version_no", "id")))
    # of numbers first, so that a very large family is no single task's work
    part = x.where(F.col("root").isNotNull()).groupBy("root", "version_no").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_children") > 1).alias("forks"), last.alias("last"))
    spread = F.coalesce(F.max("version_no") - F.min("version_no") + 1 - F.count("version_no"), F.lit(0))
    family = written(part.groupBy("root").agg(F.sum("n").alias("n_versions"), F.sum("forks").alias("n_forks"), spread.alias("n_gaps"), F.max("last")["id"].alias("current")), "families")
    x = x.join(family, "root", "left")
    return x.select("id", "root", "depth", leaf.alias("is_leaf"), "current", F.coalesce(F.col("current") == F.col("id"), F.lit(False)).alias("is_current"), "n_versions", "n_forks", "n_gaps", "orphan", "cyclic")
