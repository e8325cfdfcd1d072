"""Result logs: headed texts of answers, as rows of sections, items and fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What may stand before a field: a number, a bullet, or both.
_LEAD = r"^(?:[0-9]+[.、]\s*)?(?:[*-]\s+)?"
_BLANKS = " \t\n\x0b\f\r　"


def log_items(logs: DataFrame, case: str = "case_id", text: str = "text") -> DataFrame:
    """(case_id, section, item, field, value, line) of every line of a log that says something.

    A line of # and a title, or of words and a colon at its end, begins a section. Other lines are fields: before the first colon
    the name, if it is no more than 20 characters, without a number at its end, after it the value; without such a colon there is
    no name. A number or a bullet before a field is dropped. A section's items begin where its first field comes again, so they
    are counted from 1 whether they are numbered, bulleted or neither; lines before the first section are of section ''. line
    counts from 1. Nulls and empty texts have no rows; rows of one case are taken for one log each, in no order between them.
    """
    x = logs.select(F.col(case).alias("case_id"), F.xxhash64(text).alias("log"), F.posexplode(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"), "\n")).alias("at", "raw"))
    x = x.where(F.btrim("raw", F.lit(_BLANKS)) != "").select("case_id", "log", (F.col("at") + 1).alias("line"), F.btrim("raw", F.lit(_BLANKS)).alias("said"))
    titled = F.col("said").startswith("#")
    plain = F.regexp_replace("said", _LEAD, "")
    x = x.withColumn("said", F.regexp_replace("said", r"^[0-9]+[.、]$", "")).where(F.col("said") != "").withColumns({
        "heading": F.when(titled, F.regexp_replace("said", r"^#+\s*", "")).when(F.col("said").rlike("^[^*0-9：:-][^：:]*[：:]$"), F.regexp_replace("said", "[：:]$", "")),
        "field": F.regexp_replace(F.regexp_extract(plain, "^([^：:]{1,20})[：:]", 1), r"\s*[0-9]+$", ""), "value": F.btrim(F.regexp_replace(plain, "^[^：:]{1,20}[：:]", ""), F.lit(_BLANKS)),
    })
    log = Window.partitionBy("case_id", "log").orderBy("line")
    x = x.withColumns({"nth": F.count("heading").over(log), "section": F.coalesce(F.last("heading", True).over(log), F.lit(""))}).where(F.col("heading").isNull())
    part = Window.partitionBy("case_id", "log", "nth").orderBy("line")
    again = F.col("field") == F.first("field").over(part)
    return x.withColumn("again", again.cast("int")).select("case_id", "section", F.sum("again").over(part).alias("item"), "field", "value", "line")


def cited_paths(items: DataFrame, triples: DataFrame, field: str = "证据路径", separator: str = " — ") -> DataFrame:
    """(case_id, n_paths, n_known): how many different paths each log cites, and how many of them are triples of the graph: what
    an experiment's summary takes as its metrics."""
    paths = items.where(F.col("field").endswith(field)).select("case_id", F.col("value").alias("path")).distinct()
    own = triples.select(F.concat_ws(separator, "head_cn", "relation_cn", "tail_cn").alias("path")).distinct().withColumn("known", F.lit(True))
    return paths.join(own, "path", "left").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_paths"), F.count("known").alias("n_known"))
