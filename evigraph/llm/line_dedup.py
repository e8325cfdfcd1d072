"""Line dedup with DataFrame functions only.

Lines are reduced to (document, position, 128-bit key hash). The hashes are range-partitioned: a task gets a range of the first
64 bits, and ranges that hold a very common line are found by counting and dealt over several tasks by document. Within a task
rows are sorted by hash, document and position, and windows stream over that order: the first row of a document is its first
occurrence of a line, the first occurrences of a hash are its documents. A hash that lies in one task is decided there; only
those of dealt ranges are summed over their tasks. What comes back to the documents is no text but a keep bitmap per document,
run-length compressed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, row_key, spare, strip_blanks, written


def _with_row(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row_key", row_key("text"))


def _lines(text) -> F.Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """(doc_id, row_key, n_lines, pos, h1, h2): every line whose key has min_chars code points at least."""
    d = _with_row(docs, id_col, text_col).withColumn("lines", _lines(F.col("text")))
    x = d.select("doc_id", "row_key", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    x = x.where(F.char_length("line") >= min_chars).withColumn("key", ascii_lower(strip_blanks(F.col("line")))).where(F.char_length("key") >= min_chars)
    return x.select("doc_id", "row_key", "n_lines", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def _dealt(hashes: DataFrame, parts: int) -> tuple[DataFrame, bool]:
    """hashes with part, the task that a row goes to, and dealt: whether its range is dealt over several. Whether any range is.

    Ranges of equal width hold about as many rows, as hashes are uniform; only a very common line makes one larger than a
    task's share. There are half as many of these as tasks at most, so they suit a broadcast.
    """
    bits = max(2, (4 * parts - 1).bit_length())
    x = hashes.withColumn("bucket", F.shiftrightunsigned("h1", 64 - bits))
    share = F.greatest(F.ceil(F.sum("n").over(Window.partitionBy()) / parts), F.lit(1))
    counts = x.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # 8 rows a task at most
    large = counts.withColumn("pieces", F.ceil(F.col("n") / share).cast("int")).where(F.col("pieces") > 1).select("bucket", "pieces").collect()
    own = F.shiftright(F.col("bucket") * parts, bits)
    if not large:
        return x.select("*", own.cast("int").alias("part"), F.lit(False).alias("dealt")).drop("bucket"), False
    table = hashes.sparkSession.createDataFrame([tuple(r) for r in large], "bucket long, pieces int")
    x = x.join(F.broadcast(table), "bucket", "left")
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).otherwise(0)
    return x.select("*", F.pmod(own + piece, F.lit(parts)).cast("int").alias("part"), F.col("pieces").isNotNull().alias("dealt")).drop("bucket", "pieces"), True


def lost_lines(hashes: DataFrame, min_docs: int) -> DataFrame:
    """(doc_id, row_key, n_lines, pos): the lines of common keys, in all documents but the one of the largest id."""
    parts = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x, any_dealt = _dealt(hashes, parts)
    first = F.row_number().over(Window.partitionBy("part", "h1", "h2", "doc_id").orderBy("pos"))
    x = x.repartitionById(parts, F.col("part")).withColumn("first", (first == 1).cast("int"))
    run = Window.partitionBy("part", "h1", "h2")
    cols = ["doc_id", "row_key", "n_lines", "pos"]
    lost = lambda y: y.where((F.col("n_docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("keeper"))).select(*cols)
    out = lost(x.where(~F.col("dealt")).withColumns({"n_docs": F.sum("first").over(run), "keeper": F.max("doc_id").over(run)}))
    if not any_dealt:
        return out
    x = x.where("dealt")
    common = x.where("first = 1").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"), F.collect_set("part").alias("at"))
    common = written(common.where(F.col("n_docs") >= min_docs).select("h1", "h2", "n_docs", "keeper", F.explode("at").alias("part")), "common-lines")
    return out.unionByName(lost(x.join(common, ["part", "h1", "h2"])))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, row_key, n_lines, n_dropped, keep): keep holds runs (start, len) of the lines that stay.

    Only documents that lose a line have a row. A key of min_chars code points in min_docs documents loses its lines in all
    documents but the one of the largest id. A null id counts as one document, below all others. Rows of one id are one
    document when documents are counted; each row gets its own bitmap.
    """
    lost = lost_lines(written(line_hashes(docs, id_col, text_col, min_chars), "line-hashes"), min_docs)
    at = lost.groupBy("doc_id", "row_key").agg(F.max("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("at"))
    start = lambda i: F.when(i == 0, 0).otherwise(F.get("at", i - 1) + 1)
    end = lambda i: F.coalesce(F.get("at", i), F.col("n_lines"))
    keep = F.filter(F.transform(F.sequence(F.lit(0), F.size("at")), lambda i: F.struct(start(i).alias("start"), (end(i) - start(i)).alias("len"))), lambda r: r["len"] > 0)
    return at.select("doc_id", "row_key", "n_lines", F.size("at").alias("n_dropped"), keep.alias("keep"))


def apply_keep(lines: F.Column, keep: F.Column) -> F.Column:
    """The kept lines joined again. Runs are sliced, so the cost is that of the lines and the runs, not of their product."""
    return F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, r["len"]))), "\n")


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The rows of docs with all their columns, the text with its common lines dropped, and last line_dedup: struct(n_lines,
    n_dropped).

    A null or empty text is one empty line, which stays. A text that loses all its lines becomes empty. Repeated rows stay
    repeated. Other columns may have any names; where docs has a line_dedup, underscores follow the new one's name. An empty
    table gives no rows.
    """
    name = spare(docs, "line_dedup")
    marks = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs).select(F.struct("doc_id", "row_key", "n_dropped", "keep").alias(name))
    text = F.coalesce(docs[text_col], F.lit(""))
    key = F.xxhash64(text.isNull(), text)  # row_key of that text
    x = docs.join(marks, docs[id_col].eqNullSafe(marks[name]["doc_id"]) & (key == marks[name]["row_key"]), "left")
    lines, mark = _lines(text), marks[name]
    kept = F.when(mark.isNull(), text).otherwise(apply_keep(lines, mark["keep"]))
    counts = F.struct(F.size(lines).cast("long").alias("n_lines"), F.coalesce(mark["n_dropped"], F.lit(0)).cast("long").alias("n_dropped"))
    return x.select(*[kept.alias(c) if c == text_col else docs[c] for c in docs.columns], counts.alias(name))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of every row of docs; see marked() for the cases."""
    x = marked(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", min_chars, min_docs)
    return x.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", "text")
