"""Where two tokenizers cut the same text: groups of tokens between common cuts, and links of tokens that end together.

Each side's tokens are exploded with their positions, a window sums their byte lengths up to their ends, and the sides meet in
an equi-join on text and end. A row of it is a cut and a link, and its place in the order of ends, the running count of cuts,
is the group that ends there: group i has the tokens of either side after cut i - 1, up to those of cut i. As the last token of
both sides ends with the text, all tokens are in a group.

Equal texts are one text with its number of rows. What is sent are id arrays, once, by a hash of the text: explode, windows,
join and groups keep that partitioning, so rows of tokens never leave their task. A text is encoded in parts, see parts(), so
the encoders' memory does not grow with it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import spare, written

#: Characters of a part, beyond which a text is cut at the next place that is a boundary of both sides.
PART = 1 << 16
#: Distinct linked id pairs up to which their counts are broadcast; 16 bytes each. Beyond that they are joined by shuffles.
BROADCAST_PAIRS = 1 << 20
#: Bytes of text whose token rows a task sorts.
TASK_BYTES = 2 << 20
#: Ids are sent as 16-bit integers, less this.
_SHIFT = 1 << 15
#: Of a pair's number, the lower bits hold the id of side B; of a cut's, the position on side B.
_B_BITS, _AT_BITS = 15, 31
_BOUNDARY = re.compile(r"(?<=[^\s▁]) (?=[A-Za-z])")


def _bytes_of_chars() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes with: printable bytes stand for themselves, the rest
    follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Side A: byte-level BPE by a vocabulary file of the tokenizers library, whose ids are in the order of its merges. Its
    pattern is the usual one, as given; the encoding is the tiktoken library's, several times as fast as the other's, and tests
    hold both to the same ids."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        byte, special = _bytes_of_chars(), {x["content"] for x in d["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in d["model"]["vocab"].items() if t not in special}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes_of[i] = t
        if not all(bytes([i]) in ranks for i in range(256)):
            raise ValueError("a byte-level vocabulary has every byte")  # so a text's tokens are always the text
        self.tiktoken = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, part: str) -> np.ndarray:
        return np.array(self.tiktoken.encode_ordinary(part), np.int32)


class Pieces:
    """Side B: a sentencepiece model that puts a blank before a text."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = lambda i: bytes([int(p.id_to_piece(i)[3:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()
        self.bytes_of = [piece(i) for i in range(p.get_piece_size())]
        if any(b" " in x.lstrip(b" ") for x in self.bytes_of):
            raise ValueError("pieces have blanks at their beginning only")  # so texts can be cut before one
        self.model = p

    def encode(self, part: str) -> np.ndarray | None:
        """None where the pieces' bytes differ from the part's."""
        ids = self.model.encode(part[1:], num_threads=1)
        return np.array(ids, np.int32) if b"".join(map(self.bytes_of.__getitem__, ids)) == part.encode() else None


@lru_cache(maxsize=4)
def encoder(kind: type, path: str) -> ByteLevel | Pieces:
    """One per worker; the files are part of an installed package, so every machine has them at the same place."""
    return kind(path)


def parts(text: str, size: int = PART) -> Iterator[str]:
    """Parts of blank + text, each beginning with a blank, cut where a blank stands between a character that is none and a letter
    A-Z: the pattern of side A has a boundary there, whatever lies farther off, and no piece of side B goes on with a blank
    after another character. So the parts' tokens are the text's."""
    x, at = " " + text, 0
    while len(x) - at > size:
        cut = _BOUNDARY.search(x, at + size)
        if cut is None:
            break
        yield x[at : cut.start()]
        at = cut.start()
    yield x[at:]


def encoded(kind: type, path: str, text: str, size: int = PART) -> np.ndarray:
    """The ids of blank + text; none where their joined bytes differ from it."""
    e, out = encoder(kind, path), []
    for part in parts(text, size):
        ids = e.encode(part)
        if ids is None:
            return np.zeros(0, np.int32)
        out.append(ids)
    return np.concatenate(out)


def _tokenise(a_path: str, b_path: str, size: int):
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                one = b.slice(i, 64)
                both = []
                for x in one.column("text"):
                    text = x.as_py()
                    p, q = encoded(ByteLevel, a_path, text, size), encoded(Pieces, b_path, text, size)
                    both.append((p, q) if len(p) and len(q) else (p[:0], q[:0]))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, side)]).astype(np.int32)), pa.array((np.concatenate(side) - _SHIFT).astype(np.int16))) for side in zip(*both)]
                yield pa.RecordBatch.from_arrays([one.column("k1"), one.column("k2"), pa.StructArray.from_arrays(lists, ["a", "b"])], ["k1", "k2", "ids"])

    return run


def key(text: str) -> list[Column]:
    """128 bits of a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def texts(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", size: int = PART) -> DataFrame:
    """(k1, k2, n, ids.a, ids.b): each different text that has characters, with its number of rows and its ids less _SHIFT. Both
    sides are one column, so that whatever reads one of them reads the same exchange."""
    d = docs.where(F.char_length(text_col) > 0).select(F.col(text_col).alias("text")).select(*key("text"), "text")
    x = d.mapInArrow(_tokenise(a_path, b_path, size), "k1 long, k2 long, ids struct<a: array<short>, b: array<short>>")
    return x.groupBy("k1", "k2").agg(F.any_value("ids").alias("ids"), F.count(F.lit(1)).alias("n"))


def ends(t: DataFrame, side: str, lengths: list[int]) -> DataFrame:
    """(k1, k2, end, the side's position) of every token; end is the place of its last byte, counted from 1."""
    at = f"{side}_at"
    # every text has rows: the condition only keeps n in the exchange, as all that read it have to ask for the same columns
    x = t.where("n > 0").select("k1", "k2", F.posexplode(f"ids.{side}").alias(at, "id"))
    x = x.select("k1", "k2", at, F.element_at(F.lit(np.array(lengths, np.int32)), F.col("id") + _SHIFT + 1).alias("length"))
    w = Window.partitionBy("k1", "k2").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return x.select("k1", "k2", at, F.sum("length").over(w).alias("end"))


def cuts(t: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(k1, k2, end, cut, a_at, b_at) of every place where tokens of both sides end, numbered from 1 in each text."""
    lengths = [[len(x) for x in encoder(kind, path).bytes_of] for kind, path in ((ByteLevel, a_path), (Pieces, b_path))]
    x = ends(t, "a", lengths[0]).join(ends(t, "b", lengths[1]).hint("merge"), ["k1", "k2", "end"])
    return x.withColumn("cut", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("end")))


def aligned(t: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(k1, k2, n, a, b, cuts) of each of texts() that has tokens: cuts are numbers a_at * 2 ** 31 + b_at, in order."""
    c = cuts(t, a_path, b_path).select("k1", "k2", (F.shiftleft(F.col("a_at").cast("long"), _AT_BITS) + F.col("b_at")).alias("at"))
    c = c.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("at")).alias("cuts"))
    return t.join(c.hint("merge"), ["k1", "k2"]).select("k1", "k2", "n", "ids.a", "ids.b", "cuts")


@lru_cache(maxsize=1)
def _decimals() -> np.ndarray:
    """Ids as decimals after nothing, a comma, a semicolon and a bar; what is shorter than the longest has zero bytes behind it."""
    return np.array([sep + b"%d" % i for sep in (b"", b",", b";", b"|") for i in range(1 << 16)])


def groups_text(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> bytes:
    """`a1,a2|b1;a3|b2,b3` of ids and the places of both sides' cuts."""
    p, q = np.diff(at_a + 1, prepend=0), np.diff(at_b + 1, prepend=0)  # tokens a group
    out = np.empty(len(a) + len(b), np.int32)
    start_a, start_b = np.cumsum(p) - p, np.cumsum(q) - q
    first_a, first_b = start_a + start_b, start_a + p + start_b
    out[np.arange(len(a)) + np.repeat(start_b, p)] = a + (1 << 16)
    out[np.arange(len(b)) + np.repeat(start_a + p, q)] = b + (1 << 16)
    out[first_a] += 1 << 16
    out[first_b] += 2 << 16
    out[0] -= 2 << 16
    return _decimals()[out].tobytes().translate(None, b"\0")


@F.arrow_udf(StructType([StructField("groups_sha256", StringType()), StructField("links", ArrayType(IntegerType()))]))
def rendered(a: pa.Array, b: pa.Array, cut: pa.Array) -> pa.Array:
    """Of a row of aligned() the digest of its groups, and the linked pairs: a * 2 ** 15 + b each."""
    np_of = lambda x: x.values.to_numpy(zero_copy_only=False)
    digests, links = [], []
    for p, q, c in zip(a, b, cut):
        p, q, c = np_of(p).astype(np.int32) + _SHIFT, np_of(q).astype(np.int32) + _SHIFT, np_of(c)
        at_a, at_b = c >> _AT_BITS, c & ((1 << _AT_BITS) - 1)
        digests.append(hashlib.sha256(groups_text(p, q, at_a, at_b)).hexdigest())
        links.append((p[at_a] << _B_BITS) + q[at_b])
    ends = pa.array(np.cumsum([0, *map(len, links)]), pa.int32())
    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *links]), pa.int32()))
    return pa.StructArray.from_arrays([pa.array(digests, pa.string()), lists], ["groups_sha256", "links"])


@contextmanager
def _kept_apart(spark: SparkSession, partitions: int):
    """Joins by a key that the rows are dealt by a part of, tasks of few bytes but many token rows left as they are, and rows that
    come in order aggregated in that order. Of effect while a table is written; results do not depend on it."""
    now = {
        "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.execution.replaceHashWithSortAgg": "true",  # the join's rows come in order, so a text's cuts are collected without a sort
    }
    old = {k: spark.conf.get(k, None) for k in now}
    try:
        for k, v in now.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def link_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best) of every linked id pair, from rows (links, n): in how many links of all rows it is, and whether no
    pair of its id of B is in more."""
    c = rows.select(F.explode("links").alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("count"))
    c = written(c.withColumn("b", F.col("pair").bitwiseAND((1 << _B_BITS) - 1)), "link-counts")
    most = c.groupBy("b").agg(F.max("count").alias("most"))
    return c.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _sums(rows: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """(k1, k2, n_best, count_sum) of rows (k1, k2, links)."""
    x = rows.select("k1", "k2", F.explode("links").alias("pair"))
    if counts.count() <= most:
        x = x.withColumn("m", F.lit(1)).join(F.broadcast(counts), "pair")
    else:  # a pair of a text goes once; as a table of its own, the counts' side can be split at pairs that very many texts have
        x = x.groupBy("k1", "k2", "pair").agg(F.count(F.lit(1)).alias("m")).join(written(counts, "best-links"), "pair")
    return x.groupBy("k1", "k2").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("count")).alias("count_sum"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = PART, most: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs.

    Texts that are null, empty, or whose joined bytes on either side differ from blank + text have no tokens: zeros and ''.
    Repeated rows stay, and each counts in the corpus-wide counts; rows without id are aligned, too. Other columns are not
    looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    has = F.coalesce(F.char_length(text_col), F.lit(0)) > 0
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    with _kept_apart(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))):
        x = aligned(texts(docs, a_path, b_path, text_col, size), a_path, b_path)
        x = x.select("k1", "k2", "n", F.size("a").alias("n_a"), F.size("b").alias("n_b"), F.size("cuts").alias("n_groups"), rendered("a", "b", "cuts").alias("r"))
        each = written(x.select("k1", "k2", "n", "n_a", "n_b", "n_groups", "r.groups_sha256", "r.links"), "aligned")
    counts = link_counts(each.select("links", "n"))
    # a table of its own, so that Spark can split the join below at a text that very many documents have
    sums = written(each.drop("links", "n").join(_sums(each.select("k1", "k2", "links"), counts, most), ["k1", "k2"]), "alignments")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), has.alias("has"), *[c.alias(name) for c, name in zip(key(text_col), ("d1", "d2"))])
    x = d.join(sums, F.col("has") & (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return x.select("doc_id", zero("n_a").alias("n_a"), zero("n_b").alias("n_b"), zero("n_groups").alias("n_groups"), zero("n_groups").alias("n_links"), zero("n_best").alias("n_best"), zero("count_sum").alias("count_sum"), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
