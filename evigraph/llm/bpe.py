"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of more than `chunk` characters is cut into chunks that overlap. Chunks are pre-tokenised apart, so that one very long
text is the work of many tasks, and stitched where the pre-token boundaries of two neighbours meet again: from a common
boundary on both see the same text with a pattern that looks only ahead, so all later boundaries agree. Only boundaries within
the overlaps are needed for that. Each chunk then encodes the pieces between its two cuts, again in many tasks, and decodes
them by concatenating the tokens' raw bytes; what is left is to join the bytes. A text in which two neighbours share no
boundary, as in a piece longer than the overlap, is stitched and encoded by one task.

A piece's merges by rank are the tiktoken library's own, and remembered.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CHUNK, OVERLAP = 65_536, 1_024
#: A boundary this near to a chunk's end is not trusted: the pattern may look that far ahead.
MARGIN = 16
#: Pieces whose ids a worker remembers before it starts anew; bounds its memory.
REMEMBERED, LONGEST = 200_000, 64


class _Ids(dict):
    """Piece -> its ids as little-endian 32-bit integers."""

    def __init__(self, single):
        self.single = single

    def __missing__(self, piece: str) -> bytes:
        ids = np.asarray(self.single(piece.encode()), dtype="<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        self.split = regex.compile(pattern)
        core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ids = _Ids(core._encode_single_piece)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def pieces(self, text: str) -> list[str]:
        return self.split.findall(text)

    def encode_pieces(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.ids.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        return self.encode_pieces(self.pieces(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def tokenizer(ranks_path: str, pattern: str) -> Tokenizer:
    """One per worker. The rank file is part of an installed package, so every machine has it at the same place."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Tokenizer(ranks, pattern)


def chunks(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, str]]:
    """(start, chunk's text); each runs on for overlap characters into its successor."""
    for start in range(0, max(1, len(text)), chunk):
        yield start, text[start : start + chunk + overlap]


def stitch(parts: list[tuple[int, str, list[str]]], split) -> list[str]:
    """The pieces of the whole text from those of its chunks (start, text, pieces), in order.

    A chunk's last pieces may be cut short, so their ends are no boundaries. Where two neighbours share no boundary within their
    overlap, as in a piece longer than that, their texts are joined and pre-tokenised again.
    """
    out: list[str] = []
    start, text, pieces = parts[0]
    for nxt_start, nxt_text, nxt_pieces in parts[1:]:
        ends = start + np.cumsum([len(p) for p in pieces], dtype=np.int64)
        nxt = nxt_start + np.concatenate([[0], np.cumsum([len(p) for p in nxt_pieces], dtype=np.int64)])
        # nxt[0], the chunk's own start, holds only if the left side has a boundary there
        ends = ends[ends <= start + len(text) - MARGIN]
        both = np.intersect1d(ends, nxt[:-1], assume_unique=True)
        if len(both):
            cut = both[0]
            out += pieces[: int(np.searchsorted(ends, cut)) + 1]
            k = int(np.searchsorted(nxt, cut))
            start, text, pieces = int(cut), nxt_text[int(cut) - nxt_start :], nxt_pieces[k:]
        else:
            text = text[: nxt_start - start] + nxt_text
            pieces = split(text)
    return out + pieces


def _whole(path: str, pattern: str):
    def run(batches):
        t = tokenizer(path, pattern)
        for b in batches:
            for some in range(0, b.num_rows, 256):
                ids = [t.encode(x or "") for x in b.column("text").slice(some, 256).to_pylist()]
                decoded = [t.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(some, 256), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return run


def _cut(chunk: int, overlap: int):
    def run(batches):
        for b in batches:
            for doc_id, row, text in zip(b.column("doc_id"), b.column("row"), b.column("text")):
                for start, part in chunks(text.as_py(), chunk, overlap):
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], pa.int64()), pa.array([row.as_py()], pa.int64()), pa.array([start], pa.int64()), pa.array([part], pa.string())], ["doc_id", "row", "start", "part"])

    return run


def _pretokenise(path: str, pattern: str, chunk: int, overlap: int):
    """Chunks with the lengths of their pieces, the boundaries that they share with the chunk before (head) and after (tail)."""

    def run(batches):
        t = tokenizer(path, pattern)
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                text, start = one.column("part")[0].as_py(), one.column("start")[0].as_py()
                lengths = np.array([len(p) for p in t.pieces(text)], dtype="<u4")
                ends = start + np.cumsum(lengths, dtype=np.int64)
                head = np.concatenate([[start], ends[:-1]])
                tail = ends[(ends >= start + chunk) & (ends <= start + len(text) - MARGIN)]
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([lengths.tobytes()], pa.binary()), pa.array([head[head <= start + overlap].tolist()], pa.list_(pa.int64())), pa.array([tail.tolist()], pa.list_(pa.int64()))], [*one.schema.names, "lengths", "head", "tail"])

    return run


def _pieces_of(part: str, lengths: bytes) -> tuple[list[str], np.ndarray]:
    ends = np.cumsum(np.frombuffer(lengths, dtype="<u4").astype(np.int64))
    return [part[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())], ends


def _between_cuts(path: str, pattern: str):
    def run(batches):
        t = tokenizer(path, pattern)
        for b in batches:
            for doc_id, row, start, part, lengths, begin, end in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "start", "part", "lengths", "begin", "end"))):
                pieces, ends = _pieces_of(part, lengths)
                first = 0 if begin == start else int(np.searchsorted(ends, begin - start)) + 1
                last = len(pieces) if end is None else int(np.searchsorted(ends, end - start)) + 1
                ids = t.encode_pieces(pieces[first:last])
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([row], pa.int64()), pa.array([start], pa.int64()), pa.array([ids], pa.binary()), pa.array([t.decode(ids)], pa.binary())], ["doc_id", "row", "start", "ids", "decoded"])

    return run


def _joined(batches):
    """The bytes of chunks that come sorted by row and start, row by row."""

    def given(doc_id, ids, decoded):
        return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([b"".join(ids)], pa.binary()), pa.array([b"".join(decoded)], pa.binary())], ["doc_id", "ids", "decoded"])

    now, held = None, None
    for b in batches:
        for doc_id, row, ids, decoded in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "ids", "decoded"))):
            if row != now:
                if held:
                    yield given(*held)
                now, held = row, (doc_id, [], [])
            held[1].append(ids)
            held[2].append(decoded)
    if held:
        yield given(*held)


def _in_one_task(path: str, pattern: str):
    def run(key, group):
        import pandas as pd

        t = tokenizer(path, pattern)
        group = group.sort_values("start")
        parts = [(int(start), part, _pieces_of(part, lengths)[0]) for start, part, lengths in zip(group["start"], group["part"], group["lengths"])]
        ids = t.encode_pieces(stitch(parts, t.pieces))
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(x) else int(x) for x in group["doc_id"][:1]], "Int64"), "ids": [ids], "decoded": [t.decode(ids)]})

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian unsigned 32-bit integers, decoded as the raw bytes that they stand for.

    A null text counts as empty and has no ids. Strings of special tokens are ordinary text. Repeated rows stay repeated; rows
    with no id are encoded too. Other columns are not looked at. An empty table gives no rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = "doc_id long, ids binary, decoded binary"
    short = d.where(F.char_length("text") <= chunk).mapInArrow(_whole(ranks_path, pattern), out)
    # a row's number tells texts apart for as long as the chunks are not written, which is one job
    long = d.where(F.char_length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    cols = "doc_id long, row long, start long, part string"
    # chunks are few bytes and much work: a given number of partitions, which Spark does not merge by their bytes
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = long.mapInArrow(_cut(chunk, overlap), cols).repartition(parts, "row", "start")
    x = written(x.mapInArrow(_pretokenise(ranks_path, pattern, chunk, overlap), f"{cols}, lengths binary, head array<long>, tail array<long>"), "bpe-chunks")
    if x.isEmpty():
        return short
    w = Window.partitionBy("row").orderBy("start")
    cuts = x.select("row", "start", "tail", F.lead("head").over(w).alias("next")).withColumn("end", F.array_min(F.array_intersect("tail", "next")))
    cuts = cuts.select("row", "start", "end", F.coalesce(F.lag("end").over(w), F.lit(0)).alias("begin"), F.max(F.col("next").isNotNull() & F.col("end").isNull()).over(Window.partitionBy("row")).alias("apart"))
    x = x.join(cuts, ["row", "start"])
    encoded = x.where(~F.col("apart")).repartition(parts, "row", "start").mapInArrow(_between_cuts(ranks_path, pattern), "doc_id long, row long, start long, ids binary, decoded binary")
    encoded = encoded.repartition("row").sortWithinPartitions("row", "start").mapInArrow(_joined, out)
    whole = x.where("apart").select("doc_id", "row", "start", "part", "lengths").groupBy("row").applyInPandas(_in_one_task(ranks_path, pattern), out)
    return short.unionByName(encoded).unionByName(whole)


def decode(rows: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of ids in the form that encode() gives; null ids decode to no bytes."""

    def run(batches):
        t = tokenizer(ranks_path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode(x or b"") for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "decoded"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded binary")
