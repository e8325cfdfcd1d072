"""Quality classifier by nearest-neighbour voting in a latent semantic space.

A text's terms are its byte pairs and a few style statistics of the whole text. From a bounded sample of labelled documents a
truncated SVD of their weighted term matrix gives the latent space. The sample's vectors and labels are broadcast; every
document takes exact cosine products with all of them, in blocks, and its nearest neighbours' labels are averaged, weighted by
similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most, dimensions of the latent space, neighbours that vote, documents in a block.
SAMPLE, DIMENSIONS, NEIGHBOURS, BLOCK = 6_144, 64, 15, 256
_PAIRS, _STATS, _STEPS, _STAT_WEIGHT = 65_536, 6, 12, 6.0
TERMS = _PAIRS + _STATS * _STEPS
#: Bytes of a text that are counted at once; longer texts are counted piece by piece.
_PIECE = 1 << 20


def _statistics(text: str, raw: np.ndarray) -> list[float]:
    """Shares between 0 and 1: words like the one before, distinct words, capitals, marks, digits, lines that repeat."""
    words, lines = text.split(), text.split("\n")
    n, size = len(words), max(1, len(raw))
    same = sum(map(str.__eq__, words, words[1:])) / max(1, n - 1)
    counts = np.bincount(raw, minlength=256)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    return [same, len(set(words)) / max(1, n), counts[65:91].sum() / max(1, letters), marks / size, counts[48:58].sum() / size, 1 - len(set(lines)) / len(lines)]


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, weights) of a text's terms; none for a text without characters."""
    if not text:
        return np.zeros(0, np.int32), np.zeros(0)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    counts = np.zeros(_PAIRS, np.int64)
    for i in range(0, len(raw), _PIECE):
        part = raw[i : i + _PIECE + 1].astype(np.int32)
        counts += np.bincount((part[:-1] << 8) | part[1:], minlength=_PAIRS)
    ids = np.flatnonzero(counts)
    steps = [min(_STEPS - 1, int(np.sqrt(max(0.0, x)) * _STEPS)) for x in _statistics(text, raw)]
    own = _PAIRS + np.arange(_STATS) * _STEPS + steps
    return np.concatenate([ids, own]).astype(np.int32), np.concatenate([np.log1p(counts[ids]), np.full(_STATS, _STAT_WEIGHT)])


@dataclass
class Model:
    """column: of a term, or -1; weights: by column; basis: column -> latent; vectors, labels: of the sample; prior: its mean label."""

    column: np.ndarray
    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int

    def latent(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(found), self.basis.shape[1]))
        for i, (ids, values) in enumerate(found):
            at = self.column[ids]
            fit = at >= 0
            at = at[fit]
            out[i] = (values[fit] * self.weights[at]) @ self.basis[at]
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, lengths, out=np.zeros_like(out), where=lengths > 0)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Similarities are rounded, so that a score doesn't hang on the order in which a product is summed."""
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        v = self.latent([terms(x) for x in texts])
        cos = np.round(v @ self.vectors.T, 6)
        k = min(self.neighbours, cos.shape[1])
        at = np.argsort(-cos, axis=1, kind="stable")[:, :k] if cos.shape[1] <= 64 else _nearest(cos, k)
        w = np.maximum(np.take_along_axis(cos, at, 1), 0) ** 4
        total = w.sum(1)
        return np.where(total > 0, (w * self.labels[at]).sum(1) / np.where(total > 0, total, 1), self.prior)


def _nearest(cos: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row, ties to the smaller column."""
    out = np.empty((len(cos), k), np.int64)
    edge = np.partition(cos, cos.shape[1] - k, axis=1)[:, -k]
    for i, (row, least) in enumerate(zip(cos, edge)):
        at = np.flatnonzero(row >= least)
        out[i] = at[np.argsort(-row[at], kind="stable")[:k]]
    return out


def _term_rows(batches):
    for b in batches:
        found = [terms(x or "") for x in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("y"), b.column("at"), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())], ["y", "at", "ids", "weights"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of `sample` labelled documents at most, chosen by a hash of their ids.

    Several labels of one id count as their mean, rounded up from a half; null labels don't count. Each id of the sample gives
    one text; where texts of one id differ, that of the least hash. So rows that repeat never take another id's place, and
    `sample` bounds what is fitted and what comes to the driver. Without any labelled row every score is 0.5.
    """
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("y_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    y = y.join(docs.select(F.col(id_col).alias("y_id")).distinct(), "y_id", "left_semi").withColumn("at", F.xxhash64(F.lit(11), "y_id")).orderBy("at", "y_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("y_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(y), "y_id")  # sample rows at most are broadcast
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")
    got = rows.groupBy("at", "y_id", "y").agg(one).select("y", "at", "text").mapInArrow(_term_rows, "y int, at long, ids binary, weights binary").orderBy("at", "ids").collect()
    found = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["weights"], np.float32)) for r in got]
    return _model([r["y"] for r in got], found, dimensions, neighbours)


def _model(y: list[int], found: list[tuple[np.ndarray, np.ndarray]], dimensions: int, neighbours: int) -> Model:
    labels = np.array(y, dtype=np.float64)
    df = np.zeros(TERMS, np.int64)
    for ids, _ in found:
        df[ids] += 1
    known = np.flatnonzero(df >= min(2, max(1, len(y))))
    column = np.full(TERMS, -1, np.int32)
    column[known] = np.arange(len(known))
    weights = np.log((1 + len(y)) / (1 + df[known])) + 1
    empty = Model(column, weights, np.zeros((len(known), 1)), np.zeros((0, 1)), np.zeros(0), float(labels.mean()) if len(y) else 0.5, neighbours)
    if not len(y) or not len(known):
        return empty

    def blocks() -> Iterator[np.ndarray]:
        """The weighted term matrix, some rows at a time, each of length 1."""
        for start in range(0, len(found), BLOCK):
            part = found[start : start + BLOCK]
            x = np.zeros((len(part), len(known)), np.float32)
            for i, (ids, values) in enumerate(part):
                at = column[ids]
                x[i, at[at >= 0]] = values[at >= 0] * weights[at[at >= 0]]
            yield x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    basis = _right_vectors(blocks, len(known), min(dimensions, len(y), len(known)))
    model = Model(column, weights, basis, np.zeros((0, 1)), labels, empty.prior, neighbours)
    model.vectors = model.latent(found)
    return model


def _right_vectors(blocks: Callable[[], Iterator[np.ndarray]], columns: int, k: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors, by randomised subspace iteration over blocks of rows: no more than a block is dense."""
    q = np.random.default_rng(5).standard_normal((columns, min(columns, k + 16))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(sum(x.T @ (x @ q) for x in blocks()))
    small = np.concatenate([x @ q for x in blocks()])
    return (q @ np.linalg.svd(small, full_matrices=False)[2].T[:, :k]).astype(np.float64)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, and the columns named in keep): 0 to 1 for every row of docs, higher where label 1 is likelier.

    A null or empty text, or one that shares no term with the sample, scores the sample's mean label.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # sample x dimensions and terms x dimensions numbers at most
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("scored_text"), *[F.col(c).alias(f"kept_{c}") for c in keep])

    def run(batches):
        m = shared.value
        for b in batches:
            for some in _blocks(b):
                s = m.scores(some.column("scored_text").to_pylist())
                kept = [c for c in some.schema.names if c != "scored_text"]
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in kept], pa.array(s)], [*kept, "score"])

    types = dict(d.dtypes)
    out = d.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in d.columns if c != "scored_text") + ", score double")
    return out.select("doc_id", "score", *[F.col(f"kept_{c}").alias(c) for c in keep])


def _blocks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, b.num_rows, BLOCK):
        yield b.slice(i, BLOCK)


def keep_good(docs: DataFrame, model: Model, cut: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score `cut` or more. A text without terms, as a null or empty one, scores
    the sample's mean label and so stays where that is `cut` or more. An empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for b in batches:
            for some in _blocks(b):
                yield some.filter(pa.array(m.scores([x or "" for x in some.column(at).to_pylist()]) >= cut))

    return docs.mapInArrow(run, docs.schema)
