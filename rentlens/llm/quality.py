"""Quality scores by votes of the nearest labelled documents in a latent semantic space.

A text is a bag of hashed terms: its words, the shapes of its tokens (capitals, digits,
punctuation) and marks for repetition. Weighted, these project onto the leading singular vectors
of a labelled sample. Every document meets every labelled vector in blocked, exact cosine
products; its nearest ``neighbours`` vote with their similarity as weight.

The labelled vectors are few (``fit_documents``, whatever the tables hold), so they are
broadcast; documents are scored where they lie and nothing is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import BoundedCache, id_remainder, in_batches, kept_by_worker, texts

# Bound of the labelled sample: documents of each label.
FIT_DOCUMENTS = 1500
DIMENSIONS = 48
NEIGHBOURS = 31
BLOCK = 256
WORD_TERMS = 4096
SHAPE_TERMS = 1024
TERMS = WORD_TERMS + SHAPE_TERMS
CACHED_TOKENS = 300_000
# Similarities are raised to this power before they weigh a vote.
SHARPNESS = 4

_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
_SHAPES = ((re.compile(r"[^\W\d_a-z]*[A-Z][A-Z]+[^\W\d_a-z]*"), "AA"), (re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"))


def _shape(token: str) -> str:
    """Runs of letters, capitals and digits shortened; punctuation as it is, runs of one mark as two."""
    for pattern, short in _SHAPES:
        token = pattern.sub(short, token)
    return re.sub(r"(.)\1+", r"\1\1", token)[:16]


def _terms_of(token: str) -> tuple[int, int]:
    word = re.sub(r"[\W\d_]+", "", token).lower()
    return (
        zlib.crc32(word.encode()) % WORD_TERMS,
        WORD_TERMS + 8 + zlib.crc32(_shape(token).encode()) % (SHAPE_TERMS - 8))


@kept_by_worker
def _token_terms() -> BoundedCache:
    return BoundedCache(_terms_of, CACHED_TOKENS)


def term_weights(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of a whole text and the square roots of their shares; empty without a token."""
    tokens = text.split()
    if not tokens:
        return np.empty(0, np.int64), np.empty(0)
    terms = np.array([*map(_token_terms().__getitem__, tokens)]).ravel()
    counts = np.bincount(terms, minlength=TERMS).astype(float)
    counts[:WORD_TERMS] /= len(tokens)
    # Shapes other than a plain word are rare and tell much.
    counts[WORD_TERMS:] *= 2.0 / len(tokens)
    again = sum(a == b for a, b in zip(tokens, tokens[1:])) / len(tokens)
    distinct = len(set(tokens)) / len(tokens)
    lines = text.split("\n")
    counts[WORD_TERMS:WORD_TERMS + 4] = (
        4.0 * again, 2.0 * (1.0 - distinct) * min(1.0, len(tokens) / 50), 2.0 * (1.0 - len(set(lines)) / len(lines)), 0.1)
    at = np.flatnonzero(counts)
    return at, np.sqrt(counts[at])


@dataclass(frozen=True, eq=False)
class QualityModel:
    weights: np.ndarray  # terms
    basis: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled documents x dimensions, of length 1
    labels: np.ndarray
    vote: np.ndarray  # what a vote of each labelled document counts
    prior: float

    def project(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        dense = np.zeros((len(rows), len(self.weights)), np.float32)
        for place, (at, values) in enumerate(rows):
            dense[place, at] = values * self.weights[at]
        return normalized(dense @ self.basis)

    def score(self, many: list[str], neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled documents; the prior where nothing is alike."""
        out = np.full(len(many), self.prior)
        if not len(self.vectors):
            return out
        for first in range(0, len(many), BLOCK):
            rows = [term_weights(text) for text in many[first:first + BLOCK]]
            cosines = self.project(rows) @ self.vectors.T
            count = min(neighbours, cosines.shape[1])
            nearest = np.argpartition(-cosines, count - 1, axis=1)[:, :count]
            weight = np.maximum(np.take_along_axis(cosines, nearest, 1), 0.0).astype(float) ** SHARPNESS * self.vote[nearest]
            total = weight.sum(axis=1)
            share = (weight * self.labels[nearest]).sum(axis=1) / np.maximum(total, 1e-12)
            out[first:first + BLOCK] = np.where(total > 1e-12, np.clip(share, 0.0, 1.0), self.prior)
        return out


def normalized(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 1e-9)


def _leading_vectors(rows: np.ndarray, dimensions: int) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration from a fixed start."""
    rng = np.random.default_rng(7)
    subspace = rng.standard_normal((rows.shape[1], dimensions + 8)).astype(np.float32)
    for _ in range(4):
        subspace, _ = np.linalg.qr(rows.T @ (rows @ subspace))
    _, _, right = np.linalg.svd(rows @ subspace, full_matrices=False)
    return (subspace @ right.T[:, :dimensions]).astype(np.float32)


def fit(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    fit_documents: int = FIT_DOCUMENTS, dimensions: int = DIMENSIONS,
) -> QualityModel:
    """Learn from at most ``fit_documents`` labelled documents of each label, those whose ids hash lowest.

    Null ids and labels teach nothing, nor do labels other than 0 and 1. Of an id with several
    labels the smallest counts. Votes are weighted so that the sample stands for the shares that
    the labels have in the whole label table.
    """
    known = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label")))
    totals = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    first = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = known.withColumn("place", F.row_number().over(first)).where(F.col("place") <= fit_documents).drop("place")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("doc_id", pa.int64()), ("label", pa.int32()), ("at", pa.list_(pa.int64())), ("value", pa.list_(pa.float64()))])
        for batch in batches:
            yield from in_batches(
                ((row["doc_id"], row["label"], *map(list, term_weights(row["text"]))) for row in batch.to_pylist()), schema)

    # The sample has at most two times ``fit_documents`` rows, so it is broadcast.
    rows = (
        texts(documents, id_col, text_col).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
        .mapInArrow(weigh, "doc_id long, label int, at array<long>, value array<double>")
        .orderBy("doc_id").collect())
    rows = [row for row in rows if row["at"]]
    label = np.array([row["label"] for row in rows], float)
    seen = sum(totals.values())
    prior = totals.get(1, 0) / seen if seen else 0.5
    if not rows:
        return QualityModel(np.zeros(TERMS), np.zeros((TERMS, 1), np.float32), np.empty((0, 1)), label, label, prior)
    used = np.bincount(np.concatenate([row["at"] for row in rows]), minlength=TERMS)
    weights = np.log1p(len(rows) / (1.0 + used))
    dense = np.zeros((len(rows), TERMS), np.float32)
    for place, row in enumerate(rows):
        at = np.array(row["at"])
        dense[place, at] = np.array(row["value"]) * weights[at]
    basis = _leading_vectors(dense, min(dimensions, len(rows)))
    in_sample = np.array([(label == 0).sum(), (label == 1).sum()])
    share = np.array([totals.get(0, 0), totals.get(1, 0)]) / np.maximum(in_sample, 1)
    # Halfway between the sample's balance and the table's.
    vote = np.sqrt(share / share.max())[label.astype(int)]
    return QualityModel(weights, basis, normalized(dense @ basis), label, vote, prior)


def score(
    df: DataFrame, model: QualityModel, held_out_remainder: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row, from the whole text alone.

    Null and empty texts, texts unlike every labelled one, and all texts under a model that saw no
    label get the share of label 1 among the labels as score. Null ids and repeated rows are kept.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quality = shared.value

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK):
                    ids, held, many = (batch.slice(start, BLOCK).column(n).to_pylist() for n in range(3))
                    for doc_id, out, value in zip(ids, held, quality.score(many).tolist()):
                        yield doc_id, out, value, int(value >= 0.5)

        return in_batches(rows(), _RESULT)

    rows = texts(df, id_col, text_col).select("doc_id", (id_remainder(3) == held_out_remainder).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
