"""Language identification by unigram models whose segmentations are summed out.

Every language has a probability for each piece of one fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, by the forward algorithm; a
text's is the product over its words. Piece probabilities are learned by expectation
maximisation over the same sums. Words recur, so tasks score each distinct word once.

Words are runs of letters, lower case; a run of more than ``MAX_LETTERS`` counts as several.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.joins import lookup_join
from ..session import cut_lineage
from .common import id_remainder, id_text, in_batches, kept_by_worker, texts

MAX_LETTERS = 24
# Bounds of the training sample of each language: documents, and distinct words of these.
FIT_DOCUMENTS = 400
FIT_WORDS = 50_000
ROUNDS = 3
# Expected uses that every piece has beforehand.
PRIOR_USES = 0.02
# Words that the confidence of a text counts at most.
CONFIDENCE_WORDS = 32
CACHED_WORDS = 400_000
UNDECIDED = "und"
# Texts whose best language is less likely than this among the others are rejected.
LEAST_SCORE = 0.4

_LETTERS = re.compile(r"[^\W\d_]+")
_START = "▁"
_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def words_of(text: str) -> list[str]:
    words = _LETTERS.findall(text.lower())
    if max(map(len, words), default=0) <= MAX_LETTERS:
        return words
    return [w[i:i + MAX_LETTERS] for w in words for i in range(0, len(w), MAX_LETTERS)]


def read_pieces(path: str) -> list[str]:
    """Ordinary pieces of a vocabulary file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(n) for n in range(model.get_piece_size()) if not any(is_odd(n) for is_odd in odd)]


class Lattice:
    """Which pieces lie in which words, for many words at once."""

    def __init__(self, pieces: list[str]):
        self.pieces = [p for p in pieces if p == p.lower() and len(p) <= MAX_LETTERS + 1]
        self.longest = max(map(len, self.pieces))
        hashes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        self.unknown = len(self.pieces)  # the number of any single character outside the vocabulary

    @staticmethod
    def _hash(piece: str) -> int:
        value = 0
        for char in piece:
            value = (value * 0x9E3779B97F4A7C15 + ord(char) + 1) & 0xFFFFFFFFFFFFFFFF
        return value

    def arcs(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For words of one length: (from, to, word numbers, piece numbers), in order of ``to``."""
        size = len(words[0]) + 1
        codes = np.array([[ord(c) for c in _START + w] for w in words], np.uint64).reshape(len(words), size)
        factor = np.uint64(0x9E3779B97F4A7C15)
        running = {}
        everyone = np.arange(len(words))
        for to in range(1, size + 1):
            running[to - 1] = np.zeros(len(words), np.uint64)
            for start in range(max(0, to - self.longest), to):
                running[start] = running[start] * factor + codes[:, to - 1] + np.uint64(1)
                place = np.minimum(np.searchsorted(self.hashes, running[start]), len(self.hashes) - 1)
                found = self.hashes[place] == running[start]
                if found.any():
                    yield start, to, everyone[found], self.numbers[place[found]]
                if start == to - 1 and not found.all():
                    missing = everyone[~found]
                    yield start, to, missing, np.full(len(missing), self.unknown)
            running.pop(to - self.longest, None)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield at, [words[i] for i in at]


def log_likelihoods(lattice: Lattice, words: list[str], probabilities: np.ndarray) -> np.ndarray:
    """log P(word | language): words x languages; ``probabilities`` is pieces x languages."""
    out = np.empty((len(words), probabilities.shape[1]))
    for at, group in by_length(words):
        size = len(group[0]) + 1
        forward = np.zeros((size + 1, len(group), probabilities.shape[1]))
        forward[0] = 1.0
        for start, to, rows, pieces in lattice.arcs(group):
            forward[to, rows] += forward[start, rows] * probabilities[pieces]
        out[at] = np.log(forward[size])
    return out


def learn(lattice: Lattice, words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities per language from words x languages counts, by expectation maximisation."""
    languages = counts.shape[1]
    probabilities = np.full((len(lattice.pieces) + 1, languages), 1.0 / (len(lattice.pieces) + 1))
    groups = []
    for at, group in by_length(words):
        groups.append((at, len(group[0]) + 1, len(group), list(lattice.arcs(group))))
    for _ in range(rounds):
        uses = np.full_like(probabilities, PRIOR_USES)
        for at, size, number, arcs in groups:
            forward = np.zeros((size + 1, number, languages))
            backward = np.zeros_like(forward)
            forward[0] = backward[size] = 1.0
            for start, to, rows, pieces in arcs:
                forward[to, rows] += forward[start, rows] * probabilities[pieces]
            for start, to, rows, pieces in sorted(arcs, key=lambda arc: -arc[0]):
                backward[start, rows] += backward[to, rows] * probabilities[pieces]
            share = counts[at] / forward[size]
            for start, to, rows, pieces in arcs:
                used = forward[start, rows] * probabilities[pieces] * backward[to, rows] * share[rows]
                np.add.at(uses, pieces, used)
        probabilities = uses / uses.sum(axis=0)
    return probabilities


@dataclass(frozen=True, eq=False)
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    probabilities: np.ndarray


class TextScorer:
    """Scores texts; distinct words are scored once, many at a time."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.lattice = Lattice(model.pieces)
        self.number: dict[str, int] = {}
        self.table = np.empty((0, len(model.languages)))

    def score(self, many: list[str]) -> list[tuple[str, float]]:
        """(language, confidence) of each text."""
        if not self.model.languages:
            return [(UNDECIDED, 0.0)] * len(many)
        split = [words_of(text) for text in many]
        unknown = [w for w in set().union(*split) if w not in self.number]
        if len(self.number) + len(unknown) > CACHED_WORDS:
            self.number, self.table = {}, self.table[:0]
            unknown = list(set().union(*split))
        if unknown:
            first = len(self.number)
            self.number.update(zip(unknown, range(first, first + len(unknown))))
            scored = [
                log_likelihoods(self.lattice, unknown[i:i + 20_000], self.model.probabilities)
                for i in range(0, len(unknown), 20_000)]
            self.table = np.concatenate([self.table[:first], *scored])
        return [self._decide(words) for words in split]

    def _decide(self, words: list[str]) -> tuple[str, float]:
        if not words:
            return UNDECIDED, 0.0
        rows = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        mean = self.table[rows].sum(axis=0) / len(words)
        best = int(mean.argmax())
        odds = np.exp((mean - mean[best]) * min(len(words), CONFIDENCE_WORDS))
        return self.model.languages[best], float(1.0 / odds.sum())


@kept_by_worker
def scorer_of(model: LanguageModel) -> TextScorer:
    """One scorer per worker: the words that one task has scored serve the next."""
    return TextScorer(model)


@kept_by_worker
def _lattice_of(pieces: tuple[str, ...]) -> Lattice:
    return Lattice(list(pieces))


def fit(
    df: DataFrame, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    documents: int = FIT_DOCUMENTS, words: int = FIT_WORDS, rounds: int = ROUNDS,
) -> LanguageModel:
    """Learn every language from at most ``documents`` of its texts and their ``words`` most frequent words.

    The texts are those whose ids and texts hash lowest, rows equal in both once, so the sample is the same on
    every run and bounded whatever repeats. Each language is learned in a task of its own, from its own words;
    the driver gets one row of probabilities for each. Rows without a language do not teach; without any
    such row the model knows no language.
    """
    rows = df.where(F.col(f"`{lang_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # Only hashes are ranked, per language; the texts stay in their tasks.
    hashed = rows.select("lang", F.xxhash64("doc_id", "text").alias("order"), "text")
    first = Window.partitionBy("lang").orderBy("order")
    chosen = cut_lineage(
        hashed.select("lang", "order").distinct().withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= documents).select("lang", "order"))
    sample = lookup_join(hashed, chosen, ["lang", "order"]).dropDuplicates(["lang", "order"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("word", pa.string())])
        for batch in batches:
            yield from in_batches(
                ((lang, word) for lang, text in id_text(batch) for word in words_of(text)), schema, 1)

    pieces = read_pieces(pieces_path)
    shared = df.sparkSession.sparkContext.broadcast(tuple(pieces))

    def learned(group: pa.Table) -> pa.Table:
        ordered = group.sort_by("word")
        counts = ordered.column("count").to_numpy().astype(float).reshape(-1, 1)
        found = learn(_lattice_of(shared.value), ordered.column("word").to_pylist(), counts, rounds)
        return pa.table({"lang": ordered.column("lang").slice(0, 1).combine_chunks(), "probabilities": pa.array([found[:, 0]], pa.list_(pa.float64()))})

    counted = (
        sample.select("lang", "text").mapInArrow(split, "lang string, word string").groupBy("lang", "word").count()
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word")))
        .where(F.col("place") <= words).select("lang", "word", "count"))
    found = counted.groupBy("lang").applyInArrow(learned, "lang string, probabilities array<double>").toArrow().sort_by("lang")
    if not found.num_rows:
        return LanguageModel([], pieces, np.empty((0, 0)))
    columns = found.column("probabilities").combine_chunks().values.to_numpy().reshape(found.num_rows, -1)
    return LanguageModel(found.column("lang").to_pylist(), pieces, np.ascontiguousarray(columns.T))


def keep_identified(
    df: DataFrame, model: LanguageModel, text_col: str = "text", least_score: float = LEAST_SCORE,
) -> DataFrame:
    """The rows whose text has a language with at least ``least_score``; all columns as they are.

    Texts that are null, empty or without a letter go. Rows that repeat are kept or go alike; an empty table
    stays empty. Only texts are sent to Python and only verdicts come back.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = scorer_of(shared.value)
        for batch in batches:
            verdicts = []
            for start in range(0, len(batch), 512):
                found = scorer.score(batch.slice(start, 512).to_pylist())
                verdicts.extend(lang != UNDECIDED and score >= least_score for lang, score in found)
            yield pa.array(verdicts, pa.bool_())

    return df.where(identified(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))


def identify(
    df: DataFrame, model: LanguageModel, held_out_every: int = 5, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row, from the text alone.

    Texts that are null, empty or without a letter (and all texts, if the model learned no language)
    are ``und`` with score 0. ``held_out`` marks rows whose id's crc32 leaves remainder 0. Equal
    scores go to the language first in alphabet. Repeated rows and null ids are kept.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared.value)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    ids, held, many = (part.column(n).to_pylist() for n in range(3))
                    yield from ((i, h, *s) for i, h, s in zip(ids, held, scorer.score(many)))

        return in_batches(rows(), _RESULT)

    rows = texts(df, id_col, text_col).select("doc_id", (id_remainder(held_out_every) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
