"""Token counts by prefix dynamic programming.

A byte pair encoding has one encoding per text, and any two neighbours in it form the encoding
of their own concatenation. So the encoding of a prefix ends in the one token that is a suffix
of it and compatible with the last token of the prefix before that token; the count at the
prefix is one more than the count there. The table of (last token, count) over prefixes answers
every question about truncation or budgets without encoding anything again.

The vocabulary ends words with a mark, so a prefix has two states: ``open`` (the word goes on)
and ``closed`` (the text ends here). Words are independent, so a text's prefix counts are its
words' counts added up, and states are shared by all words that begin alike.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .chunks import byte_alphabet
from .common import id_text, in_batches, kept_by_worker, texts

MAX_TOKENS = 2048
# Entries that a worker remembers: chunks, and open prefixes of words.
CACHED_CHUNKS = 500_000
CACHED_PREFIXES = 500_000
CACHED_PAIRS = 300_000
REMEMBERED_CHARS = 64
# Fixed value: the word pattern of the vocabulary with word ends.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Characters that str.split takes for white space and the vocabulary's pattern does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_CHUNKS = re.compile(r"[\S\x1c-\x1f]+")

_COUNTS = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()),
    ("fitting_chars", pa.int64())])
_PREFIXES = pa.schema([
    ("doc_id", pa.int64()), ("normalized", pa.string()), ("ends", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


class PrefixCounter:
    """Counts of tokens at prefixes, for a word vocabulary file (merges, word-end mark, lower case)."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = set(model["vocab"])
        self.longest = max(map(len, self.vocab))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: n for n, pair in enumerate(merges)}
        self.char_of = {byte: char for char, byte in byte_alphabet().items()}
        special = [token["content"] for token in spec["added_tokens"]]
        self.special = set(special)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.words = regex.compile(WORDS)
        self.open: dict[str, tuple[str, int]] = {"": ("", 0)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunk_counts: dict[str, int] = {}

    # The dynamic programme --------------------------------------------------------------

    def _merged(self, symbols: list[str]) -> list[str]:
        """Plain merging, for the short texts on which compatibility is settled."""
        while len(symbols) > 1:
            ranks = [self.rank.get(pair, 1 << 30) for pair in zip(symbols, symbols[1:])]
            least = min(ranks)
            if least == 1 << 30:
                break
            at = ranks.index(least)
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if not token.endswith(self.end):
            return list(token)
        body = token[:-len(self.end)]
        return [*body[:-1], body[-1] + self.end]

    def _compatible(self, left: str, right: str) -> bool:
        """Are these two (or the right one alone) the encoding of their concatenation?"""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            wanted = [left, right] if left else [right]
            known = self.pairs[key] = self._merged([*left, *self._symbols(right)]) == wanted
        return known

    def _step(self, word: str, states: list[tuple[str, int]], to: int, mark: str) -> tuple[str, int]:
        """State of the prefix ``word[:to]`` from the states of the shorter ones."""
        for start in range(max(0, to - self.longest), to):
            token = word[start:to] + mark
            if token in self.vocab:
                before, count = states[start]
                if self._compatible(before, token):
                    return token, count + 1
        raise ValueError(f"the vocabulary has no symbol for the end of {word[:to][-8:]!r}")

    def open_states(self, word: str) -> list[tuple[str, int]]:
        """(last token, count) at every prefix of a word (in the byte alphabet) that goes on."""
        if len(word) > REMEMBERED_CHARS:
            states = [("", 0)]
            for to in range(1, len(word) + 1):
                states.append(self._step(word, states, to, ""))
            return states
        if len(self.open) >= CACHED_PREFIXES:
            self.open = {"": ("", 0)}
        states = []
        for to in range(len(word) + 1):
            prefix = word[:to]
            state = self.open.get(prefix)
            if state is None:
                state = self.open[prefix] = self._step(word, states, to, "")
            states.append(state)
        return states

    def closed_count(self, word: str, states: list[tuple[str, int]], to: int) -> int:
        """Tokens of ``word[:to]`` as a whole word."""
        return self._step(word, states, to, self.end)[1] if to else 0

    def word_count(self, word: str) -> int:
        spelled = "".join(map(self.char_of.__getitem__, word.encode()))
        return self.closed_count(spelled, self.open_states(spelled[:-1]), len(spelled))

    # Texts ------------------------------------------------------------------------------

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special strings; whether a part is one."""
        if self.splitter is None or "<" not in text:
            return [(text, False)]
        return [(part, part in self.special) for part in self.splitter.split(text) if part]

    @staticmethod
    def normalized(text: str) -> str:
        """Composed, lower case letter by letter; white space is left, as only words count."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _chunk_count(self, chunk: str) -> int:
        count = sum(map(self.word_count, self.words.findall(chunk)))
        if len(chunk) <= REMEMBERED_CHARS:
            if len(self.chunk_counts) >= CACHED_CHUNKS:
                self.chunk_counts.clear()
            self.chunk_counts[chunk] = count
        return count

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        total = 0
        for part, special in self.segments(text):
            if special:
                total += 1
                continue
            part = self.normalized(part)
            chunks = _CHUNKS.findall(part) if _SEPARATORS.search(part) else part.split()
            known = self.chunk_counts
            try:
                total += sum(map(known.__getitem__, chunks))
            except KeyError:
                total += sum(known[c] if c in known else self._chunk_count(c) for c in chunks)
        return total

    def prefixes(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """The normalised text, the ends of its words (and special strings) in it, the count at each end."""
        parts, ends, counts, at = [], [], [], 0
        for part, special in self.segments(text):
            part = part if special else self.normalized(part)
            if special:
                ends.append(at + len(part))
                counts.append(1)
            else:
                for match in self.words.finditer(part):
                    ends.append(at + match.end())
                    counts.append(self.word_count(match.group()))
            parts.append(part)
            at += len(part)
        return "".join(parts), np.array(ends, np.int64), np.cumsum(np.array(counts, np.int64))

    def fitting_chars(self, text: str, budget: int) -> int:
        """Length of the longest prefix of the normalised text with at most ``budget`` tokens."""
        at, left = 0, budget
        for part, special in self.segments(text):
            if special:
                if not left:
                    return at
                left -= 1
                at += len(part)
                continue
            part = self.normalized(part)
            for chunk in _CHUNKS.finditer(part):
                count = self.chunk_counts.get(chunk.group())
                if count is None:
                    count = self._chunk_count(chunk.group())
                if count > left:
                    return at + chunk.start() + self._fitting_in_chunk(chunk.group(), left)
                left -= count
            at += len(part)
        return at

    def _fitting_in_chunk(self, chunk: str, left: int) -> int:
        """The same within a chunk that does not fit as a whole."""
        for match in self.words.finditer(chunk):
            word = match.group()
            count = self.word_count(word)
            if count <= left:
                left -= count
                continue
            spelled = "".join(map(self.char_of.__getitem__, word.encode()))
            states = self.open_states(spelled)
            # A cut inside a word ends it there: the closed count of the part decides.
            to = len(spelled)
            for chars in range(len(word) - 1, 0, -1):
                to -= len(word[chars].encode())
                if self.closed_count(spelled, states, to) <= left:
                    return match.start() + chars
            return match.start()
        return len(chunk)


@kept_by_worker
def counter_of(raw: bytes) -> PrefixCounter:
    return PrefixCounter(raw)


def _file(df: DataFrame, path: str):
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def token_counts(
    df: DataFrame, vocabulary_path: str, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fitting_chars: one row per input row.

    ``fitting_chars`` is the longest prefix of the normalised text within ``max_tokens``, from the
    prefix table (the whole normalised length where nothing is over). A null text counts as empty:
    0 tokens. Null ids and repeated rows are kept as they are; an empty table gives no rows; other
    columns are not read.
    """
    vocabulary = _file(df, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary.value)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in id_text(batch):
                    n = counter.count(text)
                    fitting = counter.fitting_chars(text, max_tokens) if n > max_tokens else len(counter.normalized(text))
                    yield doc_id, len(text.encode()), n, n > max_tokens, fitting

        return in_batches(rows(), _COUNTS)

    return texts(df, id_col, text_col).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long")


def prefix_table(
    df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, normalized, ends, counts: the token count at the end of every word of every text.

    A table to keep: any budget is then a search in ``counts`` (:func:`within_budget`), without the
    vocabulary. Null and empty texts have empty arrays.
    """
    vocabulary = _file(df, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary.value)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in id_text(batch):
                    normalized, ends, counts = counter.prefixes(text)
                    yield doc_id, normalized, ends.tolist(), counts.tolist()

        return in_batches(rows(), _PREFIXES, 1)

    return texts(df, id_col, text_col).mapInArrow(
        run, "doc_id long, normalized string, ends array<int>, counts array<int>")


def within_budget(prefixes: DataFrame, budget: int) -> DataFrame:
    """doc_id and ``truncated``: whole words of each normalised text that fit the budget."""
    words = F.size(F.filter("counts", lambda n: n <= budget))
    return prefixes.select(
        "doc_id", F.substring("normalized", F.lit(1), F.coalesce(F.get("ends", words - 1), F.lit(0))).alias("truncated"))
