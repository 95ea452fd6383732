"""Byte pair encoding and decoding by recursive queries.

Texts are cut into matches of the split pattern ("words"). Each task encodes the distinct words
that it has not met before, many at once, in an in-memory database of its own:

* a row per byte of a word (word, position, token),
* joined with the merge table (left, right -> token, whose id is its rank) on neighbours,
* each word's leftmost pair of least rank is contracted, again and again, until nothing joins.

An ordered aggregation over the remaining rows gives a word's ids and, through the vocabulary,
its bytes. Documents are the ordered concatenation of their words.

A recursion needs a round per merge, so words of more than ``LONG_WORD`` bytes (a run of letters
without any space) are contracted with a heap instead, by the same rule.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .chunks import REMEMBERED_CHARS, independent, little_endian, read_ranks
from .common import id_text, in_batches, kept_by_worker, texts

LONG_WORD = 256
CACHED_CHUNKS = CACHED_WORDS = 500_000
# Characters of text whose words are resolved together, and words in one query.
TEXT_AT_ONCE = 6_000_000
WORDS_AT_ONCE = 60_000

_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

# Rows are linked: each knows the next position and its token. A key holds a merge's id, its
# position and the position it absorbs, 20 bits each for positions, so the least key is the
# leftmost pair of least rank.
_ENCODE = """
WITH RECURSIVE pieces AS (
  SELECT word, pos, token, lead(token) OVER w AS following, lead(pos) OVER w AS next, 0 AS round
  FROM start_rows WINDOW w AS (PARTITION BY word ORDER BY pos)
  UNION ALL
  SELECT p.word, p.pos,
    CASE WHEN p.pos = best.pos THEN best.id ELSE p.token END,
    CASE WHEN p.pos = best.pos THEN best.following WHEN p.next = best.pos THEN best.id ELSE p.following END,
    CASE WHEN p.pos = best.pos THEN best.next ELSE p.next END,
    p.round + 1
  FROM pieces p JOIN (
    SELECT k.word, (k.key >> 40)::INTEGER AS id, (k.key >> 20) & 1048575 AS pos, gone.pos AS absorbed,
      gone.following, gone.next
    FROM (
      SELECT q.word, min((m.id::BIGINT << 40) + (q.pos::BIGINT << 20) + q.next) AS key
      FROM pieces q JOIN merges m ON q.token = m.lft AND q.following = m.rgt GROUP BY q.word
    ) k JOIN pieces gone ON gone.word = k.word AND gone.pos = k.key & 1048575
  ) best ON p.word = best.word AND p.pos <> best.absorbed
), final AS (
  SELECT word, pos, token FROM pieces JOIN (SELECT word, max(round) AS round FROM pieces GROUP BY word) USING (word, round)
)
SELECT f.word, string_agg(v.spelled, '' ORDER BY f.pos) AS spelled
FROM final f JOIN vocabulary v ON f.token = v.id GROUP BY f.word
"""


# Ids are spelled as characters from here on; words are parted by another that is neither.
_ID_BASE = 0x20000
_PART = "\U0001ffff"
_ID_CHARACTERS = re.compile(f"[{chr(_ID_BASE)}-{chr(0x10FFFF)}]+")
_BYTE_CHARACTERS = re.compile("[\x00-\xff]+")


def _taken_apart(spelled: list[str]) -> tuple[list[bytes], list[bytes]]:
    """Ids (little-endian 32-bit integers) and bytes of spelled words, all words at once."""
    joined = _PART.join(spelled)
    decoded = [text.encode("latin-1") for text in _ID_CHARACTERS.sub("", joined).split(_PART)]
    codes = np.frombuffer(_BYTE_CHARACTERS.sub("", joined).encode("utf-32-le"), "<u4")
    ends = [*np.flatnonzero(codes == ord(_PART)).tolist(), len(codes)]
    raw = (codes - np.uint32(_ID_BASE)).astype("<u4").tobytes()
    starts = [0, *(end + 1 for end in ends[:-1])]
    return [raw[4 * start:4 * end] for start, end in zip(starts, ends)], decoded


class RecursiveEncoder:
    """Ids and decoded bytes of texts, for a rank file and a split pattern."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = read_ranks(raw)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([byte])] for byte in range(256)], np.int32)
        # By part (what follows a space), and by word: (ids, bytes).
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}
        self.words: dict[str, tuple[bytes, bytes]] = {}
        # In memory only: the batches are bounded, so nothing has to spill to a local folder.
        self.database = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        pairs = [
            (self.ranks[token[:cut]], self.ranks[token[cut:]], rank)
            for token, rank in self.ranks.items() for cut in range(1, len(token))
            if token[:cut] in self.ranks and token[cut:] in self.ranks]
        lefts, rights, ids = zip(*pairs) if pairs else ((), (), ())
        self._table("merges", pa.table({
            "lft": pa.array(lefts, pa.int32()), "rgt": pa.array(rights, pa.int32()), "id": pa.array(ids, pa.int32())}))
        self._table("vocabulary", pa.table({
            "id": pa.array(self.bytes_of, pa.int32()),
            # A character for the id, then the token's bytes as characters of Latin-1, so that one
            # ordered aggregation of strings brings both together.
            "spelled": pa.array([chr(_ID_BASE + rank) + token.decode("latin-1") for rank, token in self.bytes_of.items()])}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.database.register("incoming", rows)
        self.database.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.database.unregister("incoming")

    def encode_words(self, words: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """Word -> (ids as little-endian 32-bit integers, the bytes that these ids stand for)."""
        out = {}
        short = []
        for word in words:
            if len(word) > LONG_WORD:
                ids = self._by_heap(word)
                out[word] = little_endian(ids), b"".join(map(self.bytes_of.__getitem__, ids))
            elif word in self.ranks:  # a word that is a token needs no merging
                out[word] = little_endian([self.ranks[word]]), self.bytes_of[self.ranks[word]]
            else:
                short.append(word)
        for first in range(0, len(short), WORDS_AT_ONCE):
            some = short[first:first + WORDS_AT_ONCE]
            lengths = np.array([len(word) for word in some])
            flat = np.frombuffer(b"".join(some), np.uint8)
            starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
            self.database.register("start_rows", pa.table({
                "word": np.repeat(np.arange(len(some), dtype=np.int32), lengths),
                "pos": (np.arange(len(flat)) - starts).astype(np.int32), "token": self.single[flat]}))
            found = self.database.sql(_ENCODE).to_arrow_table()
            self.database.unregister("start_rows")
            numbers, spelled = (column.to_pylist() for column in found.columns)
            for word, ids, decoded in zip(numbers, *_taken_apart(spelled)):
                out[some[word]] = ids, decoded
        return out

    def _by_heap(self, word: bytes) -> list[int]:
        """The same contraction for a long word: a heap of (rank, position) over a linked list."""
        tokens = [word[i:i + 1] for i in range(len(word))]
        after = [*range(1, len(word) + 1)]
        before = [*range(-1, len(word) - 1)]
        heap: list[tuple[int, int, bytes]] = []

        def offer(at: int) -> None:
            if 0 <= at and after[at] < len(word):
                joined = tokens[at] + tokens[after[at]]
                if joined in self.ranks:
                    heapq.heappush(heap, (self.ranks[joined], at, joined))

        for at in range(len(word)):
            offer(at)
        while heap:
            _, at, joined = heapq.heappop(heap)
            if not tokens[at] or after[at] >= len(word) or tokens[at] + tokens[after[at]] != joined:
                continue  # one of the two has been merged meanwhile
            gone = after[at]
            tokens[at], tokens[gone], after[at] = joined, b"", after[gone]
            if after[gone] < len(word):
                before[after[gone]] = at
            offer(before[at])
            offer(at)
        return [self.ranks[token] for token in tokens if token]

    def encode_many(self, many: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of each text.

        A text is a head and parts that each follow a space. Where white space touches such a
        space the pattern looks over it, and the text is cut by the pattern itself.
        """
        split = [text.split(" ") for text in many]
        heads = [parts.pop(0) for parts in split]
        used = set().union(*split)
        unknown = used.difference(self.ids)
        if len(self.ids) + len(unknown) > CACHED_CHUNKS:  # forget what these texts do not use
            self.ids = {part: ids for part, ids in self.ids.items() if part in used}
            self.decoded = {part: self.decoded[part] for part in self.ids}
        if len(self.words) > CACHED_WORDS:
            self.words = {}
        touching = {part for part in unknown if not independent(part)}
        whole = [
            head[-1:].isspace() and bool(parts) or not touching.isdisjoint(parts) for head, parts in zip(heads, split)]
        # A space and letters are one match of the pattern.
        words_of = {
            part: [" " + part] if part.isalpha() else self.pattern.findall(" " + part) for part in unknown - touching}
        head_words = [self.pattern.findall(text if w else head) for text, head, w in zip(many, heads, whole)]
        new = set().union(*words_of.values(), *head_words).difference(self.words)
        for word, value in self.encode_words([word.encode() for word in new]).items():
            self.words[word.decode()] = value
        words = self.words
        for part, found in words_of.items():
            if len(found) == 1:
                self.ids[part], self.decoded[part] = words[found[0]]
            else:
                self.ids[part] = b"".join([words[word][0] for word in found])
                self.decoded[part] = b"".join([words[word][1] for word in found])
        for parts, found, w in zip(split, head_words, whole):
            rest = [] if w else parts
            yield (
                b"".join([words[word][0] for word in found]) + b"".join(map(self.ids.__getitem__, rest)),
                b"".join([words[word][1] for word in found]) + b"".join(map(self.decoded.__getitem__, rest)))
        for part in words_of:
            if len(part) > REMEMBERED_CHARS:
                del self.ids[part], self.decoded[part]
        for word in new:
            if len(word) > REMEMBERED_CHARS:
                del words[word]


@kept_by_worker
def encoder_of(raw: bytes, pattern: str) -> RecursiveEncoder:
    return RecursiveEncoder(raw, pattern)


def _portions(rows: Iterable[tuple[int | None, str]]) -> Iterator[list[tuple[int | None, str]]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= TEXT_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_and_decode(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per input row.

    Null and empty texts have no ids (the digests are those of nothing). Special strings are ordinary
    text. Null ids and repeated rows are kept; an empty table gives no rows; other columns are not
    read. Only digests leave the tasks; :class:`RecursiveEncoder` gives the ids themselves.
    """
    with open(ranks_path, "rb") as file:
        ranks = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks.value, pattern)

        def rows() -> Iterator[tuple]:
            for held in _portions(row for batch in batches for row in id_text(batch)):
                results = encoder.encode_many([text for _, text in held])
                for (doc_id, _), (ids, decoded) in zip(held, results):
                    yield doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

        return in_batches(rows(), _RESULT)

    return texts(df, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
