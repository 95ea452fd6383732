"""Personal data: fixed patterns, extended by a skip-chain conditional random field.

The patterns give the base spans. The field labels the tokens of a document that hold a digit or
an ``@`` (all others are outside by definition): each token's features speak for a label,
neighbouring tokens share a potential, and so do distant tokens that are repeated or similar (the
same token but for case and punctuation, or the same seven or more digits): each set of them has a
hub, to which all its tokens are linked. Tokens inside base spans hold their label, and so do hubs
of such a token (the label that most of them have); loopy message passing over chain and hub edges,
until the messages settle, carries it to the rest, so what is a telephone number in one place of a
document speaks for one in every place, however far or often. Tokens that end with
a kind's belief of at least ``BELIEF`` become added spans.

The field is learned from the base spans of a bounded sample, by pseudo-likelihood, without
telling it which tokens the patterns cover.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_text, in_batches, texts

# Kinds in the order in which spans at one place are listed.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)
BELIEF = 0.6
# Messages have settled when none changes by more than this; after so many rounds the steps get shorter,
# so that fields without a fixed point end too.
SETTLED = 1e-3
ROUNDS = 100
# Bounds of the training sample: documents, and tokens of each.
FIT_DOCUMENTS = 2000
FIT_TOKENS = 200
FEATURES = 2048
STEPS = 300
# A clamped token's potential for its own label.
CLAMP = 30.0

# The base patterns. Local parts and digit runs are found from the inside, which
# gives the same matches in linear time on any text.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARKS = re.compile(r"[0-9@]")
_BLANK = re.compile(r"\s")

Span = tuple[int, int, int]  # start, kind number, end

_RESULT = pa.schema([
    ("doc_id", pa.int64()), *((f"n_{kind}", pa.int64()) for kind in KINDS), ("base_sha256", pa.string()),
    ("spans", pa.string()), ("n_added", pa.int64())])
_NODES = pa.schema([
    ("doc", pa.int64()), ("node", pa.int32()), ("label", pa.int32()), ("adjacent", pa.bool_()), ("alike", pa.int32()),
    ("features", pa.list_(pa.int32()))])


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            end = domain.end()
        at = text.find("@", max(at + 1, end))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    run: list[tuple[int, int]] = []
    for match in _DIGITS.finditer(text):
        joined = run and match.start() == run[-1][1] + 1 and text[run[-1][1]] == "."
        run = [*run, match.span()] if joined else [match.span()]
        if len(run) == 4:
            # Leading zeros do not count, however many.
            parts = [text[a:b].lstrip("0") for a, b in run]
            if all(len(part) <= 3 and int(part or 0) <= 255 for part in parts):
                yield run[0][0], run[3][1]
            run = []


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and kind."""
    spans: list[Span] = []
    if "@" in text:
        spans += ((start, 0, end) for start, end in _emails(text))
    if _DIGITS.search(text):
        spans += ((start, 1, end) for start, end in _addresses(text))
        for match in _CARD.finditer(text):
            digits = match.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((match.start(), 2, match.end()))
        if "+" in text:
            for match in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in match.group()) <= 15:
                    spans.append((match.start(), 3, match.end()))
    return sorted(spans)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


# The graph of a document -------------------------------------------------------------------

@dataclass
class Graph:
    tokens: list[tuple[int, int]]
    label: np.ndarray  # of the base span over the token, 0 without one
    adjacent: np.ndarray  # whether the token follows the one before directly
    alike: np.ndarray  # number of the last similar token before, -1 without one
    features: list[list[int]]
    sets: list[tuple[int, ...]]  # numbers of similar tokens, two at least


def _marked_tokens(text: str) -> list[tuple[int, int]]:
    tokens: list[tuple[int, int]] = []
    end = 0
    mark = _MARKS.search(text)
    while mark:
        start = mark.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        blank = _BLANK.search(text, mark.end())
        end = blank.start() if blank else len(text)
        tokens.append((start, end))
        mark = _MARKS.search(text, end)
    return tokens


def _shape(token: str) -> str:
    shape = re.sub(r"[^\W\d_]+", "a", token)
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 20)}", shape)[:40]


def _feature(name: str, value: str) -> int:
    return zlib.crc32(f"{name}={value}".encode()) % FEATURES


def _features(token: str, before: str, after: str) -> list[int]:
    core = token.strip("!?.,;:#$%&*\"'|[]{}<>")
    digits = "".join(c for c in core if "0" <= c <= "9")
    other = re.sub(r"[0-9]", "", core)
    return sorted({
        _feature("bias", ""), _feature("shape", _shape(core)), _feature("digits", str(min(len(digits), 20))),
        _feature("luhn", f"{12 <= len(digits) <= 19 and luhn(digits)} {not other.strip(' -')}"),
        _feature("at", str(core.count("@"))), _feature("dots", str(min(core.count("."), 4))),
        _feature("letters", str(any(c.isalpha() for c in core))), _feature("plus", str(core[:1] == "+")),
        _feature("small", str(core.count(".") == 3 and all(len(p) <= 3 and p.isdigit() and int(p) <= 255 for p in core.split(".")))),
        _feature("before", _shape(before)[-6:]), _feature("after", _shape(after)[:6]),
    })


def _neighbour(text: str, at: int, step: int) -> str:
    """The token beside a position, at most 24 characters of it."""
    part = text[at:at + 32] if step > 0 else text[max(0, at - 32):at]
    words = part.split()
    return (words[0][:24] if step > 0 else words[-1][-24:]) if words else ""


def graph_of(text: str, spans: list[Span]) -> Graph:
    tokens = _marked_tokens(text)
    label = np.zeros(len(tokens), np.int64)
    adjacent = np.zeros(len(tokens), bool)
    alike = np.full(len(tokens), -1)
    features = []
    last: dict[str, int] = {}
    members: dict[str, list[int]] = {}
    open_spans = [(start, end, kind + 1) for start, kind, end in spans]
    first = 0
    for n, (start, end) in enumerate(tokens):
        while first < len(open_spans) and max(e for _, e, _ in open_spans[first:first + 4]) <= start:
            first += 1
        for span_start, span_end, kind in open_spans[first:]:
            if span_start >= end:
                break
            if span_end > start:
                label[n] = kind
                break
        adjacent[n] = n > 0 and 0 < start - tokens[n - 1][1] <= 2 and text[tokens[n - 1][1]:start].isspace()
        token = text[start:end]
        digits = "".join(c for c in token if "0" <= c <= "9")
        names = [re.sub(r"[\W_]+", "", token).lower()] + ([f"#{digits}"] if len(digits) >= 7 else [])
        alike[n] = max((last.get(name, -1) for name in names), default=-1)
        last.update(dict.fromkeys(names, n))
        for name in names:
            members.setdefault(name, []).append(n)
        features.append(_features(token, _neighbour(text, start, -1), _neighbour(text, end, 1)))
    # The same tokens by two names are one set.
    sets = list(dict.fromkeys(tuple(numbers) for numbers in members.values() if len(numbers) > 1))
    return Graph(tokens, label, adjacent, alike, features, sets)


# The field ---------------------------------------------------------------------------------

@dataclass(frozen=True, eq=False)
class Field:
    weights: np.ndarray  # features x labels
    chain: np.ndarray  # label of a token x label of the next one
    skip: float  # agreement of similar tokens

    def beliefs(self, graph: Graph) -> np.ndarray:
        """Marginal beliefs, tokens x labels, after loopy message passing."""
        tokens = len(graph.features)
        unary = np.zeros((tokens + len(graph.sets), len(LABELS)))
        unary[:tokens] = [self.weights[f].sum(axis=0) for f in graph.features]
        held = np.flatnonzero(graph.label > 0)
        unary[held, graph.label[held]] += CLAMP
        member = np.array([n for numbers in graph.sets for n in numbers], int)
        hub = np.repeat(np.arange(len(graph.sets)) + tokens, [len(numbers) for numbers in graph.sets])
        # A hub holds the label that most held tokens of its set have.
        seen = np.zeros_like(unary)
        np.add.at(seen, (hub, graph.label[member]), graph.label[member] > 0)
        hubs = np.flatnonzero(seen.any(axis=1))
        unary[hubs, seen[hubs].argmax(axis=1)] += CLAMP
        chained = np.flatnonzero(graph.adjacent)
        # Directed edges: each of the two directions of chain and hub edges.
        source = np.concatenate([chained - 1, chained, hub, member])
        target = np.concatenate([chained, chained - 1, member, hub])
        if not len(source):
            return _softmax(unary)
        c, s = len(chained), len(member)
        agree = self.skip * np.eye(len(LABELS))
        potential = np.concatenate([
            np.broadcast_to(self.chain, (c, *self.chain.shape)), np.broadcast_to(self.chain.T, (c, *self.chain.shape)),
            np.broadcast_to(agree, (2 * s, *agree.shape))])
        back = np.concatenate([np.arange(c) + c, np.arange(c), np.arange(s) + 2 * c + s, np.arange(s) + 2 * c])
        messages = np.zeros((len(source), len(LABELS)))
        n, change = 0, np.inf
        while change > SETTLED:
            total = unary.copy()
            np.add.at(total, target, messages)
            outgoing = (total[source] - messages[back])[:, :, None] + potential
            top = outgoing.max(axis=1, keepdims=True)
            fresh = np.log(np.exp(outgoing - top).sum(axis=1)) + top[:, 0, :]
            fresh -= fresh.max(axis=1, keepdims=True)
            step = 0.5 * (fresh - messages) * 0.9 ** max(0, n - ROUNDS)
            messages = messages + step
            n, change = n + 1, np.abs(step).max()
        total = unary.copy()
        np.add.at(total, target, messages)
        return _softmax(total[:tokens])

    def added_spans(self, text: str, base: list[Span]) -> list[Span]:
        """Spans of tokens that the field labels and no base span touches; neighbours of one kind are one."""
        graph = graph_of(text, base)
        if not graph.tokens or not (graph.label == 0).any():
            return []
        beliefs = self.beliefs(graph)
        kind = np.where(beliefs[:, 1:].max(axis=1) >= BELIEF, beliefs[:, 1:].argmax(axis=1) + 1, 0)
        spans: list[Span] = []
        joined = False
        for n, (start, end) in enumerate(graph.tokens):
            if not kind[n] or graph.label[n]:
                joined = False
                continue
            token = text[start:end]
            left = start + len(token) - len(token.lstrip("!?.,;:#$%&*\"'|[]{}<>"))
            right = start + len(token.rstrip("!?.,;:#$%&*\"'|[]{}<>"))
            if joined and graph.adjacent[n] and spans[-1][1] == kind[n] - 1 == 3:
                spans[-1] = (spans[-1][0], spans[-1][1], right)
            elif left < right:
                spans.append((left, int(kind[n]) - 1, right))
            joined = left < right
        return spans


def _softmax(logits: np.ndarray) -> np.ndarray:
    odds = np.exp(logits - logits.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def learn(rows: list[tuple[int, int, int, bool, int, list[int]]], steps: int = STEPS) -> Field:
    """Pseudo-likelihood: each token's label given its features and its neighbours' labels.

    ``rows`` are (document, node, label, adjacent, alike, features), by document and node.
    """
    labels = len(LABELS)
    if not rows:
        bias = np.zeros((FEATURES, labels))
        bias[_feature("bias", ""), 0] = 10.0
        return Field(bias, np.zeros((labels, labels)), 1.0)
    label = np.array([row[2] for row in rows])
    one_hot = np.eye(labels)[label]
    number = {(row[0], row[1]): n for n, row in enumerate(rows)}
    later = np.array([n for n, row in enumerate(rows) if row[3] and (row[0], row[1] - 1) in number], int)
    pairs = [(n, number[row[0], row[4]]) for n, row in enumerate(rows) if row[4] >= 0 and (row[0], row[4]) in number]
    pairs = np.array(pairs, int).reshape(-1, 2)
    owner = np.repeat(np.arange(len(rows)), [len(row[5]) for row in rows])
    feature = np.concatenate([row[5] for row in rows]).astype(int)
    alike = np.zeros((len(rows), labels))
    np.add.at(alike, pairs[:, 0], one_hot[pairs[:, 1]])
    np.add.at(alike, pairs[:, 1], one_hot[pairs[:, 0]])
    weights, chain, skip = np.zeros((FEATURES, labels)), np.zeros((labels, labels)), 1.0
    # Gradient ascent with per-weight steps (Adagrad) and a small quadratic penalty.
    seen = [np.full(weights.shape, 1e-6), np.full(chain.shape, 1e-6), 1e-6]
    for _ in range(steps):
        logits = np.zeros((len(rows), labels))
        np.add.at(logits, owner, weights[feature])
        logits[later] += chain[label[later - 1]]
        logits[later - 1] += chain[:, label[later]].T
        logits += skip * alike
        error = (one_hot - _softmax(logits)) / len(rows)
        step = np.zeros_like(weights)
        np.add.at(step, feature, error[owner])
        step -= 1e-5 * weights
        chain_step = -1e-5 * chain
        np.add.at(chain_step, label[later - 1], error[later])
        np.add.at(chain_step.T, label[later], error[later - 1])
        skip_step = float((error * alike).sum()) - 1e-5 * skip
        for n, gradient in enumerate((step, chain_step, skip_step)):
            seen[n] = seen[n] + gradient ** 2
        weights = weights + 0.5 * step / np.sqrt(seen[0])
        chain = chain + 0.2 * chain_step / np.sqrt(seen[1])
        skip = max(0.0, skip + 0.2 * skip_step / seen[2] ** 0.5)
    return Field(weights, chain, skip)


def fit(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    documents: int = FIT_DOCUMENTS, tokens: int = FIT_TOKENS,
) -> Field:
    """Learn the field from at most about ``documents`` texts with a digit or ``@``, those whose ids hash lowest."""
    marked = texts(df, id_col, text_col).where(F.col("text").rlike("[0-9@]")).withColumn("order", F.xxhash64("doc_id", "text"))
    # Only hashes are sorted; the texts stay in their tasks.
    lowest = marked.select("order").orderBy("order").limit(documents).agg(F.max("order")).first()[0]
    if lowest is None:
        return learn([])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for order, text in id_text(batch):
                    graph = graph_of(text, base_spans(text))
                    parts = zip(graph.label.tolist(), graph.adjacent.tolist(), graph.alike.tolist(), graph.features)
                    for n, (label, adjacent, alike, features) in enumerate(parts):
                        if n == tokens:
                            break
                        yield order, n, label, adjacent, alike, features

        return in_batches(rows(), _NODES)

    found = (
        marked.where(F.col("order") <= lowest).dropDuplicates(["order"]).select("order", "text")
        .mapInArrow(nodes, "doc long, node int, label int, adjacent boolean, alike int, features array<int>")
        .toArrow().sort_by([("doc", "ascending"), ("node", "ascending")]))
    return learn(list(zip(*(column.to_pylist() for column in found.columns))))


@functools.lru_cache(maxsize=65536)
def _digest(listing: str) -> str:
    return hashlib.sha256(listing.encode()).hexdigest()


def find_personal_data(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: one row per input row.

    The counts and the digest are of the base spans; ``spans`` lists base and added ones as
    ``kind:start:end`` (code points, end exclusive) by start, then kind; ``n_added`` counts the added
    ones. Null and empty texts have no spans. Null ids and repeated rows are kept; an empty table gives
    no rows; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in id_text(batch):
                    base = base_spans(text)
                    added = model.added_spans(text, base)
                    counts = [sum(kind == n for _, kind, _ in base) for n in range(len(KINDS))]
                    yield doc_id, *counts, _digest(listed(base)), listed(sorted(base + added)), len(added)

        return in_batches(rows(), _RESULT, 6)

    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    return texts(df, id_col, text_col).mapInArrow(
        run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union is one."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_personal_data(df: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The table with personal data in ``text_col`` replaced by ``[kind]``; nulls stay null, other columns as they are."""
    shared = df.sparkSession.sparkContext.broadcast(field)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def clean(text: str | None) -> str | None:
            if text is None or not _MARKS.search(text):
                return text
            base = base_spans(text)
            return masked(text, base + model.added_spans(text, base))

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                cleaned = pa.array([clean(text) for text in part.column(place).to_pylist()], part.schema.field(place).type)
                yield part.set_column(place, part.schema.field(place), cleaned)

    return df.mapInArrow(run, df.schema)
