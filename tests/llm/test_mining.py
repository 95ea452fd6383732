"""Collocations, lexical search and language-model scores, beside brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

import check
from rentlens.llm import collocations, context_tree, lexical
from rentlens.llm.common import id_remainder
from rentlens.llm.queries import ORACLES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score int, n string, rank int"


def documents(spark, rows):
    """(id, text, language) beside columns whose names clash with results."""
    return spark.createDataFrame([(*row, 1, "x", 2) for row in rows], SCHEMA)


@pytest.mark.parametrize("name", ["op11_collocations", "op12_lexical_search"])
def test_query_agrees_with_sql_on_more_rows(spark, name):
    assert check.compare(spark, check.oracle_connection(SF), SF, name) == ""


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# Collocations


def phrases_by_hand(rows, wanted):
    f = defaultdict(Counter)
    n = Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for size in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found = []
        for phrase, a in counts.items():
            if len(phrase) < 2 or a < 10:
                continue
            cuts = [(10**6 * a * a // (counts[phrase[:k]] * counts[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            longer = [b for p, b in counts.items() if len(p) == 3 > len(phrase) and b >= 10 and phrase in (p[:2], p[1:])]
            if any(100 * b >= 50 * a for b in longer):
                continue
            found.append((-score, -a, " ".join(phrase).encode(), counts[phrase[:k]], counts[phrase[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:wanted], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out, key=repr)


def spoken(seed, size):
    """Texts of a small vocabulary with set phrases, in languages of unlike size, with odd rows."""
    draw = random.Random(seed)
    vocabulary = ["a", "b", "The", "the", "é", "z9", "new", "york", "city", "San", "ma", "rino"]
    rows = [(1, None, "en"), (2, "", "en"), (3, "a b", None), (4, " ,;:!? \n\t", "fr"), (None, "new york city. " * 40, "de")]
    for n in range(size):
        words = [draw.choice(["new york city", "San ma rino", "a b"] + vocabulary) for _ in range(draw.randrange(12))]
        rows.append((n % 50, draw.choice([" ", "\t ", ", ", "\r\n"]).join(words), draw.choice(["en", "en", "en", "fr", None])))
    return rows + rows[:20]


@pytest.mark.parametrize("wanted,reach,limits", [
    (2000, 4, {}), (5, 1, {}), (12, 1, {"NUMBERED_WORDS": 3}), (3, 2, {"FRONTIER_PAIRS": 2}),
    (25, 1, {"CHUNK_BYTES": 50, "HELD_PHRASES": 20, "HELD_WORDS": 5}), (25, 1, {"NUMBERED_WORDS": 0})])
def test_collocations_by_hand(spark, rows, monkeypatch, wanted, reach, limits):
    for name, value in limits.items():
        monkeypatch.setattr(collocations, name, value)
    texts = spoken(wanted, 400)
    assert rows(collocations.collocations(documents(spark, texts).repartition(5), wanted, reach)) == phrases_by_hand(texts, wanted)


def test_collocation_ties_past_the_wanted_ones(spark, rows):
    # All pairs score alike, so only the byte order of the phrases tells the first ones.
    texts = [(n, f"w{n % 40:02d} é{n % 40:02d}", "en") for n in range(400)]
    got = rows(collocations.collocations(documents(spark, texts), 7, 1))
    assert got == phrases_by_hand(texts, 7) and len(got) == 7


def test_scores_stay_exact_past_64_bits(spark):
    values = [(10**13 + 7, 10**13 + 9, 3 * 10**13 + 1), (3, 7, 11), (10, 10, 10)]
    got = spark.createDataFrame(values, "a long, l long, r long").select(collocations._score("a", "l", "r")).collect()
    assert [row[0] for row in got] == [10**6 * a * a // (l * r) for a, l, r in values]


def test_collocations_of_nothing(spark):
    for texts in ([], [(1, None, None)], [(1, "one two three", "en")]):
        assert collocations.collocations(documents(spark, texts)).collect() == []


# Lexical search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))


def search_by_hand(docs, items, k=20):
    found = [(doc_id, Counter(terms(text))) for doc_id, text, _ in docs]
    found = [(doc_id, c) for doc_id, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(term for _, c in found for term in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        scored = []
        for doc_id, c in found:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        scored.sort(key=lambda row: (row[0], row[1], row[2] or 0))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def word(n):
    return "".join(chr(97 + n // 26**k % 26) for k in range(3))


def library(seed, size):
    draw = random.Random(seed)
    rows = [(None, "aaa baa", "x"), (None, "Aaa-BAA", "x"), (7, None, "x"), (8, "", "x"), (9, " -.\x00\x7f", "x"), (5, "é日本 x²", "x")]
    rows += [(n, " ".join(word(min(int(draw.expovariate(0.05)), 700)) for _ in range(draw.randrange(60))), "x") for n in range(size)]
    return rows + rows[10:30] + [(900, "aaa " * 50_000 + "baa", "x")]


def questions(seed):
    draw = random.Random(seed)
    items = [(1, "aaa baa aaa"), (2, None), (3, ""), (4, "unknown"), (5, "É日本 é日本 x²"), (1, "caa"), (1, "caa"), (None, "daa aaa")]
    return items + [(10 + n, " ".join(word(draw.randrange(120)) for _ in range(draw.choice([3, 9, 70])))) for n in range(12)]


@pytest.mark.parametrize("block_terms,cells", [(8192, 8 << 20), (20, 3000)])
def test_lexical_search_by_hand(spark, rows, monkeypatch, block_terms, cells):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(lexical, "TABLE_CELLS", cells)
    docs, items = library(3, 300), questions(4)
    table = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    assert rows(lexical.search(documents(spark, docs).repartition(3), table)) == search_by_hand(docs, items)


def test_few_masks_are_scored():
    """Groups whose bound cannot matter are not looked at, and the best ones are those of all documents."""
    draw = np.random.default_rng(1)
    present = draw.random((9, 5000)) < np.linspace(0.02, 0.7, 9)[:, None]
    impacts = np.where(present, draw.integers(300, 900, present.shape), 0)
    weights = np.linspace(5000, 10, 9).astype(np.int64)
    best = lexical.Best(20)
    scored = lexical.rank_by_masks(present, impacts, weights, list(range(5000)), best)
    whole = weights @ impacts
    assert best.rows == sorted(((int(s), n) for n, s in enumerate(whole) if s), key=lambda r: (-r[0], r[1]))[:20]
    assert scored < 500


@pytest.mark.parametrize("n_terms", [1, 8, 64, 65, 200])
def test_groups_by_mask(n_terms):
    present = np.random.default_rng(n_terms).random((n_terms, 300)) < 0.01
    held, group, bits = lexical.group_by_mask(present)
    assert list(held) == [n for n in range(300) if present[:, n].any()]
    assert (bits[group].T.astype(bool) == present[:, held]).all()
    assert len({row.tobytes() for row in bits}) == len(bits)


def test_lexical_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "aaa")], "item_id long, text string")
    for docs in ([], [(1, None, "x")], [(1, "bbb", "x")]):
        assert lexical.search(documents(spark, docs), items).collect() == []
    assert lexical.search(documents(spark, library(1, 5)), items.where("false")).collect() == []


# Language model


def tree_by_hand(texts, depth):
    """Next-bit probability by the definition, in exact fractions."""
    seen = defaultdict(lambda: [0, 0])

    def steps(text):
        data = [0xFF] * depth + list(text) + [0xFF]
        for at in range(depth, len(data)):
            place = 1
            for shift in range(7, -1, -1):
                bit = data[at] >> shift & 1
                yield tuple(data[at - k] for k in range(1, depth + 1)), place, bit
                place = 2 * place + bit

    for text in texts:
        for context, place, bit in steps(text):
            for size in range(depth + 1):
                seen[context[:size], place][bit] += 1
    longer = defaultdict(set)
    for context, place in seen:
        if context:
            longer[context[:-1], place].add((context, place))

    def kt(a, b):
        p = Fraction(1)
        for n in range(a):
            p *= Fraction(2 * n + 1, 2 * (n + 1))
        for n in range(b):
            p *= Fraction(2 * n + 1, 2 * (a + n + 1))
        return p

    weighted = {}
    for node in sorted(seen, key=lambda node: -len(node[0])):
        own = kt(*seen[node])
        weighted[node] = own if len(node[0]) == depth else (own + math.prod(weighted[c] for c in longer[node])) / 2

    def one(context, place, size=0):
        node = context[:size], place
        if node not in seen:
            return None
        a, b = seen[node]
        here, stop = Fraction(2 * b + 1, 2 * (a + b + 1)), kt(a, b) / 2 / weighted[node]
        below = one(context, place, size + 1) if size < depth else None
        return here if below is None else stop * here + (1 - stop) * below

    def score(text):
        total = 0.0
        for context, place, bit in steps(text):
            p = one(context, place)
            p = Fraction(1, 2) if p is None else p
            total += math.log10(p if bit else 1 - p)
        return total

    return score


def model_by_hand(rows, depth):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _, _ in rows]
    texts = [(t or "").encode() for _, t, _ in rows]
    counts = Counter(w for t, h in zip(texts, held) if not h for w in t.lower().split() + [b""])
    n, v = sum(counts.values()), len(counts)
    tree = tree_by_hand([t for t, h in zip(texts, held) if not h], depth)
    out = []
    for (doc_id, _, _), text, h in zip(rows, texts, held):
        words = text.lower().split() + [b""]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        out.append((doc_id, h, len(words), sum(counts[w] > 0 for w in words), n, base, tree(text)))
    return out


LETTERS = [
    (1, "the cat sat on the mat", "x"), (2, "The dog ate", "x"), (3, None, "x"), (4, "", "x"), (None, "the\x0bcat\x1cx", "x"),
    (5, "éé 日本", "x"), (6, "zzzz qq the", "x"), (7, "the cat sat", "x"), (7, "the cat sat", "x"), (8, " \n", "x"), (9, "cat the dog", "x"),
    (10, "sat", "x"), (11, "QQ zz", "x"), (13, "mat mat", "x"),
]


@pytest.mark.parametrize("depth,split,strings,hot", [(2, 1, 1 << 20, 100), (3, 2, 0, 2), (2, 2, 0, 0)])
def test_model_by_hand(spark, depth, split, strings, hot):
    got = context_tree.score(
        documents(spark, LETTERS).repartition(3), id_remainder(7) != 2, depth, split,
        broadcast_strings=strings, hot_words=hot, block_bytes=40)
    rows = got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte", "n_bytes").collect()
    key = lambda row: (row[0] is None, row[0] or 0, row[6])
    expected = sorted(model_by_hand(LETTERS, depth), key=key)
    assert any(e[1] for e in expected) and len(rows) == len(expected)
    for row, e in zip(sorted(rows, key=key), expected):
        assert row[:5] == e[:5]
        assert row[5:7] == pytest.approx(e[5:7], rel=1e-9, abs=1e-9)
        assert row.bits_per_byte == pytest.approx(-e[6] * math.log2(10) / (row.n_bytes + 1))


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.9, 8.0, 33.3, 1e6 + 0.5, 1e13])
    assert context_tree.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-13, abs=1e-13)


def test_held_and_cut_counts_agree(spark, rows, monkeypatch):
    """Parts that a task gives up early add up to the same model."""
    docs = documents(spark, LETTERS).coalesce(1)
    whole = rows(context_tree.score(docs, id_remainder(7) != 2, 3, 1).select("doc_id", "n_known", "score"))
    for name, value in (("HELD_STRINGS", 8), ("HELD_WORDS", 3), ("CHUNK_BYTES", 5)):
        monkeypatch.setattr(context_tree, name, value)
    parts = rows(context_tree.score(docs, id_remainder(7) != 2, 3, 1).select("doc_id", "n_known", "score"))
    assert [p[:2] for p in parts] == [w[:2] for w in whole]
    assert [p[2] for p in parts] == pytest.approx([w[2] for w in whole])


def test_model_of_nothing(spark):
    assert context_tree.score(documents(spark, []), id_remainder(7) != 2).collect() == []
    got = context_tree.score(documents(spark, [(1, "a b", "x")]), id_remainder(7) != id_remainder(7)).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (3, 0, 0, 0.0)
    assert got.score == pytest.approx(4 * 8 * math.log10(0.5))


def test_texts_like_the_corpus_cost_fewer_bits(spark):
    """Held-out documents of the sample are cheaper than their bytes in another order."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = docs.where(id_remainder(7) == 2).selectExpr("doc_id", "reverse(text) AS text")
    both = context_tree.score(docs.unionByName(odd), id_remainder(7) != 2).where("held_out AND n_bytes > 200")
    bits = defaultdict(list)
    for row in both.collect():
        bits[row.doc_id].append(row.bits_per_byte)
    assert all(len(pair) == 2 for pair in bits.values())
    forward = docs.where(id_remainder(7) == 2).count()
    assert forward > 50 and np.mean([max(p) - min(p) for p in bits.values()]) > 0.5
    assert np.mean([min(p) for p in bits.values()]) < 3.0
