"""Exact and near duplicates and components, beside brute force and SQL."""

import hashlib
import random
from collections import defaultdict

import pytest

import check
from conftest import SMALLEST
from rentlens.llm import components, exact_dedup, minhash
from rentlens.llm.queries import ORACLES

BLANK = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert check.compare(spark, check.oracle_connection(SMALLEST), SMALLEST, name) == ""


def documents(spark, rows, schema="doc_id long, text string, kept string, Content int"):
    """Documents beside columns whose names clash with results."""
    return spark.createDataFrame([(doc_id, text, "x", 1) for doc_id, text in rows], schema)


EDGE_ROWS = [
    (5, "a b"), (3, "ab "), (9, " a\tb\n"), (9, " a\tb\n"), (None, "ab"), (1, None), (2, ""), (4, " \n"),
    (7, "é b"), (8, "éb"), (6, "word " * 30_000), (10, "word " * 30_000 + " "),
]


def exact_by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        content = "".join(c for c in text or "" if c not in BLANK)
        groups[content].append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for content, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        digest = hashlib.sha256(content.encode()).hexdigest()
        out += [(m[2], members[0][2], len(members), place == 0, digest) for place, m in enumerate(members)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("salts", [1, 3])
def test_exact_dedup_of_odd_rows(spark, rows, salts):
    assert rows(exact_dedup.exact_dedup(documents(spark, EDGE_ROWS), salts=salts)) == exact_by_hand(EDGE_ROWS)


def test_exact_dedup_of_a_hot_group(spark, rows):
    many = [(n, "same text" if n % 3 == 0 else f"text {n % 50}") for n in range(600)]
    df = documents(spark, many).repartition(7, "doc_id")
    assert rows(exact_dedup.exact_dedup(df, salts=4)) == exact_by_hand(many)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(documents(spark, [])).collect() == []


def by_hand(likeness, rows):
    """Components from all pairs of full sets."""
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        size = min(likeness.words, len(words))
        sets[doc_id] = {tuple(words[n:n + size]) for n in range(len(words) - size + 1)} if words else set()
    root = {doc_id: doc_id for doc_id in sets}
    changed = True
    while changed:
        changed = False
        for one in sets:
            for other in sets:
                union = len(sets[one] | sets[other])
                if sets[one] and sets[other] and 100 * len(sets[one] & sets[other]) >= likeness.percent * union:
                    least = min(root[one], root[other])
                    changed |= root[one] != least or root[other] != least
                    root[one] = root[other] = least
    return sorted(((d, len(sets[d]), root[d], root[d] == d) for d in sets), key=repr)


def near_copies(seed, groups, copies, words):
    rng = random.Random(seed)
    rows = []
    for group in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(5)):
                text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize("likeness", [minhash.Likeness(), minhash.FIVE_WORDS])
def test_near_duplicates_are_those_of_all_pairs(spark, rows, likeness):
    some = near_copies(1, 6, 12, 70) + [(900, "a b"), (901, "A  b"), (902, ""), (903, None), (904, "one"), (905, " \n")]
    assert rows(minhash.near_duplicates(documents(spark, some), likeness)) == by_hand(likeness, some)


def test_large_buckets_meet_in_blocks(spark, rows):
    """Blocks of four rows: links across blocks are found too."""
    some = near_copies(2, 2, 40, 60)
    result = minhash.near_duplicates(documents(spark, some), block_rows=4)
    assert rows(result) == by_hand(minhash.Likeness(), some)


def test_near_duplicates_of_odd_rows(spark):
    some = [(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (3, "A b c d"), (4, "word " * 40_000), (5, "word word word")]
    found = sorted((tuple(r) for r in minhash.near_duplicates(documents(spark, some)).collect()), key=repr)
    assert found == sorted([
        (None, 2, None, True), (None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (4, 1, 4, True), (5, 1, 4, False),
    ], key=repr)
    assert minhash.near_duplicates(documents(spark, [])).collect() == []


def test_signatures_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    shared = rng.integers(0, 2**63, 700, dtype=np.uint64)
    for size in (1, 20, 300, 5000):
        own = [rng.integers(0, 2**63, size, dtype=np.uint64) for _ in range(2)]
        common = shared[:size]
        signed = minhash.signatures([np.unique(np.concatenate([common, x])) for x in own], 120)
        true = len(common) / (len(common) + 2 * size)
        assert np.isfinite(signed).all()
        assert abs((signed[0] == signed[1]).mean() - true) < 0.2


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(n, n + 1) for n in range(300)], [(0, n) for n in range(200)], [(9, 8), (8, 7), (3, 4), (4, 9), (20, 21)],
])
def test_components_are_those_of_a_search(spark, links):
    sets = components.UnionFind()
    for one, other in links:
        sets.union(one, other)
    wanted = sorted((node, sets.root(node)) for node in {x for link in links for x in link} if sets.root(node) != node)
    df = spark.createDataFrame(links, "one long, other long").repartition(5)
    assert sorted((r["node"], r["component"]) for r in components.components(df).collect()) == wanted
