"""Encoders, counts and packing beside the libraries whose vocabularies they use."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from rentlens.llm import bpe, chunks, packing, prefix_counts

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PARTS = [
    "a", "b", " ", "  ", "\n", "\t", " \n", "<|endoftext|>", "<|startoftext|>", "é", "é", "ß", "漢", "字", "1", "²", "'s", "'",
    "!", "...", " ", "　", "\x1c", "\x85", "​", "😀", "word", "The", "Σ", "İ", "the", "in", "\x00",
]


def odd_texts(count, seed=1):
    rng = random.Random(seed)
    short = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(count)]
    return short + ["", " ", "a" * 3000, " " * 2000, "ab" * 800 + "!" * 400, "Some words, some more words. " * 300]


def raw(name):
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_byte_level_ids_are_the_library_s():
    encoder, tokenizer = packing.encoder_of(raw("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    for text in odd_texts(1500):
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text[:80]


def test_recursive_encoding_is_the_library_s():
    encoder = bpe.encoder_of(raw("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    engine = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    texts = odd_texts(1500, 2)
    for text, (ids, decoded) in zip(texts, encoder.encode_many(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == engine.encode_ordinary(text), text[:80]
        assert decoded == text.encode()


def test_recursion_and_heap_agree():
    encoder = bpe.encoder_of(raw("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdethinr") for _ in range(rng.randrange(2, 120))).encode() for _ in range(200)]
    by_query = encoder.encode_words(words)
    for word in words:
        assert by_query[word][0] == chunks.little_endian(encoder._by_heap(word))


def test_caches_only_change_the_speed(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 3)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    encoder = bpe.RecursiveEncoder(raw("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in ("one two three four five", "two  three six", "one two three four five"):
        [(_, decoded)] = encoder.encode_many([text])
        assert decoded == text.encode()


def frame(spark, texts):
    rows = [(n, text, "x", 1) for n, text in enumerate(texts)] + [(None, "null id", "x", 1), (7, None, "x", 1), (7, None, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, PIECE int")


def test_encoding_rows(spark):
    df = frame(spark, odd_texts(30))
    found = sorted(map(tuple, bpe.encode_and_decode(
        df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()), key=repr)
    engine = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=chunks.read_ranks(raw("byte_bpe_multi_50k.tiktoken")))
    wanted = []
    for row in df.collect():
        ids = engine.encode_ordinary(row["text"] or "")
        wanted.append((
            row["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256((row["text"] or "").encode()).hexdigest()))
    assert found == sorted(wanted, key=repr)


def test_word_counts_and_prefixes_are_the_library_s():
    counter, tokenizer = prefix_counts.counter_of(raw("word_bpe_49k.json")), library("word_bpe_49k.json")
    for text in odd_texts(1500, 3):
        wanted = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert counter.count(text) == wanted, text[:80]
        counts = counter.prefixes(text)[2]
        assert (int(counts[-1]) if len(counts) else 0) == wanted


def test_longest_fitting_prefix():
    counter, tokenizer = prefix_counts.counter_of(raw("word_bpe_49k.json")), library("word_bpe_49k.json")
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["ththat", "inones ", "Word", " ", "é", "12", "!?", "'s", "\n"]) for _ in range(12))
        normalized = counter.prefixes(text)[0]
        counts = [len(tokenizer.encode(normalized[:n], add_special_tokens=False).ids) for n in range(len(normalized) + 1)]
        for budget in {0, 1, counts[-1] // 2, counts[-1]}:
            best = max(n for n, count in enumerate(counts) if count <= budget)
            # Trailing white space costs nothing, so any end of it is as good.
            assert normalized[:counter.fitting_chars(text, budget)].rstrip() == normalized[:best].rstrip()


def test_count_rows_and_tables(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = frame(spark, ["three little words", "", "x" * 5000])
    found = {(r["doc_id"], r["n_bytes"]): r for r in prefix_counts.token_counts(df, path, max_tokens=2).collect()}
    assert found[0, 18]["n_tokens"] == 3 and found[0, 18]["over_limit"] and found[0, 18]["fitting_chars"] == 13
    assert found[1, 0]["n_tokens"] == 0 and not found[1, 0]["over_limit"]
    assert found[7, 0]["n_tokens"] == 0 and found[None, 7]["n_tokens"] == 2
    table = prefix_counts.prefix_table(df, path)
    short = {r["doc_id"]: r["truncated"] for r in prefix_counts.within_budget(table, 2).collect()}
    assert short[0] == "three little" and short[1] == "" and short[2] == ""
    assert prefix_counts.token_counts(df.limit(0), path).collect() == []


def test_plan_fills_sequences_without_gaps():
    rng = random.Random(6)
    for limit in (1, 7, 64):
        counts = {length: rng.randrange(1, 60) for length in range(1, limit + 1) if rng.random() < 0.6}
        sequences = defaultdict(list)
        for length, ranks, firsts, offsets in packing.plan(counts, limit):
            for n, (rank, first, offset) in enumerate(zip(ranks, firsts, offsets)):
                end = ranks[n + 1] if n + 1 < len(ranks) else counts[length]
                for taken in range(end - rank):
                    sequences[first + taken].append((offset, length))
        assert sum(map(len, sequences.values())) == sum(counts.values())
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= limit
        tokens = sum(length * n for length, n in counts.items())
        assert len(sequences) <= 1 + 11 / 9 * -(-tokens // limit) + limit  # best-fit decreasing's bound, roughly


def test_packing_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = frame(spark, odd_texts(40) + ["many words here " * 900])
    tokenizer = library("byte_bpe_50k.json")
    pieces = packing.pack(df, path).collect()
    wanted = sorted(
        ((row["doc_id"], [*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 2]) for row in df.collect()), key=repr)
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for row in pieces:
        by_doc[row["doc_id"]].append(row)
        sequences[row["sequence_id"]].append((row["offset"], row["length"]))
    for doc_id, ids in wanted:
        own = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        copies = sum(d == doc_id for d, _ in wanted)
        if copies == 1:
            assert [r["piece"] for r in own] == list(range(-(-len(ids) // 1024)))
            assert sum(r["length"] for r in own) == len(ids)
            for r in own:
                part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
                assert zlib.crc32(part) == r["ids_crc32"]
        assert all(r["length"] == 1024 for r in own if r["piece"] > 0)
    assert sum(r["length"] for r in pieces) == sum(len(ids) for _, ids in wanted)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(df.limit(0), path).collect() == []


def test_ranks_over_many_parts(spark):
    """Slots are each taken once, however the ranks are counted."""
    pieces = spark.range(500).selectExpr(
        "id AS doc_id", "0 AS piece", "0L AS start", "IF(id % 3 = 0, 5L, id % 9 + 1) AS length", "id AS ids_crc32")
    placed = packing.take_slots(pieces, 10, rows_per_part=37).collect()
    taken = [(r["sequence_id"], place) for r in placed for place in range(r["offset"], r["offset"] + r["length"])]
    assert len(placed) == 500 and len(taken) == len(set(taken)) and max(place for _, place in taken) < 10
