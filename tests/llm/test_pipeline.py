"""Recurring lines, and the pipeline stage by stage beside plain versions."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rentlens.llm import line_dedup, minhash, pii
from rentlens.llm.language import UNDECIDED
from rentlens.operators import joins
from test_copies import by_hand

SMALLEST = "/root/testdata/sf0.001"


def documents(spark, rows):
    return spark.createDataFrame(
        [(doc_id, text, "x", "line", 1) for doc_id, text in rows],
        "doc_id long, text string, line_no string, row_id string, n_lines int")


def lengths(count):
    """Own lines of very different lengths."""
    return [" ".join(f"own{n}w{k}" for k in range(2, 3 + 2 ** n)) for n in range(count)]


def test_recurring_lines_go_with_their_variable_fields(spark):
    rows = [(n, f"{own}\nCopyright 20{n:02d} by the House of Lines, all rights\nOK.") for n, own in enumerate(lengths(7))]
    found = {r["doc_id"]: r for r in line_dedup.drop_recurring_lines(documents(spark, rows)).collect()}
    for n, own in enumerate(lengths(7)):
        assert found[n]["text"] == f"{own}\nOK." and found[n]["n_lines"] == 1


def test_lines_that_only_copies_share_stay(spark):
    text = "\n".join(f"line number {word} of the text" for word in "one two three four five six".split())
    rows = [(n, text) for n in range(30)] + [(100 + n, own) for n, own in enumerate(lengths(6))]
    assert line_dedup.recurring_lines(documents(spark, rows)).count() == 0


def words(name, count):
    return " ".join(f"{name}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(count))


@pytest.mark.parametrize("count", [2, 3, 12])
def test_passages_of_texts_of_equal_length_go(spark, count):
    passage = "\n".join([words("shared", 20), "", words("more", 20), words("last", 20), "the end"])
    own = [words(f"own{chr(97 + n)}", 60) for n in range(count)]
    rows = [(n, f"{text}\n{passage}\n{text[::-1]}") for n, text in enumerate(own)]
    assert len({len(text) for _, text in rows}) == 1
    found = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring_lines(documents(spark, rows)).collect()}
    assert found == {n: f"{text}\n\n{text[::-1]}" for n, text in enumerate(own)}


def test_templates_of_texts_of_equal_length_go(spark):
    own = [words(f"own{chr(97 + n)}", 30) for n in range(8)]
    # Four texts are enough for a short line, three are not.
    rows = [(n, f"{text}\nAll rights are held by the House no {n}" + "\nonly three have this"[:21 * (n < 3)]) for n, text in enumerate(own)]
    found = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring_lines(documents(spark, rows)).collect()}
    assert found == {n: text + "\nonly three have this"[:21 * (n < 3)] for n, text in enumerate(own)}


def test_lines_that_only_near_copies_share_stay(spark):
    lines = [words(f"line{chr(97 + n)}", 20) for n in range(12)]
    rows = [(n, "\n".join([*lines[:n], f"{lines[n]} changed {n}", *lines[n + 1:]])) for n in range(9)]
    assert line_dedup.recurring_lines(documents(spark, rows)).count() == 0
    # What a text of its own has too recurs.
    other = "\n".join([words("other", 100), *lines[9:]])
    found = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring_lines(documents(spark, [*rows, (99, other)])).collect()}
    assert found == {n: "\n".join(text.split("\n")[:9]) for n, text in rows} | {99: words("other", 100)}


def test_pages_that_are_mostly_template_lose_it(spark):
    def page(name, shared, own):
        template = [words(f"{name}{chr(97 + k)}", 9) for k in range(shared)]
        pages = [[words(f"{name}own{chr(97 + n // 26)}{chr(97 + n % 26)}{k}x".replace("0", "z").replace("1", "y"), 9) for k in range(own)] for n in range(40)]
        return [("\n".join([*template, *text]), "\n".join(text)) for text in pages] + [("\n".join(template), "")]

    # 60, 86 and 95 % template, and with each a text that is nothing but template.
    pairs = page("few", 3, 2) + page("more", 6, 1) + page("most", 19, 1)
    found = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring_lines(documents(spark, [(n, text) for n, (text, _) in enumerate(pairs)])).collect()}
    assert found == {n: left for n, (_, left) in enumerate(pairs)}


def test_numeric_rows_are_not_one_template(spark):
    rows = [(n, f"{own}\n{n} 7 20{n:02d}\nsum {n} 1{n} 2{n}") for n, own in enumerate(lengths(7))]
    tables = [(100 + n, "\n".join(f"{n}{k} {k} 5{k}" for k in range(4 ** n))) for n in range(1, 5)]
    found = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring_lines(documents(spark, rows + tables), drop_emptied=True).collect()}
    assert found == dict(rows + tables)


def test_few_texts_of_a_line_in_many_are_compared(spark, monkeypatch):
    compared, copies = [], line_dedup._copies

    def counted(pairs, sketches):
        compared.append(pairs.count())
        return copies(pairs, sketches)

    monkeypatch.setattr(line_dedup, "_copies", counted)
    own = [words(f"own{chr(97 + n // 26)}{chr(97 + n % 26)}", 20 + n) for n in range(40)]
    rows = [(n, f"{text}\nAll rights are held by the House of Lines") for n, text in enumerate(own)]
    found = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring_lines(documents(spark, rows)).collect()}
    assert found == dict(enumerate(own)) and sum(compared) < 40


@pytest.mark.parametrize("others", [2, 3])
def test_all_texts_are_compared_if_the_largest_are_copies(spark, others):
    line = "All rights are held by the House of Lines"
    near = [f"{words('near', 200)} {'x' * n}\n{line}" for n in range(30)]
    own = [words(f"own{chr(97 + n)}", 20) for n in range(others)]
    rows = list(enumerate([*near, *(f"{text}\n{line}" for text in own)]))
    found = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring_lines(documents(spark, rows)).collect()}
    # The copies count as one text, so with three others there are four.
    assert found == {n: text if others < 3 else text[:-len(line) - 1] for n, text in rows}


@pytest.fixture
def nothing_fits(monkeypatch):
    """As with tables of keys that are too large to broadcast."""
    for module in (joins, line_dedup):
        monkeypatch.setattr(module, "fits_broadcast", lambda *_, **__: False, raising=False)


def test_texts_are_sketched_without_a_shuffle_of_them(spark, nothing_fits):
    import contextlib
    import io

    docs, plan = documents(spark, [(n, own) for n, own in enumerate(lengths(7))]), io.StringIO()
    texts = docs.where("doc_id < 3").select(F.xxhash64("text").alias("row_hash"))
    sketches = line_dedup._sketches(docs, texts, "text")
    with contextlib.redirect_stdout(plan):
        sketches.explain("formatted")
    shuffled = [part for part in plan.getvalue().split("\n\n") if re.search(r"^\(\d+\) Exchange", part, re.M)]
    assert shuffled and not any("text#" in part for part in shuffled)
    assert {r[0] for r in texts.collect()} <= {r["row_hash"] for r in sketches.collect()}


def test_recurring_lines_of_many_keys_are_those_of_few(spark, rows, request):
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet")
    odd = documents(spark, [(None, None), (1, ""), (1, "x y z\n\n")]).select("doc_id", "text")
    docs = docs.select("doc_id", "text").unionByName(docs.where("doc_id % 5 = 0").select("doc_id", "text")).unionByName(odd)
    few = rows(line_dedup.line_dedup(docs))
    assert len(few) == docs.count() and any(row[2] for row in few)
    request.getfixturevalue("nothing_fits")
    assert rows(line_dedup.line_dedup(docs)) == few


def test_lines_of_odd_rows(spark):
    rows = [(None, "a b c\n\n"), (1, None), (2, ""), (3, "x y z"), (3, "x y z"), (4, "word " * 40_000)]
    found = sorted((tuple(r) for r in line_dedup.line_dedup(documents(spark, rows)).collect()), key=repr)
    assert [(r[0], r[1], r[2]) for r in found] == sorted(
        [(None, 3, 0), (1, 1, 0), (2, 1, 0), (3, 1, 0), (3, 1, 0), (4, 1, 0)], key=repr)
    assert line_dedup.line_dedup(documents(spark, [])).collect() == []


def test_plan_of_line_dedup_has_no_python(spark):
    import contextlib
    import io

    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        line_dedup.line_dedup(spark.read.parquet(f"{SMALLEST}/documents.parquet")).explain("formatted")
    assert "Python" not in text.getvalue() and "Arrow" not in text.getvalue()


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before each stage, and after the last."""
    from rentlens.session import cut_lineage

    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "123 456 !!", "en", "s", 10), (10**6 + 1, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(junk.select(*[junk[c].cast(docs.schema[c].dataType) for c in docs.columns]))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], SMALLEST)))
    return out


def test_all_but_the_last_stage_keep_the_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    for df in stages[1:-1]:
        assert df.where("n_chars <> length(text)").isEmpty()


def test_language_stage_drops_only_texts_without_a_language(stages):
    before = {r["doc_id"] for r in stages[0].collect()}
    assert before - {r["doc_id"] for r in stages[1].collect()} == {10**6, 10**6 + 1}
    assert UNDECIDED == "und"


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    wanted = {doc_id for doc_id, _, _, kept in by_hand(minhash.FIVE_WORDS, rows) if kept}
    assert {r["doc_id"] for r in stages[3].collect()} == wanted


def test_personal_data_stage_leaves_none(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    after = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    assert before.keys() == after.keys()
    for doc_id, text in after.items():
        assert not pii.base_spans(text)
        if not any(c.isdigit() or c == "@" for c in before[doc_id]):
            assert text == before[doc_id]


def test_packing_stage_holds_every_document(stages):
    pieces = stages[5].collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in stages[4].collect()}
    taken = [(r["sequence_id"], n) for r in pieces for n in range(r["offset"], r["offset"] + r["length"])]
    assert len(taken) == len(set(taken))


def test_pipeline_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame(
        [(1, "the first of many words here", "en"), (1, "the first of many words here", "en"), (None, "the words of no one", "en")],
        "doc_id long, text string, lang string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted((r["doc_id"] or 0 for r in kept.collect())) == [0, 1]


def test_near_duplicates_of_an_id_with_several_texts(spark):
    one, other, third = words("one", 40), words("other", 40), words("third", 40)
    docs = spark.createDataFrame([(3, other, "en"), (5, one, "en"), (5, other, "en"), (5, third, "en"), (5, third, "en")], "doc_id long, text string, lang string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(tuple(r)[:2] for r in kept.collect()) == sorted([(3, other), (5, one), (5, third)])
