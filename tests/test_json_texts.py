"""JSON texts cut into elements, beside the json module, however files are split."""

import gzip
import json
import random

import pytest

from rentlens.sources.json_texts import Cutter, Summary, chained, json_elements, with_position

CONFS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture
def split_at(spark):
    """Sets how many bytes a split has."""
    before = {name: spark.conf.get(name) for name in CONFS}

    def to(size):
        for name in CONFS:
            spark.conf.set(name, str(size))

    yield to
    for name, value in before.items():
        spark.conf.set(name, value)


def value(draw, depth=0):
    kind = draw.randrange(6)
    if kind == 0:
        return draw.choice(['a"b', "}{", "\\", "[,]", "é日\n", "", 'x\\"},{', "}" * 90])
    if kind == 1:
        return draw.choice([draw.randrange(1000), True, 1.5])
    if kind == 2 and depth < 3:
        return [value(draw, depth + 1) for _ in range(draw.randrange(4))]
    if kind >= 3 and depth < 3:
        return {draw.choice(["k", "}", '"', ","]) + str(n): value(draw, depth + 1) for n in range(draw.randrange(4))}
    return None


def texts(draw):
    """Some texts, and their elements."""
    out, elements = [], []
    for _ in range(draw.choice([1, 1, 4])):
        if draw.random() < 0.7:
            one = [value(draw) for _ in range(draw.randrange(25))]
            elements += one
        else:
            one = {"a": value(draw), "b": value(draw)}
            elements.append(one)
        out.append(json.dumps(one, ensure_ascii=False, indent=draw.choice([None, None, 1])))
    return draw.choice(["", "\n", " "]).join(out) + draw.choice(["", "\n"]), elements


def same(records, elements):
    dump = lambda x: json.dumps(x, ensure_ascii=False)
    return sorted(dump(json.loads(r)) for r in records) == sorted(map(dump, elements))


@pytest.mark.parametrize("size", [40, 300, 5000, 1 << 27])
def test_elements_by_hand(spark, tmp_path, split_at, size):
    split_at(size)
    draw, expected = random.Random(size), []
    for n in range(6):
        text, elements = texts(draw)
        (tmp_path / f"{n}.json").write_text(text)
        expected += elements
    got = json_elements(spark, str(tmp_path)).collect()
    assert all(row.whole for row in got) and same([row.record for row in got], expected)


@pytest.mark.parametrize("size", [60, 1 << 27])
def test_positions_and_entries(spark, tmp_path, split_at, size):
    split_at(size)
    one, other = {f"k{n}": {"}": n} for n in range(40)}, {"z": [1, 2], "y": "}"}
    (tmp_path / "m.json").write_text(json.dumps(one) + json.dumps(other))
    rows = with_position(json_elements(spark, str(tmp_path / "m.json"), entries=True)).orderBy("position").collect()
    assert [row.position for row in rows] == list(range(42))
    assert [json.loads("{" + row.record + "}") for row in rows] == [{k: v} for d in (one, other) for k, v in d.items()]


@pytest.mark.parametrize("size", [60, 1 << 27])
@pytest.mark.parametrize("cut", range(1, 45, 4))
def test_nothing_is_lost_of_a_cut_off_file(spark, tmp_path, split_at, size, cut):
    split_at(size)
    text = json.dumps([{"id": n, "t": "}{" * n} for n in range(12)])[:-cut]
    (tmp_path / "c.json").write_text(text)
    (tmp_path / "good.json").write_text('[{"id": 99}]')
    rows = json_elements(spark, str(tmp_path)).collect()
    whole = sorted(json.loads(r.record)["id"] for r in rows if r.whole)
    bad = [r.record for r in rows if not r.whole]
    assert len(bad) == 1 and whole == [*range(len(whole) - 1), 99] and text.endswith(bad[0])
    assert len(whole) >= 10


def test_text_outside_of_values(spark, tmp_path):
    (tmp_path / "s.json").write_text('oops {"a": 1} ]]} , [1,, 2] 5')
    rows = json_elements(spark, str(tmp_path / "s.json")).collect()
    assert sorted(r.record for r in rows if r.whole) == ["", "1", "2", '{"a": 1}']
    assert sorted(r.record for r in rows if not r.whole) == ["5", "]]} ,", "oops"]


def test_compressed_empty_and_blank_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as file:
        file.write(json.dumps([{"id": n} for n in range(500)]))
    with gzip.open(tmp_path / "b.json.gz", "wt") as file:
        file.write('{"id": 500}')
    (tmp_path / "c.json").write_text("")
    (tmp_path / "d.json").write_text(" \n")
    (tmp_path / "e.json").write_text("[]{} [ ]")
    rows = json_elements(spark, str(tmp_path)).collect()
    assert all(r.whole for r in rows)
    assert sorted(json.loads(r.record).get("id", -1) for r in rows) == [-1, *range(501)]


def test_one_array_is_read_by_many_tasks(spark, tmp_path, split_at):
    split_at(1 << 16)
    (tmp_path / "big.json").write_text(json.dumps([{"id": n, "text": "x}" * 50} for n in range(20_000)]))
    found = json_elements(spark, str(tmp_path / "big.json"))
    assert found.selectExpr("count(*)", "count_if(whole)", "count(distinct block)").first()[:] == (20_000, 20_000, found.select("block").distinct().count())
    assert found.select("block").distinct().count() > 30


def test_splits_do_not_depend_on_other_files(spark, tmp_path, split_at):
    """Files that the first pass leaves out are no reason to cut the others elsewhere in the second."""
    split_at(1000)
    spark.conf.set(CONFS[0], str(1 << 14))
    expected = [{"id": n, "in": {"id": n}} for n in range(2_000)]
    (tmp_path / "big.json").write_text(json.dumps(expected))
    for n in range(60):
        small = [{"id": n, "of": {"id": m}} for m in range(20)]
        (tmp_path / f"{n}.json").write_text(json.dumps(small))
        expected += small
    for cores in (1, 3, 8, 64):
        spark.conf.set("spark.sql.files.minPartitionNum", str(cores))
        try:
            got = json_elements(spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
        assert all(row.whole for row in got) and same([row.record for row in got], expected)


@pytest.mark.parametrize("seed", range(20))
def test_summaries_chain_to_what_a_whole_run_gives(seed):
    draw = random.Random(seed)
    data = "".join(draw.choice(['{', '}', '[', ']', ',', '"', "a", '\\"']) for _ in range(draw.randrange(120))).encode()
    cutter = Cutter(False, 0, "", False)
    list(cutter.feed(data))
    in_string, depth, container = False, 0, ""
    at = 0
    while at < len(data):
        step = draw.randrange(1, 9)
        while data[at:at + step].endswith(b"\\"):
            step += 1
        part = Summary(in_string)
        part.feed(data[at:at + step])
        depth, container = chained(depth, container, part.change, part.low, part.opener)
        in_string, at = part.in_string, at + step
    assert (in_string, depth, container) == (cutter.in_string, cutter.depth, cutter.container)


def test_small_files_are_a_row_each(spark, tmp_path):
    """Only larger ones, and those that may be compressed, come in fragments."""
    from rentlens.sources.json_texts import _texts

    text = json.dumps([{"a": "}" * 9, "b": n} for n in range(500)])
    for name in ("a.json", "b.txt"):
        (tmp_path / name).write_text(text)
    (tmp_path / "c.json.gz").write_bytes(gzip.compress(text.encode()))
    whole = {row.path[-6:]: bytes(row.value) for row in _texts(spark, str(tmp_path), whole=True).collect()}
    assert whole == {"a.json": text.encode(), "/b.txt": text.encode()}
    assert {row.path[-3:] for row in _texts(spark, str(tmp_path), whole=False).select("path").collect()} == {".gz"}
    assert json_elements(spark, str(tmp_path)).count() == 1500


def test_parts_of_a_text_end_after_a_brace(monkeypatch):
    from rentlens.sources import json_texts

    monkeypatch.setattr(json_texts, "_PART_BYTES", 10)
    text = json.dumps([{"k": 'a\\"}' * 3, "n": n} for n in range(20)]).encode()
    parts = list(json_texts._parts(json_texts.pa.py_buffer(text)))
    assert b"".join(parts) == text and len(parts) > 20 and all(part.endswith(b"}") for part in parts[:-1])
    cutter = Cutter(False, 0, "", False)
    found = [piece for part in parts for piece in cutter.feed(part)]
    assert [json.loads(piece[2])["n"] for piece in found] == list(range(20)) and list(cutter.end()) == []
