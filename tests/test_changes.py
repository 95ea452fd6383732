"""Base plus changes, beside a dictionary."""

import random

import pytest

from rentlens.operators import joins
from rentlens.sources import changes as C

SCHEMA = "src string, dst int, minutes int, note string"


def table(spark, rows):
    return spark.createDataFrame([(*key, *value) for key, value in rows.items()], SCHEMA)


def held(spark, base):
    rows = C.current_rows(spark, base).collect()
    out = {(r.src, r.dst): (r.minutes, r.note) for r in rows}
    assert len(out) == len(rows)
    return out


def written(spark, base, version):
    return spark.read.parquet(f"{base}/rows/version={version}").count()


@pytest.mark.parametrize("broadcast", [True, False])
def test_rounds_of_changes_and_folds(spark, tmp_path, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    draw, base = random.Random(5), str(tmp_path / "t")
    key = lambda: (draw.choice("abcdefgh"), draw.randrange(40))
    expected = {key(): (draw.randrange(9), draw.choice(["x", None])) for _ in range(200)}
    assert C.publish_base(table(spark, expected), base, ["src", "dst"], 5) == 1
    for turn in range(4):
        update = {key(): (draw.randrange(9), draw.choice(["x", None])) for _ in range(30)}
        update |= {k: expected[k] for k in draw.sample(sorted(expected), 10)}
        altered = sum(expected.get(k) != v for k, v in update.items())
        version = C.publish_changes(table(spark, update), base)
        expected |= update
        assert written(spark, base, version) == altered and held(spark, base) == expected
        if turn % 2:
            C.fold_changes(spark, base, share=draw.choice([0.0, 0.25]))
            assert held(spark, base) == expected


def test_one_percent_of_keys_writes_one_percent(spark, tmp_path):
    base = str(tmp_path / "t")
    rows = {("a", n): (n % 50, None) for n in range(5000)}
    C.publish_base(table(spark, rows), base, ["src", "dst"], 8)
    update = {("a", n): (99, None) for n in range(0, 5000, 100)}
    version = C.publish_changes(table(spark, update), base)
    assert written(spark, base, version) == 50
    assert C.fold_changes(spark, base) == [] and held(spark, base) == rows | update
    versions = {r.version for r in C.current_rows(spark, base).select("version").distinct().collect()}
    assert versions == {1, 2}


def test_folds_touch_only_ranges_that_are_due(spark, tmp_path):
    base = str(tmp_path / "t")
    rows = {("a", n): (0, None) for n in range(400)}
    C.publish_base(table(spark, rows), base, ["src", "dst"], 8)
    ranges = C._with_range(table(spark, rows), ["src", "dst"], 8).collect()
    update = {(r.src, r.dst): (1, None) for r in ranges if r._range == 3}
    C.publish_changes(table(spark, update), base)
    assert C.fold_changes(spark, base) == [3]
    assert written(spark, base, 3) == len(update) and held(spark, base) == rows | update
    assert C.fold_changes(spark, base) == []


def test_failed_writes_empty_updates_and_repeated_keys(spark, tmp_path):
    base = str(tmp_path / "t")
    with pytest.raises(ValueError, match="nothing published"):
        C.current_rows(spark, base)
    C.publish_base(table(spark, {("a", 1): (5, "x")}), base, ["src", "dst"], 2)
    # Rows without a row in the log are those of an attempt that failed.
    C._with_range(table(spark, {("a", 1): (6, "y")}), ["src", "dst"], 2).write.partitionBy("_range").parquet(f"{base}/rows/version=2")
    assert held(spark, base) == {("a", 1): (5, "x")}
    nothing = spark.createDataFrame([], SCHEMA)
    assert C.publish_changes(nothing, base) == 2 and held(spark, base) == {("a", 1): (5, "x")}
    twice = spark.createDataFrame([("a", 1, 7, "p"), ("a", 1, 8, "q")], SCHEMA)
    with pytest.raises(Exception, match="key given twice"):
        C.publish_changes(twice, base)
    C.publish_changes(twice, base, order=["minutes"])
    assert held(spark, base) == {("a", 1): (8, "q")}
    C.publish_base(table(spark, {("b", 2): (1, None)}), base, ["src", "dst"], 3)
    assert held(spark, base) == {("b", 2): (1, None)}


@pytest.mark.parametrize("broadcast", [True, False])
def test_an_update_is_computed_once(spark, tmp_path, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    base, seen = str(tmp_path / "t"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = {("a", n): (n, None) for n in range(100)}
    C.publish_base(table(spark, rows), base, ["src", "dst"], 3)
    update = {("a", n): (n + n % 2, None) for n in range(50, 150)}
    frame = table(spark, update)
    version = C.publish_changes(frame.mapInArrow(counted, frame.schema), base)
    # Every other of the 50 known keys is altered, and 50 are new.
    assert seen.value == 100 and written(spark, base, version) == 75 and held(spark, base) == rows | update
