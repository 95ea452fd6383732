import datetime as dt

import pytest

from rentlens.operators import rules as R
from rentlens.operators.review import review_sheet
from rentlens.operators.snapshots import unseen
from rentlens.plans import accepted_listings, judged_listings

NOW = dt.datetime(2024, 6, 30, 12, tzinfo=dt.timezone.utc)
COLUMNS = (
    "id long, commercial boolean, development boolean, students boolean, auction boolean, amount int, frequency string, "
    "display_size string, let_agreed boolean, first_visible_date timestamp, latitude double, longitude double, property_url string"
)
GOOD = dict(
    commercial=False, development=False, students=False, auction=False, amount=1500, frequency="monthly",
    display_size="600 sq. ft.", let_agreed=False, first_visible_date=dt.datetime(2024, 6, 28), latitude=51.5,
    longitude=-0.1, property_url="/p/1",
)


def listings(spark, *changes):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple({"id": n, **GOOD, **c}[k] for k in names) for n, c in enumerate(changes)], COLUMNS)


def all_rules(max_rent=2000, max_days=7, min_sqm=50):
    return [
        R.rule_residential(), R.rule_has_price(), R.rule_min_area(min_sqm), R.rule_available(), R.rule_max_rent(max_rent),
        R.rule_recent(NOW, max_days),
    ]


CASES = [
    ({}, None), ({"commercial": True}, "residential"), ({"development": True}, "residential"),
    ({"students": True}, "residential"), ({"auction": True}, "residential"), ({"commercial": None}, None),
    ({"amount": None, "frequency": None}, "has_price"), ({"display_size": "500 sq. ft."}, "min_area"),
    ({"display_size": "538 sq. ft."}, "min_area"), ({"display_size": "539 sq. ft."}, None),
    ({"display_size": None}, None), ({"display_size": "10 sq. m."}, None), ({"let_agreed": True}, "available"),
    ({"amount": 2000}, None), ({"amount": 2001}, "max_rent"), ({"amount": 0}, "max_rent"),
    ({"amount": 470, "frequency": "weekly"}, "max_rent"), ({"first_visible_date": None}, None),
    ({"first_visible_date": dt.datetime(2024, 6, 22, 12)}, "recent"),
    ({"first_visible_date": dt.datetime(2024, 6, 22, 12, 0, 1)}, None),
    # The first rule in the order wins.
    ({"commercial": True, "amount": None, "let_agreed": True}, "residential"),
    ({"amount": None, "display_size": "5 sq. ft."}, "has_price"),
    ({"display_size": "5 sq. ft.", "let_agreed": True}, "min_area"), ({"let_agreed": True, "amount": 9999}, "available"),
    ({"amount": 9999, "first_visible_date": dt.datetime(2020, 1, 1)}, "max_rent"),
]


def test_first_rule_wins(spark):
    judged = R.classify(listings(spark, *[c for c, _ in CASES]), all_rules()).collect()
    assert {r.id: r.skip_rule for r in judged} == {n: rule for n, (_, rule) in enumerate(CASES)}
    assert all((r.skip_rule is None) == (r.skip_reason is None) for r in judged)
    assert R.suitable(listings(spark, *[c for c, _ in CASES]), all_rules()).count() == sum(rule is None for _, rule in CASES)


@pytest.mark.parametrize("change, rule", [
    ({"frequency": "quarterly", "commercial": True}, "residential"),
    ({"display_size": "about 500 sq. ft.", "auction": True}, "residential"),
    ({"frequency": "quarterly", "let_agreed": True}, "available"),
    ({"display_size": "some sq. ft.", "amount": None}, "has_price"),
])
def test_an_earlier_rule_wins_over_a_later_error(spark, change, rule):
    judged = R.classify(listings(spark, change, {}), all_rules())
    assert {r.id: r.skip_rule for r in judged.collect()} == {0: rule, 1: None}
    assert R.suitable(listings(spark, change, {}), all_rules()).count() == 1


@pytest.mark.parametrize("change, message", [
    ({"frequency": "quarterly"}, "unknown price frequency: quarterly"),
    ({"display_size": "about 500 sq. ft.", "let_agreed": True}, "size is not a whole number: about 500"),
])
def test_an_error_that_is_reached_fails(spark, change, message):
    with pytest.raises(Exception, match=message):
        R.classify(listings(spark, change), all_rules()).collect()
    with pytest.raises(Exception, match=message):
        R.suitable(listings(spark, {**change, "let_agreed": False}), all_rules()).collect()


def test_funnel_adds_up(spark):
    counts = {r.outcome: r.listings for r in R.funnel(R.classify(listings(spark, *[c for c, _ in CASES]), all_rules())).collect()}
    assert sum(counts.values()) == len(CASES)
    assert counts["accepted"] == sum(rule is None for _, rule in CASES)


@pytest.mark.parametrize("limit", [None, 0])
def test_no_day_limit(spark, limit):
    old = listings(spark, {"first_visible_date": dt.datetime(2001, 1, 1)})
    assert R.suitable(old, all_rules(max_days=limit)).count() == 1


def test_cap_per_place(spark):
    caps = spark.createDataFrame([("here", 1000)], "name string, cap int")
    there = spark.createDataFrame([(1, "here"), (2, "there")], "id long, name string")
    assert {r.id: r.cap for r in R.with_price_cap(there, caps, 2200).collect()} == {1: 1000, 2: 2200}


def test_history(spark, rows):
    found = listings(spark, *[{}] * 5)
    assert R.exclude_seen(found, None).count() == 5
    # All but one are in the history.
    history = found.where("id <> 3")
    assert rows(R.exclude_seen(found, history).select("id")) == [(3,)]
    agreed = spark.createDataFrame([(1, True), (2, False)], "id long, let_agreed boolean")
    assert rows(R.drop_let_agreed(found.select("id"), agreed)) == [(0,), (2,), (3,), (4,)]
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (7, "x"), (7, "x")], "id long, note string")
    assert rows(unseen(twice, None, ["note"])) == [(1, "a"), (7, "x")]
    assert rows(unseen(twice, agreed.select("id"))) == [(7, "x")]


def places(spark, n):
    return spark.createDataFrame([(f"p{i}", 51.0 + i, 0.5) for i in range(n)], "name string, latitude double, longitude double")


def journeys(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, name string, position int, duration int")


def test_job_runs_the_commute_rule_last(spark):
    found = listings(spark, {}, {}, {"commercial": True}, {}, {})
    times = journeys(
        spark, (0, "p0", 0, 50), (0, "p0", 1, 45), (0, "p1", 0, 10),        # both in time
        (1, "p0", 0, 10), (1, "p1", 0, 46),                                 # one too far
        (2, "p0", 0, 10), (2, "p1", 0, 10), (3, "p0", 0, 10),               # one without a journey
    )
    history = spark.createDataFrame([(4,)], "id long")
    judged = judged_listings(found, places(spark, 2), times, NOW, 2000, 7, 45, history=history)
    assert {r.id: r.skip_rule for r in judged.collect()} == {0: None, 1: "commute", 2: "residential", 3: "commute"}
    accepted = accepted_listings(found, places(spark, 2), times, NOW, 2000, 7, 45, history=history, centre=(51.5, 0.0))
    assert [r.id for r in accepted.collect()] == [0]
    nowhere = judged_listings(found, places(spark, 2).limit(0), times, NOW, 2000, 7, 45)
    assert {r.id for r in nowhere.where("skip_rule is null").collect()} == {0, 1, 3, 4}


def test_links_per_listing(spark):
    found = listings(spark, {}, {"property_url": None}, {"property_url": "/p/3"})
    sheet = review_sheet(found, places(spark, 2), "https://h.example").collect()
    # One link each, and one per place; a listing without a link of its own has only routes.
    assert len(sheet) == 3 * (1 + 2) - 1
    assert {(r.id, r.kind) for r in sheet if r.id == 1} == {(1, "route")}
    first = next(r for r in sheet if r.kind == "route" and r.id == 0 and r.place == "p1")
    assert "origin=52.0%2C0.5&destination=51.5%2C-0.1" in first.link
