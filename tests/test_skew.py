"""The ways around hot keys give the same result as the plain ones."""

import datetime as dt
import itertools
import random

import pytest

from panelscope.functions.joins import keep_members
from panelscope.operators import working_set
from panelscope.plans.store import TableStore

EVENTS = "event_id long, user_id long, created_time timestamp_ntz, url string"


def mirrors_by_hand(rows, need=3):
    seen = {}
    for _, user, at, url in rows:
        seen.setdefault(user, set()).add((at, url))
    alias = {}
    for a, b in itertools.combinations(sorted(seen), 2):
        if len(seen[a] & seen[b]) >= need and b not in alias:
            alias[b] = a
    return alias


def mirror_rows(seed):
    """Copies of one person, partial copies, and events that nearly everybody shares."""
    r = random.Random(seed)
    day = dt.datetime(2026, 5, 1)
    keys = set()
    for user in range(40):
        for _ in range(r.randrange(2, 9)):
            keys.add((user, r.randrange(25), "/common"))
        for _ in range(r.randrange(6)):
            keys.add((user, r.randrange(200), "/rare"))
        if user % 3 == 0:
            keys.update((user, s, "/copied") for s in range(r.randrange(2, 7)))
    return [(i, u, day + dt.timedelta(seconds=s), url) for i, (u, s, url) in enumerate(sorted(keys))]


def alias_of(spark, rows):
    """The three rounds, each written and read again, and how many ids each left open."""
    store = TableStore(spark)
    shared = store.write("shared", working_set.shared_events(rows))
    near = store.write("near", working_set.alias_near(shared))
    far = store.write("far", working_set.alias_far(shared, near))
    return working_set.user_alias(shared, near, far), near.where("open").count(), far.where("open").count()


@pytest.mark.parametrize("seed, block, first, second", [(1, 3, 64, 4096), (1, 1000, 1, 2), (2, 7, 2, 5), (3, 500, 4, 9), (4, 5, 3, 4096)])
def test_user_alias(spark, seed, block, first, second, monkeypatch):
    for name, value in (("PAIR_BLOCK", block), ("NEAR", first), ("FAR", second)):
        monkeypatch.setattr(working_set, name, value)
    rows = mirror_rows(seed)
    alias, near, far = alias_of(spark, spark.createDataFrame(rows, EVENTS))
    got = {r["user_id"]: r["person_id"] for r in alias.collect()}
    assert got == mirrors_by_hand(rows)
    assert len(got) > 5 and (near > 5 if first < 5 else near == 0) and (far > 0 if second < 5 else True)


def test_one_event_of_many_ids_costs_no_pairs(spark):
    """An event that 100,000 ids share, most of whose other events are their own."""
    rows = spark.range(100_000).selectExpr(
        "id AS event_id", "id AS user_id", "TIMESTAMP_NTZ'2026-05-01 00:00:00' AS created_time", "'/popular' AS url")
    more = spark.range(300_000).selectExpr(
        "id + 100000 AS event_id", "id % 100000 AS user_id", "TIMESTAMP_NTZ'2026-05-02 00:00:00' AS created_time",
        "concat('/page', (id % 100000) div 2, '_', id div 100000) AS url")
    got, near, far = alias_of(spark, rows.unionByName(more))
    assert got.count() == got.where("user_id = person_id + 1 AND person_id % 2 = 0").count() == 50_000
    assert far == 0


def test_three_events_of_many_ids_settle_early(spark):
    """Three events that 30,000 ids share: each finds the smallest of them in the first round, without meeting the others."""
    rows = spark.range(90_000).selectExpr(
        "id AS event_id", "id % 30000 AS user_id", "TIMESTAMP_NTZ'2026-05-01 00:00:00' AS created_time", "concat('/popular', id div 30000) AS url")
    got, near, far = alias_of(spark, rows)
    assert (near, far) == (0, 0)
    assert got.where("person_id = 0").count() == got.count() == 29_999


@pytest.mark.parametrize("heads, first, second", [(4, 64, 4096), (1, 2, 4), (2, 5, 9)])
def test_a_round_of_few_ids_comes_first(spark, heads, first, second, monkeypatch):
    for name, value in (("HEADS", heads), ("NEAR", first), ("FAR", second)):
        monkeypatch.setattr(working_set, name, value)
    rows, store = mirror_rows(3), TableStore(spark)
    shared = store.write("shared", working_set.shared_events(spark.createDataFrame(rows, EVENTS)))
    few = store.write("heads", working_set.alias_heads(shared))
    near = store.write("near", working_set.alias_near(shared, few))
    far = store.write("far", working_set.alias_far(shared, near))
    assert {r["user_id"]: r["person_id"] for r in working_set.user_alias(shared, near, far).collect()} == mirrors_by_hand(rows)
    assert few.count() == near.count() and near.where("open").count() <= few.where("open").count()


def test_copies_settle_among_few_ids(spark):
    """Three events that 5,000 ids share, and as many of their own in pairs: no id needs more than the smallest of each event."""
    rows = spark.range(15_000).selectExpr(
        "id AS event_id", "id % 5000 AS user_id", "TIMESTAMP_NTZ'2026-05-01 00:00:00' AS created_time", "concat('/popular', id div 5000) AS url")
    few = working_set.alias_heads(working_set.shared_events(rows))
    assert few.where("open").count() == 0 and few.where("best = 0").count() == 4_999


def test_members_are_kept_with_their_rows(spark):
    rows = spark.range(5000).selectExpr("id AS event_id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 100 END AS user_id")
    members = spark.range(5, 40).selectExpr("id AS user_id")
    assert sorted(keep_members(rows, members, "user_id").select("event_id").collect()) == sorted(
        rows.where("user_id BETWEEN 5 AND 39").select("event_id").collect())
