"""Person-days: bounded groups, nothing dealt out again, and nothing lost at midnight."""

import datetime as dt
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import sql
from panelscope.functions.days import DAY_S, LOOK_AHEAD_S, LOOK_BACK_S, by_day, lists_by_day, with_lists
from panelscope.operators import clicks, conversions, flooding, funnels, quality, signals, visits
from panelscope.plans.stages import TABLES, Workspace
from panelscope.plans.store import TableStore
from tests.compare import assert_same
from tests.test_corrections import plan_of
from tests.test_random import DAY, stream

RAW = "event_id string, user_id string, session_id string, created_time timestamp_ntz, host string, url string"
LAYOUT = TABLES["person_days"].layout
CLICKS = "brand string, click_key string, user_id string, click_time timestamp_ntz, converted boolean, strong_hijack_signal boolean, no_landing boolean"
OVER_EVENTS = ["brand_visits", "brand_visit_sources", "conversions", "hop_clicks", "click_context", "click_outcomes", "click_stage", "click_flood_behaviour"]


def around_midnight(seed):
    """The ties of the random streams, pressed into the 40 minutes before and after three midnights."""
    r = random.Random(seed)
    rows = []
    for event, user, session, at, host, url in stream(seed, 8, 2400, 3000):
        second = int((at - DAY).total_seconds())
        midnight = DAY + dt.timedelta(days=1 + int(user.strip("um")) % 3 if r.random() < 0.5 else 1)
        rows.append((event, user, session, midnight + dt.timedelta(seconds=second if r.random() < 0.5 else -second), host, url))
    return rows


@pytest.fixture(scope="module")
def midnight(spark):
    rows = around_midnight(7)
    store = TableStore(spark)
    raw = store.write("raw_clicks", spark.createDataFrame(rows, RAW))
    con = duckdb.connect()
    names = ["event_id", "user_id", "session_id", "created_time", "host", "url"]
    con.register("stream", pa.table({n: [row[i] for row in rows] for i, n in enumerate(names)}))
    con.execute("CREATE TABLE micro AS SELECT * REPLACE (CAST(created_time AS TIMESTAMP) AS created_time) FROM stream")
    return Workspace(spark, raw, None, store), con


@pytest.mark.parametrize("name", OVER_EVENTS)
def test_nothing_is_lost_at_midnight(midnight, name):
    work, con = midnight
    assert assert_same(work.table(name), con, sql.statement(name, raw_clicks="SELECT * FROM micro")) > 0


def test_rows_are_in_the_days_that_look_at_them(spark):
    at = [0, LOOK_AHEAD_S, LOOK_AHEAD_S + 1, DAY_S // 2, DAY_S - LOOK_BACK_S - 1, DAY_S - LOOK_BACK_S, DAY_S - 1]
    got = by_day(spark.createDataFrame([(DAY_S * 5 + s,) for s in at], "sec long")).collect()
    days = {s: sorted((r["day"], r["own"]) for r in got if r["sec"] == DAY_S * 5 + s) for s in at}
    own, before, after = (5, True), (4, False), (6, False)
    assert days == {0: [before, own], LOOK_AHEAD_S: [before, own], LOOK_AHEAD_S + 1: [own], DAY_S // 2: [own],
                    DAY_S - LOOK_BACK_S - 1: [own], DAY_S - LOOK_BACK_S: [own, after], DAY_S - 1: [own, after]}


@pytest.fixture(scope="module")
def ninety_days(spark):
    """One person with ninety days of pages, a hop and a tagged landing each, and a few others."""
    seconds = spark.range(90 * 200).selectExpr("id", "id div 200 AS d", "(id % 200) * 400 AS s")
    rows = seconds.selectExpr(
        "concat('e', id) AS event_id", "CASE WHEN id % 200 < 190 THEN 'busy' ELSE concat('u', id % 7) END AS user_id", "'s' AS session_id",
        f"TIMESTAMP_NTZ'2026-05-01 00:00:00' + make_dt_interval(d, 0, 0, s) AS created_time",
        "CASE id % 5 WHEN 0 THEN 'saatva.prf.hn' WHEN 1 THEN 'google.com' ELSE 'saatva.com' END AS host",
        "CASE id % 5 WHEN 0 THEN concat('https://saatva.prf.hn/click/camref:1/destination:https%3A%2F%2Fwww.saatva.com%2F', id) "
        "WHEN 1 THEN 'https://www.google.com/search?q=saatva' WHEN 2 THEN concat('https://www.saatva.com/p?irclickid=', id) "
        "ELSE concat('https://www.saatva.com/p', id) END AS url")
    store = TableStore(spark)
    return Workspace(spark, store.write("raw_clicks", rows), None, store)


def test_one_person_with_ninety_days_is_many_tasks(ninety_days):
    days = ninety_days.table("person_days")
    tasks = days.where("user_id = 'busy'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 0.5 * sum(r["count"] for r in tasks)
    assert days.groupBy("user_id", "day").count().agg(F.max("count")).first()[0] < 250
    assert ninety_days.table("brand_visits").where("user_id = 'busy'").count() > 80
    assert ninety_days.table("hop_clicks").count() > 80


def readers(work):
    days, landings, us = (work.table(n) for n in ("person_days", "landing_clicks", "us_clicks"))
    return {
        "brand_visits": visits.brand_visits(days), "conversions": conversions.conversions(days), "hop_clicks": clicks.hop_clicks(days, landings),
        "click_context": signals.click_context(work.table("affiliate_clicks"), days), "click_stage": funnels.click_stage(us, days),
        "click_flood_behaviour": flooding.click_flood_behaviour(us, days)}


def ancestors(plan: str, mark: str):
    """Operators above each line with ``mark``, nearest first."""
    lines = plan.split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if mark in line:
            above, d = [], depth[i]
            for j in range(i - 1, -1, -1):
                if depth[j] < d:
                    above.append(lines[j].strip(" :+-"))
                    d = depth[j]
            yield above


@pytest.mark.parametrize("name", ["brand_visits", "conversions", "hop_clicks", "click_context", "click_stage", "click_flood_behaviour"])
def test_events_are_not_dealt_out_again(ninety_days, name):
    """One scan of the person-days; every window or group of their seconds stands below the first exchange; no window is keyed by person alone."""
    plan = plan_of(readers(ninety_days)[name])
    scans = list(ancestors(plan, "Bucketed: true"))
    assert len(scans) == 1, plan
    for above in scans:
        exchange = next((i for i, x in enumerate(above) if x.startswith("Exchange")), len(above))
        grouped = [i for i, x in enumerate(above) if "Aggregate" in x]
        assert grouped and min(grouped) < exchange, plan
        seconds = [i for i, x in enumerate(above) if x.startswith("Window") and "day#" in x.split("windowspecdefinition")[-1] or "Aggregate" in x and "sec#" in x.split("functions")[0]]
        assert max(seconds, default=0) < exchange, plan
        assert not any(x.startswith("Window") and "[user_id#" in x and "day#" not in x and i < exchange for i, x in enumerate(above)), plan


def test_flooding_counts_a_persons_days(spark):
    """Eight clicks on each of three days are three days with 4 to 9 clicks, not one with 24."""
    rows = []
    for d in range(3):
        for i in range(8):
            at = DAY + dt.timedelta(days=d, minutes=90 * i)
            rows.append((f"e{d}{i}", "u1", "s", at, "saatva.com", f"https://www.saatva.com/p?irclickid={d}{i}"))
    store = TableStore(spark)
    raw = store.write("raw_clicks", spark.createDataFrame(rows, RAW))
    got = Workspace(spark, raw, None, store).table("click_flood_behaviour").collect()
    assert [(r["clicks_per_day"], r["people"], r["clicks"], r["median_active_hours"]) for r in got] == [("2 4-9", 3, 24, 8.0)]


def test_a_layout_survives_a_restart(spark, midnight):
    work, _ = midnight
    store = work.store
    table = work.table("person_days")
    want = sorted(map(str, table.collect()))
    spark.sql(f"DROP TABLE {store._table('person_days')}")
    again = TableStore(spark, store.root).read("person_days")
    assert sorted(map(str, again.collect())) == want and again.schema == table.schema
    assert "Exchange" not in plan_of(again.groupBy("user_id", "day", "sec").count())


def test_reports_on_rows_and_users_read_the_activity(spark, ninety_days):
    """The raw input is scanned once for the activity; beyond it only distinct events, sessions and copies read it again."""
    raw, activity, users = (ninety_days.table(n) for n in ("raw_clicks", "activity", "panel_users"))
    scans = lambda df: plan_of(df).count("url")
    assert plan_of(quality.activity(raw)).count("FileScan") == 1
    for name in ("dq_hourly", "panel_users", "panel_coverage"):
        assert "raw_clicks" not in TABLES[name].inputs
    assert sum(line.count("event_id") > 0 for line in plan_of(quality.dq_profile(raw, activity, users)).split("\n") if "FileScan" in line) == 1
    assert scans(quality.dq_hourly(activity)) == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_list_meets_one_event_of_its_day(spark, how):
    """A busy day's list is not copied to each of its events before all but the first drop it."""
    seconds = by_day(spark.range(3000).selectExpr("CASE WHEN id % 3 = 2 THEN NULL ELSE id % 3 END AS user_id", "40000 + id AS sec", "'x' AS url"))
    lists = lists_by_day(spark.range(500).selectExpr("0L AS user_id", "40000 + id AS sec", "id AS click"), "click")
    got = with_lists(seconds, lists, how)
    assert got.columns == [*seconds.columns, "beside"]
    sizes = sorted(r[0] for r in got.select(F.size("beside")).collect())
    assert sizes == [0] * ((1000 if how == "inner" else 3000) - 1) + [500]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and plan.index("Join LeftOuter") < plan.index("Window [row_number")
