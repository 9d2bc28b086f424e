"""Input that arrives day by day, and rebuilding what is stale."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from panelscope import config as C
from panelscope.operators import flooding, quality, signals, visits
from panelscope.plans import pipeline
from panelscope.plans.fingerprint import of_function
from panelscope.plans.stages import EXPORTS, TABLES, Workspace
from panelscope.plans.store import TableStore
from tests.test_corrections import plan_of
from tests.test_random import DAY, stream

RAW = "event_id string, user_id string, session_id string, created_time timestamp_ntz, host string, url string"
DAYS = [DAY.date() + dt.timedelta(days=d) for d in range(3)]


def exports(root):
    """All result lines, by table."""
    out = {}
    for path in sorted(glob.glob(f"{root}/exports/*/part-*.csv")):
        out.setdefault(path.split("/")[-2], []).extend(open(path).read().splitlines())
    return out


@pytest.fixture(scope="module")
def three_days(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("days")
    raw = TableStore(spark, f"{root}/in").write("raw", spark.createDataFrame(stream(5, 10, 3 * 86400, 1500), RAW))
    pipeline.run(spark, raw, None, f"{root}/whole")
    for day in (DAYS[1], DAYS[0], DAYS[2]):  # in any order
        pipeline.run(spark, raw, None, f"{root}/days", days=(day, day), changed=True)
    return raw, str(root)


def files(root):
    return {d: sorted(glob.glob(f"{root}/tables/{t}/day={d}/*.parquet")) for d in DAYS for t in ("raw_clicks", "activity")} | {
        (d, t): sorted(glob.glob(f"{root}/tables/{t}/day={d}/*.parquet")) for d in DAYS for t in ("raw_clicks", "activity")}


def test_day_by_day_gives_what_one_run_gives(three_days):
    _, root = three_days
    whole, by_day = exports(f"{root}/whole"), exports(f"{root}/days")
    assert set(whole) == set(EXPORTS) - {"seasonal_scaling"} and sum(map(len, whole.values())) > 100
    assert by_day == whole


def test_a_day_is_replaced_alone(spark, three_days):
    raw, root = three_days
    before = files(f"{root}/days")
    changed = raw.where((F.to_date("created_time") != F.lit(DAYS[1])) | (F.crc32("event_id") % 2 == 0))
    pipeline.run(spark, changed, None, f"{root}/days", days=(DAYS[1], DAYS[1]), changed=True)
    after = files(f"{root}/days")
    for table in ("raw_clicks", "activity"):
        assert before[DAYS[0], table] == after[DAYS[0], table] and before[DAYS[2], table] == after[DAYS[2], table]
        assert before[DAYS[1], table] and not set(before[DAYS[1], table]) & set(after[DAYS[1], table])
    pipeline.run(spark, changed, None, f"{root}/whole2")
    assert exports(f"{root}/days") == exports(f"{root}/whole2")
    # a day without events is taken away, the others stay
    pipeline.run(spark, raw.where("false"), None, f"{root}/days", days=(DAYS[1], DAYS[1]), last=2, changed=True)
    gone = files(f"{root}/days")
    assert gone[DAYS[1], "raw_clicks"] == gone[DAYS[1], "activity"] == [] and gone[DAYS[0], "activity"] == after[DAYS[0], "activity"]


def test_files_of_other_days_are_not_read(spark, three_days):
    _, root = three_days
    store = TableStore(spark, f"{root}/days/tables")
    work = Workspace(spark, store.read("raw_clicks"), None, store, days=(DAYS[0], DAYS[0]), sources={})
    plan = plan_of(quality.activity(work.raw_of(work.days)))
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "day" in filters and str(DAYS[0]) in filters, plan
    assert plan_of(store.read("activity").where(F.col("day") == F.lit(DAYS[2]))).split("PartitionFilters: [")[1].startswith("isnotnull(day")


def test_days_are_parsed():
    assert pipeline.parse_days("2026-05-01") == (dt.date(2026, 5, 1),) * 2
    assert pipeline.parse_days("2026-05-01..2026-05-03") == (dt.date(2026, 5, 1), dt.date(2026, 5, 3))
    assert pipeline.parse_days(None) is None
    with pytest.raises(ValueError):
        pipeline.parse_days("2026-05-03..2026-05-01")


def readers_of(changed):
    """Tables whose own code changed, and all built from them."""
    out = set(changed)
    for name, spec in TABLES.items():
        if out & set(spec.inputs):
            out.add(name)
    return out


def test_only_what_is_stale_is_built(spark, three_days, monkeypatch):
    raw, root = three_days
    out = f"{root}/stale"
    build = lambda source="a": {n for _, n, _, _ in pipeline.run(spark, raw, None, out, source=source, changed=True)}
    build()
    assert build() == set()
    before = exports(out)
    monkeypatch.setattr(C, "FLOOD_MIN_CLICKS", 3)
    stale = readers_of({"click_risk", "click_flooding"})
    written = build()
    assert written == {n for n in stale if (TABLES[n].stored or TABLES[n].export) and n != "seasonal_scaling"}
    assert "brand_visits" not in written and "user_alias" not in written and "us_clicks" in written
    after = exports(out)
    assert after["click_flooding"] != before["click_flooding"] and after["traffic_mix"] == before["traffic_mix"]
    # a restart does not trust stale tables of earlier steps either
    monkeypatch.setattr(C, "FLOOD_MIN_CLICKS", 4)
    pipeline.run(spark, raw, None, out, source="a", first=15, last=15)
    assert TableStore(spark, f"{out}/tables").read("us_clicks").where("click_flood <> (user_brand_clicks >= 4)").count() == 0


def test_what_changes_a_fingerprint(monkeypatch):
    marks = lambda: [of_function(f) for f in (signals.click_risk, flooding.click_flooding, visits.brand_visits, visits.brand_visit_sources)]
    before = marks()
    assert before == marks() and len(set(before)) == 4
    monkeypatch.setattr(C, "FLOOD_MIN_CLICKS", 7)
    assert [a != b for a, b in zip(before, marks())] == [True, True, False, False]
    monkeypatch.setattr(C, "VISIT_GAP_S", 60)
    assert [a != b for a, b in zip(before, marks())] == [True, True, True, False]
    # a helper in another module counts as well
    monkeypatch.setattr(visits, "has_affiliate_marker", lambda url: F.lit(True))
    assert of_function(visits.brand_visits) != marks()[0]
