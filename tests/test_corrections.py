"""Cases the fixtures do not reach: missing control groups, brands without a ratio, plans, restarts, all days of a year."""

import datetime as dt
from collections import Counter

import pytest

from panelscope import config as C
from panelscope.operators import incrementality, panel, quality, scaling, seasonality
from panelscope.plans import pipeline
from panelscope.plans.stages import TABLES, Workspace
from panelscope.plans.store import TableStore
from panelscope.sources.synthetic import read_clickstream
from panelscope.sources.trends import trends_from_orders

SF_DIR = "/root/testdata/sf0.001"
GROUPS = "stage string, grp string, users long, orders long, order_rate_pct double"


def effect(spark, rows):
    return incrementality.incrementality_summary(spark.createDataFrame([(*r, None) for r in rows], GROUPS)).first()


def test_expected_orders_need_a_control_group_in_every_stage(spark):
    injected, control = incrementality.INJECTED, incrementality.CONTROL
    rows = [("cart", injected, 10, 10), ("checkout", injected, 10, 10), ("checkout", control, 10, 5)]
    out = effect(spark, rows)
    assert (out["injected_users"], out["observed_orders"]) == (20, 20)
    assert out["expected_orders_without_click"] is None and out["observed_to_expected"] is None and out["pct_orders_incremental"] is None
    assert effect(spark, [*rows, ("cart", control, 4, 1)])["expected_orders_without_click"] == 7.5
    # a stage nobody was injected in needs no control
    assert effect(spark, [("cart", control, 4, 1), *rows[1:]])["expected_orders_without_click"] == 5.0


def test_a_brand_without_a_ratio_is_left_out_on_both_sides(spark):
    pooled = list(C.MAY_CALIBRATION)
    ratios = {b: 2.0 for b in pooled}
    days = [dt.date.fromisoformat(str(C.SEASON_WEEK[0])), dt.date(2026, C.SEASON_MONTH, 5)]
    names = [b.brand for b in C.BRANDS]
    missing = pooled[-1]
    rows = [(days[0], *[None if n == missing else 40 for n in names]), (days[1], *[20 for n in names])]
    got = {r["brand"]: r["ratio"] for r in seasonality.seasonal_ratio(spark.createDataFrame(rows, "day date, " + ", ".join(f"{n} int" for n in names))).collect()}
    assert missing not in got and all(got[b] == ratios[b] for b in pooled if b != missing)
    validation = spark.createDataFrame([(n, 100.0, 10) for n in names], "brand string, similarweb_us_visits_per_day double, panel_us_visits long")
    summary = spark.createDataFrame([(n, 1.0, 5, 7.0) for n in names], "brand string, scale_factor double, panel_affiliate_clicks long, est_us_affiliate_clicks double")
    ratio = spark.createDataFrame(list(got.items()), "brand string, ratio double")
    out = {r["brand"]: r["scale_factor_may"] for r in seasonality.seasonal_scaling(summary, validation, ratio).collect()}
    assert missing not in out and all(out[b] == 20.0 for b in pooled if b != missing)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distinct_counts_do_not_expand_the_input(spark):
    raw = read_clickstream(spark, SF_DIR)
    activity = quality.activity(raw)
    users = scaling.panel_users(activity)
    assert "Expand" not in plan_of(quality.dq_profile(raw, activity, users))
    events = raw.selectExpr("user_id", "session_id")
    alias = spark.createDataFrame([], "user_id long, person_id long")
    assert "Expand" not in plan_of(panel.panel_profile(users, alias, events))


def test_profile_of_rows_with_nulls(spark):
    at = dt.datetime(2026, 5, 1)
    rows = [(1, 1, 1, at, "h", "u"), (2, 1, 1, at, "h", "u"), (None, None, None, None, None, None), (3, 2, None, at + dt.timedelta(days=1), "h", "v")]
    raw = spark.createDataFrame(rows, "event_id long, user_id long, session_id long, created_time timestamp_ntz, host string, url string")
    activity = quality.activity(raw)
    out = quality.dq_profile(raw, activity, scaling.panel_users(activity)).first().asDict()
    assert {k: out[k] for k in ("rows", "distinct_event_ids", "duplicate_rows", "users", "sessions", "days", "rows_with_nulls")} == {
        "rows": 4, "distinct_event_ids": 3, "duplicate_rows": 1, "users": 2, "sessions": 1, "days": 2, "rows_with_nulls": 2}


class CountingStore(TableStore):
    """Notes every write."""

    def __init__(self, spark, root):
        super().__init__(spark, root)
        self.writes = Counter()

    def write(self, name, df, layout=None):
        self.writes[name] += 1
        return super().write(name, df, layout)


def test_a_restart_on_an_empty_store_writes_every_table_once(spark, tmp_path):
    raw = read_clickstream(spark, SF_DIR)
    trends = trends_from_orders(spark.read.parquet(f"{SF_DIR}/orders.parquet"))
    store = CountingStore(spark, str(tmp_path / "tables"))
    work = Workspace(spark, raw, trends, store, first_step=9)
    done = work.each([n for n, t in TABLES.items() if t.step == 9], lambda name, df: df.count(), threads=16)
    assert set(done) == {n for n, t in TABLES.items() if t.step == 9} and set(store.writes.values()) == {1}


def test_inputs_come_before_their_readers(spark):
    order = Workspace(spark, None, None, TableStore(spark, "/nowhere")).order(TABLES)
    assert sorted(order) == sorted(TABLES)
    assert all(order.index(i) < order.index(n) for n in order for i in TABLES[n].inputs if i in TABLES)


def test_a_store_of_another_input_is_refused(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.parquet").write_text("x")
    source = pipeline.input_fingerprint(spark, f"{tmp_path}/one/*", None)
    store = TableStore(spark, f"{tmp_path}/tables")
    store.claim(source, fresh=True)
    store.claim(source, fresh=False)
    (tmp_path / "one" / "b.parquet").write_text("more")
    other = pipeline.input_fingerprint(spark, f"{tmp_path}/one/*", None)
    assert other != source
    with pytest.raises(ValueError, match="another input"):
        store.claim(other, fresh=False)
    store.claim(other, fresh=True)
    store.claim(other, fresh=False)


def test_session_folders_are_dropped(spark):
    store = TableStore(spark)
    store.write("t", spark.range(3))
    assert store.exists("t")
    store.drop()
    assert not store.exists("t")


def test_trends_cover_the_whole_year(spark):
    rows = [(i, dt.date(y, m, d)) for i, (y, m, d) in enumerate([(1996, 2, 29), (1997, 2, 28), (1995, 1, 1), (1998, 12, 31), (1998, 12, 31), (1998, 12, 31)])]
    out = trends_from_orders(spark.createDataFrame(rows, "o_custkey long, o_orderdate date")).collect()
    assert {r["day"] for r in out} == {dt.date(2026, 2, 28), dt.date(2026, 1, 1), dt.date(2026, 12, 31)}
