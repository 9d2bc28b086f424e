"""The tables of the analysis and how they depend on each other.

``TABLES`` maps every table to its step number, the function that builds it and the tables
the function reads. ``Workspace.table`` resolves a table on demand; tables marked as stored
are written once and shared, the others stay lazy and melt into the plan of their reader.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date
from threading import RLock
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.operators import (
    clicks, conversions, flooding, funnels, incrementality, panel, publisher, quality, scaling, seasonality, signals,
    summary, visits, working_set,
)
from panelscope.functions.days import PERSON_DAY
from panelscope.plans.fingerprint import digest, of_function
from panelscope.plans.store import Layout, TableStore


@dataclass(frozen=True)
class Table:
    step: int
    build: Callable[..., DataFrame]
    inputs: tuple[str, ...] = ()
    stored: bool = False
    export: bool = False
    layout: Layout | None = None
    #: Rows of a day come from raw events of that day only, so that single days can be built anew.
    by_day: bool = False


def _table(step, build, *inputs, stored=False, export=False, layout=None, by_day=False) -> Table:
    return Table(step, build, inputs, stored or by_day or layout is not None, export, layout, by_day)


# Inputs that a workspace is given rather than builds.
SOURCES = ("raw_clicks", "google_trends")

# Intermediate tables that are stored for their readers but are no result of their own.
INTERNAL = ("activity", "shared_events", "alias_heads", "alias_near", "alias_far", "person_days", "us_users", "site_steps", "site_timeline")

TABLES: dict[str, Table] = {
    "activity": _table(2, quality.activity, "raw_clicks", by_day=True),
    "dq_profile": _table(2, quality.dq_profile, "raw_clicks", "activity", "panel_users", export=True),
    "dq_hourly": _table(2, quality.dq_hourly, "activity", export=True),

    "brand_tagging": _table(3, working_set.brand_tagging, "raw_clicks"),
    "brand_users": _table(3, working_set.brand_users, "brand_tagging", stored=True),
    "brand_user_events_raw": _table(3, working_set.brand_user_events_raw, "brand_tagging", "brand_users", stored=True),
    "shared_events": _table(3, working_set.shared_events, "brand_user_events_raw", stored=True),
    "alias_heads": _table(3, working_set.alias_heads, "shared_events", stored=True),
    "alias_near": _table(3, working_set.alias_near, "shared_events", "alias_heads", stored=True),
    "alias_far": _table(3, working_set.alias_far, "shared_events", "alias_near", stored=True),
    "user_alias": _table(3, working_set.user_alias, "shared_events", "alias_near", "alias_far", stored=True),
    "brand_user_events": _table(3, working_set.brand_user_events, "brand_user_events_raw", "user_alias", stored=True),
    "person_days": _table(3, working_set.person_days, "brand_user_events", layout=Layout(PERSON_DAY, (*PERSON_DAY, "sec"))),

    "affiliate_landings": _table(4, clicks.affiliate_landings, "brand_user_events"),
    "landing_clicks": _table(4, clicks.landing_clicks, "affiliate_landings", stored=True),
    "affiliate_hops": _table(4, clicks.affiliate_hops, "brand_user_events"),
    "hop_clicks": _table(4, clicks.hop_clicks, "person_days", "landing_clicks"),
    "affiliate_clicks": _table(4, clicks.affiliate_clicks, "landing_clicks", "hop_clicks", stored=True),

    "brand_visits": _table(5, visits.brand_visits, "person_days", stored=True),
    "brand_visit_sources": _table(5, visits.brand_visit_sources, "brand_visits"),

    "conversion_events": _table(6, conversions.conversion_events, "brand_user_events"),
    "conversions": _table(6, conversions.conversions, "person_days", stored=True),
    "funnel_events": _table(6, conversions.funnel_events, "brand_user_events", stored=True),
    "click_outcomes": _table(6, conversions.click_outcomes, "affiliate_clicks", "conversions", "funnel_events"),
    "brand_funnel": _table(6, conversions.brand_funnel, "brands", "brand_user_events", "funnel_events", "conversions",
                           export=True),

    "click_context": _table(7, signals.click_context, "affiliate_clicks", "person_days"),
    "click_risk": _table(7, signals.click_risk, "affiliate_clicks", "click_context"),

    "panel_users": _table(8, scaling.panel_users, "activity", stored=True),
    "us_users": _table(8, scaling.us_users, "panel_users"),
    "scaling": _table(8, scaling.scaling, "brand_visits", "panel_users", "brands", "external_benchmarks", stored=True,
                      export=True),
    "brand_benchmarks": _table(8, scaling.brand_benchmarks, "brands", "external_benchmarks", "brand_user_events"),
    "brand_scale": _table(8, scaling.brand_scale, "brands", "scaling"),
    "scaling_validation": _table(8, scaling.scaling_validation, "brands", "brand_visits", "panel_users",
                                 "external_benchmarks", "scaling", stored=True, export=True),

    "us_clicks": _table(9, summary.us_clicks, "click_risk", "click_outcomes", "us_users", stored=True),
    "competitor_summary": _table(9, summary.competitor_summary, "brands", "brand_scale", "brand_visits", "us_clicks",
                                 "conversions", "us_users", stored=True, export=True),
    "traffic_mix": _table(9, summary.traffic_mix, "brand_visit_sources", "us_users", export=True),
    "publisher_summary": _table(9, summary.publisher_summary, "us_clicks", export=True),
    "signal_summary": _table(9, summary.signal_summary, "us_clicks", export=True),
    "flagged_click_sources": _table(9, summary.flagged_click_sources, "us_clicks", export=True),

    "hijack_sensitivity": _table(10, summary.hijack_sensitivity, "us_clicks", stored=True, export=True),

    "checkout_anchors": _table(11, incrementality.checkout_anchors, "funnel_events", "us_users", "conversions",
                               "us_clicks"),
    "incrementality": _table(11, incrementality.incrementality, "checkout_anchors", stored=True, export=True),
    "incrementality_summary": _table(11, incrementality.incrementality_summary, "incrementality", export=True),
    "commission_at_risk": _table(11, incrementality.commission_at_risk, "competitor_summary", "hijack_sensitivity",
                                 "us_clicks", export=True),

    "seasonal_ratio": _table(12, seasonality.seasonal_ratio, "google_trends"),
    "seasonal_scaling": _table(12, seasonality.seasonal_scaling, "competitor_summary", "scaling_validation",
                               "seasonal_ratio", export=True),

    "panel_activity": _table(13, panel.panel_activity, "panel_users"),
    "panel_profile": _table(13, panel.panel_profile, "panel_users", "user_alias", "brand_user_events", export=True),
    "panel_coverage": _table(13, panel.panel_coverage, "activity", "coverage_sites", export=True),
    "coupon_extension_users": _table(13, panel.coupon_extension_users, "brand_user_events"),
    "hijack_by_segment": _table(13, panel.hijack_by_segment, "us_clicks", "coupon_extension_users", "panel_activity",
                                export=True),
    "hijack_reweighted": _table(13, panel.hijack_reweighted, "us_clicks", "coupon_extension_users", export=True),

    "category_events": _table(14, funnels.category_events, "raw_clicks", "user_alias", "us_users", stored=True),
    "category_funnel": _table(14, funnels.category_funnel, "category_events", export=True),
    "brand_funnel_cat": _table(14, funnels.brand_funnel_cat, "category_events", export=True),
    "cross_shopping": _table(14, funnels.cross_shopping, "category_events", export=True),
    "journey_order": _table(14, funnels.journey_order, "category_events", export=True),
    "click_stage": _table(14, funnels.click_stage, "us_clicks", "person_days", stored=True),
    "click_funnel_stage": _table(14, funnels.click_funnel_stage, "click_stage", export=True),

    "click_flood_behaviour": _table(15, flooding.click_flood_behaviour, "us_clicks", "person_days", export=True),
    "click_flooding": _table(15, flooding.click_flooding, "us_clicks", "brand_scale", export=True),
    "click_flood_sources": _table(15, flooding.click_flood_sources, "us_clicks", export=True),

    "named_sites": _table(16, publisher.named_sites, "brand_user_events", stored=True),
    "monitor_clicks": _table(16, publisher.monitor_clicks, "us_clicks", "click_stage", "named_sites"),
    "site_steps": _table(16, publisher.site_steps, "us_clicks", "brand_user_events", stored=True),
    "site_timeline": _table(16, publisher.site_timeline, "us_clicks", "site_steps", stored=True),
    "click_journey": _table(16, publisher.click_journey, "us_clicks", "site_steps", "site_timeline", stored=True),
    "masked_journey": _table(16, publisher.masked_journey, "click_journey", "named_sites"),
    "publisher_risk_status": _table(16, publisher.publisher_risk_status, "us_clicks"),
}

# Small dimensions that come from the configuration.
DIMENSIONS: dict[str, Callable[[SparkSession], DataFrame]] = {
    "brands": working_set.brands,
    "external_benchmarks": scaling.external_benchmarks,
    "coverage_sites": panel.coverage_sites,
}

EXPORTS = tuple(name for name, t in TABLES.items() if t.export)


class Workspace:
    """All tables of one input, built on demand."""

    def __init__(self, spark: SparkSession, raw_clicks: DataFrame, google_trends: DataFrame | None = None,
                 store: TableStore | None = None, first_step: int = 0, days: tuple[date, date] | None = None,
                 sources: dict[str, str] | None = None):
        """``first_step``: stored tables of earlier steps are read from the store when it has them.

        ``days``: the raw input has a column ``day``, and of tables by day only these days are built, if the store has the others.
        ``sources``: a text per source that changes with it. With these, stored tables count only if they were made of the
        same sources, code and parameters.
        """
        self.spark = spark
        self.store = store or TableStore(spark)
        self.first_step, self.days, self.sources = first_step, days, sources
        self._lock, self._locks = RLock(), {}
        self._fingerprints: dict[str, str] = {}
        self._raw_by_day = raw_clicks if days else None
        self._ready: dict[str, DataFrame] = {"raw_clicks": raw_clicks.drop("day") if days else raw_clicks}
        if google_trends is not None:
            self._ready["google_trends"] = google_trends

    def fingerprint(self, name: str) -> str:
        """What a table would be made of now."""
        if name not in self._fingerprints:
            if name in TABLES:
                spec = TABLES[name]
                text = digest(of_function(spec.build), repr(spec.layout), *[self.fingerprint(i) for i in spec.inputs])
            elif name in DIMENSIONS:
                text = of_function(DIMENSIONS[name])
            else:
                text = (self.sources or {}).get(name, "")
            self._fingerprints[name] = digest(name, text)
        return self._fingerprints[name]

    def table(self, name: str) -> DataFrame:
        """A table; whoever asks first builds it, others wait."""
        with self._lock:
            turn = self._locks.setdefault(name, RLock())
        with turn:
            if name not in self._ready:
                if name in DIMENSIONS:
                    self._ready[name] = DIMENSIONS[name](self.spark)
                elif self._kept(name):
                    self._ready[name] = self.store.read(name)
                else:
                    self._ready[name] = self.build(name)
            return self._ready[name]

    def _kept(self, name: str) -> bool:
        """Whether the store has the table from an earlier run, made of what it would be made of now."""
        if name not in TABLES or TABLES[name].step >= self.first_step or not self.store.exists(name):
            return False
        return self.sources is None or self.store.noted("fingerprints", name) == self.fingerprint(name)

    def build(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(f"unknown table {name!r}" if name not in SOURCES else f"this workspace has no {name!r}")
        spec = TABLES[name]
        if not spec.stored:
            return spec.build(*[self.table(i) for i in spec.inputs])
        if spec.by_day:
            days = self.days if self.days and self.store.exists(name) else None
            inputs = [self.raw_of(days) if i == "raw_clicks" else self.table(i) for i in spec.inputs]
            df = self.store.write_days(name, spec.build(*inputs), days)
        else:
            df = self.store.write(name, spec.build(*[self.table(i) for i in spec.inputs]), spec.layout)
        if self.sources is not None:
            self.store.note("fingerprints", name, self.fingerprint(name))
        return df

    def raw_of(self, days: tuple[date, date] | None) -> DataFrame:
        """The raw events of some days; the files of others are not read."""
        if days is None:
            return self.table("raw_clicks")
        return self._raw_by_day.where(F.col("day").between(F.lit(days[0]), F.lit(days[1]))).drop("day")

    def order(self, names: Iterable[str]) -> list[str]:
        """``names`` and all tables they are built from, inputs first. What the store has needs no inputs."""
        out: dict[str, None] = {}

        def visit(name: str) -> None:
            if name in TABLES and name not in out:
                if name not in self._ready and not self._kept(name):
                    for i in TABLES[name].inputs:
                        visit(i)
                out[name] = None

        for name in names:
            visit(name)
        return list(out)

    def each(self, names: Iterable[str], action: Callable[[str, DataFrame], Any], threads: int = 8) -> dict[str, Any]:
        """Build tables and call ``action(name, df)`` for each, several at a time.

        Reports over small tables do not fill a cluster one by one. Every table that is needed, asked for or not, is
        one job and waits for its own inputs only; inputs are submitted first, so whatever a
        job waits for has already been started.
        """
        wanted = set(names)
        jobs: dict[str, Future] = {}

        def job(name: str):
            for i in TABLES[name].inputs:
                if i in jobs:
                    jobs[i].result()
            df = self.table(name)
            return action(name, df) if name in wanted else None

        with ThreadPoolExecutor(threads) as pool:
            for name in self.order(n for n in TABLES if n in wanted):
                jobs[name] = pool.submit(job, name)
            return {name: f.result() for name, f in jobs.items() if name in wanted}
