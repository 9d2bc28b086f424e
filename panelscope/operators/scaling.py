"""From panel counts to national estimates: who is in the panel, and by what factor it is scaled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope import config as C
from panelscope.functions.exprs import count_where, ratio, round_half


def ordered_sum(x: Column) -> Column:
    """Sum of a handful of doubles, smallest first, so that reruns agree to the last bit (per-brand rows only)."""
    return F.aggregate(F.array_sort(F.collect_list(x)), F.lit(0.0), lambda a, b: a + b)


def panel_users(activity: DataFrame) -> DataFrame:
    """Events per raw user id and whether the user is in the US (less than 20 % on non-US country domains)."""
    return activity.groupBy("user_id").agg(F.sum("n").alias("events"), F.sum("non_us").alias("non_us_cctld_events")).withColumn(
        "is_us", F.col("non_us_cctld_events") * 100 < F.col("events") * C.NON_US_PCT)


def us_users(panel_users: DataFrame) -> DataFrame:
    return panel_users.where("is_us").select("user_id")


def external_benchmarks(spark: SparkSession) -> DataFrame:
    """Public monthly visits and US share by domain; one row per entry of ``config.BENCHMARKS``."""
    rows = [
        (d, visits, share, C.BENCHMARK_SOURCE if visits is not None else C.BENCHMARK_SOURCE_HIDDEN,
         C.BENCHMARK_URL.format(domain=d))
        for d, visits, share in C.BENCHMARKS
    ]
    return spark.createDataFrame(
        rows, "domain string, monthly_visits double, us_share double, source string, source_url string")


def brand_benchmarks(brands: DataFrame, benchmarks: DataFrame, events: DataFrame) -> DataFrame:
    """Each brand of the dimension with its benchmark and the page events and persons the panel has on its site."""
    seen = events.where("is_brand_page").groupBy("brand", "user_id").agg(F.count("*").alias("n")).groupBy("brand").agg(
        F.sum("n").alias("panel_events"), F.count("user_id").alias("panel_persons"))
    known = benchmarks.select("domain", "monthly_visits", "us_share")
    return brands.select("brand", "domain", "is_client", "search_term_re").join(known, "domain", "left").join(seen, "brand", "left").select(
        "brand", "domain", "is_client", "search_term_re", "monthly_visits", "us_share",
        F.coalesce("panel_events", F.lit(0).cast("long")).alias("panel_events"), F.coalesce("panel_persons", F.lit(0).cast("long")).alias("panel_persons"))


def us_visits(visits: DataFrame, us_users: DataFrame) -> DataFrame:
    """Visits of US persons per brand, all and those entered through an affiliate link."""
    return visits.join(us_users, "user_id", "left_semi").groupBy("brand").agg(
        F.count("*").alias("visits"), count_where(F.col("affiliate_entry")).alias("affiliate_entry_visits"))


def _benchmark_per_day(benchmarks: DataFrame) -> DataFrame:
    per_day = F.col("monthly_visits") * F.col("us_share") / F.lit(float(C.BENCHMARK_DAYS))
    return benchmarks.select("domain", per_day.alias("per_day"))


def scaling(visits: DataFrame, panel_users: DataFrame, brands: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Scale factors (one row): benchmark visits per day over panel visits, retail and other brands, and by population."""
    by_brand = (
        us_visits(visits, us_users(panel_users)).join(brands, "brand")
        .join(_benchmark_per_day(benchmarks), "domain").where(F.col("per_day").isNotNull())
    )
    retail = F.col("brand") == C.RETAIL_BRAND
    totals = by_brand.agg(
        F.max(F.when(retail, F.col("visits"))).alias("retail_panel"),
        F.max(F.when(retail, F.col("per_day"))).alias("retail_day"),
        F.sum(F.when(~retail, F.col("visits"))).alias("other_panel"),
        F.when(F.count(F.when(~retail, 1)) > 0, ordered_sum(F.when(~retail, F.col("per_day")))).alias("other_day"),
    )
    us_panel = panel_users.agg(count_where(F.col("is_us"))).scalar()
    return totals.withColumn("us_panel_users", us_panel).select(
        F.col("retail_panel").alias("walmart_us_visits_panel"),
        F.col("retail_day").alias("walmart_us_visits_per_day"),
        ratio(F.col("retail_day"), F.col("retail_panel")).alias("scale_factor_retail"),
        F.col("other_panel").alias("mattress_us_visits_panel"),
        F.col("other_day").alias("mattress_us_visits_per_day"),
        ratio(F.col("other_day"), F.col("other_panel")).alias("scale_factor_mattress"),
        "us_panel_users",
        ratio(F.lit(C.US_INTERNET_USERS), F.col("us_panel_users")).alias("scale_factor_population"),
    )


def _factors(scaling: DataFrame, *names: str) -> Column:
    """The one row of scale factors as a scalar subquery."""
    return scaling.select(F.struct(*names)).scalar()


def brand_scale(brands: DataFrame, scaling: DataFrame) -> DataFrame:
    """Primary and alternative factor of each brand."""
    names = ("scale_factor_retail", "scale_factor_mattress", "scale_factor_population")
    f = _factors(scaling, *names)
    retail = F.col("brand") == C.RETAIL_BRAND
    return brands.withColumn("f", f).select(
        "brand",
        F.when(retail, F.col("f.scale_factor_retail")).otherwise(F.col("f.scale_factor_mattress"))
        .alias("scale_factor"),
        F.when(retail, F.col("f.scale_factor_population")).otherwise(F.col("f.scale_factor_retail"))
        .alias("scale_factor_alt"),
    )


def scaling_validation(brands: DataFrame, visits: DataFrame, panel_users: DataFrame, benchmarks: DataFrame,
                       scaling: DataFrame) -> DataFrame:
    """Scaled panel visits over benchmark visits, per brand and factor."""
    f = _factors(scaling, "scale_factor_retail", "scale_factor_mattress")
    rows = (
        brands.join(us_visits(visits, us_users(panel_users)), "brand", "left")
        .join(_benchmark_per_day(benchmarks), "domain", "left")
        .withColumn("n", F.coalesce("visits", F.lit(0))).withColumn("f", f)
    )

    def scaled(factor: str) -> Column:
        return round_half(ratio(F.col("n") * F.col(f"f.{factor}"), F.col("per_day")), 2)

    return rows.select(
        "brand",
        F.col("n").alias("panel_us_visits"),
        round_half(F.col("per_day")).alias("similarweb_us_visits_per_day"),
        scaled("scale_factor_retail").alias("ratio_with_f_retail"),
        scaled("scale_factor_mattress").alias("ratio_with_f_mattress"),
    )
