"""Move the scale factors from the benchmark month to the panel day with a search-interest series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope import config as C
from panelscope.functions.exprs import ratio, round_half
from panelscope.operators.scaling import ordered_sum


def seasonal_ratio(trends: DataFrame) -> DataFrame:
    """Mean interest in the week around the panel day over the mean of the benchmark month, per brand.

    A brand without a ratio (no interest known in either period, or none at all in the month) has no row, so it is left
    out of the pooled factor on both sides, and of the result.
    """
    long = trends.unpivot(["day"], [b.brand for b in C.BRANDS], "brand", "interest")
    week = F.col("day").between(*[F.lit(d).cast("date") for d in C.SEASON_WEEK])
    month = F.month("day") == C.SEASON_MONTH
    return long.groupBy("brand").agg(
        ratio(F.avg(F.when(week, F.col("interest"))), F.avg(F.when(month, F.col("interest")))).alias("ratio")
    ).where("ratio IS NOT NULL")


def seasonal_scaling(summary: DataFrame, validation: DataFrame, seasonal_ratio: DataFrame) -> DataFrame:
    """Scale factor and click estimate per brand, as measured and moved to the panel day."""
    moved = F.col("similarweb_us_visits_per_day") * F.col("ratio")
    retail, pooled = F.col("brand") == C.RETAIL_BRAND, F.col("brand").isin(*C.MAY_CALIBRATION)
    f = validation.join(seasonal_ratio, "brand").agg(F.struct(
        ratio(ordered_sum(F.when(pooled, moved)), F.sum(F.when(pooled, F.col("panel_us_visits")))).alias("mattress"),
        ratio(ordered_sum(F.when(retail, moved)), F.sum(F.when(retail, F.col("panel_us_visits")))).alias("retail"),
    )).scalar()
    factor = F.when(retail, F.col("f.retail")).otherwise(F.col("f.mattress"))
    return summary.join(seasonal_ratio, "brand").withColumn("f", f).select(
        "brand",
        round_half(F.col("ratio"), 2).alias("trends_may_vs_aug"),
        F.col("scale_factor").alias("scale_factor_aug"),
        round_half(factor).alias("scale_factor_may"),
        "panel_affiliate_clicks",
        F.col("est_us_affiliate_clicks").alias("est_us_affiliate_clicks_aug"),
        round_half(F.col("panel_affiliate_clicks") * factor).alias("est_us_affiliate_clicks_may"),
    )
