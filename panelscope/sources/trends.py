"""Daily search-interest series: one date column and one integer column per brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope import config as C

TRENDS_SCHEMA = T.StructType(
    [T.StructField("day", T.DateType())] + [T.StructField(b.brand, T.IntegerType()) for b in C.BRANDS]
)


def read_trends(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; dates as ``yyyy-MM-dd``."""
    return spark.read.schema(TRENDS_SCHEMA).csv(path, header=True)


def trends_from_orders(orders: DataFrame) -> DataFrame:
    """A series of the same shape derived from the ``orders`` table.

    Orders of all years are laid over one year by month and day, spread over the brands
    by customer, counted per day, and scaled so that each brand's busiest day is 100. A 29th
    of February counts as the 28th.
    """
    month, day = F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    daily = (
        orders.groupBy(F.make_date(F.lit(2026), month, F.when(month == 2, F.least(day, F.lit(28))).otherwise(day)).alias("day"))
        .agg(*[
            F.count(F.when(F.col("o_custkey") % 5 == i, F.lit(1))).alias(b.brand) for i, b in enumerate(C.BRANDS)
        ])
    )
    peaks = daily.agg(F.struct(*[F.max(b.brand).alias(b.brand) for b in C.BRANDS]).alias("p")).scalar()
    return daily.select("day", *[
        F.try_divide(F.col(b.brand) * 100, peaks[b.brand]).cast("int").alias(b.brand) for b in C.BRANDS
    ])
