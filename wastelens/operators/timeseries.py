"""Month series with gap fill and moving mean, flat forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_STEP = {"Weekly": "7 days", "Monthly": "1 month", "Quarterly": "3 months", "Annual": "1 year"}


def spine(keys: DataFrame, key_col: str, grain: str) -> DataFrame:
    """Every period key from the smallest to the largest key present.

    Built from ``min``/``max`` of an already aggregated key table, so its
    size is the number of periods in the span, not the number of rows.
    """
    step = F.expr(f"INTERVAL {_STEP[grain]}")
    b = keys.agg(F.min(key_col).alias("_lo"), F.max(key_col).alias("_hi"))
    return b.where(F.col("_lo").isNotNull()).select(
        F.explode(F.sequence(F.col("_lo"), F.col("_hi"), step)).alias(key_col))


def month_series(df: DataFrame, date_col: str = "date", cost_col: str = "cost") -> DataFrame:
    """Cost per calendar month with empty months as 0 and a 3-month moving
    mean (fewer months at the start). Columns: period (date), cost, cost_ma3.

    The moving mean window has no partition key; it runs on the month table
    (one row per month of the span), never on log rows.
    """
    m = (df.where(F.col(date_col).isNotNull())
         .groupBy(F.trunc(F.to_date(date_col), "MM").alias("period"))
         .agg(F.sum(F.coalesce(F.col(cost_col), F.lit(0.0))).alias("cost")))
    s = spine(m, "period", "Monthly").join(m, "period", "left") \
        .withColumn("cost", F.coalesce("cost", F.lit(0.0)))
    w = Window.orderBy("period").rowsBetween(-2, 0)
    return s.withColumn("cost_ma3", F.avg("cost").over(w))


def forecast(series: DataFrame, periods: int = 3) -> DataFrame:
    """Flat forecast: the last moving mean (or last cost) for the next
    ``periods`` months. An empty series gives an empty frame."""
    base = "cost_ma3" if "cost_ma3" in series.columns else "cost"
    last = series.agg(F.max("period").alias("_last"), F.max_by(base, "period").alias("_base"))
    return (last.where(F.col("_last").isNotNull())
            .select(F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("_i"), "_last", "_base")
            .select(F.add_months("_last", F.col("_i")).alias("period"),
                    F.col("_base").alias("cost_fcst")))
