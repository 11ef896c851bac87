"""Projections and filters over the waste log."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wastelens import schemas
from wastelens.functions import scalars as S


def _as_date(d):
    if isinstance(d, str):
        return _dt.date.fromisoformat(d)
    return d


def date_range_cond(ts_col: str, start, end, dtype: str = "timestamp_ntz"):
    """``to_date(ts) BETWEEN start AND end`` written on the raw column
    (``ts >= start AND ts < end + 1 day``) so it reaches the Parquet scan as a
    pushed filter and prunes row groups; same rows, including the last day."""
    start, end = _as_date(start), _as_date(end)
    lo = _dt.datetime.combine(start, _dt.time())
    hi = _dt.datetime.combine(end + _dt.timedelta(days=1), _dt.time())
    c = F.col(ts_col)
    if dtype == "date":
        return (c >= F.lit(start)) & (c <= F.lit(end))
    if dtype in ("timestamp_ntz", "timestamp"):
        return (c >= F.lit(lo).cast(dtype)) & (c < F.lit(hi).cast(dtype))
    d = F.to_date(c)
    return (d >= F.lit(start)) & (d <= F.lit(end))


def filter_log(df: DataFrame, start, end, materials=None, reasons=None, suites=None,
               ts_col: str = "timestamp_local", keep_date_only: bool = False) -> DataFrame:
    """Dashboard filter (P1): drop null stamps, inclusive local-date range,
    optional membership lists (empty or None means no filter; null never matches).

    If the log is stored partitioned by ``log_date`` filter that column too:
    ``to_date(ts)`` alone cannot prune partitions.
    """
    start, end = _as_date(start), _as_date(end)
    d = F.to_date(F.col(ts_col))
    cond = F.col(ts_col).isNotNull() & date_range_cond(ts_col, start, end, dict(df.dtypes)[ts_col])
    if "log_date" in df.columns:
        cond = cond & F.col("log_date").between(F.lit(start), F.lit(end))
    if materials:
        cond = cond & F.col("material").isin(list(materials))
    if reasons:
        cond = cond & F.col("reason").isin(list(reasons))
    if suites and "suite" in df.columns:
        cond = cond & F.col("suite").isin(list(suites))
    out = df.where(cond)
    return out.withColumn("date_only", d) if keep_date_only else out


def default_range(df: DataFrame, ts_col: str = "timestamp_local") -> DataFrame:
    """Default filter range (P2): first and last local date of the log."""
    c = F.col(ts_col)
    return df.agg(F.to_date(F.min(c)).alias("start_date"), F.to_date(F.max(c)).alias("end_date"))


def analysis_frame(df: DataFrame) -> DataFrame:
    """Analysis layout (P3): date, suite, material, vendor, qty, cost, description.

    qty/cost: number or 0; vendor := material as text; description := reason or "";
    rows without a parseable date are dropped.
    """
    date = F.col("timestamp_local").cast("timestamp_ntz") if dict(df.dtypes).get(
        "timestamp_local") in ("timestamp_ntz", "timestamp") else S.parse_timestamp("timestamp_local")
    return (df.select(
        date.alias("date"),
        F.col("suite"),
        F.col("material"),
        F.col("material").cast("string").alias("vendor"),
        F.coalesce(S.number_of(df, "quantity"), F.lit(0.0)).alias("qty"),
        F.coalesce(S.number_of(df, "total_cost"), F.lit(0.0)).alias("cost"),
        F.coalesce(F.col("reason"), F.lit("")).alias("description"))
        .where(F.col("date").isNotNull()))


#: Every column of the library's tables that holds an amount of money, or text with one.
COST_COLUMNS = ("total_cost", "cost_per_unit", "cost", "mock_price", "day_cost", "cost_ma3", "cost_fcst", "amount_bucket",
                "report_text", "top_materials", "top_vendors")


def cost_view(df: DataFrame, role: str, metric: str | None = None) -> DataFrame:
    """Role gate (P5): amounts are visible to Managers only, everywhere.

    ``metric`` names what a table's ``value`` column measures; for other roles a
    ``value`` goes unless it is known to be no amount.
    """
    if role == "Manager":
        return df
    hidden = set(COST_COLUMNS) | ({"value"} if metric is None or metric in COST_COLUMNS else set())
    return df.drop(*[c for c in df.columns if c in hidden])


def domain_check(df: DataFrame, suites=None, shifts=None, reasons=None,
                 materials=None) -> DataFrame:
    """Domain check (P8): adds ``violations`` (array of reasons, empty = accepted).

    Lists default to the closed lists of the application; materials to no check.
    """
    suites = schemas.SUITES if suites is None else suites
    shifts = schemas.SHIFTS if shifts is None else shifts
    reasons = schemas.REASONS if reasons is None else reasons
    checks = [
        (F.coalesce(F.col("suite").isin(list(suites)), F.lit(False)), "suite"),
        (F.coalesce(F.col("shift").isin(list(shifts)), F.lit(False)), "shift"),
        (F.coalesce(F.col("reason").isin(list(reasons)), F.lit(False)), "reason"),
        (F.coalesce(F.col("quantity") >= 0, F.lit(False)), "quantity"),
    ]
    if materials is not None:
        checks.append((F.coalesce(F.col("material").isin(list(materials)), F.lit(False)),
                       "material"))
    arr = F.array(*[F.when(~ok, F.lit(name)) for ok, name in checks])
    return df.withColumn("violations", F.filter(arr, lambda x: x.isNotNull()))


def with_vendor_bucket(df: DataFrame, vendor: str = "vendor", cost: str = "cost") -> DataFrame:
    """P9 + P10: ``vendor_norm`` and ``amount_bucket`` columns."""
    return df.withColumns({"vendor_norm": S.vendor_norm(vendor),
                           "amount_bucket": S.amount_bucket(cost)})


def report_input(df: DataFrame) -> DataFrame:
    """Report input (P11): parse date and drop bad, cost coerced (0 if absent or bad),
    absent flags false. A frame without ``date`` is an error."""
    if "date" not in df.columns:
        raise ValueError("a report needs a column named date")
    cols = set(df.columns)
    out = df.withColumn("date", S.column_date(df, "date"))
    out = out.withColumn("cost", F.coalesce(S.number_of(df, "cost"), F.lit(0.0))
                         if "cost" in cols else F.lit(0.0))
    for flag in ("ai_anomaly", "subscription_like"):
        out = out.withColumn(flag, F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
                             if flag in cols else F.lit(False))
    return out.where(F.col("date").isNotNull())
