"""Entry enrichment: prices, units, SOP links, totals, alerts.

The same functions serve batch and streaming inputs: they only use
stateless expressions and stream-static joins with dimension tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wastelens.functions import scalars as S
from wastelens.operators.filters import date_range_cond


def resolve_price(entries: DataFrame, materials: DataFrame, prices: DataFrame | None = None,
                  use_mock: bool = True) -> DataFrame:
    """Adds ``unit`` and ``cost_per_unit``. With ``use_mock`` an override
    wins whenever the material has an override row (even a 0 price); else
    the catalog price. Dimensions must hold one row per name (see dims)."""
    cat = materials.select(F.col("name").alias("material"), F.col("unit"),
                           F.col("cost_per_unit").alias("_catalog_price"))
    d = entries.drop("unit", "cost_per_unit").join(cat, "material", "left")
    if use_mock and prices is not None:
        ovr = prices.select(F.col("name").alias("material"), F.col("mock_price").alias("_mock"),
                            F.lit(True).alias("_has_mock"))
        d = d.join(ovr, "material", "left")
        price = F.when(F.col("_has_mock"), F.col("_mock")).otherwise(F.col("_catalog_price"))
    else:
        price = F.col("_catalog_price")
    return d.withColumn("cost_per_unit", price).drop("_catalog_price", "_mock", "_has_mock")


def sop_for_reason(entries: DataFrame, sop: DataFrame) -> DataFrame:
    """The reason's SOP URL, "" when none."""
    s = sop.select("reason", F.col("sop_url").alias("_sop"))
    d = entries.drop("sop_url").join(s, "reason", "left")
    return d.withColumn("sop_url", F.coalesce("_sop", F.lit(""))).drop("_sop")


def enrich_entries(entries: DataFrame, materials: DataFrame, prices: DataFrame | None,
                   sop: DataFrame, use_mock: bool = True, keep=()) -> DataFrame:
    """Submitted facts (id, log_date, log_time, suite, shift, employee_id,
    material, quantity, reason, batch_lot, notes[, photo_filename]) to log rows.

    ``timestamp_local`` is the ISO text ``date T time``; ``total_cost`` is
    quantity x unit price rounded to 4 places; legacy columns are "". ``keep``: columns of the entries that follow the log's.
    Digest columns are added by :mod:`wastelens.operators.audit`.
    """
    d = resolve_price(entries, materials, prices, use_mock)
    d = sop_for_reason(d, sop)
    qty = F.col("quantity").cast("bigint")
    date_txt = F.date_format(F.col("log_date"), "yyyy-MM-dd")
    time_txt = F.col("log_time").cast("string")
    blank = F.lit("")
    if "photo_filename" not in d.columns:
        d = d.withColumn("photo_filename", blank)
    return d.select(
        F.col("id").cast("string").alias("id"),
        F.concat(date_txt, F.lit("T"), time_txt).alias("timestamp_local"),
        date_txt.alias("date"), time_txt.alias("time"),
        blank.alias("site"), S.strip(F.col("suite")).alias("suite"), blank.alias("line"),
        blank.alias("room"), F.col("shift"), S.strip(F.coalesce("employee_id", blank)).alias("employee_id"),
        F.col("material"), F.col("unit"), qty.alias("quantity"), F.col("reason"),
        S.strip(F.coalesce("batch_lot", blank)).alias("batch_lot"),
        F.col("cost_per_unit"), S.round4(qty * F.col("cost_per_unit")).alias("total_cost"),
        S.strip(F.coalesce("notes", blank)).alias("notes"),
        F.coalesce("photo_filename", blank).alias("photo_filename"), F.col("sop_url"), *keep)


def entry_alerts(df: DataFrame, threshold: float = 500.0) -> DataFrame:
    """M5: entries with ``total_cost >= threshold``; a threshold of 0 never alerts."""
    if not threshold > 0:
        return df.where(F.lit(False))
    return df.where(F.col("total_cost") >= F.lit(threshold))


def day_alerts(df: DataFrame, threshold: float = 2000.0, ts_col: str = "timestamp_local",
               as_of=None) -> DataFrame:
    """M6 + A12: days whose summed cost reaches ``threshold`` (bad cost counts
    0). ``as_of`` limits the check to that one day, as the entry page does."""
    if as_of is not None:
        df = df.where(date_range_cond(ts_col, as_of, as_of, dict(df.dtypes)[ts_col]))
    d = df.withColumn("day", F.to_date(F.col(ts_col)))
    tot = d.where(F.col("day").isNotNull()).groupBy("day").agg(
        F.sum(F.coalesce(S.number_of(df, "total_cost"), F.lit(0.0))).alias("day_cost"))
    if not threshold > 0:
        return tot.where(F.lit(False))
    return tot.where(F.col("day_cost") >= F.lit(threshold))
