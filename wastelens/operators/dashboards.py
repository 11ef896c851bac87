"""Grouped dashboard tables (A1-A10), SOP coverage (J1), top-N.

Conventions: null group keys are dropped (N1); a sum over only-null values
is 0 (N2); descending sorts break ties by the key ascending (N12). Sorting a
grouped result is cheap (one row per key) and is kept because it is the
feature; the driver compares without order anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wastelens.functions.scalars import sum0


def _grouped(df: DataFrame, keys, sums: dict, order_by: str) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    d = df
    for k in keys:
        d = d.where(F.col(k).isNotNull())
    out = d.groupBy(*keys).agg(*[sum0(src).alias(name) for name, src in sums.items()])
    return out.orderBy(F.desc(order_by), *keys)


def by_day(df: DataFrame, ts_col: str = "timestamp_local") -> DataFrame:
    """A1: quantity and total cost per local date."""
    d = df.withColumn("date", F.to_date(ts_col))
    return _grouped(d, "date", {"quantity": "quantity", "total_cost": "total_cost"},
                    "quantity").orderBy("date")


def by_shift(df: DataFrame) -> DataFrame:
    """A2: quantity per shift, descending."""
    return _grouped(df, "shift", {"quantity": "quantity"}, "quantity")


def by_material(df: DataFrame) -> DataFrame:
    """A3: quantity and total cost per material, by quantity descending."""
    return _grouped(df, "material", {"quantity": "quantity", "total_cost": "total_cost"},
                    "quantity")


def by_reason(df: DataFrame) -> DataFrame:
    """A4: quantity and total cost per reason, by quantity descending."""
    return _grouped(df, "reason", {"quantity": "quantity", "total_cost": "total_cost"},
                    "quantity")


def kpis(df: DataFrame) -> DataFrame:
    """A5: entries, total quantity, mean quantity per entry, total cost."""
    return df.agg(F.count(F.lit(1)).alias("entries"),
                  sum0("quantity").alias("total_qty"),
                  F.avg("quantity").alias("avg_qty"),
                  sum0("total_cost").alias("total_cost"))


def by_suite_cost(df: DataFrame) -> DataFrame:
    """Total cost per suite, descending."""
    return _grouped(df, "suite", {"total_cost": "total_cost"}, "total_cost")


def by_suite_qty(df: DataFrame) -> DataFrame:
    """Quantity per suite, descending."""
    return _grouped(df, "suite", {"quantity": "quantity"}, "quantity")


def suite_material_topn(df: DataFrame, top_n: int = 8) -> DataFrame:
    """A8 + W1: quantity per (suite, material); the top ``top_n`` materials of
    each suite, ties by material name (the order in which they appear).

    The window runs on the aggregated table (suites x materials rows), never
    on raw log rows, so a hot suite costs one row per material.
    """
    d = df.withColumn("quantity", F.coalesce(F.col("quantity").cast("double"), F.lit(0.0)))
    agg = (d.where(F.col("suite").isNotNull() & F.col("material").isNotNull())
           .groupBy("suite", "material").agg(F.sum("quantity").alias("quantity")))
    w = Window.partitionBy("suite").orderBy(F.desc("quantity"), "material")
    return (agg.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .where(F.col("rank") <= top_n))


def material_suite_topn(df: DataFrame, top_n: int = 8) -> DataFrame:
    """A9 + W2 + J6: quantity per (material, suite), kept only for the overall
    top ``top_n`` materials (left-semi join with a list of ``top_n`` rows)."""
    d = df.withColumn("quantity", F.coalesce(F.col("quantity").cast("double"), F.lit(0.0)))
    agg = (d.where(F.col("suite").isNotNull() & F.col("material").isNotNull())
           .groupBy("material", "suite").agg(F.sum("quantity").alias("quantity")))
    tops = (agg.groupBy("material").agg(F.sum("quantity").alias("value"))
            .orderBy(F.desc("value"), "material").limit(top_n).select("material"))
    # top_n rows by construction: a broadcast side with a fixed bound.
    return agg.join(F.broadcast(tops), "material", "left_semi")


def overall_material(df: DataFrame, metric: str = "quantity", role: str = "Manager") -> DataFrame:
    """A10: per material the sum of ``quantity`` or ``total_cost`` as ``value``;
    roles other than Manager always get the quantity (P5)."""
    if metric not in ("quantity", "total_cost"):
        raise ValueError("metric must be 'quantity' or 'total_cost'")
    if role != "Manager":
        metric = "quantity"
    return _grouped(df, "material", {"value": metric}, "value")


def sop_coverage(df: DataFrame, sop: DataFrame) -> DataFrame:
    """A4 + J1: per-reason totals with the reason's SOP link (null if none)."""
    return by_reason(df).join(sop.select("reason", "sop_url"), "reason", "left") \
        .orderBy(F.desc("quantity"), "reason")
