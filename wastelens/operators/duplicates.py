"""Duplicate charges and subscription-like patterns.

Input: an analysis frame with ``date``, ``vendor``, ``cost`` (and any other
columns) plus a unique row key used as tiebreak (``key_cols``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wastelens.functions import scalars as S
from wastelens.operators.ordered import global_lag, lag_name

DUP_DAYS = 3
SUB_MIN, SUB_MAX = 27, 33


def _prepare(df: DataFrame) -> DataFrame:
    b = S.amount_bucket("cost")
    # NaN equals NaN in Spark but never matches in the reference: make it null.
    return df.withColumns({"vendor_norm": S.vendor_norm("vendor"),
                           "amount_bucket": F.when(~F.isnan(b), b)})


def _with_dated(df: DataFrame, fn, flags: dict) -> DataFrame:
    """Apply ``fn`` to rows with a date; undated rows get every flag false."""
    dated = fn(df.where(F.col("date").isNotNull()))
    undated = df.where(F.col("date").isNull()).withColumns(flags)
    return dated.unionByName(undated.select(*dated.columns))


def adjacent_duplicates(df: DataFrame, key_cols: list[str], chunks: int | None = None, like: DataFrame | None = None) -> DataFrame:
    """``dup_candidate`` when the row equals the previous row of the whole
    frame (ordered by date, then key) in normalised vendor and amount bucket,
    and lies within 3 whole days of it. ``like``: see :func:`global_lag`."""
    d = _prepare(df)
    like = like if like is None else _prepare(like).where(F.col("date").isNotNull())

    def fn(x):
        order = ["date", *key_cols]
        g = global_lag(x, order, ["vendor_norm", "amount_bucket", "date"], 1, chunks, like)
        same = ((F.col("vendor_norm") == F.col(lag_name("vendor_norm", 1)))
                & (F.col("amount_bucket") == F.col(lag_name("amount_bucket", 1)))
                & (F.abs(S.floor_days("date", lag_name("date", 1))) <= DUP_DAYS))
        return g.withColumn("dup_candidate", F.coalesce(same, F.lit(False))) \
                .drop(*[c for c in g.columns if c.startswith("_lag")])

    return _with_dated(d, fn, {"dup_candidate": F.lit(False)})


def _keyed(df: DataFrame, key_cols: list[str], k: int, chunks):
    """Global lag in (vendor_norm, amount_bucket, date, key) order: the
    previous rows of the same group, with hot groups split across chunks."""
    x = df.where(F.col("amount_bucket").isNotNull())
    order = ["vendor_norm", "amount_bucket", "date", *key_cols]
    return global_lag(x, order, ["vendor_norm", "amount_bucket", "date"], k, chunks)


def _same_group(j: int):
    return ((F.col(lag_name("vendor_norm", j)) == F.col("vendor_norm"))
            & (F.col(lag_name("amount_bucket", j)) == F.col("amount_bucket")))


def keyed_duplicates(df: DataFrame, key_cols: list[str], chunks: int | None = None) -> DataFrame:
    """``keyed_dup`` when the previous row with the same normalised vendor
    and amount bucket (not just the previous row overall) is within 3 days."""
    d = _prepare(df)

    def fn(x):
        g = _keyed(x, key_cols, 1, chunks)
        hit = _same_group(1) & (F.abs(S.floor_days("date", lag_name("date", 1))) <= DUP_DAYS)
        g = g.withColumn("keyed_dup", F.coalesce(hit, F.lit(False)))
        nokey = x.where(F.col("amount_bucket").isNull()) \
                 .withColumn("keyed_dup", F.lit(False))
        g = g.drop(*[c for c in g.columns if c.startswith("_lag")])
        return g.unionByName(nokey)

    return _with_dated(d, fn, {"keyed_dup": F.lit(False)})


def subscription_like(df: DataFrame, key_cols: list[str], chunks: int | None = None) -> DataFrame:
    """W4 + W5: ``gap`` = whole days since the previous row of the same
    (vendor_norm, amount_bucket); ``subscription_like`` when this gap or one
    of the two before it in the group lies in 27..33 days."""
    d = _prepare(df)

    def fn(x):
        g = _keyed(x, key_cols, 3, chunks)
        gaps = []
        for j in range(3):  # gap of the row j places back
            newer = "date" if j == 0 else lag_name("date", j)
            older = lag_name("date", j + 1)
            ok = _same_group(j + 1) & S.floor_days(newer, older).between(SUB_MIN, SUB_MAX)
            gaps.append(F.coalesce(ok, F.lit(False)))
        g = g.withColumn("gap", F.when(_same_group(1), S.floor_days("date", lag_name("date", 1))))
        g = g.withColumn("subscription_like", gaps[0] | gaps[1] | gaps[2])
        nokey = x.where(F.col("amount_bucket").isNull()) \
                 .withColumns({"gap": F.lit(None).cast("bigint"), "subscription_like": F.lit(False)})
        g = g.drop(*[c for c in g.columns if c.startswith("_lag")])
        return g.unionByName(nokey)

    out = _with_dated(d, fn, {"gap": F.lit(None).cast("bigint"),
                                   "subscription_like": F.lit(False)})
    return out


_HELPERS = ["vendor_norm", "amount_bucket", "gap"]


def duplicates_and_subs(df: DataFrame, key_cols: list[str], chunks: int | None = None) -> DataFrame:
    """Both reference flags on every row: date, vendor, cost, description,
    dup_candidate, subscription_like (plus the key columns).

    Both detectors keep every row and column, so they are chained; no join
    back is needed. The second takes its bounds and carry from ``df`` itself.
    """
    s = subscription_like(df, key_cols, chunks).drop(*_HELPERS)
    a = adjacent_duplicates(s, key_cols, chunks, df)
    return a.select("date", "vendor", "cost", "description", *key_cols, "dup_candidate",
                    "subscription_like")


def flags_in_place(df: DataFrame, key_cols: list[str], chunks: int | None = None) -> DataFrame:
    """J2 default: the subscription flag on each row; row count unchanged."""
    return subscription_like(df, key_cols, chunks).drop(*_HELPERS)


def flags_fanout(df: DataFrame, key_cols: list[str], chunks: int | None = None) -> DataFrame:
    """J2 legacy (D3) without the blow-up: the reference joins the flags back
    on (date, vendor, cost), so a row whose triple occurs m times comes out
    m times. Rather than emitting those m*m pairs, each row carries the
    multiplicity as ``legacy_copies`` (a partially aggregated group count)."""
    f = flags_in_place(df, key_cols, chunks)
    keys = ["date", "vendor", "cost"]
    c = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("legacy_copies"))
    cond = [f[k].eqNullSafe(c[k]) for k in keys]
    return f.join(c, cond[0] & cond[1] & cond[2], "left").drop(*[c[k] for k in keys])
