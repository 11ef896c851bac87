"""Period reports: week / month / quarter / year tables, labels and text
(A13, A14, R1-R7, W7, W8).

Plan shape: raw rows are aggregated once to (piece, kind, item), a piece being what a week
and a month share, so the sums are few however many pairs of material and vendor a day has;
all grains roll up from that table, in one pass and without storing it. All later steps (top-5 ranking, gap filling, label, text) run on tables with one row
per period or per (period, item), so a hot period or item never lands in one
task with raw rows; the ranking keeps the first rows of each group before it
shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wastelens import schemas
from wastelens.functions import scalars as S
from wastelens.operators.filters import report_input

GRAINS = schemas.REPORT_GRAINS


def _check(grain: str):
    if grain not in GRAINS:
        raise ValueError(f"Unknown period '{grain}'. Valid: {GRAINS}")


def piece_table(df: DataFrame) -> DataFrame:
    """Sums per (day, kind, item) of a frame prepared by :func:`report_input`: the kinds are the item columns
    (null items too), or ``total`` if there are none; ``day`` is the first of the days that lie in the same week and month."""
    kinds = [F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("item")) for c in ("material", "vendor") if c in df.columns]
    kinds = kinds or [F.struct(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("item"))]
    date = F.to_date("date")
    piece = F.greatest(F.date_sub(S.week_key(date), 6), F.trunc(date, "month"))
    rows = df.select(piece.alias("day"), F.explode(F.array(*kinds)).alias("k"), "cost", "ai_anomaly", "subscription_like")
    return rows.groupBy("day", F.col("k.kind").alias("kind"), F.col("k.item").alias("item")).agg(
        F.sum("cost").alias("cost"), F.count("cost").alias("events"),
        F.sum(F.col("ai_anomaly").cast("bigint")).alias("anomalies"),
        F.sum(F.col("subscription_like").cast("bigint")).alias("subs"))


def _grains_table(df: DataFrame, grains, top_k: int) -> DataFrame:
    """Report rows of several grains in one pipeline, with a ``grain`` column.

    Each row of :func:`piece_table` counts once for its item, and those of one kind once for the
    total, in each grain; these are summed to (grain, period, kind, item), ranked within
    (grain, period, kind), gathered by one aggregate, and gaps are filled from each
    period to the next one.
    """
    # Each row of ``df`` is in the pieces of each kind, so one kind's make the total.
    lead = next((c for c in ("material", "vendor") if c in df.columns), "total")
    total = F.struct(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("item"))
    own = F.when(F.col("item").isNotNull(), F.struct("kind", "item"))
    d = piece_table(df).withColumn("k", F.explode(F.array_compact(F.array(F.when(F.col("kind") == lead, total), own)))).drop("kind", "item")
    d = d.withColumn("grain", F.explode(F.array(*[F.lit(g) for g in grains])))
    g, day = F.col("grain"), F.col("day")
    key = (F.when(g == "Weekly", S.week_key(day)).when(g == "Monthly", F.trunc(day, "month"))
           .when(g == "Quarterly", F.trunc(day, "quarter")).otherwise(F.trunc(day, "year")))
    r = d.groupBy("grain", key.alias("period"), F.col("k.kind").alias("kind"), F.col("k.item").alias("item")).agg(
        *[F.sum(c).alias(c) for c in ("cost", "events", "anomalies", "subs")])
    # A total is the only row of its group, so it always has rank 1.
    w = Window.partitionBy("grain", "period", "kind").orderBy(F.desc(F.round("cost", 6)), F.col("item").asc())
    r = r.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(top_k, 1))
    is_total = F.col("kind") == "total"

    def joined(kind):
        chosen = F.when((F.col("kind") == kind) & (F.col("rn") <= top_k), F.struct("rn", "item"))
        return F.array_join(F.transform(F.sort_array(F.collect_list(chosen)), lambda x: x["item"]), ", ")

    t = r.groupBy("grain", "period").agg(
        *[F.sum(F.when(is_total, F.col(c))).alias(a) for c, a in (
            ("cost", "total_cost"), ("events", "events"), ("anomalies", "anomalies"), ("subs", "subs"))],
        joined("material").alias("top_materials"), joined("vendor").alias("top_vendors"))
    # Gaps: from each period up to the one before the next (one row per period in this window).
    after = F.lead("period").over(Window.partitionBy("grain").orderBy("period"))
    months = F.when(g == "Monthly", 1).when(g == "Quarterly", 3).otherwise(12)
    t = t.withColumn("_next", after)
    weeks = F.sequence("period", F.date_sub("_next", 7), F.expr("INTERVAL 7 DAYS"))
    others = F.sequence("period", F.add_months("_next", -months), F.make_ym_interval(F.lit(0), months))
    run = F.when(F.col("_next").isNull(), F.array("period")).when(g == "Weekly", weeks).otherwise(others)
    t = t.select("*", F.posexplode(run).alias("_gap", "_period"))

    def here(c, empty):
        return F.when(F.col("_gap") == 0, F.coalesce(c, empty)).otherwise(empty).alias(c)
    none = F.lit(0).cast("bigint")
    return t.select("grain", F.col("_period").alias("period"), here("total_cost", F.lit(0.0)), here("events", none),
                    here("anomalies", none), here("subs", none), here("top_materials", F.lit("")), here("top_vendors", F.lit("")))


def period_table(df: DataFrame, grain: str, top_k: int = 5, prepared: bool = False) -> DataFrame:
    """Report table of one grain (A13 + A14 + R1 + W7): one row per period key
    from the first to the last period, empty periods with 0 and ""."""
    _check(grain)
    d = df if prepared else report_input(df)
    return _grains_table(d, [grain], top_k).drop("grain")


def with_text(table: DataFrame, grain, legacy_week_label: bool = False) -> DataFrame:
    """Adds ``label`` (R4) and ``report_text`` (R5) to a report table.

    The amount is shown rounded to cents first, so the whole-dollar text
    does not depend on summation order.
    """
    g = F.col(grain) if grain in table.columns else F.lit(grain)
    label = S.period_label(g, F.col("period"), legacy_week_label)
    na = lambda c: F.when(F.col(c) == "", F.lit("n/a")).otherwise(F.col(c))
    text = F.concat(
        g, F.lit(" Report — "), F.col("label"), F.lit("\n"),
        F.lit("- Total recorded cost: "), S.money_text(F.round("total_cost", 2)), F.lit("\n"),
        F.lit("- Events recorded: "), F.col("events").cast("string"), F.lit("\n"),
        F.lit("- Anomalies flagged: "), F.col("anomalies").cast("string"), F.lit("\n"),
        F.lit("- Potential subscriptions: "), F.col("subs").cast("string"), F.lit("\n"),
        F.lit("- Top materials (by cost): "), na("top_materials"), F.lit("\n"),
        F.lit("- Top vendors (by cost): "), na("top_vendors"), F.lit("\n"),
        F.lit(schemas.RECOMMENDATION + "\n"))
    return table.withColumn("label", label).withColumn("report_text", text)


def summarize_period(df: DataFrame, grain: str, top_k: int = 5,
                     legacy_week_label: bool = False):
    """(table with label and text per period, one-row text DataFrame).

    The text frame concatenates the period blocks in period order with a
    blank line between them; it aggregates one short string per period, so
    its single group is bounded by the number of periods.
    """
    t = with_text(period_table(df, grain, top_k), grain, legacy_week_label)
    blocks = F.sort_array(F.collect_list(F.struct("period", "report_text")))
    text = t.agg(F.array_join(F.transform(blocks, lambda s: s["report_text"]), "\n")
                 .alias("report_text"))
    return t, text


def all_reports(df: DataFrame, top_k: int = 5, legacy_week_label: bool = False) -> DataFrame:
    """The four grains in one table with a ``grain`` column.

    One scan and one aggregate of its rows serve all grains.
    """
    t = _grains_table(report_input(df), GRAINS, top_k)
    return with_text(t, "grain", legacy_week_label)


def recent_periods(table: DataFrame, n: int = 8) -> DataFrame:
    """The last ``n`` periods of a report table (TakeOrdered of n rows)."""
    return table.orderBy(F.desc("period")).limit(n)
