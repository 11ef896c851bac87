"""Period reports, month series and forecast over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wastelens import schemas
from wastelens.operators import reports as R
from wastelens.operators import timeseries as TS
from wastelens.plans.registry import query
from wastelens.plans.sqlviews import WASTE_CTE, with_
from wastelens.sources.tables import table, waste_view

# Entry alert threshold used as the anomaly flag of the report input.
ANOMALY_COST = 95000.0
TOP_K = 5


def report_source(spark, sf_dir):
    """Report input: date, cost, material, vendor, ai_anomaly (high-cost entry)."""
    w = waste_view(spark, sf_dir, ["timestamp_local", "total_cost", "material", "vendor"])
    return w.select(F.col("timestamp_local").alias("date"), F.col("total_cost").alias("cost"),
                    "material", "vendor",
                    (F.col("total_cost") >= ANOMALY_COST).alias("ai_anomaly"))


_KEY_SQL = {
    "Weekly": "CAST(date_trunc('week', day - INTERVAL 1 DAY) + INTERVAL 7 DAY AS DATE)",
    "Monthly": "CAST(date_trunc('month', day) AS DATE)",
    "Quarterly": "CAST(date_trunc('quarter', day) AS DATE)",
    "Annual": "CAST(date_trunc('year', day) AS DATE)",
}
_STEP_SQL = {"Weekly": "INTERVAL 7 DAY", "Monthly": "INTERVAL 1 MONTH",
             "Quarterly": "INTERVAL 3 MONTH", "Annual": "INTERVAL 1 YEAR"}
_LABEL_SQL = {
    "Weekly": "strftime(period - INTERVAL 6 DAY, '%Y-%m-%d') || ' – ' || strftime(period, '%Y-%m-%d')",
    "Monthly": "strftime(period, '%Y-%m')",
    "Quarterly": "CAST(year(period) AS VARCHAR) || ' Q' || CAST(quarter(period) AS VARCHAR)",
    "Annual": "CAST(year(period) AS VARCHAR)",
}


def _top_sql(item, grain):
    return f"""SELECT period, string_agg({item}, ', ' ORDER BY rn) AS top_{item}s FROM (
      SELECT period, {item}, row_number() OVER (PARTITION BY period ORDER BY round(c, 6) DESC, {item}) AS rn
      FROM (SELECT {_KEY_SQL[grain]} AS period, {item}, sum(cost) AS c FROM base GROUP BY 1, 2))
    WHERE rn <= {TOP_K} GROUP BY 1"""


def grain_sql(grain: str, with_text: bool = False) -> str:
    text = ""
    if with_text:
        text = f""", {_LABEL_SQL[grain]} AS label,
  '{grain} Report — ' || {_LABEL_SQL[grain]} || chr(10)
  || '- Total recorded cost: $' || format('{{:,.0f}}', round(coalesce(total_cost, 0), 2)) || chr(10)
  || '- Events recorded: ' || CAST(coalesce(events, 0) AS VARCHAR) || chr(10)
  || '- Anomalies flagged: ' || CAST(coalesce(anomalies, 0) AS VARCHAR) || chr(10)
  || '- Potential subscriptions: ' || CAST(coalesce(subs, 0) AS VARCHAR) || chr(10)
  || '- Top materials (by cost): ' || coalesce(nullif(top_materials, ''), 'n/a') || chr(10)
  || '- Top vendors (by cost): ' || coalesce(nullif(top_vendors, ''), 'n/a') || chr(10)
  || '{schemas.RECOMMENDATION}' || chr(10) AS report_text,
  '{grain}' AS grain"""
    return f"""SELECT period, round(coalesce(total_cost, 0), 2) AS total_cost,
  CAST(coalesce(events, 0) AS BIGINT) AS events, CAST(coalesce(anomalies, 0) AS BIGINT) AS anomalies,
  CAST(coalesce(subs, 0) AS BIGINT) AS subs, coalesce(top_materials, '') AS top_materials,
  coalesce(top_vendors, '') AS top_vendors{text}
FROM (SELECT CAST(unnest(generate_series(min(period), max(period), {_STEP_SQL[grain]})) AS DATE) AS period
      FROM (SELECT {_KEY_SQL[grain]} AS period FROM base)) sp
LEFT JOIN (SELECT {_KEY_SQL[grain]} AS period, sum(cost) AS total_cost, count(cost) AS events,
                  sum(CAST(ai_anomaly AS BIGINT)) AS anomalies, sum(CAST(subscription_like AS BIGINT)) AS subs
           FROM base GROUP BY 1) a USING (period)
LEFT JOIN ({_top_sql('material', grain)}) m USING (period)
LEFT JOIN ({_top_sql('vendor', grain)}) v USING (period)"""


BASE_CTE = f"""base AS (
  SELECT CAST(timestamp_local AS DATE) AS day, total_cost AS cost, material, vendor,
         total_cost >= {ANOMALY_COST} AS ai_anomaly, false AS subscription_like
  FROM waste)"""

_NAMES = {"Weekly": "report_week", "Monthly": "report_month",
          "Quarterly": "report_quarter", "Annual": "report_year"}


def _make_grain_query(grain):
    def q(spark, sf_dir):
        t = R.period_table(report_source(spark, sf_dir), grain, TOP_K)
        return t.withColumn("total_cost", F.round("total_cost", 2))
    q.__name__ = f"q_{_NAMES[grain]}"
    return q


for _g, _n in _NAMES.items():
    query(_n, with_(WASTE_CTE, BASE_CTE) + grain_sql(_g))(_make_grain_query(_g))


@query("report_all", with_(WASTE_CTE, BASE_CTE) + "\nUNION ALL\n".join(
    "SELECT * FROM (" + grain_sql(g, True) + ")" for g in schemas.REPORT_GRAINS))
def q_report_all(spark, sf_dir):
    t = R.all_reports(report_source(spark, sf_dir), TOP_K)
    return t.withColumn("total_cost", F.round("total_cost", 2))


@query("report_text_month", with_(WASTE_CTE, BASE_CTE) + f"""
SELECT string_agg(report_text, chr(10) ORDER BY period) AS report_text
FROM ({grain_sql('Monthly', True)})""")
def q_report_text_month(spark, sf_dir):
    _, text = R.summarize_period(report_source(spark, sf_dir), "Monthly", TOP_K)
    return text


@query("recent_periods", with_(WASTE_CTE, BASE_CTE) + f"""
SELECT * FROM ({grain_sql('Monthly')}) ORDER BY period DESC LIMIT 8""")
def q_recent_periods(spark, sf_dir):
    t = R.period_table(report_source(spark, sf_dir), "Monthly", TOP_K)
    return R.recent_periods(t.withColumn("total_cost", F.round("total_cost", 2)), 8)


ORDERS_SERIES_SQL = """series AS (
  SELECT period, coalesce(cost, 0) AS cost,
         avg(coalesce(cost, 0)) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS cost_ma3
  FROM (SELECT CAST(unnest(generate_series(min(p), max(p), INTERVAL 1 MONTH)) AS DATE) AS period
        FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS p FROM orders)) sp
  LEFT JOIN (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, sum(o_totalprice) AS cost
             FROM orders GROUP BY 1) m USING (period))"""


def _orders_series(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("date"),
                                              F.col("o_totalprice").alias("cost"))
    return TS.month_series(o)


@query("month_series", with_(ORDERS_SERIES_SQL) + """
SELECT period, round(cost, 2) AS cost, round(cost_ma3, 4) AS cost_ma3 FROM series""")
def q_month_series(spark, sf_dir):
    s = _orders_series(spark, sf_dir)
    return s.select("period", F.round("cost", 2).alias("cost"), F.round("cost_ma3", 4).alias("cost_ma3"))


@query("forecast", with_(ORDERS_SERIES_SQL) + """
SELECT CAST(max(period) + INTERVAL (i) MONTH AS DATE) AS period,
       round(arg_max(cost_ma3, period), 4) AS cost_fcst
FROM series, range(1, 4) t(i) GROUP BY i""")
def q_forecast(spark, sf_dir):
    f = TS.forecast(_orders_series(spark, sf_dir), 3)
    return f.withColumn("cost_fcst", F.round("cost_fcst", 4))
