"""Streaming jobs over the events file, run to completion (availableNow)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wastelens.plans.registry import query
from wastelens.sources import dims
from wastelens.sources.tables import table
from wastelens.streaming import jobs as J

ALERT = 100.0
DAY_ALERT = 5000.0


def _events(spark, sf_dir):
    s = J.file_stream(spark, sf_dir, "events.parquet")
    return s.select("event_id", "ts", "user_id", "event_type", F.col("value").alias("total_cost"))


@query("stream_alerts", f"""
SELECT event_id, ts, event_type, value AS total_cost FROM events WHERE value >= {ALERT}""")
def q_stream_alerts(spark, sf_dir):
    s = J.entry_alert_stream(_events(spark, sf_dir), ALERT)
    return J.run_available_now(s.select("event_id", "ts", "event_type", "total_cost"))


_CLOSED = "CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"


@query("stream_day_totals", f"""
SELECT CAST(ts AS DATE) AS day, round(sum(value), 2) AS day_cost, count(*) AS entries
FROM events WHERE {_CLOSED} GROUP BY 1""")
def q_stream_day_totals(spark, sf_dir):
    out = J.run_available_now(J.day_totals(_events(spark, sf_dir)))
    return out.withColumn("day_cost", F.round("day_cost", 2))


@query("stream_day_alerts", f"""
SELECT * FROM (SELECT CAST(ts AS DATE) AS day, round(sum(value), 2) AS day_cost, count(*) AS entries
FROM events WHERE {_CLOSED} GROUP BY 1) WHERE day_cost >= {DAY_ALERT}""")
def q_stream_day_alerts(spark, sf_dir):
    out = J.run_available_now(J.day_alert_stream(_events(spark, sf_dir), DAY_ALERT))
    return out.withColumn("day_cost", F.round("day_cost", 2))


@query("stream_day_update", """
SELECT CAST(ts AS DATE) AS day, round(sum(value), 2) AS day_cost, count(*) AS entries FROM events GROUP BY 1""")
def q_stream_day_update(spark, sf_dir):
    """T5: the running day dashboard, every day so far."""
    out = J.run_available_now(J.day_totals(_events(spark, sf_dir)), mode="update", keys=["day"])
    return out.withColumn("day_cost", F.round("day_cost", 2))


@query("stream_enrich", """
SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp_local, strftime(ts, '%Y-%m-%d') AS date,
       strftime(ts, '%H:%M:%S') AS time, '' AS site, event_type AS suite, '' AS line, '' AS room, 'QC' AS shift,
       CAST(user_id AS VARCHAR) AS employee_id, event_type AS material, 'ea' AS unit, CAST(round(value) AS BIGINT) AS quantity,
       event_type AS reason, '' AS batch_lot, CAST(length(event_type) AS DOUBLE) AS cost_per_unit,
       CAST(round(value) AS BIGINT) * CAST(length(event_type) AS DOUBLE) AS total_cost, '' AS notes, '' AS photo_filename,
       'https://sop.example/' || event_type AS sop_url FROM events""")
def q_stream_enrich(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    mats = dims.first_per_key(ev.select(F.col("event_type").alias("name"), F.lit("ea").alias("unit"),
                                        F.length("event_type").cast("double").alias("cost_per_unit"),
                                        F.col("event_id").alias("seq")), "name", "seq").drop("seq")
    sop = ev.select(F.col("event_type").alias("reason")).distinct() \
        .withColumn("sop_url", F.concat(F.lit("https://sop.example/"), F.col("reason")))
    s = _events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("id"), F.to_date("ts").alias("log_date"),
        F.date_format("ts", "HH:mm:ss").alias("log_time"), F.col("event_type").alias("suite"),
        F.lit("QC").alias("shift"), F.col("user_id").cast("string").alias("employee_id"),
        F.col("event_type").alias("material"), F.round("total_cost").cast("bigint").alias("quantity"),
        F.col("event_type").alias("reason"), F.lit("").alias("batch_lot"), F.lit("").alias("notes"))
    return J.run_available_now(J.enrich_stream(s, mats, None, sop, use_mock=False))


# Chains by event type and a sixteenth of the users; of each, the rows of the hours that are closed
# when the watermark stands a day before the last event.
_EVENT_CHAINS = """WITH RECURSIVE ev AS (
  SELECT event_type || '/' || CAST(user_id % 16 AS VARCHAR) AS chain, CAST(event_id AS VARCHAR) AS id, ts,
         event_id || '|' || user_id || '|' || event_type || '|' || CAST(floor(value * 100) AS BIGINT) AS payload,
         row_number() OVER (PARTITION BY event_type, user_id % 16 ORDER BY ts, event_id) AS k
  FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY),
chain AS (
  SELECT chain, id, ts, payload, '' AS prev_hash, sha256(payload || '|') AS hash, k FROM ev WHERE k = 1
  UNION ALL
  SELECT e.chain, e.id, e.ts, e.payload, c.hash, sha256(e.payload || '|' || c.hash), e.k
  FROM ev e JOIN chain c ON e.chain = c.chain AND e.k = c.k + 1)
SELECT chain, id, ts, payload, prev_hash, hash FROM chain"""


@query("stream_chain", _EVENT_CHAINS)
def q_stream_chain(spark, sf_dir):
    """T4: rows of closed hours, linked in event order."""
    e = _events(spark, sf_dir).withColumns({"part": F.col("user_id") % 16, "cents": F.floor(F.col("total_cost") * 100)})
    return J.run_available_now(J.chain_stream(e, ["event_type", "part"], "event_id", "ts", ["event_id", "user_id", "event_type", "cents"]))
