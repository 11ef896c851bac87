"""Streaming forms of enrichment, alerts, day totals and the audit chain.

The batch operators are reused as-is where they are stateless (enrichment,
entry alerts). Day totals use a tumbling one-day event-time window with a
watermark, so state is dropped once a day is closed and late rows past the
watermark are ignored. The running audit chain keeps the last digest per
chain key, and the rows that wait for their turn, in keyed state.
"""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from wastelens import schemas
from wastelens.operators import entries as EN
from wastelens.session import ensure_checkpoint_dir


def file_stream(spark: SparkSession, folder: str, pattern: str | None = None, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of files appearing in ``folder`` (optionally only names matching
    ``pattern``); the schema is declared from the files present."""
    r = spark.read.format(fmt)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    schema = r.load(folder).schema
    s = spark.readStream.schema(schema).format(fmt)
    if pattern:
        s = s.option("pathGlobFilter", pattern)
    if max_files_per_trigger:
        s = s.option("maxFilesPerTrigger", max_files_per_trigger)
    return s.load(folder)


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; driver files carry TIMESTAMP_NTZ (UTC session)."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def enrich_stream(entries: DataFrame, materials: DataFrame, prices: DataFrame | None,
                  sop: DataFrame, use_mock: bool = True) -> DataFrame:
    """The batch enrichment on a stream (stream-static joins)."""
    return EN.enrich_entries(entries, materials, prices, sop, use_mock)


def entry_alert_stream(df: DataFrame, threshold: float = 500.0,
                       cost_col: str = "total_cost") -> DataFrame:
    """Stateless filter of high-cost entries."""
    if not threshold > 0:
        return df.where(F.lit(False))
    return df.where(F.col(cost_col) >= F.lit(threshold))


def day_totals(df: DataFrame, ts_col: str = "ts", cost_col: str = "total_cost",
               watermark: str = "1 day") -> DataFrame:
    """T5: cost and entries per one-day event-time window (UTC days)."""
    d = event_time(df, ts_col).withWatermark(ts_col, watermark)
    g = d.groupBy(F.window(ts_col, "1 day")).agg(
        F.sum(F.coalesce(F.col(cost_col), F.lit(0.0))).alias("day_cost"),
        F.count(F.lit(1)).alias("entries"))
    return g.select(F.to_date(F.col("window.start")).alias("day"), "day_cost", "entries")


def day_alert_stream(df: DataFrame, threshold: float = 2000.0, ts_col: str = "ts",
                     cost_col: str = "total_cost", watermark: str = "1 day") -> DataFrame:
    """Closed days whose total reaches ``threshold`` (append mode)."""
    t = day_totals(df, ts_col, cost_col, watermark)
    if not threshold > 0:
        return t.where(F.lit(False))
    return t.where(F.col("day_cost") >= F.lit(threshold))


CHAIN_OUT = T.StructType([
    T.StructField("chain", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("ts", T.TimestampType()), T.StructField("payload", T.StringType()),
    T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())])
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ChainLinker(StatefulProcessor):
    """Links a key's rows in (ts, id) order, in whatever order they come.

    Rows wait in a list state until the watermark has passed the end of their stretch of event time
    (``step_ms``); the first timer that fires then links all rows of closed stretches, the others of the
    same batch see that it is done. What waits is bounded by
    the watermark's delay and a step; besides, a key keeps one digest and one time. Rows behind the watermark are dropped,
    as in any event-time aggregate.
    """

    def __init__(self, step_ms: int):
        self.step_ms = step_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "hash string")
        self.done = handle.getValueState("done", "until long")
        self.waiting = handle.getListState("waiting", "micros long, id string, payload string")

    def handleInputRows(self, key, rows, timerValues):
        closed = timerValues.getCurrentWatermarkInMs()
        new, ends = [], set()
        for pdf in rows:
            micros = pdf["micros"].to_numpy()
            for m, i, p in zip(micros.tolist(), pdf["id"], pdf["payload"]):
                end = (m // 1000 // self.step_ms + 1) * self.step_ms
                if end > closed:
                    new.append((m, i, p))
                    ends.add(end)
        if new:
            self.waiting.appendList(new)
            for end in ends - set(self.handle.listTimers()):
                self.handle.registerTimer(end)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        end = expiredTimerInfo.getExpiryTimeInMs()
        if self.done.exists() and self.done.get()[0] >= end:
            return iter([])
        until = max(end, timerValues.getCurrentWatermarkInMs() // self.step_ms * self.step_ms)
        self.done.update((until,))
        end = until * 1000
        rows = list(self.waiting.get())
        due = sorted((r for r in rows if r[0] < end), key=lambda r: (r[0], len(r[1]), r[1]))
        if not due:
            return iter([])
        later = [tuple(r) for r in rows if r[0] >= end]
        self.waiting.put(later) if later else self.waiting.clear()
        prev = self.last.get()[0] if self.last.exists() else ""
        prevs, hashes = [], []
        for _, _, payload in due:
            prevs.append(prev)
            prev = hashlib.sha256(f"{payload}|{prev}".encode()).hexdigest()
            hashes.append(prev)
        self.last.update((prev,))
        yield pd.DataFrame({"chain": key[0], "id": [r[1] for r in due], "ts": pd.to_datetime([r[0] for r in due], unit="us"),
                            "payload": [r[2] for r in due], "prev_hash": prevs, "hash": hashes})

    def close(self) -> None:
        pass


def chain_stream(df: DataFrame, chain_cols, id_col: str, ts_col: str, payload_cols,
                 watermark: str = "1 day", step: str = "1 hour") -> DataFrame:
    """T4: running hash chain per key, in event order.

    Rows of a key are linked in (ts, id) order (ids by length, then text, so whole numbers sort as such) once the
    watermark closes their stretch of event time of length ``step``; rows of later stretches still wait.
    State is kept in RocksDB. ``chain_cols`` should make keys fine enough that one key's rows of
    ``watermark`` and a ``step`` fit a task.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    step_ms = int(spark.range(1).select(F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"INTERVAL {step}"))).first()[0])
    payload = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in payload_cols])
    chain = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ([chain_cols] if isinstance(chain_cols, str) else chain_cols)])
    d = event_time(df, ts_col).withWatermark(ts_col, watermark).select(
        F.col(ts_col).alias("ts"), chain.alias("chain"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.unix_micros(ts_col).alias("micros"), payload.alias("payload")).where("ts IS NOT NULL")
    return d.groupBy("chain").transformWithStateInPandas(ChainLinker(step_ms), CHAIN_OUT, "append", "EventTime")


def run_available_now(sdf: DataFrame, mode: str = "append", root: str | None = None,
                      fmt: str = "parquet", keys: list[str] | None = None) -> DataFrame:
    """Run a streaming frame over everything available into a file sink in
    the shared checkpoint folder; return the sink's rows as a batch frame.
    The checkpoint makes the file output exactly-once across restarts.

    In update mode each micro-batch holds the changed rows only: the sink is partitioned by ``keys`` and
    a batch overwrites just the partitions of its own keys, so a batch that touches one of a thousand days writes one
    day, and a repeated batch gives the same. Keys should be few (days, not rows).
    """
    spark = sdf.sparkSession
    root = root or ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    out, chk = root + "/out", root + "/chk"
    if mode == "append":
        q = (sdf.writeStream.format(fmt).option("path", out).option("checkpointLocation", chk)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.format(fmt).load(out)
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys that a changed row replaces")

    def sink(batch, epoch):
        w = batch.write.mode("overwrite").format(fmt)
        if mode == "update":
            w = w.partitionBy(*keys).option("partitionOverwriteMode", "dynamic")
        w.save(out)
    q = (sdf.writeStream.foreachBatch(sink).option("checkpointLocation", chk)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    p = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], sdf.schema)
    return spark.read.schema(sdf.schema).format(fmt).load(out).select(*sdf.columns)


__all__ = ["file_stream", "event_time", "enrich_stream", "entry_alert_stream", "day_totals",
           "day_alert_stream", "chain_stream", "run_available_now", "schemas"]
