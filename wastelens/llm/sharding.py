"""Sharding by vector bin packing.

Each document is a vector (bytes, words, rows). Documents with equal texts
form a group that is placed as one unit. Units are placed on the shard where
the dot product of their vector with the shard's residual capacity is highest.

What the driver places is bounded by ``n_shards`` alone:

* groups with more than ``1 / (n_shards * FINE)`` of any total stand alone
  (at most ``3 * n_shards * FINE`` of them can exist); only one that exceeds
  half a shard is dealt by a hash of its row number into pieces of at most about
  that size, so a group with a third of all rows breaks neither the balance
  nor one task;
* all other groups are dealt by a hash of their text into bundles: coarse ones
  for nine tenths of the hash range, finer ones for the rest, which as
  smaller units are placed later and even out what the coarse ones left.

The law that holds is ``bytes``: the shards' sizes are nearly equal (as far as
single documents allow).

Null texts count as empty; null or repeated ids are rows like any other; an
empty table gives an empty result. Slots are gapless within a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wastelens.llm.common import read, stored, text_of, words_of

FINE = 64
TAIL = 0.1
WHOLE = 0.5
DIMS = ("size", "n_words", "n_rows")


def place(vectors: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each unit. ``vectors``: (units, 3) shares of the totals (each
    column sums to 1).

    Large units first; a unit goes where dot(unit, residual capacity) is
    highest (ties: the lowest shard). For the smallest units, the last tenth
    of all bytes, only the bytes count, so that the law holds closely.
    """
    residual = np.full((n_shards, vectors.shape[1]), 1.0 / n_shards)
    shard = np.zeros(len(vectors), np.int64)
    order = np.lexsort((np.arange(len(vectors)), -vectors[:, 0], -vectors.max(axis=1)))
    done = 0.0
    for i in order:
        weight = vectors[i] * (1.0, 0.0, 0.0) if done >= 1 - TAIL else vectors[i]
        shard[i] = s = int(np.argmax(np.round(residual @ weight, 18)))
        residual[s] -= vectors[i]
        done += vectors[i, 0]
    return shard


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: id, ``size`` (UTF-8 bytes of the text plus 8),
    ``n_words``, ``text_crc32``, ``group_key`` (hash of the text), ``shard``,
    ``slot`` (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    text = text_of(text_col)
    base = stored(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.size(words_of(text)).cast("long").alias("n_words"),
        F.lit(1).cast("long").alias("n_rows"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group_key"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("row")))

    total = base.agg(*[F.sum(d).alias(d) for d in DIMS]).first()
    totals = [max(float(total[d] or 0), 1.0) for d in DIMS]
    share = F.greatest(*[F.col(d) / F.lit(t) for d, t in zip(DIMS, totals)])
    limit = 1.0 / (n_shards * FINE)
    n_coarse, n_tail = n_shards * FINE, n_shards * FINE * 2

    # Bounded: at most 3 * n_shards * FINE groups can exceed the limit.
    heavy = [(r["group_key"], int(np.ceil(r["share"] * n_shards / WHOLE))) for r in
             base.groupBy("group_key").agg(*[F.sum(d).alias(d) for d in DIMS])
             .select("group_key", share.alias("share")).where(F.col("share") > limit)
             .orderBy("group_key").collect()]
    first, known = n_coarse + n_tail, []
    for key, pieces in heavy:
        known.append((key, first, pieces))
        first += pieces
    heavy_df = spark.createDataFrame(known, "group_key long, first long, pieces long")

    u = F.shiftrightunsigned(F.xxhash64("group_key"), 11) / F.lit(float(1 << 53))
    bundle = F.when(u >= TAIL, F.floor((u - TAIL) / (1 - TAIL) * n_coarse)) \
        .otherwise(n_coarse + F.floor(u / TAIL * n_tail))
    with_unit = base.join(F.broadcast(heavy_df), "group_key", "left").withColumn(
        "unit", F.coalesce(F.col("first") + F.pmod(F.xxhash64("row"), F.col("pieces")),
                           bundle.cast("long")))

    # Bounded: bundles and pieces are at most about 12 * n_shards * FINE.
    units = with_unit.groupBy("unit").agg(*[F.sum(d).alias(d) for d in DIMS]).orderBy("unit").collect()
    ids = np.array([r["unit"] for r in units], np.int64)
    vectors = np.array([[r[d] for d in DIMS] for r in units], float).reshape(-1, 3) / totals
    shards = place(vectors, n_shards)
    placed = spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, shards)], "unit long, shard int")
    out = with_unit.join(F.broadcast(placed), "unit")

    # Slots: number the rows of a shard within each partition of the stored
    # table, then shift by the counts of the partitions before it.
    counts = out.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n"))
    out = out.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")))
    return out.join(before.drop("n"), ["shard", "part"]).select(
        "doc_id", "size", "n_words", "text_crc32", "group_key", "shard",
        (F.col("before") + F.col("nth") - 1).alias("slot"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 23 under the law ``bytes``."""
    return shard_documents(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "n_words")
