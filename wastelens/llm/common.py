"""Helpers shared by the training-data operators.

A *word* is a maximal run of bytes other than space and 0x09-0x0D. A null text
counts as an empty one everywhere.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wastelens.session import cut_lineage, ship_package

BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000,
           "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}
FIT_BYTES = 1 << 20  # longer texts are scored, but no classifier is fitted on them
MOST_BITS = 1 << 27  # of a bit table
WHITE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text: Column, pattern: str = WHITE) -> Column:
    """Non-empty pieces of ``text`` between matches of ``pattern``."""
    return F.array_remove(F.split(text, pattern), "")


def word_codes(text: Column, pattern: str = WHITE) -> Column:
    """64-bit hash of each word, as ``array<bigint>``; the words stay in the JVM."""
    return F.transform(words_of(text, pattern), lambda w: F.xxhash64(w))


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder and read from there."""
    return cut_lineage(df)


def prepare(spark: SparkSession) -> None:
    """Make the package importable in the Python workers, and bound the Arrow batches
    they get: whole texts make long rows, so fewer of them go into one batch than by
    default (settings of fewer rows or bytes stay)."""
    ship_package(spark)
    for key, most in BATCHES.items():
        now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(key))
        if now and not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def hash_share(key: Column, salt: str) -> Column:
    """A fixed pseudo-random number in [0, 1) of ``key``."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 11) / F.lit(float(1 << 53))


def may_hold(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be one of ``keys``: all that are, and few others, without an exchange of ``df``.

    A bit table of the keys' hashes is broadcast: 16 to 32 bits a key, at most ``MOST_BITS``.
    """
    bits = min(MOST_BITS, max(1 << 15, 1 << (16 * keys.count()).bit_length()))
    bit = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    table = keys.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = df.join(F.broadcast(table), F.bitmap_bucket_number(bit) == F.col("_bucket"))
    return found.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*df.columns)


def bounded_sample(df: DataFrame, key: str, bound: int, salt: str) -> DataFrame:
    """At most ``bound`` rows of ``df``: those with the smallest hash of ``key``.

    One rule at every size: a first filter on the hash lets about twice the
    bound pass (all rows when there are fewer), so the final top-k sees a
    bounded number of rows however large ``df`` is. The same on every run.
    """
    n = df.count()
    u = hash_share(F.col(key), salt)
    rate = min(1.0, 2.0 * bound / max(n, 1))
    return df.where(u < F.lit(rate)).orderBy(u, F.col(key)).limit(bound)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int,
                    salt: str, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = FIT_BYTES) -> DataFrame:
    """One row of ``docs`` for each sampled id, with a column ``_y``: at most ``bound`` labelled ids for each class.

    ``labels`` may repeat an id; its largest label counts. Rows with a null id
    or label, and ids for which ``learn`` (an expression over ``id_col``) is
    not true, are never used. The sampled ids are at most twice ``bound``, so
    they are broadcast. Of an id's rows the one whose text has the smallest hash is used, and none of more
    than ``most_bytes``, so what is fitted on is at most ``2 * bound`` rows and ``most_bytes`` each, however
    many rows an id has and however long texts are.
    """
    known = (labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
             .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1)))
    known = known.withColumn("_ok", learn).where("_ok").drop("_ok")
    parts = [bounded_sample(known.where(F.col("_y") == y).select("_id").distinct(), "_id", bound, salt)
             .withColumn("_y", F.lit(y)) for y in (0, 1)]
    ids = parts[0].unionByName(parts[1]).groupBy("_id").agg(F.max("_y").alias("_y"))
    rows = docs.join(F.broadcast(ids), F.col(id_col) == F.col("_id"), "inner") \
        .where(F.coalesce(F.octet_length(text_col), F.lit(0)) <= most_bytes)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns], "_y")
    return rows.groupBy("_id").agg(F.min_by(row, F.struct(F.xxhash64(text_col), F.col(text_col))).alias("_row")).select("_row.*")


def every_fifth(y: np.ndarray) -> np.ndarray:
    """Every fifth case of each class: what calibration keeps out of training."""
    held = np.zeros(len(y), bool)
    for label in np.unique(y):
        held[np.flatnonzero(y == label)[::5]] = True
    return held
