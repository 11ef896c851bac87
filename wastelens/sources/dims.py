"""Dimension tables: load-order dedupe (D8) and change sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key: the row with the smallest ``seq`` (catalog rule)."""
    others = [c for c in df.columns if c != key]
    row = F.min_by(F.struct(*others), F.col(seq))
    return df.groupBy(key).agg(row.alias("_r")).select(key, "_r.*")


def last_per_key(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key: the row with the largest ``seq`` (price-override rule)."""
    others = [c for c in df.columns if c != key]
    row = F.max_by(F.struct(*others), F.col(seq))
    return df.groupBy(key).agg(row.alias("_r")).select(key, "_r.*")


def upsert(base: DataFrame, changes: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """Rows of ``changes`` replace rows of ``base`` with the same key; new keys
    are appended (edit / add / price upsert). Of changes that repeat a key the one of the largest
    ``seq`` counts, without ``seq`` the largest by its values, so a key stays one row."""
    rows = [F.col(f"`{c}`") for c in base.columns]
    order = F.struct(*([F.col(f"`{seq}`")] if seq else []), *rows)
    latest = changes.groupBy(key).agg(F.max_by(F.struct(*rows), order).alias("_r")).select("_r.*")
    return _without(base, latest, key).unionByName(latest)


def _without(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` whose key, null included, is none of ``keys``."""
    gone = keys.select(F.col(f"`{key}`").alias("_gone")).distinct()
    return base.join(gone, F.col(f"`{key}`").eqNullSafe(F.col("_gone")), "left_anti")


DELETE, UPDATE, UPSERT = "delete", "update", "upsert"


def compact_changes(changes: DataFrame, key: str, columns: list[str], seq: str = "seq", op: str = "op") -> DataFrame:
    """One row for each key of an ordered change log: what the log does to it.

    Changes are, in the order of ``seq``: ``delete``; ``upsert``, which sets every column; ``update``,
    which sets the columns that are not null, if the key exists by then. Of changes with one key and one
    ``seq`` a delete comes first, then upserts, then updates, these by their values. Other operations are an error.

    Columns: the key; ``kind`` (``delete``: the key is gone before what follows; ``upsert``: a row set by the log;
    ``update``: the old row, if any, goes on); ``_row``, the upserted row; ``_set``, for each column the value that
    later updates give it, in a struct that is null where none does. One aggregate, combined
    before the shuffle, so a key that a third of all changes name is no hot spot.
    """
    kind = F.col(f"`{op}`")
    known = F.when(kind.isin(DELETE, UPDATE, UPSERT), kind).otherwise(
        F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(kind, F.lit("null")))).cast("string"))
    rank = F.when(known == DELETE, 0).when(known == UPSERT, 1).otherwise(2)
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    at = F.struct(F.col(f"`{seq}`").alias("seq"), rank.alias("rank"), row.alias("row"))

    def last(value, when):
        return F.max_by(F.struct(at.alias("at"), value.alias("value")), F.when(when, at))
    d = changes.groupBy(key).agg(
        F.max(F.when(rank == 0, at)).alias("_deleted"), last(row, rank == 1).alias("_upserted"),
        *[last(F.col(f"`{c}`"), (rank == 2) & F.col(f"`{c}`").isNotNull()).alias(f"_set_{i}") for i, c in enumerate(columns)])
    set_at, gone_at = F.col("_upserted.at"), F.col("_deleted")
    back = set_at.isNotNull() & (gone_at.isNull() | (set_at > gone_at))
    since = F.greatest(set_at, gone_at)  # nulls are passed over
    later = [F.when(F.col(f"_set_{i}.at").isNotNull() & (since.isNull() | (F.col(f"_set_{i}.at") > since)),
                    F.struct(F.col(f"_set_{i}.value").alias("value"))).alias(c) for i, c in enumerate(columns)]
    return d.select(key, F.when(back, UPSERT).when(gone_at.isNotNull(), DELETE).otherwise(UPDATE).alias("kind"),
                    F.col("_upserted.value").alias("_row"), F.struct(*later).alias("_set"))


def apply_changes(base: DataFrame, changes: DataFrame, key: str, seq: str = "seq", op: str = "op") -> DataFrame:
    """``base`` (one row a key) after an ordered change log: edits, additions and deletions in the
    order they were made (see :func:`compact_changes`). Nulls are a key like any other."""
    columns = [c for c in base.columns if c != key]
    net = compact_changes(changes, key, columns, seq, op).withColumnRenamed(key, "_key")
    both = base.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_base"), F.col(f"`{key}`").alias("_own"),
                       F.lit(True).alias("_old")).join(net, F.col("_own").eqNullSafe(F.col("_key")), "full_outer")
    old = F.when(F.col("kind") == UPSERT, F.col("_row")).otherwise(F.col("_base"))
    stays = F.col("kind").isNull() | (F.col("kind") == UPSERT) | ((F.col("kind") == UPDATE) & F.col("_old"))
    types = dict(base.dtypes)

    def value(c: str):
        later = F.col("_set")[c]
        return F.when(later.isNotNull(), later["value"]).otherwise(old[c]).cast(types[c]).alias(c)
    named = F.when(F.col("_old"), F.col("_own")).otherwise(F.col("_key")).alias(key)
    return both.where(stays).select(*[named if c == key else value(c) for c in base.columns])


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Drop rows whose key is listed in ``keys``."""
    return _without(base, keys, key)


def append(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows."""
    return base.unionByName(rows.select(*base.columns))
