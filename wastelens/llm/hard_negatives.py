"""Hard negatives for anchors, by exact integer inner products.

Vectors are made integers, floor(256 * x) for each component. Anchors are cut into blocks
by a hash, all rows into blocks by another, and each pair of blocks is one group
(a stated query set against all rows, in blocks): both sides are shuffled to it,
nothing goes through the driver, and a block's size does not depend on how
often a label or a vector occurs. A group multiplies its anchor block with tiles of
its candidates by Strassen's recursion: operands are padded with zeros to even sizes, seven
half-size products and exact integer additions make one product, and from
``BASE`` on numpy multiplies. Each anchor's best are held in heaps as rows of sorted arrays,
and a tile's heap is merged into the block's: the best ``positives`` of the same
label, then, in a second round that knows every positive's score, the best ``negatives`` of other
labels within each positive's window. The blocks' heaps are merged by Spark with
the same order (score descending, then smaller id).

First round: candidates meet only anchors of their own label, in blocks by (label, hash), so
a label that holds a third of all rows is many blocks.

Rules. Rows with a null label, a null vector, a null or non-finite component, or
a null id take no part. An empty vector is all zeros; a shorter one is filled up with zeros.
"Other" rows are those of another id. Rows that repeat an id are rows like any other: as candidates
each fills a place of its own, as anchors they give their results once for each.
Ties of score go to the smaller id, then to the row that comes first in the table's
blocks (rows alike in both give the same result either way). An anchor without positives, or a positive without a row in
its window, gives no row. An empty table gives an empty result. Extra columns are not read.
Products that might leave 63 bits are computed on Python's integers, and such scores are held at
the ends +-2**62 in the result and in comparisons.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wastelens.llm.common import prepare, read, stored

BASE = 16  # side from which numpy multiplies
TILE = 512  # candidates of one product
ANCHORS = 1024  # of one block, on average
ROWS = 8192  # candidates of one block, on average
END = 1 << 62
NONE = -END - 1  # below every score: an empty place

HEAP = "anchor long, slot int, id long, score long"


# ---------------------------------------------------------------- products
def strassen(a: np.ndarray, b: np.ndarray, base: int = BASE) -> np.ndarray:
    """``a @ b`` of whole numbers by Strassen's recursion with zero padding."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= base:
        return a @ b
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, base)
    p2 = strassen(a21 + a22, b11, base)
    p3 = strassen(a11, b12 - b22, base)
    p4 = strassen(a22, b21 - b11, base)
    p5 = strassen(a11 + a12, b22, base)
    p6 = strassen(a21 - a11, b11 + b12, base)
    p7 = strassen(a12 - a22, b21 + b22, base)
    out = np.empty((2 * h, 2 * j), p1.dtype)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def inner_products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``a`` and ``c``, whole numbers held as doubles."""
    if not (a.size and c.size):
        return np.zeros((len(a), len(c)), np.int64)
    # A level of the recursion at most doubles the operands and quadruples a sum of products.
    levels = max(int(min(len(a), a.shape[1], len(c))) // BASE, 1).bit_length()
    if np.abs(a).max() * np.abs(c).max() * a.shape[1] * 16.0 ** levels < 2.0 ** 62:
        return strassen(a.astype(np.int64), c.astype(np.int64).T)
    exact = strassen(np.array([[int(x) for x in r] for r in a], object), np.array([[int(x) for x in r] for r in c], object).T)
    return np.clip(exact, -END, END).astype(np.int64)


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array as doubles, filled up with zeros to ``width``."""
    offsets = np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset:vectors.offset + len(vectors) + 1].astype(np.int64)
    size = np.diff(offsets)
    out = np.zeros((len(vectors), width))
    flat = vectors.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], size)] = flat
    return out


# ------------------------------------------------------------------- heaps
class Heaps:
    """For each row the best ``k`` (score, id), best first; empty places hold ``NONE``."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.score, self.id = np.full((rows, k), NONE, np.int64), np.full((rows, k), END, np.int64)

    def merge(self, score: np.ndarray, ids: np.ndarray) -> None:
        """Takes in more (score, id), as many for each row."""
        score, ids = np.hstack([self.score, score]), np.hstack([self.id, ids])
        best = np.lexsort((ids, -score), axis=1)[:, :self.k]
        self.score, self.id = np.take_along_axis(score, best, 1), np.take_along_axis(ids, best, 1)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the ``k`` largest of each row, ties to the left."""
    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(score, best, 1), ids[best]


def same_label(anchors: pa.Table, rows: pa.Table, k: int) -> Heaps:
    """The best ``k`` rows of each anchor's label and another id."""
    heaps = Heaps(len(anchors), k)
    for score, (id_a, label_a), (id_c, label_c) in products(anchors, rows):
        other = (label_a[:, None] == label_c[None, :]) & (id_a[:, None] != id_c[None, :])
        heaps.merge(*_first(np.where(other, score, NONE), id_c, k))
    return heaps


def in_windows(anchors: pa.Table, rows: pa.Table, k: int, low: int, high: int) -> Heaps:
    """For each of the anchors' ``positives`` (lists of scores) the best ``k`` rows of other labels
    whose score lies between ``low`` and ``high`` hundredths of the positive's."""
    offers = anchors.column("positives").combine_chunks()
    size = offers.value_lengths().to_numpy()
    bound = offers.flatten().to_numpy(zero_copy_only=False)
    owner, at = np.repeat(np.arange(len(size)), size), np.append(0, np.cumsum(size))
    # In whole numbers: ceil(low * p / 100) and floor(high * p / 100), without leaving 64 bits.
    at_least = low * (bound // 100) + -(-(low * (bound % 100)) // 100)
    at_most = high * (bound // 100) + high * (bound % 100) // 100
    heaps = Heaps(len(owner), k)
    for score, (_, label_a), (id_c, label_c) in products(anchors, rows):
        score, ids = _first(np.where(label_a[:, None] != label_c[None, :], score, NONE), id_c, len(id_c))
        first = np.concatenate([np.searchsorted(-row, -at_most[i:j]) for row, i, j in zip(score, at[:-1], at[1:])])
        place = first[:, None] + np.arange(k)
        inside = place < len(id_c)
        place = owner[:, None], np.where(inside, place, 0)
        inside &= score[place] >= at_least[:, None]
        heaps.merge(np.where(inside, score[place], NONE), np.where(inside, ids[place], END))
    return heaps


def products(anchors: pa.Table, rows: pa.Table):
    """Scores of all anchors with a tile of the rows, and both sides' (ids, labels); rows by id."""
    width = max(int(t.column("vector").combine_chunks().value_lengths().to_numpy().max(initial=0)) for t in (anchors, rows))
    rows = rows.take(pa.array(np.argsort(rows.column("id").to_numpy(), kind="stable")))
    left = matrix(anchors.column("vector").combine_chunks(), width)
    ours = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
    for at in range(0, len(rows), TILE):
        tile = rows.slice(at, TILE)
        yield inner_products(left, matrix(tile.column("vector").combine_chunks(), width)), ours, (
            tile.column("id").to_numpy(), tile.column("label").to_numpy())


def _table(anchor: np.ndarray, slot: np.ndarray, heaps: Heaps) -> pa.Table:
    row, place = np.nonzero(heaps.score != NONE)
    return pa.table({"anchor": pa.array(anchor[row], pa.int64()), "slot": pa.array(slot[row].astype(np.int32)),
                     "id": pa.array(heaps.id[row, place], pa.int64()), "score": pa.array(heaps.score[row, place], pa.int64())})


# ------------------------------------------------------------------- Spark
def integer_vectors(table: DataFrame, id_col: str, label: Column, vector: str) -> DataFrame:
    """id, label, vector (whole numbers as doubles) of the rows that take part."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    ok = F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & F.forall(
        x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    # floor() of a double is a long in Spark, which very large values would leave; these are whole already.
    whole = F.transform(x, lambda v: F.when(F.abs(v) < 2.0 ** 44, F.floor(v * 256).cast("double")).otherwise(v * 256))
    return table.where(ok).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                                  whole.alias("vector"))


def mine(table: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         id_col: str = "vec_id", label: Column | None = None, vector: str = "embedding",
         anchors_a_block: int = ANCHORS, rows_a_block: int = ROWS) -> DataFrame:
    """For each anchor (``is_anchor``, over the columns id and label) and positive the first ``negatives`` rows of
    other labels whose score lies from ``low`` to ``high`` hundredths of the positive's:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    prepare(table.sparkSession)
    rows = integer_vectors(table, id_col, F.col("label") if label is None else label, vector)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    anchors = rows.where(is_anchor)
    n_rows, n_anchors = rows.count(), anchors.count()
    row_blocks, anchor_blocks = -(-n_rows // rows_a_block) or 1, -(-n_anchors // anchors_a_block) or 1

    def block(n: int, salt: str) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Round 1: anchors meet the blocks of their own label only; a label has blocks by its number of rows.
    sizes = rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / rows_a_block).cast("int").alias("blocks"))
    fresh = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # columns of their own beside the anchors'
    own = fresh.join(sizes.select(F.col("label").alias("of"), "blocks"), F.col("label") == F.col("of")).withColumn("rb", F.pmod(F.xxhash64("row", F.lit("rows")), F.col("blocks")).cast("int")) \
        .withColumn("ab", every(anchor_blocks)).drop("blocks", "row", "of")
    asked = anchors.join(sizes, "label").withColumn("ab", block(anchor_blocks, "anchors")) \
        .withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    key = ["label", "rb", "ab"]

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        heaps = same_label(left, right, positives) if len(left) and len(right) else Heaps(0, positives)
        return _table(left.column("row").to_numpy(), np.zeros(len(left)), heaps)
    found = asked.groupBy(*key).cogroup(own.groupBy(*key)).applyInArrow(first, HEAP)
    by = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    found = stored(found.withColumn("slot", F.row_number().over(by)).where(F.col("slot") <= positives))
    # Round 2: every block of rows, windows by the positives' scores.
    offers = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "score"))).alias("p")) \
        .select(F.col("anchor").alias("row"), F.col("p.score").alias("positives"))
    asked = anchors.join(offers, "row").withColumn("ab", block(anchor_blocks, "anchors")).withColumn("rb", every(row_blocks))
    others = fresh.withColumn("rb", block(row_blocks, "rows")).withColumn("ab", every(anchor_blocks)).drop("row")
    key = ["rb", "ab"]

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        size = left.column("positives").combine_chunks().value_lengths().to_numpy() if len(left) else np.zeros(0, np.int64)
        heaps = in_windows(left, right, negatives, low, high) if len(left) and len(right) else Heaps(0, negatives)
        anchor = np.repeat(left.column("row").to_numpy(), size)
        slot = np.arange(len(anchor)) - np.repeat(np.cumsum(size) - size, size) + 1
        return _table(anchor, slot, heaps)
    hard = asked.groupBy(*key).cogroup(others.groupBy(*key)).applyInArrow(second, HEAP)
    by = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    hard = hard.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives) \
        .withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    named = found.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor") \
        .withColumnsRenamed({"id": "positive_id", "score": "positive_score"})
    return named.join(hard, ["anchor", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id",
                                                       "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Rows of ``embeddings`` whose id is divisible by 50 against all rows; the label of rows whose id is
    divisible by 7 is moved on by one."""
    table = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table, F.col("id") % 50 == 0, label=label)


#: The same rows in DuckDB.
OP13_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS lab,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.id AS anchor_id, c.id AS cand_id, a.lab = c.lab AS same,
         list_sum(list_transform(list_zip(a.vec, c.vec), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.id % 50 = 0 AND a.id <> c.id),
pos AS (
  SELECT anchor_id, cand_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, cand_id) <= 5),
neg AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, c.cand_id AS negative_id, c.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY c.score DESC, c.cand_id) AS rank
  FROM pos p JOIN pairs c ON c.anchor_id = p.anchor_id AND NOT c.same
   AND 50 * p.positive_score <= 100 * c.score AND 100 * c.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM neg WHERE rank <= 3
"""
