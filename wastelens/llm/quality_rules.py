"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target
and the raw corpus, in DataFrame functions only.

Single words and pairs of neighbours are hashed into ``BUCKETS``. Two smoothed
multinomials over the buckets are counted from all documents: the raw corpus, and
the documents that ``labels`` trusts. A document's score is the sum of log(target /
raw) over its n-grams divided by their number. Weights are rounded to millionths
and summed as whole numbers, so scores don't depend on the order of summation.

The threshold is one of a grid of ``1 / GRID``: the one that parts trusted from
distrusted labelled documents best (largest sum of the share of trusted ones kept
and the share of distrusted ones not kept; the lowest of equals), counted over all of
them; without labels of both kinds it is minus infinity. A document is kept if the
base rules pass and its score reaches the threshold; a document without words has score 0.

Base rules: fewer than ``MIN_WORDS`` words, or more than half of the words in repeated
three-word windows, fail.

Null texts are empty; null ids match no label; repeated rows are scored alike, each on its own;
an id labelled both ways counts by its smallest label; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wastelens.llm.common import WHITE, read, stored, text_of, words_of

BUCKETS = 1 << 16
ALPHA = 1.0
MICRO = 1_000_000
GRID = 100
MIN_WORDS = 50
FEW = 16


def _hashes(codes: str, width: int) -> Column:
    """Hash of each window of ``width`` word codes."""
    last = F.greatest(F.size(codes) - (width - 1), F.lit(0))
    return F.transform(F.slice(codes, F.lit(1), last),
                       lambda x, i: F.xxhash64(x, *[F.get(F.col(codes), i + j) for j in range(1, width)]))


def n_grams(codes: str) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    one = F.transform(codes, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    two = F.transform(_hashes(codes, 2), lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    return F.concat(one, two)


def _covered(starts: Column) -> Column:
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))


def base_columns(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the base statistics; ``_codes``: the words' hashes."""
    text = text_of(text_col)
    df = docs.select(*keep, text.alias("_text"), words_of(text).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        *keep, F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("_text", WHITE, "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_codes"))
    names = [*keep, "n_words", "word_chars", "n_symbols"]
    df = df.select(*names, "_codes", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                   _hashes("_codes", 3).alias("_windows"))
    names.append("n_dup_lines")
    df = df.withColumn("_sorted", F.sort_array("_windows"))
    df = df.withColumn("_twice", F.array_distinct(F.filter(
        "_sorted", lambda x, i: (i > 0) & (x == F.get(F.col("_sorted"), i - 1)))))
    # Where the repeated windows start: by looking up when few of them repeat, else by sorting with places.
    few = F.filter(F.transform("_windows", lambda x, i: F.when(F.array_contains(F.col("_twice"), x), i)),
                   lambda i: i.isNotNull())
    placed = F.when(F.size("_twice") > FEW, F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.withColumn("_placed", placed)
    many = F.transform(F.filter("_placed", lambda x, k: (
        ((k > 0) & (F.get(F.col("_placed"), k - 1)["h"] == x["h"]))
        | F.coalesce(F.get(F.col("_placed"), k + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["i"])
    starts = F.when(F.size("_twice") > FEW, many).otherwise(few)
    repeat = F.when(F.size("_twice") == 0, 0).otherwise(_covered(starts)).cast("long")
    return df.select(*names, repeat.alias("n_repeat_words"), "_codes")


def weights(docs: DataFrame, trust: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, weight): log(target / raw) in millionths, counted over all documents.
    ``trust``: (_id, _y), y 1 for trusted ids."""
    # The trusted ids grow with the input: the same join by shuffle at every size.
    target = trust.where("_y = 1").hint("merge")
    text = text_of(text_col)
    df = docs.join(target, F.col(id_col) == F.col("_id"), "left").select(
        F.transform(words_of(text), lambda w: F.xxhash64(w)).alias("_codes"), F.coalesce("_y", F.lit(0)).alias("_y"))
    counts = stored(df.select(F.explode(n_grams("_codes")).alias("bucket"), "_y").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("raw"), F.sum("_y").alias("target")))
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    smooth = ALPHA * BUCKETS
    ratio = F.log((F.col("target") + ALPHA) / (total[1] + smooth)) - F.log((F.col("raw") + ALPHA) / (total[0] + smooth))
    return counts.select("bucket", F.round(ratio * MICRO).cast("long").alias("weight"))


def scored(docs: DataFrame, weight: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, the base statistics, ``total`` (sum of the weights) and ``n_grams``; a row for each document."""
    base = base_columns(docs, keep, text_col).withColumn("_row", F.monotonically_increasing_id())
    names = [c for c in base.columns if c != "_codes"]
    rows = base.select(*names, F.explode_outer(n_grams("_codes")).alias("bucket"))
    # At most BUCKETS weights, so they are broadcast; all n-grams of a document are in one task
    # and add up there before the exchange.
    return rows.join(F.broadcast(weight), "bucket", "left").groupBy(*names).agg(
        F.coalesce(F.sum("weight"), F.lit(0)).alias("total"), F.count("bucket").alias("n_grams")).drop("_row")


def threshold(scores: DataFrame, trust: DataFrame, id_col: str = "doc_id") -> int | None:
    """Grid place of the threshold; ``scores``: (id, _place). None: no labels of both kinds."""
    both = scores.join(trust, F.col(id_col) == F.col("_id")).groupBy("_place").agg(
        F.sum("_y").alias("good"), F.sum(1 - F.col("_y")).alias("bad"))
    # Bounded: weights lie within a few tens, so the grid has a few thousand places.
    rows = sorted((r["_place"], r["good"], r["bad"]) for r in both.collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return None
    best, at, lost, cut = -1.0, rows[0][0], 0, 0
    for place, g, b in rows:
        gain = (good - lost) / good + cut / bad
        if gain > best + 1e-12:
            best, at = gain, place
        lost, cut = lost + g, cut + b
    return at


def judge(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id",
          text_col: str = "text", label: str = "quality") -> DataFrame:
    """The base statistics, ``base_failed``, ``score`` and ``kept`` of each document."""
    trust = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(
        F.col(id_col).alias("_id")).agg(F.min(F.col(label).cast("int")).alias("_y"))
    docs = docs.select(*dict.fromkeys([*(keep or [id_col]), id_col, text_col]))
    table = stored(scored(docs, weights(docs, trust, id_col, text_col), keep or [id_col], text_col))
    place = F.coalesce(F.floor(F.col("total") * GRID / (F.col("n_grams") * MICRO)), F.lit(0))
    place = F.when(F.col("n_grams") > 0, place).otherwise(F.lit(0)).cast("long")
    table = table.withColumn("_place", place)
    least = threshold(table.select(id_col, "_place"), trust, id_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    score = F.when(F.col("n_grams") > 0, F.col("total") / (F.col("n_grams") * MICRO)).otherwise(0.0)
    passes = F.lit(True) if least is None else F.col("_place") >= least
    return table.select(*(keep or [id_col]), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), (~failed & passes).alias("kept"), score.alias("score"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of all documents."""
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
