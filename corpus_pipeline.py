"""The training-data pipeline over ``documents``.

``STAGES`` lists (name, function) in order; each function takes (spark, docs, sf_dir)
and returns a DataFrame, which ``run`` writes as Parquet into the shared folder and reads
again as the next stage's ``docs``. All but the last return the columns of documents.

1. toxicity: documents whose score reaches their language's threshold go.
2. near_duplicates: of each SimHash component one document stays, the one of the
   smallest id; of rows that repeat id and text one stays. A component without any id keeps
   one document of each fingerprint.
3. repeated_passages: bytes covered by 50-byte strings of smaller ids go (whole
   characters); ``n_chars`` follows; a document of which nothing is left goes.
4. decontamination: documents that hold a benchmark item go.
5. packing: the rest as pieces in sequences of at most 2048 tokens.

Nulls in any column are kept as they are (a null text counts as empty and is
empty after stage 3); extra columns pass through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wastelens.llm import decontaminate, packing, simhash, suffixes, toxicity
from wastelens.llm.common import read, text_of
from wastelens.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classifier = toxicity.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(_row(docs), "text", "lang"), classifier, ["row"])
    return scored.where(~F.col("_toxic")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = simhash.near_duplicates(docs)
    # The first of each component by (id, hash of the text); rows without an id come last.
    first = named.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("lone")) \
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"),
             F.count(F.lit(1)).alias("n"))
    keep = first.select(F.col("first.doc_id").alias("keep_id"), F.col("first.text_key").alias("keep_key"),
                        (F.col("n") > 1).alias("many"))
    kept = _keyed(docs).join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("key") == F.col("keep_key")))
    # Only a component of several rows can hold a row twice.
    once = kept.where("many").dropDuplicates(["id", "key"])
    return kept.where("not many").unionByName(once).select("row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(docs).where((F.col("removed") == 0) | (F.col("kept") != ""))
    length = F.when(F.col("removed") > 0, F.char_length("kept"))

    def value(name: str):
        if name == "text":
            return F.col("kept")
        old = F.col("row")[name]
        return F.coalesce(length, old).cast(docs.schema[name].dataType) if name == "n_chars" else old
    return cut.select(*[value(c).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark")).select(
        F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key")).distinct()
    return _keyed(docs).join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key")),
                             "left_anti").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


def _row(docs: DataFrame):
    """All columns as one struct, so that no name of theirs can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_row(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_of()).alias("key"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # SQL has no way to state a trained classifier, SimHash or byte-pair tokens.


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
