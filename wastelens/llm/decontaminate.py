"""Benchmark decontamination: short test items inside long documents.

Shingles are five words (runs of letters and digits, lower case). A document holds an item
if it has at least ``THRESHOLD`` of the item's different shingles, wherever they stand. An item of one to
four words is one shingle of its own width, which a document has or has not.

The search is a containment search by MinHash with the items partitioned by size, as a
short item in a long document has next to no Jaccard similarity:

1. Items are partitioned by their number of shingles (powers of two). The sketch of an
   item is its smallest shingle hashes, as many as its partition's largest size allows to
   be missing, and one more. A document that holds enough of the item has one of
   them at least, however long it is: no match is lost.
2. Each document's shingles are looked up in a bit table of fixed size made from the
   sketches' hashes, and the few that pass are joined with the sketches: a document that
   shares an entry with an item is a candidate for it. Most documents have none.
3. For candidate pairs alone the shared shingles are counted against all of the item's.

Items without a word match nothing; null texts are empty; items of a null id are left out; documents of
one id with different texts are told apart by ``text_key``, rows that repeat both give their
pairs once; items alike in text are each found (there are no ties to break); a very long text is one
array of word codes of its task; with an empty table on either side the result is empty. Columns
beside id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wastelens.llm.common import prepare, read, stored, text_of, word_codes

WIDTH = 5
THRESHOLD = 0.8
SPLIT = r"[^\p{L}\p{N}]+"
DOCS_AT_ONCE = 200
BITS = 22  # the bit table has 2 ** BITS entries
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                 0x85EBCA77C2B2AE63], np.uint64)


def shingles(codes: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` word codes within a text, and the text's index."""
    n = np.maximum(np.diff(offsets) - width + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
    h = np.zeros(len(start), np.uint64)
    codes = codes.view(np.uint64)
    for j in range(width):
        h += codes[start + j] * _ODD[j]
        h ^= h >> np.uint64(29)
    h *= _ODD[1]
    h ^= h >> np.uint64(32)
    return h.view(np.int64), text


def _shingle_batches(shared, widths: list[int] | None = None, keys=None):
    """(…, codes) -> (…, h): a row for each different shingle of a text that the bit
    table knows, of each of ``widths``. Without a table: all of them, and of a text of fewer than
    ``WIDTH`` words the one that is the whole text. With ``keys``, a bit table too, texts whose
    ``text_key`` it doesn't know are passed over."""

    def run(batches):
        table = None if shared is None else np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        wanted = None if keys is None else np.unpackbits(np.frombuffer(keys.value, np.uint8)).astype(bool)
        for b in batches:
            if wanted is not None:
                b = b.filter(pa.array(wanted[b.column("text_key").to_numpy() & ((1 << BITS) - 1)]))
            codes = b.column(b.num_columns - 1)
            off = codes.offsets.to_numpy().astype(np.int64)
            values, found = codes.values.to_numpy(), []
            for at in range(0, b.num_rows, DOCS_AT_ONCE):
                part = off[at:at + DOCS_AT_ONCE + 1]
                for width in [WIDTH, *range(1, WIDTH)] if widths is None else widths:
                    h, text = shingles(values, part, width)
                    known = np.diff(part)[text] == width if widths is None and width < WIDTH else slice(None)
                    if table is not None:
                        known = table[h & ((1 << BITS) - 1)]
                    found.append((h[known], text[known] + at))
            h, text = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            h, text = h[new], pa.array(text[new])
            yield pa.RecordBatch.from_arrays([*[c.take(text) for c in b.columns[:-1]], pa.array(h)],
                                             [*b.schema.names[:-1], "h"])
    return run


def _bit_table(spark, hashes: DataFrame, name: str = "h"):
    """Broadcast table of fixed size: which of the lowest ``BITS`` bits occur among the hashes ``name``."""
    marks = hashes.select(F.col(name).bitwiseAND((1 << BITS) - 1).alias("b")).distinct().toArrow().column("b").to_numpy()
    table = np.zeros(1 << BITS, bool)
    table[marks] = True
    return spark.sparkContext.broadcast(np.packbits(table).tobytes())


def sketches(shingled: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, h, n, in_sketch) from (item_id, h): the sketch by partitions of size."""
    n = shingled.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1  # of the item's partition
    size = F.least(F.col("n"), (largest - F.ceil(largest * threshold - 1e-9) + 1).cast("long"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("h"))
    return shingled.join(n, "item_id").withColumn("in_sketch", place <= size)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_key, item_id, n_shared, n_item, containment): documents that hold an item."""
    spark = docs.sparkSession
    prepare(spark)
    words = items.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("item_id"), word_codes(F.lower(text_of(item_text)), SPLIT).alias("codes"))
    listed = stored(sketches(words.mapInArrow(_shingle_batches(None), "item_id long, h long").distinct(), threshold))
    # Widths that occur: at most WIDTH of them.
    widths = sorted(r[0] for r in words.select(F.least(F.size("codes"), F.lit(WIDTH))).distinct().collect() if r[0] > 0)
    text = text_of(text_col)
    coded = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"),
                        word_codes(F.lower(text), SPLIT).alias("codes"))
    key = ["doc_id", "text_key"]
    sketch = listed.where("in_sketch").select("item_id", "h", "n")
    found = coded.mapInArrow(_shingle_batches(_bit_table(spark, sketch), widths), "doc_id long, text_key long, h long")
    candidates = stored(found.join(sketch, "h").select(*key, "item_id", "n").distinct())
    # Exact counts: the shingles of documents with candidates that any item has. Texts stay where they are read;
    # the few that only share bits with a candidate's key find no partner in the join.
    known = coded.mapInArrow(_shingle_batches(_bit_table(spark, listed), widths, _bit_table(spark, candidates, "text_key")),
                             "doc_id long, text_key long, h long").distinct()
    pair = candidates.withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    shared = known.join(pair, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))) \
        .join(listed.select("item_id", "h"), ["item_id", "h"], "left_semi")
    return shared.groupBy(*key, "item_id").agg(F.count(F.lit(1)).alias("n_shared"), F.max("n").alias("n_item")) \
        .where(F.col("n_shared") >= F.col("n_item") * threshold - 1e-9) \
        .select(*key, "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All (document, test item) pairs with a containment of 0.8 or more."""
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_key")
