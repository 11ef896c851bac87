"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints: the text with A-Z in lower case, its words in shingles (joined
by one space, repeats included; fewer words than a shingle: all of them; none:
fingerprint zero), XXH64 of each shingle; a bit is set if it is set in more
than half of the hashes.

Links join different fingerprints that differ in at most ``max_bits`` bits;
equal fingerprints are one node, so copies are never paired up.

The index has masked bit patterns as its nodes:

* Upper nodes. The bits are split into ``max_bits + 1`` masks. Two linked
  fingerprints agree on at least one mask, so each fingerprint stands below
  one upper node (mask, bits under it) for every mask, and linked ones meet
  below one of them: no link is lost. An upper node with more than ``LIMIT``
  fingerprints is split again by masks of its remaining bits, as often as
  needed; one that all three levels leave too large is dealt into a grid of cells
  (every two of its fingerprints meet in one cell).
* Lower nodes. Below an upper node the fingerprints are sorted by Gray rank,
  which puts codes that differ in few bits side by side, and runs of
  ``FAN`` are factored level by level: a node holds the bits all below it share.
  A search adds up, from the top, the differences under the bits that a node
  shares beyond its parent, and drops a whole node once they exceed the limit.

A task keeps a forest of the links it finds and gives out one link for each
fingerprint at most, so a dense group of near copies does not give all pairs.

Null texts count as empty; null ids link like others but never name a component;
an empty table gives an empty result. Rows that repeat an id or a text are rows like any other; ties (equal
ids of a component, equal ranks of equal codes) give the same ids either way. Very long texts are hashed whole.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wastelens.llm.common import prepare, read, stored, text_of
from wastelens.llm.components import components

SEED = 42
LIMIT = 4096
FAN = 8
BROADCAST_ROWS = 50_000
DOCS_AT_ONCE = 500
ROWS_AT_ONCE = 100_000
FRONTIER = 1 << 18  # pairs of a query and a node that a search holds at a time

# Byte -> its 8 bits as the 8 byte lanes of one 64-bit word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


# ------------------------------------------------------------ fingerprints
def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each word shingle of the lower-cased text."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()  # bytes: A-Z and the six white-space bytes only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [digest(joined, SEED)]
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    return [digest(joined[s:e - 1], SEED) for s, e in zip(starts, ends[width - 1:])]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of ``counts`` hashes (0 for an empty run)."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    # Sum byte lanes over at most 255 hashes at a time, then the partial sums.
    parts = -(-n // 255)
    first = np.cumsum(n) - n
    part_first = np.cumsum(parts) - parts
    within = np.arange(parts.sum()) - np.repeat(part_first, parts)
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.repeat(first, parts) + 255 * within, axis=0)
    ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 64), part_first, axis=0, dtype=np.int32)
    bits = 2 * ones.astype(np.int64) > n[:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint_batches(width: int):
    def run(batches):
        for b in batches:
            fps = []
            for at in range(0, b.num_rows, DOCS_AT_ONCE):
                lists = [shingle_hashes(t, width) for t in b.column(2).slice(at, DOCS_AT_ONCE).to_pylist()]
                counts = np.array([len(x) for x in lists], np.int64)
                hashes = np.fromiter((h for x in lists for h in x), np.uint64, int(counts.sum()))
                fps.append(majority(hashes, counts))
            fp = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))],
                                             ["doc_id", "text_key", "fp"])
    return run


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp): one row for each document; fp as a signed 64-bit number."""
    prepare(docs.sparkSession)
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"),
                       text.cast("binary").alias("text")) \
        .mapInArrow(_fingerprint_batches(width), "doc_id long, text_key long, fp long")


# ------------------------------------------------------------------- index
def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    r = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def split_mask(mask: int, parts: int) -> list[int]:
    """``mask``'s bits in ``parts`` masks of nearly equal size."""
    bits = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << b for b in bits[len(bits) * p // parts:len(bits) * (p + 1) // parts]) for p in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Forest:
    """Which of n items hang together; each tree is named by its smallest item."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def linked(key: np.ndarray, code: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as a forest) between the different codes of each key that differ
    in at most ``max_bits`` bits."""
    order = np.lexsort((gray_rank(code), key))
    key, code = key[order], code[order]
    n = len(code)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, n))
    keep = np.repeat(size > 1, size)  # a code alone has no link
    key, code = key[keep], code[keep]
    n = len(code)
    forest = Forest(n)
    if n:
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, n))
        # Levels bottom up: (first child, end of children) and the bits shared below.
        levels = []
        starts, groups = np.arange(n), np.repeat(np.arange(len(first)), size)
        low = high = code
        while True:
            levels.append((starts, low, ~(low ^ high)))
            if len(starts) == len(first):
                break
            at = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
            within = np.arange(len(groups)) - np.repeat(at, np.diff(np.append(at, len(groups))))
            starts = np.flatnonzero(within % FAN == 0)
            groups = groups[starts]
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
        ends = [np.append(s[1:], len(below)) for (s, _, _), (below, _, _) in zip(levels[1:], levels)]
        # The last code below each node: a search only looks for later codes than its own.
        last = [np.arange(n)]
        for e in ends:
            last.append(last[-1][e - 1])
        # What is still to be searched: (depth, queries, their nodes, bits that differ so far). A part whose
        # children would be more than FRONTIER is cut, the rest waits, so memory does not grow with the nodes.
        top = len(levels) - 1
        todo = [(top, np.arange(n), np.repeat(np.arange(len(first)), size), np.zeros(n, np.int64))]  # the top's shared bits agree
        while todo:
            depth, query, node, diff = todo.pop()
            if not len(query):
                continue
            if depth == 0:
                forest.join(query, node)
                continue
            begin, end = levels[depth][0][node], ends[depth - 1][node]
            count = end - begin
            fit = max(1, int(np.searchsorted(np.cumsum(count), FRONTIER, side="right")))
            if fit < len(query):
                todo.append((depth, query[fit:], node[fit:], diff[fit:]))
                query, node, diff, begin, count = query[:fit], node[:fit], diff[:fit], begin[:fit], count[:fit]
            child = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
            q, parent, acc = np.repeat(query, count), np.repeat(node, count), np.repeat(diff, count)
            later = last[depth - 1][child] > q
            child, q, parent, acc = child[later], q[later], parent[later], acc[later]
            _, value, shared = levels[depth - 1]
            fresh = shared[child] & ~levels[depth][2][parent]
            acc = acc + np.bitwise_count((code[q] ^ value[child]) & fresh)
            near = acc <= max_bits
            todo.append((depth - 1, q[near], child[near], acc[near]))
    moved = np.flatnonzero(forest.root != np.arange(n))
    return code[moved], code[forest.root[moved]]


def _link_batches(max_bits: int):
    def run(batches):
        keys, codes, held = [], [], 0

        def flush(all_of_it: bool):
            nonlocal keys, codes, held
            key, code = np.concatenate(keys), np.concatenate(codes)
            cut = len(key) if all_of_it else int(np.searchsorted(key, key[-1]))
            keys, codes, held = [key[cut:]], [code[cut:]], len(key) - cut
            a, b = linked(key[:cut], code[:cut].view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

        for batch in batches:  # sorted by key
            keys.append(batch.column(0).to_numpy())
            codes.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held >= ROWS_AT_ONCE:
                yield flush(False)
        if held:
            yield flush(True)
    return run


def links(codes: DataFrame, max_bits: int = 3, limit: int = LIMIT) -> DataFrame:
    """Links (u, v) that join all fingerprints of ``codes`` (column fp, each
    once) within ``max_bits`` bits of each other, directly or through others
    that are."""
    parts, everything = max_bits + 1, (1 << 64) - 1
    masks = [everything]  # bits still free, by path
    level = codes.select("fp", F.lit(0).alias("path"), F.lit(0).cast("long").alias("key"))
    cells = []
    for _ in range(3):
        pieces = [split_mask(m, parts) for m in masks]
        table = F.array(*[F.lit(_signed(p)) for ps in pieces for p in ps])
        masks = [m & ~p for m, ps in zip(masks, pieces) for p in ps]
        level = level.withColumn("path", F.explode(F.sequence(F.col("path") * parts, F.col("path") * parts + parts - 1)))
        level = level.withColumn("key", F.xxhash64("key", "path", F.col("fp").bitwiseAND(F.get(table, F.col("path")))))
        hot = stored(level.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit))
        n_hot = hot.count()
        if n_hot == 0:
            cells.append(level)
            level = None
            break
        # Few upper nodes are this large; with more than a bounded number of
        # them the planner joins by shuffle.
        small = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        cells.append(level.join(small, "key", "left_anti"))
        level, last = level.join(small, "key", "left_semi"), (level, small)
    if level is not None:
        # Bits that fewer masks than these tell apart: a grid of cells, in
        # which every two fingerprints of the node meet once.
        rows, small = last
        side = F.ceil(F.col("n") / limit)
        mine = F.pmod(F.xxhash64("fp", F.lit("cell")), F.col("side"))
        level = rows.join(small, "key").withColumn("side", side).withColumn("mine", mine) \
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("side") - 1)))
        cells.append(level.select("fp", "path", F.xxhash64(
            "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key")))
    out = cells[0].select("key", "fp")
    for c in cells[1:]:
        out = out.unionByName(c.select("key", "fp"))
    return out.repartition("key").sortWithinPartitions("key").mapInArrow(_link_batches(max_bits), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fingerprint, component_id): one row for each document.

    ``component_id`` is the smallest id whose document can be reached over
    links; ``text_key`` a hash of the text, to tell documents of one id apart.
    """
    fps = stored(fingerprints(docs, width, id_col, text_col))
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(nodes, max_bits))
    named = nodes.join(roots, nodes.fp == roots.u, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = named.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        "doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at 3 or fewer differing bits."""
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
