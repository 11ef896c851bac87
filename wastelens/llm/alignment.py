"""Alignment of two tokenizers over a corpus.

Tokenizer A is a byte-level vocabulary applied to a blank and the text, B a piece vocabulary
applied to the text (it puts the blank there itself); special tokens' strings in a text
are ordinary text. Both token sequences cut the same bytes, and two tokens are linked
where their byte ranges overlap.

1. Tokens. Texts are cut before a blank or a line feed between characters that are no
   white space: neither vocabulary has tokens across such a place (checked when
   B's pieces are read), so each different stretch of a batch is encoded once and the token
   arrays of all documents are gathered from these.
2. Lockstep merging. One NumPy state vector holds the A and B pointers of all documents of a batch
   and advances them at the same time: each step links the tokens pointed at and moves the
   pointer whose token ends first, or both, which is a cut. Finished ones leave the
   vector. A document of more than ``LANE`` stretches takes several places of the vector, so that
   a very long one doesn't run on alone.
3. Counts. A document keeps how many of its links hold each pair of ids; these are
   written to the shared folder and summed over the corpus.
4. Each document's links look their counts up: pairs of at least a count that at most
   ``COMMON`` pairs reach are broadcast; the rest, if any, is joined by a shuffle of just
   those links. Both ways are exact.

Texts that are null or empty, or whose joined token bytes differ from a blank and the text
(U+2581 in a text, which B takes for a blank), have no tokens: zeros, and '' for the digest. Rows that repeat an id
or a text each give a row and count each time. Ties of a B id's highest count all count as best.
An empty table gives an empty result. Very long texts are whole lists of tokens of one row. Other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wastelens.llm.common import prepare, read, stored, text_of
from wastelens.session import ensure_checkpoint_dir

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k", "piece_bpe_32k"
LANE = 64  # stretches of one place of the state vector
AT_ONCE = 3 << 20  # bytes of texts aligned together; a longer text is alone
REMEMBERED = 1 << 18  # stretches a process keeps, or twice as many
LONG = 64  # bytes of a stretch that is kept
COMMON = 1 << 18  # pairs that may be broadcast

ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pair array<int>, times array<int>")


class TwoTokenizers:
    """Ids of both vocabularies for stretches of text, and the bytes of each id."""

    def __init__(self, name_a: str = TOKENIZER_A, name_b: str = TOKENIZER_B):
        import public_tokenizers as P
        import sentencepiece
        import tiktoken

        with open(P.path(f"{name_a}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding(name_a, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.b = sp = sentencepiece.SentencePieceProcessor(model_file=P.path(f"{name_b}.model"))
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.blank = sp.piece_to_id("▁")
        # Stretches are independent only if no piece goes on with a blank or holds a line feed.
        self.parts = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and sp.encode("\n")[:1] == [self.blank]
        self.size_a = np.array(list(map(len, self.bytes_a)), np.int64)
        self.size_b = np.array(list(map(len, self.bytes_b)), np.int64)
        self.spelled_b = np.frombuffer(b"".join(self.bytes_b), np.uint8)
        self.new: dict[bytes, tuple[bytes, bytes, bool]] = {}
        self.old: dict[bytes, tuple[bytes, bytes, bool]] = {}

    def encode(self, stretches: list[bytes]) -> list[tuple[bytes, bytes, bool]]:
        """A's and B's ids of each as 32-bit numbers, and whether both spell it."""
        texts = [s.decode("utf-8", "replace") for s in stretches]
        a = list(map(self.a.encode_ordinary, texts))
        # B puts a blank in front: it is the stretch's own, or none before a line feed.
        b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        b = [ids if t[0] == " " else ids[1:] for t, ids in zip(texts, b)]
        flat, at = zip(*((np.fromiter(chain.from_iterable(x), np.int32), running([len(ids) for ids in x])) for x in (a, b)))
        # What the pieces spell, beside the stretches. A's bytes are the text's by construction.
        raw = np.frombuffer(b"".join(stretches), np.uint8)
        own, spelled = running([len(s) for s in stretches]), ragged(self.spelled_b, running(self.size_b), flat[1].astype(np.int64))
        ends_a, ends_b = running(self.size_a[flat[0]])[at[0]], running(self.size_b[flat[1]])[at[1]]
        good = (np.diff(ends_a) == np.diff(own)) & (np.diff(ends_b) == np.diff(own))
        if len(spelled) == len(raw) and good.all():
            good &= np.diff(running(spelled != raw)[own]) == 0
        else:
            good &= [bool(g) and spelled[x:y].tobytes() == s for g, x, y, s in zip(good, ends_b, ends_b[1:], stretches)]
        good &= [t.isascii() or t.encode() == s for t, s in zip(texts, stretches)]
        ids = [x.tobytes() for x in flat]
        at = [(4 * x).tolist() for x in at]
        return [(ids[0][i:j], ids[1][k:m], g) for i, j, k, m, g in zip(at[0], at[0][1:], at[1], at[1][1:], good.tolist())]

    def ids(self, stretches: list[bytes]) -> list[tuple[bytes, bytes, bool]]:
        """:meth:`encode`, with the last ``REMEMBERED`` to twice as many kept."""
        old, new = self.old, self.new
        out = [new.get(s) or old.get(s) for s in stretches]
        missing = [k for k, got in enumerate(out) if got is None]
        for k, got in zip(missing, self.encode([stretches[k] for k in missing]) if missing else ()):
            out[k] = got
        if len(new) + len(out) > REMEMBERED:
            self.old, self.new = new, {}
        self.new.update((s, got) for s, got in zip(stretches, out) if len(s) <= LONG)
        return out


def stretch_starts(raw: np.ndarray, texts: np.ndarray, parts: bool = True) -> np.ndarray:
    """Where the stretches of joined UTF-8 texts begin: at each of ``texts`` (sorted places), and
    at a blank or line feed between characters that are surely no white space."""
    if not parts or len(raw) < 6:
        return texts
    p = np.flatnonzero((raw == 32) | (raw == 10))
    p = p[(p > 3) & (p < len(raw) - 1)]
    b1, b2, b3, b4, after = raw[p - 1], raw[p - 2], raw[p - 3], raw[p - 4], raw[p + 1]
    # White space beyond ASCII has the leads C2 and E1 to E3, so these are left out.
    before = ((b1 > 32) & (b1 < 127)) | ((b1 > 127) & (
        ((b2 > 0xC2) & (b2 < 0xE0)) | ((b3 > 0xE3) & (b3 < 0xF0) & (b2 > 127)) | ((b4 > 0xEF) & (b3 > 127) & (b2 > 127))))
    after = ((after > 32) & (after < 127)) | ((after > 0xC2) & (after < 0xE1)) | (after > 0xE3)
    starts = np.zeros(len(raw), bool)
    starts[texts] = starts[p[before & after]] = True
    return np.flatnonzero(starts)


def running(x) -> np.ndarray:
    """Running totals of whole numbers, from 0."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(np.asarray(x, np.int64))])


def ragged(values: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The slices ``values[starts[c]:starts[c + 1]]`` for each code, joined."""
    size = np.diff(starts)[codes]
    ends = np.cumsum(size)
    return values[np.repeat(starts[codes] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, i: np.ndarray, j: np.ndarray, stop: np.ndarray):
    """Links (indices of A and of B tokens) and flags of the tokens that end at a cut.

    ``i`` and ``j`` are the lanes' first A and B tokens, ``stop`` the A tokens behind their last; a
    lane's A and B tokens cover the same bytes, and ``end_a``, ``end_b`` say where tokens end.
    """
    links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cut_a, cut_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    live = i < stop
    i, j, stop = i[live], j[live], stop[live]
    while len(i):
        links_a.append(i)
        links_b.append(j)
        a, b = end_a[i], end_b[j]
        move_a, move_b = a <= b, b <= a
        both = move_a & move_b
        cut_a[i[both]] = True
        cut_b[j[both]] = True
        i, j = i + move_a, j + move_b
        live = i < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    return np.concatenate(links_a), np.concatenate(links_b), cut_a, cut_b


class Aligner:
    def __init__(self, name_a: str = TOKENIZER_A, name_b: str = TOKENIZER_B):
        self.two = TwoTokenizers(name_a, name_b)
        self.ids_b = len(self.two.bytes_b)
        # Token ids as text, followed by each separator: within a side, before B's side, behind a group.
        words = [[f"{i}{mark}" for i in range(max(len(self.two.bytes_a), self.ids_b))] for mark in ",|;"]
        self.base = len(words[0])
        self.words = pa.array([w for mark in words for w in mark], pa.large_string())

    def batch(self, texts: list[bytes]):
        """For each text (n_a, n_b, n_groups, n_links, digest), and per text the pairs of ids
        with the number of links that hold them (offsets, pairs, numbers)."""
        n = len(texts)
        kept = [k for k, t in enumerate(texts) if t]
        raw = np.frombuffer(b"".join(b" " + texts[k] for k in kept), np.uint8)
        size = np.array([len(texts[k]) + 1 for k in kept], np.int64)
        begin = running(size)
        starts = stretch_starts(raw, begin[:-1], self.two.parts)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        found = self.two.ids(coded.dictionary.to_pylist())
        flat, first = [], []
        for side in (0, 1):
            parts = [f[side] for f in found]
            flat.append(np.frombuffer(b"".join(parts), np.int32))
            first.append(running(list(map(len, parts))) // 4)
        good = np.array([f[2] for f in found], bool)
        # Texts that both vocabularies spell; of the others no token is used.
        bounds = np.searchsorted(starts, begin)
        wrong = running(~good[codes])
        spelled = np.diff(wrong[bounds]) == 0
        used = np.repeat(spelled, np.diff(bounds))
        codes = codes[used]
        bounds = running(np.where(spelled, np.diff(bounds), 0))
        doc = np.array(kept, np.int64)

        at, token, end = [], [], []
        for side, sizes in ((0, self.two.size_a), (1, self.two.size_b)):
            at.append(running(np.diff(first[side])[codes]))
            token.append(ragged(flat[side], first[side], codes))
            end.append(np.cumsum(sizes[token[side]]))
        # Lanes: at most LANE stretches of one text.
        lane = np.concatenate([np.zeros(0, np.int64)] + [np.arange(x, y, LANE) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
        behind = np.append(lane[1:], len(codes))
        links_a, links_b, cut_a, cut_b = lockstep(end[0], end[1], at[0][lane], at[1][lane], at[0][behind])

        edge_a, edge_b = at[0][bounds], at[1][bounds]
        out = {name: np.zeros(n, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
        out["n_a"][doc], out["n_b"][doc] = np.diff(edge_a), np.diff(edge_b)
        out["n_groups"][doc] = np.diff(running(cut_a)[edge_a])
        owner = np.repeat(doc, np.diff(edge_a))[links_a]
        out["n_links"] += np.bincount(owner, minlength=n)
        digest = [""] * n
        for k, d in zip(doc.tolist(), self._digests(token, cut_a, cut_b, edge_a + edge_b)):
            digest[k] = d
        key = owner << 32 | (token[0][links_a].astype(np.int64) * self.ids_b + token[1][links_b])
        key.sort()
        first = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
        key, times = key[first], np.diff(np.append(first, len(key)))
        offsets = np.searchsorted(key >> 32, np.arange(n + 1))
        return out, digest, (offsets, (key & 0xFFFFFFFF).astype(np.int32), times.astype(np.int32))

    def _digests(self, token, cut_a, cut_b, edge):
        """SHA-256 of each text's groups, ``a1,a2|b1;a3|b2``: both sides' ids are put in one
        sequence, group by group, and taken as text with the separator behind each."""
        n_a, n_b = len(cut_a), len(cut_b)
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        last_a, last_b = np.flatnonzero(cut_a) + 1, np.append(0, np.flatnonzero(cut_b) + 1)
        code = np.empty(n_a + n_b, np.int64)
        code[np.arange(n_a) + last_b[group_a]] = token[0] + self.base * cut_a
        code[np.arange(n_b) + (last_a[group_b] if n_b else 0)] = token[1] + 2 * self.base * cut_b
        text = pc.take(self.words, pa.array(code))
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data = memoryview(text.buffers()[2] or b"")
        edge = offsets[edge].tolist()
        return [hashlib.sha256(data[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(edge[:-1], edge[1:])]


_ALIGNERS: dict[tuple, Aligner] = {}  # a worker process reads the vocabularies once


def aligned_batches(name_a: str, name_b: str):
    def run(batches):
        key = name_a, name_b
        if key not in _ALIGNERS:
            _ALIGNERS[key] = Aligner(name_a, name_b)
        aligner = _ALIGNERS[key]
        for b in batches:
            size = b.column(2).to_numpy()
            at = 0
            while at < b.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(size[at:]), AT_ONCE, side="right")))
                some = b.slice(at, n)
                at += n
                numbers, digest, (offsets, pair, times) = aligner.batch(some.column(1).cast(pa.binary()).to_pylist())
                offsets = pa.array(offsets, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), *[pa.array(v) for v in numbers.values()], pa.array(digest),
                     pa.ListArray.from_arrays(offsets, pa.array(pair)), pa.ListArray.from_arrays(offsets, pa.array(times))],
                    ["doc_id", *numbers, "groups_sha256", "pair", "times"])
    return run


def align(docs: DataFrame, name_a: str = TOKENIZER_A, name_b: str = TOKENIZER_B, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its different
    linked pairs ``pair`` (A's id times B's number of ids, plus B's id) with their ``times``."""
    prepare(docs.sparkSession)
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("size")) \
        .mapInArrow(aligned_batches(name_a, name_b), ALIGNED)


def pair_counts(aligned: DataFrame, ids_b: int) -> DataFrame:
    """pair, n (links of the corpus that hold it), best (0 or 1: n is the highest of its B id)."""
    counts = stored(aligned.select(F.explode(F.arrays_zip("pair", "times")).alias("l"))
                    .groupBy(F.col("l.pair").alias("pair")).agg(F.sum("l.times").alias("n")))
    id_b = F.col("pair") % ids_b
    # At most one row for each id of B's vocabulary.
    highest = counts.groupBy(id_b.alias("id_b")).agg(F.max("n").alias("highest"))
    return counts.join(F.broadcast(highest), id_b == F.col("id_b")) \
        .select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best"))


def link_statistics(docs: DataFrame, name_a: str = TOKENIZER_A, name_b: str = TOKENIZER_B, common: int = COMMON,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    import public_tokenizers as P
    import sentencepiece

    ids_b = sentencepiece.SentencePieceProcessor(model_file=P.path(f"{name_b}.model")).get_piece_size()
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/aligned-{uuid.uuid4().hex}"
    align(docs, name_a, name_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()) \
        .write.option("compression", "zstd").parquet(folder)
    aligned = spark.read.parquet(folder)
    counts = stored(pair_counts(aligned, ids_b))
    # Pairs by the binary logarithm of their count: at most 64 rows.
    by_size = {int(r["e"]): int(r["pairs"]) for r in counts.groupBy(F.length(F.bin("n")).alias("e"))
               .agg(F.count(F.lit(1)).alias("pairs")).collect()}
    least, room = 64, common
    while least > 0 and by_size.get(least, 0) <= room:
        room -= by_size.get(least, 0)
        least -= 1
    often = F.length(F.bin("n")) > least
    links = aligned.select("row", F.explode(F.arrays_zip("pair", "times")).alias("l")) \
        .select("row", F.col("l.pair").alias("pair"), F.col("l.times").alias("times"))

    def sums(found: DataFrame) -> DataFrame:
        return found.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"),
                                        F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    hot = F.broadcast(counts.where(often))  # at most ``common`` rows
    total = sums(links.join(hot, "pair"))
    if sum(v for e, v in by_size.items() if e <= least):
        rare = sums(links.join(hot.select("pair"), "pair", "left_anti").join(counts.where(~often).hint("merge"), "pair"))
        total = total.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("pair", "times").join(total, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    """Links of byte_bpe_50k and piece_bpe_32k over all ``documents``."""
    return link_statistics(read(spark, sf_dir, "documents"))
