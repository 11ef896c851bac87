"""Suffix-array removal of repeated passages.

A byte goes if a ``RUN``-byte string that covers it also starts in a document
with a smaller id. Strings never cross documents and are judged on the input.

Which suffixes are sorted: each ``RUN``-byte string names one byte offset in
itself, its *anchor* (the gram of ``GRAM`` bytes with the smallest hash; the
first of equal ones). The anchor depends on the string's bytes alone, so equal
strings have the same anchor, and one anchor serves about 18 strings in a
row. The sparse suffix array holds the suffixes that start at anchors, each
with the few bytes before it that its strings need.

Documents are dealt into chunks of about ``CHUNK_BYTES`` by a hash of id and
text; all steps that need texts read them from that one exchange.

1. Only grams that occur in two documents can matter. Each chunk sends 32 bits of
   each of its grams' hashes to the place that the rest of the hash names and
   gets a bit back: seen in another chunk or not. Strings whose anchor
   occurs once are dropped, so most unique text is not sent anywhere.
2. Splitters are taken from a bounded sample of anchors' leading bytes and cut the
   order of suffixes into buckets of about ``BUCKET_BYTES`` of text each.
3. A chunk sends its suffixes to their buckets, packed and compressed; of
   equal ones only those of the smallest id travel, the others are done.
4. A bucket sorts its suffixes by multikey quicksort (eight bytes at a time, only
   ties go on) and compares neighbours; the longest common prefix tells which
   strings can be repeated at all. These are compared exactly.
5. Equal strings share their anchor's gram, so they meet in one bucket. A gram so
   frequent that it fills several buckets is dealt out among them; each then
   passes on the single strings it found no smaller id for, by a hash of the
   string's bytes, and equal ones from several buckets are compared in a second
   round. No place of it grows with the gram: of a string that many documents
   share each bucket has settled all but those of its smallest id.

Rows with a null id are left whole and are no source; null texts are empty; rows
of one id with different texts (told apart by a 64-bit hash, the text's key) have runs
of their own and are no source for each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wastelens.llm.common import hash_share, prepare, read, stored, text_of

RUN = 50
GRAM = 16
SPREAD = RUN - GRAM  # an anchor lies 0..SPREAD bytes into its string
WIDTH = RUN + SPREAD  # bytes that an anchor's strings can reach over
ROW = WIDTH + 8 - WIDTH % 8
BUCKET_BYTES = 8 << 20
CHUNK_BYTES = 4 << 20
SEGMENT = 1 << 20  # bytes of text looked at together
WINDOWS = 1 << 18  # strings compared together
SAMPLE_DOCS = 2000
KEYS_A_DOC = 64
ROWS_A_CHUNK = 50_000
COPIES = 1000  # rows of one id and text from which they are worked on once
FEW_HOT = 100_000  # such ids and texts that are broadcast
PLACES = 4  # places of the second round for each bucket of the first

_U = np.uint64
_C = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                      0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                      0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> _U(29)
    h *= _C[2]
    h ^= h >> _U(32)
    return h


def _words(buf) -> np.ndarray:
    """The eight bytes from every offset on, as little-endian numbers."""
    raw = np.frombuffer(buf, np.uint8) if not isinstance(buf, np.ndarray) else buf.reshape(-1)
    return np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,)) if len(raw) > 7 else np.zeros(0, "<u8")


# ----------------------------------------------------------------- anchors
def anchors(buf: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the texts that end at ``ends`` in ``buf``: where each string starts, and its anchor."""
    n = len(buf) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    w = _words(buf)
    grams = n + SPREAD
    h = w[:grams] * _C[0]
    h ^= (w[8:8 + grams] * _C[1]) >> _U(7)
    h += w[8:8 + grams] * _C[3]
    h = _mix(h)
    low = _U((1 << 24) - 1)
    h &= ~low
    h |= np.arange(grams, dtype=_U)
    size = 1
    while 2 * size <= SPREAD + 1:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = SPREAD + 1 - size
    least = np.minimum(h[:n], h[rest:rest + n]) if rest else h[:n]
    at = (least & low).astype(np.int32)
    # Strings that cross a text's end are none.
    q = np.arange(n, dtype=np.int32)
    which = np.searchsorted(ends, q, side="right")
    ok = q + RUN <= ends[np.minimum(which, len(ends) - 1)]
    ok &= which < len(ends)
    return q[ok], at[ok]


def distinct(at: np.ndarray) -> np.ndarray:
    """Anchors in the order of the text, each once (``at`` never falls)."""
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    return at[new]


def gram_hash(buf: bytes, at: np.ndarray) -> np.ndarray:
    """Hash of the gram at each anchor, unlike the one that chose it."""
    w = _words(buf)
    h = w[at] * _C[4]
    h ^= h >> _U(31)
    h += w[at + 8] * _C[5]
    return _mix(h)


class Suffixes:
    """Suffixes at anchors: id and text's key of the document, offset of the first
    string, number of strings, anchor's distance from the first, and their bytes."""

    FIELDS = (("doc", "<i8"), ("key", "<i8"), ("pos", "<i8"), ("m", "<u1"), ("g", "<u1"))

    def __init__(self, doc, key, pos, m, g, mat):
        self.doc, self.key, self.pos, self.m, self.g, self.mat = doc, key, pos, m, g, mat

    def __len__(self):
        return len(self.doc)

    def take(self, idx) -> "Suffixes":
        return Suffixes(self.doc[idx], self.key[idx], self.pos[idx], self.m[idx], self.g[idx], self.mat[idx])

    @staticmethod
    def join(parts: list["Suffixes"]) -> "Suffixes":
        return Suffixes(*[np.concatenate([getattr(p, k) for p in parts])
                          for k in ("doc", "key", "pos", "m", "g", "mat")])

    def pack(self, zip_) -> bytes:
        used = np.arange(ROW) < (self.m.astype(np.int64) + RUN - 1)[:, None]
        parts = [np.int64(len(self)).tobytes()]
        parts += [np.ascontiguousarray(getattr(self, k), t).tobytes() for k, t in self.FIELDS]
        return zip_.compress(b"".join([*parts, self.mat[used].tobytes()]))

    def slim(self) -> "Suffixes":
        """With the used bytes only, one suffix after the other, as ``mat``."""
        used = np.arange(ROW) < (self.m.astype(np.int64) + RUN - 1)[:, None]
        return Suffixes(self.doc, self.key, self.pos, self.m, self.g, self.mat[used])

    def part(self, a: int, b: int, at: np.ndarray) -> "Suffixes":
        """Suffixes a..b of slim ones whose bytes start at ``at``."""
        m = self.m[a:b]
        mat = np.zeros((b - a, ROW), np.uint8)
        mat[np.arange(ROW) < (m.astype(np.int64) + RUN - 1)[:, None]] = self.mat[at[a]:at[b]]
        return Suffixes(self.doc[a:b], self.key[a:b], self.pos[a:b], m, self.g[a:b], mat)

    @staticmethod
    def unpack(blob: bytes, unzip) -> "Suffixes":
        raw = unzip.decompress(blob)
        n, at, cols = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
        for _, t in Suffixes.FIELDS:
            cols.append(np.frombuffer(raw, t, n, at))
            at += n * np.dtype(t).itemsize
        mat = np.zeros((n, ROW), np.uint8)
        used = np.arange(ROW) < (cols[3].astype(np.int64) + RUN - 1)[:, None]
        mat[used] = np.frombuffer(raw, np.uint8, -1, at)
        return Suffixes(*cols, mat)


class Segment:
    """Parts of texts looked at together: (id, text's key, part's offset, part)."""

    def __init__(self, parts: list[tuple[int, int, int, bytes]]):
        self.buf = b"".join(x[3] for x in parts)
        size = np.array([len(x[3]) for x in parts], np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.ids, self.keys, self.offsets = (np.array([x[i] for x in parts], np.int64) for i in range(3))
        self.q, self.at = anchors(self.buf, self.ends)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each anchor's gram, and its document's id."""
        at = distinct(self.at)
        return gram_hash(self.buf, at), self.ids[np.searchsorted(self.ends, at, side="right")]

    def suffixes(self, shared: np.ndarray | None = None) -> Suffixes:
        """The suffixes; ``shared`` tells of each anchor whether its gram occurs in two documents."""
        q, at = self.q, self.at
        if shared is not None:
            ok = shared[np.cumsum(np.append(False, at[1:] != at[:-1]))] if len(at) else np.zeros(0, bool)
            q, at = q[ok], at[ok]
        new = np.flatnonzero(np.append(len(q) > 0, (at[1:] != at[:-1]) | (q[1:] != q[:-1] + 1)))
        first, m, g = q[new], np.diff(np.append(new, len(q))), at[new] - q[new]
        raw = np.zeros(len(self.buf) + ROW, np.uint8)
        raw[:len(self.buf)] = np.frombuffer(self.buf, np.uint8)
        mat = np.lib.stride_tricks.sliding_window_view(raw, ROW)[first]
        mat[np.arange(ROW) >= (m + RUN - 1)[:, None]] = 0
        k = np.searchsorted(self.ends, first, side="right")
        return Suffixes(self.ids[k], self.keys[k], first - self.starts[k] + self.offsets[k],
                        m.astype(np.uint8), g.astype(np.uint8), mat)


def segments_of(docs):
    """About SEGMENT bytes of text at a time; long texts in parts that overlap by a string.
    ``docs``: (id, text) or (id, text, text's key)."""
    some, held = [], 0
    for doc, text, *key in docs:
        for at in range(0, max(len(text) - RUN + 1, 0) if doc is not None else 0, SEGMENT):
            some.append((doc, key[0] if key else 0, at, text[at:at + SEGMENT + RUN - 1]))
            held += len(some[-1][3])
            if held >= SEGMENT:
                yield Segment(some)
                some, held = [], 0
    if some:
        yield Segment(some)


def suffixes_of(docs) -> Suffixes:
    """All suffixes of a few documents."""
    out = [s.suffixes() for s in segments_of(docs)]
    return Suffixes.join(out) if out else Suffixes(
        *[np.zeros(0, t) for _, t in Suffixes.FIELDS], np.zeros((0, ROW), np.uint8))


def leading(s: Suffixes) -> np.ndarray:
    """The anchors' grams as two big-endian numbers, first and second half."""
    w = _words(s.mat)
    at = np.arange(len(s)) * ROW + s.g
    return np.stack([w[at].byteswap(), w[at + 8].byteswap()], axis=1)


def _grams(keys: np.ndarray) -> list[bytes]:
    raw = keys.astype(">u8").tobytes()
    return [raw[i:i + GRAM] for i in range(0, len(raw), GRAM)]


def bucket_of(keys: np.ndarray, splitters: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each gram among sorted ``splitters`` (repeats allowed), and
    whether the gram is dealt out among several buckets (by document)."""
    if not len(splitters):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    lo = np.searchsorted(splitters[:, 0], keys[:, 0], side="left")
    hi = np.searchsorted(splitters[:, 0], keys[:, 0], side="right")
    close = np.flatnonzero(lo != hi)
    if len(close):
        grams = _grams(splitters)
        for i, k in zip(close, _grams(keys[close])):
            lo[i], hi[i] = bisect_left(grams, k), bisect_right(grams, k)
    dealt = hi - lo > 1  # the gram is itself several splitters
    out = np.where(dealt, lo + 1 + doc % np.maximum(hi - lo, 1), hi)
    return out, dealt


# --------------------------------------------------------- sort and compare
def suffix_order(words: list[np.ndarray]) -> np.ndarray:
    """Multikey quicksort: by the first word, then ties by the next one, and so on."""
    order = np.argsort(words[0], kind="stable")
    group = np.cumsum(np.append(False, words[0][order][1:] != words[0][order][:-1]))
    for word in words[1:]:
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        idx, g = order[tied], group[tied]
        w = word[idx]
        by = np.lexsort((w, g))
        order[tied], w = idx[by], w[by]
        step = np.zeros(len(order), np.int64)
        step[tied[1:]] = (g[1:] == g[:-1]) & (w[1:] != w[:-1])
        group = group + np.cumsum(step)
    return order


def compare(s: Suffixes):
    """Repeated strings: (document, text's key, first byte, byte after the last)
    of runs of strings that also start in a document of a smaller id, and a
    mask of the suffixes with a string for which no smaller id is here."""
    runs, met = matches(s)
    return runs, met.sum(axis=1) < s.m


def matches(s: Suffixes):
    """The runs of ``compare``; for each suffix which of its strings are in them."""
    n = len(s)
    met = np.zeros((n, SPREAD + 1), bool)
    empty = [np.zeros(0, np.int64)] * 4
    if not n:
        return empty, met
    m, g = s.m.astype(np.int64), s.g.astype(np.int64)
    reach = m + RUN - 1 - g  # bytes known from the anchor on
    w = _words(np.append(s.mat.reshape(-1), np.zeros(64, np.uint8)))
    at = np.arange(n) * ROW + g
    words = []
    for k in range(7):
        x = w[at + 8 * k].byteswap()
        known = np.clip(reach - 8 * k, 0, 8).astype(_U)
        keep = np.where(known == 0, _U(0), ~_U(0) << ((_U(8) - np.maximum(known, _U(1))) * _U(8)))
        words.append(x & keep)
    order = suffix_order(words)
    # Longest common prefix of neighbours (or one byte more), not beyond what
    # the suffix knows itself; only a bound, the strings are compared below.
    lcp = np.zeros(n - 1, np.int64)
    same = np.ones(n - 1, bool)
    for x in words:
        if not same.any():
            break
        diff = x[order[1:]] ^ x[order[:-1]]
        equal = 8 - (np.frexp(diff.astype(np.float64))[1] + 7) // 8
        lcp += np.where(same, np.where(diff == 0, 8, np.maximum(equal, 0)), 0)
        same &= diff == 0
    lcp = np.minimum(lcp + 1, RUN)  # a rounded-up power of two may hide one byte
    full = order
    best = np.zeros(n, np.int64)
    best[full] = np.minimum(np.maximum(np.append(lcp, 0), np.append(0, lcp)), reach[full])
    # Strings of suffix i start 0 .. m-1 bytes after its first; string o needs RUN - (g - o) bytes after the anchor.
    count = np.clip(np.minimum(m, best - RUN + g + 1), 0, None)
    cuts = np.flatnonzero(np.append(True, lcp < GRAM))  # between different grams
    running = np.cumsum(count[full])
    out = [[], [], [], []]
    lo = 0
    while lo < n:
        # Whole grams, about WINDOWS strings at a time.
        target = (running[lo - 1] if lo else 0) + WINDOWS
        hi = int(np.searchsorted(running, target, side="right"))
        later = cuts[np.searchsorted(cuts, max(hi, lo + 1)):]
        hi = int(later[0]) if len(later) else n
        idx = full[lo:hi]
        lo = hi
        c = count[idx]
        idx, c = idx[c > 0], c[c > 0]
        if not len(idx):
            continue
        rec = np.repeat(idx, c)
        off = np.arange(len(rec)) - np.repeat(np.cumsum(c) - c, c)
        base = rec * ROW + off
        parts = [w[base + k] for k in (0, 8, 16, 24, 32, 40, 42)]
        h = np.zeros(len(rec), _U)
        for x, k in zip(parts, _C):
            h ^= (x * k) >> _U(31)
            h += x * k
        h = _mix(h)
        doc = s.doc[rec]
        by = np.lexsort((doc, h))
        first = np.flatnonzero(np.append(True, h[by][1:] != h[by][:-1]))
        head = by[np.repeat(first, np.diff(np.append(first, len(by))))]  # smallest id of the group
        gone = doc[by] > doc[head]
        for x in parts:
            gone &= x[by] == x[head]
        hit = np.zeros(len(rec), bool)
        hit[by] = gone
        met[rec[hit], off[hit]] = True
        a = np.flatnonzero(hit)
        if len(a):
            start = np.flatnonzero(np.append(True, (a[1:] != a[:-1] + 1) | (rec[a[1:]] != rec[a[:-1]])))
            stop = np.append(start[1:], len(a)) - 1
            i = rec[a[start]]
            for x, v in zip(out, (s.doc[i], s.key[i], s.pos[i] + off[a[start]], s.pos[i] + off[a[stop]] + RUN)):
                x.append(v)
    return ([np.concatenate(x) for x in out] if out[0] else empty), met


def singles(s: Suffixes, met: np.ndarray, places: int):
    """Strings that are not in ``met`` as suffixes of one string each: (place by
    a hash of the string, suffixes), from about WINDOWS strings at a time."""
    rec, off = np.nonzero(~met & (np.arange(SPREAD + 1) < s.m[:, None]))
    strings = np.lib.stride_tricks.sliding_window_view(s.mat, RUN, axis=1)
    for at in range(0, len(rec), WINDOWS):
        i, o = rec[at:at + WINDOWS], off[at:at + WINDOWS]
        mat = np.zeros((len(i), ROW), np.uint8)
        mat[:, :RUN] = strings[i, o]
        h = np.zeros(len(i), _U)
        for x, k in zip(mat.view("<u8").T, _C[4:]):
            h ^= (x * k) >> _U(31)
            h += x * k
        place = (_mix(h) % _U(places)).astype(np.int64)
        by = np.argsort(place, kind="stable")
        one = Suffixes(s.doc[i], s.key[i], s.pos[i] + o, np.ones(len(i), np.uint8), (s.g[i] - o).astype(np.uint8), mat)
        first = np.flatnonzero(np.append(True, place[by][1:] != place[by][:-1]))
        for a, b in zip(first, [*first[1:], len(by)]):
            yield int(place[by[a]]), one.take(by[a:b])


def fold(s: Suffixes):
    """Of suffixes with the same strings only those of the smallest id; the
    other's runs are done: (kept, runs as in ``compare``)."""
    n = len(s)
    words = s.mat.view("<u8")
    h = (s.m.astype(_U) << _U(8)) + s.g.astype(_U)
    for k in range(words.shape[1]):
        h ^= (words[:, k] * _C[k]) >> _U(31)
        h += words[:, k] * _C[k]
    h = _mix(h)
    by = np.lexsort((s.doc, h))
    first = np.flatnonzero(np.append(n > 0, h[by][1:] != h[by][:-1]))
    head = by[np.repeat(first, np.diff(np.append(first, n)))]
    gone = (s.doc[by] > s.doc[head]) & (s.m[by] == s.m[head]) & (s.g[by] == s.g[head])
    some = np.flatnonzero(gone)
    gone[some] = (words[by[some]] == words[head[some]]).all(axis=1)
    i = by[gone]
    keep = np.ones(n, bool)
    keep[i] = False
    return s.take(np.flatnonzero(keep)), [s.doc[i], s.key[i], s.pos[i], s.pos[i] + s.m[i] + RUN - 1]


# -------------------------------------------------------------- Spark tasks
# One row is a packed set of suffixes for a bucket, or a removed run (bucket -1).
PACKED = "bucket long, dealt boolean, blob binary, doc_id long, text_key long, span long"
_SCHEMA = pa.schema([("bucket", pa.int64()), ("dealt", pa.bool_()), ("blob", pa.binary()),
                     ("doc_id", pa.int64()), ("text_key", pa.int64()), ("span", pa.int64())])


def _run_rows(runs) -> pa.RecordBatch:
    doc, key, start, stop = runs
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, -1)), pa.array(np.zeros(n, bool)), pa.nulls(n, pa.binary()),
         pa.array(doc.astype(np.int64)), pa.array(key.astype(np.int64)),
         pa.array((start.astype(np.int64) << 32) | stop.astype(np.int64))], schema=_SCHEMA)


def _blob_rows(rows) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()),
         pa.array([r[2] for r in rows], pa.binary()), *[pa.nulls(n, pa.int64())] * 3], schema=_SCHEMA)


def _texts(table: pa.Table):
    """(id, bytes, text's key) of a chunk's documents, in an order that their content fixes."""
    ids, texts, keys = table.column("_id"), table.column("_bytes"), table.column("_key")
    rank = pc.sort_indices(pa.table({"i": ids, "n": pc.binary_length(texts), "t": texts}),
                           sort_keys=[("i", "ascending"), ("n", "ascending"), ("t", "ascending")]).to_numpy()
    for at in range(0, len(rank), 256):
        some = pa.array(rank[at:at + 256])
        yield from zip(ids.take(some).to_pylist(), texts.take(some).to_pylist(), keys.take(some).to_pylist())


class Grams:
    """The different grams of a chunk by place: sorted 32-bit values, and which
    of them two of the chunk's own documents hold."""

    def __init__(self, hashes: np.ndarray, docs: np.ndarray, places: int):
        place = (hashes >> _U(32)) % _U(places)
        key = (place << _U(32)) | (hashes & _U(0xFFFFFFFF))
        order = np.argsort(key, kind="stable")
        key, docs = key[order], docs[order]
        first = np.flatnonzero(np.append(len(key) > 0, key[1:] != key[:-1]))
        self.key = key[first]
        self.twice = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first) if len(first) else \
            np.zeros(0, bool)
        self.index = np.zeros(len(key), np.int64)
        self.index[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        at = (self.key >> _U(32)).astype(np.int64)
        cut = np.flatnonzero(np.append(len(at) > 0, at[1:] != at[:-1]))
        self.runs = {int(at[a]): (int(a), int(b)) for a, b in zip(cut, [*cut[1:], len(at)])}


def _chunk_grams(table: pa.Table, places: int) -> tuple[list[Segment], Grams]:
    segments = list(segments_of(_texts(table)))
    both = [s.grams() for s in segments]
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    hashes, docs = (np.concatenate(x) for x in zip(*(both or [none])))
    return segments, Grams(hashes, docs, places)


def _asker(places: int):
    """A chunk's grams, packed for each place."""

    def run(table: pa.Table) -> pa.Table:
        grams = _chunk_grams(table, places)[1]
        chunk = table.column("_chunk")[0].as_py()
        rows = [(k, grams.key[a:b].astype("<u4").tobytes()) for k, (a, b) in grams.runs.items()]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([chunk] * len(rows), pa.int64()),
                         pa.array([r[1] for r in rows], pa.binary())], ["place", "_chunk", "values"])
    return run


def _answer(table: pa.Table) -> pa.Table:
    """Of each chunk's grams at a place: a bit, whether another chunk has it too."""
    lists = [np.frombuffer(x.as_py(), "<u4") for x in table.column("values")]
    values = np.sort(np.concatenate(lists))
    many = np.unique(values[1:][values[1:] == values[:-1]])
    bits = []
    for x in lists:
        i = np.searchsorted(many, x)
        bits.append(np.packbits((many[np.minimum(i, len(many) - 1)] == x) if len(many) else np.zeros(len(x), bool)).tobytes())
    return pa.table([table.column("_chunk"), table.column("place"), pa.array(bits, pa.binary())], ["_chunk", "place", "bits"])


def _packer(splitters: np.ndarray, places: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        import zstandard

        if not table.num_rows:
            return _SCHEMA.empty_table()
        zip_ = zstandard.ZstdCompressor(level=3)
        segments, grams = _chunk_grams(table, places)
        shared = grams.twice.copy()
        for place, bits in zip(answers.column("place").to_pylist(), answers.column("bits").to_pylist()):
            a, b = grams.runs[place]
            shared[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        shared = shared[grams.index]
        held, at = [], 0
        for segment in segments:
            n = len(distinct(segment.at))
            s = segment.suffixes(shared[at:at + n])
            at += n
            bucket, dealt = bucket_of(leading(s), splitters, s.doc ^ (s.key >> 1))
            key = bucket * 2 + dealt
            by = np.argsort(key, kind="stable")
            key = key[by]
            s = s.take(by).slim()
            where = np.append(0, np.cumsum(s.m.astype(np.int64) + RUN - 1))
            first = np.flatnonzero(np.append(len(key) > 0, key[1:] != key[:-1])).tolist()
            held.append((s, where, {int(key[a]): (a, b) for a, b in zip(first, [*first[1:], len(key)])}))
        del segments
        # Per bucket, so that only the slim form is held for all of them.
        out = []
        for key in sorted({k for _, _, cuts in held for k in cuts}):
            s, runs = fold(Suffixes.join([s.part(*cuts[key], w) for s, w, cuts in held if key in cuts]))
            if len(runs[0]):
                out.append(_run_rows(runs))
            out.append(_blob_rows([(key // 2, bool(key % 2), s.pack(zip_))]))
        return pa.Table.from_batches(out, schema=_SCHEMA)
    return run


def _sorter(places: int):
    """Sorts and compares a bucket, and passes on the strings of dealt grams
    to ``places`` (0: nothing is passed on)."""

    def run(table: pa.Table) -> pa.Table:
        import zstandard

        unzip, zip_ = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        blobs = table.column("blob")
        s = Suffixes.join([Suffixes.unpack(b.as_py(), unzip) for b in blobs])
        dealt = bool(table.column("dealt")[0].as_py())
        runs, met = matches(s)
        out = [_run_rows(runs)]
        if dealt and places:
            out.append(_blob_rows([(place, True, x.pack(zip_)) for place, x in singles(s, met, places)]))
        return pa.Table.from_batches(out, schema=_SCHEMA)
    return run


def _sample_keys(batches):
    for b in batches:
        rows = []
        for doc, text in zip(*(c.to_pylist() for c in b.columns)):
            s = suffixes_of([(doc, text)])
            keys = leading(s)[:: max(1, len(s) // KEYS_A_DOC + 1)]
            rows.append(keys.astype(">u8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["keys"])


def choose_splitters(source: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Sorted grams that cut the suffixes into ``buckets``; a gram that fills
    several buckets appears that many times. From at most KEYS_A_DOC grams of
    each of about 2000 or 4 * buckets documents."""
    rate = min(1.0, max(SAMPLE_DOCS, 4 * buckets) / max(n, 1))
    if buckets == 1:
        return np.zeros((0, 2), np.uint64)
    # By id and text: an id with many rows passes no more of them than others do.
    rows = source.where(hash_share(F.xxhash64("_id", "_key"), "splitters") < rate).select("_id", "_bytes") \
        .mapInArrow(_sample_keys, "keys binary").collect()
    keys = sorted(r[0][i:i + GRAM] for r in rows for i in range(0, len(r[0]), GRAM))
    if not keys:
        return np.zeros((0, 2), np.uint64)
    picked = [keys[i * len(keys) // buckets] for i in range(1, buckets)]
    return np.frombuffer(b"".join(picked), ">u8").astype(np.uint64).reshape(-1, 2)


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _bytes, _key of the text, and the id with the other columns as _row if there are others) of ``docs``."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    return docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).cast("binary").alias("_bytes"),
                       F.xxhash64(text_of(text_col)).alias("_key"), *(
        [F.struct(F.col(id_col), *others).alias("_row")] if others else []))


def copies_apart(base: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows to work on, with ``_rep``, and the copies (if any) of ids and texts that more than ``COPIES`` rows
    repeat: of these one row each, marked ``_rep``, is worked on, and every copy gets its result
    by a join, so that they don't all meet in one chunk."""
    hot = stored(base.groupBy("_id", "_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COPIES)
                 .select(F.col("_id").alias("_hot"), F.col("_key").alias("_hot_key")))
    n = hot.count()
    if n == 0:
        return base.withColumn("_rep", F.lit(False)), None
    # One row in COPIES at most; past a bounded number the planner joins by shuffle.
    hot = F.broadcast(hot) if n <= FEW_HOT else hot
    same = F.col("_id").eqNullSafe(F.col("_hot")) & (F.col("_key") == F.col("_hot_key"))
    copies = base.join(hot, same, "left_semi")
    one = copies.groupBy("_id", "_key").agg(F.first("_bytes").alias("_bytes")).withColumn("_rep", F.lit(True))
    return base.join(hot, same, "left_anti").withColumn("_rep", F.lit(False)).unionByName(one, allowMissingColumns=True), copies


def chunked(base: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int, int, int]:
    """``base`` with ``_chunk``; number of rows; bytes of text; number of chunks."""
    n, size = base.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_bytes")), F.lit(0))).first()
    chunks = max(1, -(-size // chunk_bytes), -(-n // ROWS_A_CHUNK))
    return base.withColumn("_chunk", _chunk_of("_id", "_key", chunks)), n, size, chunks


def _chunk_of(id_col: str, key_col: str, chunks: int):
    return F.pmod(F.xxhash64(id_col, key_col), F.lit(chunks)).cast("long")


def repeated_runs(base: DataFrame, n: int, size: int, chunks: int, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(_chunk, doc_id, text_key, span): removed runs (first byte << 32 | byte after
    the last) of ``chunked`` documents, not merged."""
    prepare(base.sparkSession)
    buckets = max(1, -(-size // bucket_bytes))
    splitters = choose_splitters(base, n, buckets)
    asked = base.groupBy("_chunk").applyInArrow(_asker(buckets), "place long, _chunk long, values binary")
    answers = asked.groupBy("place").applyInArrow(_answer, "_chunk long, place long, bits binary")
    packed = base.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(_packer(splitters, buckets), PACKED)
    # Runs that a chunk has already settled travel as rows of their own groups.
    key = F.when(F.col("bucket") >= 0, F.col("bucket") * 2 + F.col("dealt").cast("long")) \
        .otherwise(-1 - F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(buckets)))
    found = packed.withColumn("key", key).groupBy("key").applyInArrow(_bucket_or_runs(PLACES * buckets), PACKED)
    if _first_slot(splitters):  # a gram is dealt out
        found = stored(found)
        again = found.where(F.col("bucket") >= 0).withColumn("key", F.col("bucket"))
        found = found.unionByName(again.groupBy("key").applyInArrow(_bucket_or_runs(0), PACKED))
    return found.where(F.col("bucket") < 0).select(
        _chunk_of("doc_id", "text_key", chunks).alias("_chunk"), "doc_id", "text_key", "span")


def _bucket_or_runs(places: int):
    sort = _sorter(places)

    def run(table: pa.Table) -> pa.Table:
        names = _SCHEMA.names
        return sort(table.select(names)) if table.column("bucket")[0].as_py() >= 0 else table.select(names).cast(_SCHEMA)
    return run


def _first_slot(splitters: np.ndarray) -> list[tuple[int, int]]:
    """For buckets among which one gram is dealt out: (bucket, the first of them)."""
    out, i = [], 0
    while i < len(splitters):
        j = i
        while j + 1 < len(splitters) and (splitters[j + 1] == splitters[i]).all():
            j += 1
        if j > i:
            out += [(k + 1, i + 1) for k in range(i, j + 1)]
        i = j + 1
    return out


def merge(spans) -> list[tuple[int, int]]:
    """Sorted runs without overlaps or gaps of zero between them."""
    out: list[tuple[int, int]] = []
    for x in sorted(spans):
        a, b = x >> 32, x & 0xFFFFFFFF
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def kept_pieces(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in runs:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def whole_characters(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the bytes of characters that they hold only in part."""
    out = []
    for a, b in runs:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _finisher(write):
    """Cogroups a chunk's documents with their runs; ``write(table, texts, runs)``
    makes the result."""

    def run(table: pa.Table, runs: pa.Table) -> pa.Table:
        doc, key, span = (runs.column(c).to_numpy() for c in ("doc_id", "text_key", "span"))
        by = np.lexsort((span, key, doc))
        doc, key, span = doc[by], key[by], span[by]
        cut = np.flatnonzero(np.append(len(doc) > 0, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
        own = {(int(doc[a]), int(key[a])): (a, b) for a, b in zip(cut, [*cut[1:], len(doc)])}

        def texts():
            for at in range(0, table.num_rows, 256):
                some = table.slice(at, 256)
                for i, t, k in zip(*(some.column(c).to_pylist() for c in ("_id", "_bytes", "_key"))):
                    a, b = own.get((i, k), (0, 0))
                    yield t, merge(span[a:b].tolist())
        return write(table, texts())
    return run


KEYS = ["_id", "_key", "_rep"]


def _digests(table: pa.Table, texts) -> pa.Table:
    rows = [(len(t), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_pieces(t, runs)).hexdigest())
            for t, runs in texts]
    cols = list(zip(*rows)) or [(), (), (), ()]
    return pa.table([*[table.column(c) for c in KEYS], *[pa.array(c, pa.int64()) for c in cols[:3]],
                     pa.array(cols[3], pa.string())], [*KEYS, "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _removed(table: pa.Table, texts) -> pa.Table:
    kept, removed = [], []
    for t, runs in texts:
        runs = whole_characters(t, runs)
        kept.append(kept_pieces(t, runs).decode("utf-8", "replace"))
        removed.append(sum(b - a for a, b in runs))
    return pa.table([*[table.column(c) for c in KEYS], table.column("_row"), pa.array(kept, pa.string()), pa.array(removed, pa.int64())],
                    [*KEYS, "row", "kept", "removed"])


def _finish(base: DataFrame, write, fields: list[T.StructField], own: list[str], chunk_bytes=None, bucket_bytes=None) -> DataFrame:
    """What ``write`` makes of each row of ``base``: ``own``, its own columns, and ``fields``, which its text decides."""
    work, copies = copies_apart(base)
    work, n, size, chunks = chunked(work, chunk_bytes or CHUNK_BYTES)
    runs = repeated_runs(work, n, size, chunks, bucket_bytes or BUCKET_BYTES)
    keys = [T.StructField("_id", T.LongType()), T.StructField("_key", T.LongType()), T.StructField("_rep", T.BooleanType())]
    rows = [T.StructField("row", base.schema["_row"].dataType)] if own == ["row"] else []
    out = work.groupBy("_chunk").cogroup(runs.groupBy("_chunk")).applyInArrow(_finisher(write), T.StructType([*keys, *rows, *fields]))
    names = [f.name for f in fields]
    result = out.where("not _rep").select(*own, *names)
    if copies is None:
        return result
    once = out.where("_rep").select(F.col("_id").alias("_of"), F.col("_key").alias("_of_key"), *names)
    mine = copies.select("_id", "_key", *([F.col("_row").alias("row")] if rows else []))
    return result.unionByName(mine.join(once, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_of_key")))
                              .select(*own, *names))


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int | None = None,
                   bucket_bytes: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    fields = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    return _finish(_plain(docs.select(id_col, text_col), id_col, text_col), _digests, [*fields, T.StructField("kept_sha256", T.StringType())],
                   ["_id"], chunk_bytes, bucket_bytes).withColumnRenamed("_id", "doc_id")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, kept, removed): all columns of ``docs`` but the text as a struct, the text
    that is left, and the number of bytes that went. Runs are cut to whole characters."""
    if set(docs.columns) == {id_col, text_col}:
        docs = docs.withColumn("_none", F.lit(None).cast("int"))
    fields = [T.StructField("kept", T.StringType()), T.StructField("removed", T.LongType())]
    return _finish(_plain(docs, id_col, text_col), _removed, fields, ["row"])


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of every document covered by 50-byte strings of smaller ids."""
    return repeat_digests(read(spark, sf_dir, "documents"))
