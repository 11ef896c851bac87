"""Token counts by byte-pair merging, without making token ids.

The texts' words are cut out of the Arrow buffer at once (a run of white space ends every
piece of the vocabulary's pre-tokeniser, so words are independent of each other), and
each different word of a batch is counted once: it is normalised and pre-tokenised, and a
piece of n initial symbols is a doubly linked list of n nodes beside a heap of its
adjacent pairs that have a merge rank. The pair of lowest rank (leftmost first) is popped again and again;
an entry whose nodes have changed meanwhile is passed over; a merge links the
left node to the node after the right one and pushes the two pairs it forms. A piece's
count is its initial symbols minus its merges, a text's the sum over its words. A piece of n
symbols takes O(n log n) steps, so a text of one very long word is no special case.

Special tokens' strings inside a text count one each, as the library counts them by
default. A process keeps the counts of the last ``REMEMBERED`` to twice as many words, and of as many
pieces, so memory stays bounded; longer ones than ``LONG`` bytes are not kept.

Null texts count as empty: no bytes, no tokens. Rows that repeat an id or a text each give
a row; nothing is ordered, so there are no ties but equal ranks, where the
leftmost pair is merged first. An empty table gives an empty result; other columns, whatever their names,
are not read. Bytes that are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wastelens.llm.common import prepare, read, text_of

LIMIT = 2048
DEFAULT_TOKENIZER = "word_bpe_49k"
REMEMBERED = 1 << 19
LONG = 64
#: Latin letters beyond ASCII that NFC leaves as they are and whose small letters stand among them.
LATIN = "ß-öø-įĳ-ȹȻ-Ƚȿ-ɏ"
LATIN_CAPITALS = "À-ÖØ-Þ"
POSITION = 40  # bits of a heap entry below the rank

COUNTS = "doc_id long, n_bytes long, n_tokens long"


class Remembered:
    """Counts by key, the ``most`` newest at least: when as many have come, the older ones go."""

    def __init__(self, count, most: int):
        self.count, self.most, self.new, self.old = count, most, {}, {}

    def __call__(self, key) -> int:
        n = self.new.get(key)
        if n is None:
            n = self.old.get(key)
            if n is None:
                n = self.count(key)
            if len(key) <= LONG:
                if len(self.new) >= self.most:
                    self.old, self.new = self.new, {}
                self.new[key] = n
        return n


class PairMerger:
    """Counts tokens by the byte-level vocabulary file ``name`` of ``public_tokenizers``."""

    def __init__(self, name: str = DEFAULT_TOKENIZER):
        import public_tokenizers as P
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        path = P.path(f"{name}.json")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        # The characters that stand for bytes are in the order of their code points, printable ones as themselves.
        letters = sorted(ByteLevel.alphabet())
        shown = [c for c in letters if ord(c) < 256]
        self.byte = {c: ord(c) for c in shown} | dict(zip(letters[len(shown):], sorted(set(range(256)) - set(map(ord, shown)))))
        char = {b: c for c, b in self.byte.items()}
        self.inner = [vocab.get(char[b], -1) for b in range(256)]
        self.last = [vocab.get(char[b] + suffix, -1) for b in range(256)]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[left] << 20 | vocab[right], r)
            self.made.append(vocab[left.removesuffix(suffix) + right if suffix else left + right])
        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.by_word = not self._pieces(" ")  # white space is dropped, so it parts words
        # What the file's normaliser and pre-tokeniser do to printable ASCII and common Latin letters, if they are the ones known here.
        known = self.by_word and self._pieces("It's 42 a-bÉß") == [x.encode() for x in ("it", "'s", "4", "2", "a", "-", "béß")]
        self.usual = re.compile(f"[!-~{LATIN_CAPITALS}{LATIN}]+") if known else None
        self.split = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[a-z{LATIN}]+|[0-9]|[^a-z0-9{LATIN}]+")
        self.pieces = Remembered(self.merged, REMEMBERED)
        self.words = Remembered(self.count, REMEMBERED)

    def _pieces(self, text: str) -> list[bytes]:
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        return [bytes(map(self.byte.__getitem__, p)) for p, _ in self.pre_tokenizer.pre_tokenize_str(text)]

    def merged(self, piece: bytes) -> int:
        """Tokens of one pre-tokenised piece: initial symbols minus merges."""
        node = [*map(self.inner.__getitem__, piece[:-1]), self.last[piece[-1]]]
        if -1 in node:
            node = [s for s in node if s >= 0]  # bytes the vocabulary lacks give nothing
        rank, n = self.rank, len(node)
        heap = [r << POSITION | i for i, r in enumerate(map(rank.get, [a << 20 | b for a, b in zip(node, node[1:])])) if r is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        after[n - 1] = -1
        made, pop, push, mask, merges = self.made, heapq.heappop, heapq.heappush, (1 << POSITION) - 1, 0
        while heap:
            entry = pop(heap)
            i = entry & mask
            j = after[i]
            left = node[i]
            if left < 0 or j < 0 or rank.get(left << 20 | node[j]) != entry >> POSITION:
                continue  # merged away, or another pair by now
            merges += 1
            node[i] = now = made[entry >> POSITION]
            node[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (s := rank.get(now << 20 | node[k])) is not None:
                    push(heap, s << POSITION | i)
            if (h := before[i]) >= 0 and (s := rank.get(node[h] << 20 | now)) is not None:
                push(heap, s << POSITION | h)
        return n - merges

    def _plain(self, text: str) -> int:
        if self.usual is not None and self.usual.fullmatch(text):
            return sum(map(self.pieces, [p.encode() for p in self.split.findall(text.lower())]))
        return sum(map(self.pieces, self._pieces(text)))

    def count(self, word: bytes) -> int:
        """Tokens of a word, or of any text."""
        text = word.decode("utf-8", "replace")
        if self.special is None or "<" not in text or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)  # odd places hold special tokens
        return sum(1 if k % 2 else self._plain(p) for k, p in enumerate(parts) if p)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, tokens) of each text of an Arrow array without nulls."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        size = np.diff(offsets)
        if not size.any():
            return size, np.zeros(len(texts), np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        if self.by_word:
            inside = (raw > 32) | (raw < 9) | ((raw > 13) & (raw < 32))
            first, last = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = offsets[:-1][size > 0]
            first[edge] = inside[edge]
            last[offsets[1:][size > 0] - 1] = inside[offsets[1:][size > 0] - 1]
            starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
            kept = raw[inside]
        else:  # pieces reach over white space: every text is one word
            starts, ends, kept = offsets[:-1][size > 0], offsets[1:][size > 0], raw
        bounds = np.append(0, np.cumsum(ends - starts))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(kept)]) \
            .dictionary_encode()
        n = np.array(list(map(self.words, words.dictionary.to_pylist())), np.int64)
        total = np.append(0, np.cumsum(n[words.indices.to_numpy()] if len(n) else n))
        return size, np.diff(total[np.searchsorted(starts, offsets)])


_MERGERS: dict[str, PairMerger] = {}  # a worker process reads a vocabulary once


def merger(name: str) -> PairMerger:
    if name not in _MERGERS:
        _MERGERS[name] = PairMerger(name)
    return _MERGERS[name]


def count_tokens(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, limit: int = LIMIT,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    One pass without a shuffle. ``tokenizer`` names a byte-level ``.json`` file of
    ``public_tokenizers``.
    """
    prepare(docs.sparkSession)

    def run(batches):
        m = merger(tokenizer)
        for b in batches:
            size, n = m.batch(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, COUNTS)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents`` by word_bpe_49k."""
    return count_tokens(read(spark, sf_dir, "documents"))
