"""Best-fit packing by a configuration linear program.

Documents are tokenised, ended by id 0 and, if longer than a sequence, cut
into pieces (the first takes the remainder, the rest are full). How many
pieces of each length exist is a histogram of at most ``capacity`` entries.
On it the driver solves the configuration program

    minimise  sum_c x_c   so that   sum_c count(c, l) * x_c >= n_l  for each l

where a configuration c is a multiset of lengths that fits into a sequence.
Multiplicative weights price each length, a knapsack dynamic program finds the
best configurations at these prices, with or without waste, they are added
fractionally and the prices of covered lengths fall. The sum is rounded down, again and again
while that takes anything worth while; what rounding leaves, and where few pieces share a length that is most, is taken in whole
steps at the last prices and by best fit, longest first. Configurations with their
multiplicities, not sequences, are what the driver holds: their number does
not grow with the input.

Spark then deals the pieces of each length out to the configurations' places
by rank. Ranks are counted within (length, partition) and shifted by the
counts before them; a configuration takes a range of a length's ranks, and ranges and pieces are
joined by length and block of ranks, so a length that a third of all pieces share is no hot key
and a piece is compared with the few ranges of its block.

Null texts count as empty (one token: id 0). Repeated ids are rows like any
other. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wastelens.llm.common import prepare, read, stored, text_of

CAPACITY = 2048
DOCS_AT_ONCE = 4000
DEFAULT_TOKENIZER = "byte_bpe_50k"
NEAR = 0.005  # configurations this near to the best price count as best
RATE = 0.5
ROUND = 60  # steps of a round
WORTH = 0.2  # part of what is left that a round must take for another to follow
BLOCK = 256  # ranks of a length that are joined together

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- tokens
class ByteEncoder:
    """Token ids of whole texts by the byte-level vocabulary ``name``.

    ``tiktoken`` holds the same vocabulary as the ``tokenizers`` file and
    gives the same ids (tests compare them); a text with the special token's
    string goes to ``tokenizers`` itself. A blank before a non-blank always
    starts a new piece of the vocabulary's pre-tokeniser, and so does a line
    feed between non-blanks, so a batch's different words are encoded once each;
    texts with other runs of white space are encoded whole.
    """

    def __init__(self, name: str = DEFAULT_TOKENIZER):
        import public_tokenizers as P
        import tiktoken

        with open(P.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.json, self.exact = P.path(f"{name}.json"), None

    def whole(self, text: str) -> bytes:
        if "<|" not in text:
            return np.array(self.enc.encode_ordinary(text), "<u4").tobytes()
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.json)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        plain = [bool(t) and "<|" not in t and " ".join(t.split()) == t.replace("\n", " ") for t in texts]
        # Every word starts with the blank or the line feed before it; a text's
        # first word stands behind a line feed, whose one id is cut off.
        padded = pa.array([("\n" + t).replace("\n", " \n")[1:] for t, ok in zip(texts, plain) if ok], pa.large_string())
        if not len(padded):
            return [self.whole(t) for t in texts]
        words = pc.split_pattern(padded, " ")
        coded = words.values.dictionary_encode()
        joined = (" " + " ".join(coded.dictionary.to_pylist())).replace(" \n", "\n")
        ids = np.array(self.enc.encode_ordinary(joined), "<u4")
        raw = np.frombuffer(joined.encode(), np.uint8)
        before = np.cumsum(self.size[ids]) - self.size[ids]
        first = np.append(np.searchsorted(before, np.flatnonzero((raw == 32) | (raw == 10))), len(ids))
        code = coded.indices.to_numpy()
        count = np.diff(first)[code]
        ends = np.cumsum(count)
        flat = ids[np.repeat(first[code] - (ends - count), count) + np.arange(ends[-1])]
        stop = ends[words.offsets.to_numpy()[1:] - 1].tolist()
        done = iter([flat[i + 1:j].tobytes() for i, j in zip([0] + stop, stop)])
        return [next(done) if ok else self.whole(t) for t, ok in zip(texts, plain)]


def cut(ids: bytes, capacity: int = CAPACITY):
    """(piece, start, length, crc32) of a document's ids, id 0 included."""
    n = len(ids) // 4
    full = -(-n // capacity) - 1
    end = n - full * capacity
    start = 0
    for k in range(full + 1):
        yield k, start, end - start, zlib.crc32(ids[4 * start:4 * end])
        start, end = end, end + capacity


def piece_batches(name: str, capacity: int):
    def run(batches):
        enc = ByteEncoder(name)
        for b in batches:
            cols = [[], [], [], [], []]
            for at in range(0, b.num_rows, DOCS_AT_ONCE):
                some = b.slice(at, DOCS_AT_ONCE)
                for doc, ids in zip(some.column(0).to_pylist(), enc.ids(some.column(1).to_pylist())):
                    for row in cut(ids + b"\0\0\0\0", capacity):
                        for c, v in zip(cols, (doc, *row)):
                            c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


# --------------------------------------------------- configuration program
def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to ``capacity``: the highest price of a multiset of
    lengths that fits, and the length (index) to take first for it (-1: none)."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], taken[c] = best[c - 1], taken[c - 1]
        if k := fits[c]:
            value = best[c - lengths[:k]] + price[:k]
            j = int(value.argmax())
            if value[j] > best[c]:
                best[c], taken[c] = value[j], j
    return best, taken


def column(j: int, lengths: list[int], taken: list[int], capacity: int) -> tuple[dict[int, int], int]:
    """The best configuration that holds length ``j``, and the room it leaves."""
    out, c = {j: 1}, capacity - lengths[j]
    while c > 0 and (i := taken[c]) >= 0:
        out[i] = out.get(i, 0) + 1
        c -= lengths[i]
    return out, c


def fractional(lengths: np.ndarray, total: np.ndarray, capacity: int, steps: int):
    """Configurations (as sorted (index, count) pairs) with whole multiplicities that hold
    no length more often than ``total``; what they leave; the last prices; and a lower bound on sequences.

    A step runs the knapsack program at the prices, takes of the best configuration through
    each length those within ``NEAR`` of the best price, and adds them up to each
    length's number, waste or not. The price of a length then falls by exp(-rate * share
    added). The sum of a round's steps, scaled so that no length is held too often, is
    rounded down; the next round does the same with what is left.
    """
    as_list, plan, rest = lengths.tolist(), {}, total.copy()
    log_price, bound = np.log(lengths), float((lengths * total).sum() / capacity)
    while True:
        x: dict[tuple, float] = {}
        covered = np.zeros(len(lengths))
        for t in range(steps):
            if t == steps // 3:  # prices have settled; what was added before is left out
                x, covered = {}, np.zeros(len(lengths))
            log_price -= log_price.max(initial=-np.inf, where=rest > 0)
            price = np.where(rest > 0, np.exp(np.maximum(log_price, -40)), 0.0)
            best, taken = knapsack(lengths, price, capacity)
            # Prices over the best configuration's price are feasible for the dual program.
            if not plan:
                bound = max(bound, float((total * price).sum() / best[capacity]))
            near = (rest > 0) & (best[capacity - lengths] + price >= (1 - NEAR) * best[capacity])
            open_, taken = rest.astype(float), taken.tolist()
            least = (1 - NEAR) * best[capacity]
            for j in np.flatnonzero(near)[::-1].tolist():
                config = column(j, as_list, taken, capacity)[0]
                # A length of which nothing is open leaves the configuration, if that stays near.
                while open_[j] > 0:
                    kept = {i: k for i, k in config.items() if open_[i] > 0}
                    if len(kept) < len(config) and sum(price[i] * k for i, k in kept.items()) < least:
                        break
                    config, m = kept, min(open_[i] / k for i, k in kept.items())
                    key = tuple(sorted(config.items()))
                    x[key] = x.get(key, 0.0) + m
                    for i, k in config.items():
                        open_[i] = open_[i] - k * m if open_[i] > k * m * (1 + 1e-9) else 0.0
            share = np.where(rest > 0, 1 - open_ / np.maximum(rest, 1), 0.0)
            covered += share
            log_price -= RATE / (1 + t) ** 0.5 * share
        # The steps' sum holds each piece ``held`` times on average. Its share of a configuration is rounded
        # down, the largest first, as far as its lengths still have pieces.
        took, had = 0, int(rest.sum())
        held = float((covered * lengths * rest).sum() / max((lengths * rest).sum(), 1)) or 1.0
        for key, v in sorted(x.items(), key=lambda c: -c[1]):
            if (m := min([int(v / held), *(int(rest[i]) // k for i, k in key)])) > 0:
                plan[key] = plan.get(key, 0) + m
                for i, k in key:
                    rest[i] -= k * m
                    took += k * m
        if took <= WORTH * had:
            price = np.exp(np.clip(np.nan_to_num(log_price, nan=-40.0), -40, 0))
            return plan, rest, price, bound


def whole_steps(lengths, total, rest, base, capacity, steps, part, small):
    """(configurations, what is left) from which best fit needs the fewest sequences.

    Each step prices the lengths (``base`` times a weight that falls with the share
    already covered) and adds the best configuration through each length by
    ``part`` of what its scarcest length has left, at least one. Configurations
    without waste come first; when they add little, those within a share of the best
    price that doubles each time, until it spans all.
    """
    as_list, plan, rest = lengths.tolist(), {}, rest.copy()
    kept, slack, n = None, 0.0, 0

    def weigh():
        nonlocal kept
        tail = best_fit({ln: int(r) for ln, r in zip(as_list, rest) if r}, capacity)
        used = n + sum(m for _, m in tail)
        if kept is None or used < kept[0]:
            kept = used, dict(plan), tail

    weigh()
    for _ in range(steps):
        if rest.sum() <= small:
            break
        weight = np.where(rest > 0, (rest / total) ** 0.5, 0.0)
        price = base * weight
        best, taken = knapsack(lengths, price, capacity)
        value = best[capacity - lengths] + price
        taken, added = taken.tolist(), 0
        for j in range(len(as_list) - 1, -1, -1):
            if rest[j] == 0:
                continue
            config, waste = column(j, as_list, taken, capacity)
            if waste and (not slack or value[j] < (1 - slack) * best[capacity]):
                continue
            m = min(rest[i] // k for i, k in config.items())
            m = int(m if m <= 1 else max(1, m * part))
            if m > 0:
                key = tuple(sorted(config.items()))
                plan[key] = plan.get(key, 0) + m
                n += m
                for i, k in config.items():
                    rest[i] -= k * m
                    added += k * m
        if added <= 0.002 * rest.sum():
            weigh()
            if slack >= 1:
                break
            slack = 2 * slack or 0.001
    weigh()
    return kept


def solve(counts: dict[int, int], capacity: int = CAPACITY, steps: int = 200, part: float = 0.3,
          small: int = 0) -> list[tuple[dict[int, int], int]]:
    """Configurations {length: count} with multiplicities that hold every piece once.

    One way at every size: the fractional program, rounded down, without the configurations that waste
    much more than others; the remainder in whole steps at the program's
    last prices, which end at ``small`` pieces; ``best_fit`` for what they leave.
    """
    left = {ln: n for ln, n in counts.items() if n > 0}
    plan: list[tuple[dict[int, int], int]] = []
    if left.get(capacity):
        plan.append(({capacity: 1}, left.pop(capacity)))
    if not left:
        return plan
    lengths = np.array(sorted(left), np.int64)
    total = np.array([left[ln] for ln in lengths], np.int64)
    as_list = lengths.tolist()
    chosen, left_over, price, bound = fractional(lengths, total, capacity, ROUND)
    waste = {k: capacity - sum(as_list[i] * n for i, n in k) for k in chosen}
    # On average sequences waste this, by the solution itself, and this at least, by the lower bound.
    average = sum(waste[k] * m for k, m in chosen.items()) / max(sum(chosen.values()), 1)
    found = []
    for spare in (average, capacity - float((lengths * total).sum()) / bound):
        # Configurations that waste over twice as much go back.
        own, rest = {k: m for k, m in chosen.items() if waste[k] <= 2 * spare + 0.5}, left_over.copy()
        for key in chosen.keys() - own.keys():
            for i, n in key:
                rest[i] += n * chosen[key]
        used, more, tail = whole_steps(lengths, np.maximum(rest, 1), rest, price, capacity, steps, part, small)
        for key, m in more.items():
            own[key] = own.get(key, 0) + m
        found.append((sum(own.values()) + used - sum(more.values()), own, tail))
    _, own, tail = min(found, key=lambda f: f[0])
    return plan + [({as_list[i]: k for i, k in c}, m) for c, m in own.items()] + tail


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Longest first, each into the fullest sequences that still take it.

    Equal sequences are kept as one entry with a multiplicity, so the work
    depends on the lengths, not on how many pieces there are.
    """
    open_by_room: dict[int, list[list]] = {}
    rooms = np.zeros(capacity + 1, bool)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            fit = np.flatnonzero(rooms[length:])
            if len(fit):
                room = length + int(fit[0])
                entry = open_by_room[room].pop()
                if not open_by_room[room]:
                    rooms[room] = False
            else:
                room, entry = capacity, [{}, -(-n // (capacity // length))]
            config, m = entry
            each = min(room // length, -(-n // m)) if not config else 1
            use = min(m, n // each) if n >= each else 0
            if use == 0:
                each, use = n, 1
            if m > use:
                if config:
                    open_by_room.setdefault(room, []).append([config, m - use])
                    rooms[room] = True
            config = dict(config)
            config[length] = config.get(length, 0) + each
            n -= each * use
            rest = room - each * length
            open_by_room.setdefault(rest, []).append([config, use])
            rooms[rest] = True
    return [(c, m) for entries in open_by_room.values() for c, m in entries]


def places(plan: list[tuple[dict[int, int], int]]) -> list[tuple]:
    """For each length the ranks [lo, hi) that a configuration takes: (length, lo, hi, per
    sequence, first sequence, offset of the first)."""
    out, taken, sequence = [], {}, 0
    for config, m in plan:
        offset = 0
        for length in sorted(config, reverse=True):
            k = config[length]
            lo = taken.get(length, 0)
            taken[length] = lo + k * m
            out.append((length, lo, lo + k * m, k, sequence, offset))
            offset += k * length
        sequence += m
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    prepare(spark)
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")) \
        .mapInArrow(piece_batches(tokenizer, capacity), PIECES)
    pieces = stored(pieces.withColumn("part", F.spark_partition_id())
                    .withColumn("row", F.monotonically_increasing_id()))
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # Bounded: at most one row for each length up to the capacity.
    histogram = {int(r["length"]): int(r["n"]) for r in
                 counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = places(solve(histogram, capacity))
    table = spark.createDataFrame(rows, "length long, lo long, hi long, per long, sequence long, at long")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    ranked = pieces.withColumn("nth", F.row_number().over(Window.partitionBy("length", "part").orderBy("row"))) \
        .join(before.drop("n"), ["length", "part"]) \
        .withColumn("rank", F.col("before") + F.col("nth") - 1)
    block = F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor((F.col("hi") - 1) / BLOCK)))
    table = table.withColumnRenamed("length", "_length").withColumn("_block", block)
    inside = (F.col("length") == F.col("_length")) & (F.floor(F.col("rank") / BLOCK) == F.col("_block")) \
        & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    k = F.col("rank") - F.col("lo")
    return ranked.join(table, inside).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(k / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(k, F.col("per")) * F.col("length")).alias("offset"))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 2048 tokens."""
    return pack(read(spark, sf_dir, "documents"))
