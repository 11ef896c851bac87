"""Quality classifier: supervised subword embeddings.

A document's words (runs between white space, case and punctuation kept) and their
character n-grams are hashed to ``BUCKETS`` learned vectors; a word that repeats the one before
it adds one vector for that. The document is the mean of all these vectors, a
softmax layer gives the two classes. Trained in numpy by stochastic gradients on at
most ``PER_CLASS`` labelled documents of each class (those with the smallest hash of
their id); a fifth of them is kept out to fit slope and offset of the scores, weighted to the
labelled share of the classes. Vectors start at zero, so unseen n-grams add nothing.

For scoring, vectors times output layer are one small table; each different word of a batch
is hashed once. Null and empty texts have no vector: their score is that of a mean of zero. Without
labels of both classes every score is the share of the class (0.5 without any). Rows that repeat an id
or a text are scored each by itself and alike, equal scores fall on the same side of a threshold, an
empty table gives an empty result, and a very long text is averaged whole. Other columns pass
through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wastelens.llm.common import every_fifth, labelled_sample, prepare, read, text_of

BUCKETS = 1 << 18
AGAIN = BUCKETS  # the vector of a repeated word
SIZES = (3, 4, 5)
DIM = 8
PER_CLASS = 1500
EPOCHS = 4
BATCH = 32
DOCS_AT_ONCE = 1000
BEGIN, END = 0xE000, 0xE001  # stand around a word

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
               0x85EBCA77C2B2AE63], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= _K[1]
    h ^= h >> np.uint64(32)
    return h


def _bucket(h: np.ndarray) -> np.ndarray:
    return (_mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64)


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): of each word its own bucket and those of its n-grams."""
    n = len(words)
    chars = np.asarray(pc.utf8_length(words)).astype(np.int64)
    size = chars + 2
    first = np.cumsum(size) - size
    c = np.zeros(int(size.sum()), np.uint64)
    inside = np.ones(len(c), bool)
    inside[first] = inside[first + size - 1] = False
    c[inside] = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    c[first], c[first + size - 1] = BEGIN, END
    word = np.repeat(np.arange(n), size)
    place = (np.arange(len(c)) - first[word]).astype(np.uint64)
    whole = np.add.reduceat(_mix(c * _K[0] + place * _K[2]), first) if n else np.zeros(0, np.uint64)
    buckets, owners = [_bucket(whole + _K[4])], [np.arange(n)]
    for k in SIZES:
        if len(c) < k:
            continue
        m = len(c) - k + 1
        h = np.full(m, k, np.uint64)
        for j in range(k):
            h = (h ^ c[j:j + m]) * _K[j % len(_K)]
            h ^= h >> np.uint64(27)
        ok = word[:m] == word[k - 1:]
        buckets.append(_bucket(h)[ok])
        owners.append(word[:m][ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order], np.append(0, np.cumsum(np.bincount(owner, minlength=n)))


class Words:
    """Texts as codes of their different words: ``code`` (one for each word), ``offsets``
    by text, ``repeats`` (words equal to the one before), and the words' buckets."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        flat = lists.values.dictionary_encode()
        code = flat.indices.to_numpy().astype(np.int64)
        off = lists.offsets.to_numpy().astype(np.int64)
        text = np.repeat(np.arange(len(texts)), np.diff(off))
        real = np.asarray(pc.utf8_length(flat.dictionary)).astype(np.int64)[code] > 0 if len(code) else np.zeros(0, bool)
        self.code, text = code[real], text[real]
        self.offsets = np.searchsorted(text, np.arange(len(texts) + 1))
        again = np.append(False, (self.code[1:] == self.code[:-1]) & (text[1:] == text[:-1]))[:len(text)]
        self.repeats = np.bincount(text[again], minlength=len(texts))
        self.buckets, self.bucket_offsets = word_features(flat.dictionary)
        self.n_features = np.diff(self.bucket_offsets)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of ``values`` (one row for each different word) over each text."""
        total = np.cumsum(np.concatenate([np.zeros((1, values.shape[1])), values[self.code]]), axis=0, dtype=np.float64)
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def counts(self) -> np.ndarray:
        """Number of vectors of each text."""
        return self.sums(self.n_features[:, None].astype(float))[:, 0] + self.repeats


def _by_word(rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows; every word has at least one."""
    return np.add.reduceat(rows, offsets[:-1], axis=0) if len(offsets) > 1 else np.zeros((0, rows.shape[1]))


@dataclass
class Model:
    table: np.ndarray  # (BUCKETS + 1, 2): vectors times output layer
    bias: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, texts: pa.Array) -> np.ndarray:
        """Class 1 minus class 0, before slope and offset."""
        w = Words(texts)
        logits = w.sums(_by_word(self.table[w.buckets], w.bucket_offsets).astype(np.float64)) \
            + w.repeats[:, None] * self.table[AGAIN]
        logits = logits / np.maximum(w.counts(), 1)[:, None] + self.bias
        return logits[:, 1] - logits[:, 0]

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(texts) + self.shift, -30, 30)))


def train(texts: pa.Array, y: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(table, bias) by stochastic gradients (rates by Adagrad) on softmax cross-entropy."""
    rng = np.random.default_rng(seed)
    w = Words(texts)
    vectors = np.zeros((BUCKETS + 1, DIM), np.float32)
    squares = np.full(BUCKETS + 1, 1e-8, np.float32)
    out = rng.normal(0, 1, (DIM, 2))
    bias = np.zeros(2)
    count = np.maximum(w.counts(), 1)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            some = order[lo:lo + BATCH]
            n = np.diff(w.offsets)[some]
            codes = np.concatenate([w.code[w.offsets[i]:w.offsets[i + 1]] for i in some])
            doc = np.repeat(np.arange(len(some)), n)
            used, local = np.unique(codes, return_inverse=True)
            nf = w.n_features[used]
            ends = np.cumsum(nf)
            feats = w.buckets[np.arange(ends[-1] if len(ends) else 0) + np.repeat(w.bucket_offsets[used] - (ends - nf), nf)]
            word = np.repeat(np.arange(len(used)), nf)
            word_vec = np.stack([np.bincount(word, vectors[feats, d], len(used)) for d in range(DIM)], axis=1)
            # Words of a text by how often it holds them.
            pair, times = np.unique(doc * max(len(used), 1) + local, return_counts=True)
            p_doc, p_word = pair // max(len(used), 1), pair % max(len(used), 1)
            sums = np.stack([np.bincount(p_doc, word_vec[p_word, d] * times, len(some)) for d in range(DIM)], axis=1)
            mean = (sums + w.repeats[some][:, None] * vectors[AGAIN]) / count[some][:, None]
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            g = p / len(some)
            g_mean = g @ out.T / count[some][:, None]
            g_word = np.stack([np.bincount(p_word, g_mean[p_doc, d] * times, len(used)) for d in range(DIM)], axis=1)
            hit, back = np.unique(feats, return_inverse=True)
            g_feat = np.stack([np.bincount(back, g_word[word, d], len(hit)) for d in range(DIM)], axis=1)
            hit = np.append(hit, AGAIN)
            g_feat = np.vstack([g_feat, (g_mean * w.repeats[some][:, None]).sum(axis=0)])
            squares[hit] += (g_feat ** 2).mean(axis=1)
            vectors[hit] -= (0.5 * g_feat / np.sqrt(squares[hit])[:, None]).astype(np.float32)
            out -= 0.2 * (mean.T @ g)
            bias -= 0.2 * g.sum(axis=0)
    return (vectors @ out).astype(np.float32), bias


def fit_slope(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic regression of y on the margin (Newton steps, lightly damped)."""
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    b = np.zeros(2)
    damp = np.diag([1e-3, 1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (y - p)) - damp @ b
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + damp
        step = np.linalg.solve(hess, grad)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, per_class: int = PER_CLASS,
        label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Trains on at most ``per_class`` labelled documents of each class; ``learn`` is a
    condition on ``_id`` for the labels that may be used."""
    learn = F.lit(True) if learn is None else learn
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where(learn)
    n = known.agg(F.count("_y").alias("n"), F.sum("_y").alias("ones")).first()
    share = min(max((n["ones"] or 0) / n["n"], 1e-4), 1 - 1e-4) if n["n"] else 0.5
    plain = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = labelled_sample(plain, labels.select(F.col(id_col).alias("id"), label), label, learn, per_class, "quality", "id").select(
        F.col("id").alias("_id"), "text", "_y").toArrow().sort_by("_id")
    texts = rows.column("text").combine_chunks()
    y = rows.column("_y").to_numpy().astype(np.int64)
    held = every_fifth(y)
    if not len(y) or len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        return Model(np.zeros((BUCKETS + 1, 2), np.float32), np.zeros(2), 0.0, float(np.log(share / (1 - share))))
    model = Model(*train(texts.filter(pa.array(~held)), y[~held]))
    margin, yy = model.margin(texts.filter(pa.array(held))), y[held]
    weight = np.where(yy == 1, share / yy.mean(), (1 - share) / (1 - yy.mean()))
    model.slope, model.shift = fit_slope(margin, yy, weight)
    return model


def _score_batches(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            parts = [model.scores(b.column(b.num_columns - 1).slice(at, DOCS_AT_ONCE))
                     for at in range(0, b.num_rows, DOCS_AT_ONCE)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(np.concatenate(parts) if parts else np.zeros(0))],
                [*b.schema.names[:-1], "_score"])
    return run


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``_score``, the probability of label 1."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by BUCKETS
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], "_score double"])
    return docs.select(*[f"`{k}`" for k in keep], text_of(text_col).alias("_text")).mapInArrow(_score_batches(shared), schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labels outside the held-out fold."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")

    def fold(c):
        return F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(5)) == 0
    model = fit(docs, labels, ~fold("_id"))
    return score(docs, model, ["doc_id"]).select(
        "doc_id", F.coalesce(fold("doc_id"), F.lit(False)).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.3).cast("int").alias("predicted"))
