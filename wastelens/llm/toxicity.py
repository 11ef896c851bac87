"""Toxicity: a convolutional text classifier over hashed word embeddings.

Words are runs of letters and digits in lower case. A word's vector is the sum of
two hashed, learned ones: that of the word and that of its first ``STEM``
letters, which it shares with other forms. Filters of the widths 1, 2 and 3 slide over the whole text; the largest
answer of each filter anywhere in the text goes through a logistic output.
Every labelled document that may be learned from is learned from, however long and however often its id
repeats. Words that ``MIN_TEXTS`` of them hold are counted by Spark. Training goes in ``ROUNDS``: the rows are
dealt over learners of about ``ROWS_A_LEARNER``, each goes on from the same parameters in numpy (classes
weighted alike, a part of the vectors left out at random in each step) over all of its rows, batch by batch, and Spark
averages what the learners moved: a word's vector over those that met it. The driver holds
parameters only, bounded by ``BUCKETS``. Sums are of whole units of ``1 / UNITS``, so they do not depend on their order. Vectors
start at zero, so a word never seen in training answers as no word at all. Scores are corrected from
classes weighted alike to the labelled share of the class.

Thresholds are calibrated by language on a fifth of the rows (by a hash of the id) kept out of
training: for each language with enough cases the threshold with the best F1 over all its kept rows, counted in steps
of ``1 / STEPS`` of the logit, else the one over all languages (0.5 if these have too few cases). Language
decides the threshold only, never the score.

Null and empty texts are scored as no word; a null or unknown language takes the
general threshold; without labels of both classes every score is the share of
the class (0.5 without any). Rows that repeat an id or a text are scored each by itself and alike; equal
scores fall on the same side of a threshold. An empty table gives an empty result, a very long
text is looked at whole. Other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wastelens.llm.common import hash_share, may_hold, prepare, read, stored, text_of, words_of

BUCKETS = 1 << 17  # of words, and as many of stems
STEM = 4
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8  # of each width
ROUNDS = 4
ROWS_A_LEARNER = 4096
MIN_STEPS = 500  # of all rounds, where one learner has too few rows for as many
UNITS = 1 << 32
STEPS = 100
DROP = 0.3  # of the vectors in a training step
BATCH = 32
ROWS_A_FILE = 1024
SPLIT = r"[^\p{L}\p{N}]+"
PAD = 2 * BUCKETS
CHUNK = 1 << 18  # words looked at together
MIN_CASES = 20
MIN_TEXTS = 2


def word_ids(text: Column) -> Column:
    """Buckets of the words and a margin of pads that no filter crosses, then as
    many buckets of their stems."""
    words = words_of(F.lower(text), SPLIT)
    pads = F.array_repeat(F.lit(PAD), max(WIDTHS))
    full = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    stem = F.transform(words, lambda w: (F.pmod(F.xxhash64(F.substring(w, 1, STEM), F.lit(STEM)), F.lit(BUCKETS))
                                         + BUCKETS).cast("int"))
    return F.concat(full, pads, stem, pads)


def both_halves(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(2, words) buckets of words and stems, and where each text starts."""
    n = np.diff(offsets) // 2
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[:-1] - (ends - n), n)
    return np.stack([ids[at], ids[at + np.repeat(n, n)]]), np.append(0, ends)


@dataclass
class Model:
    """``row``: bucket -> row of ``vectors`` (row 0: zero, for unseen words and pads)."""

    row: np.ndarray
    vectors: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: np.ndarray
    weight: np.ndarray
    shift: float

    def tables(self) -> list[np.ndarray]:
        """Answer of each filter's j-th place to each row."""
        return [np.ascontiguousarray(self.vectors @ f[j]) for f in self.filters for j in range(len(f))]

    def scores(self, ids: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Score of each text; text i has the ids offsets[i]:offsets[i + 1], as ``word_ids`` gives them."""
        n = len(offsets) - 1
        out = np.zeros(n)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1)
            pair, at = both_halves(ids[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            rows = self.row[pair]
            # Windows start at words or a text's first pad; later ones would reach into the next text.
            span = np.stack([at[:-1], at[1:] - (max(WIDTHS) - 1)], axis=1).ravel()
            best = np.concatenate([np.maximum.reduceat(z, span, axis=0)[::2] for z in _answers(rows, tables)], axis=1)
            out[lo:hi] = np.maximum(best + self.bias, 0) @ self.weight
            lo = hi
        return 1.0 / (1.0 + np.exp(-np.clip(out + self.shift, -30, 30)))


def _answers(rows: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
    """For each width, the filters' answers at each word (windows run on into the pads)."""
    out, k = [], 0
    for width in WIDTHS:
        z = tables[k][rows[0]] + tables[k][rows[1]]
        for j in range(1, width):
            t = tables[k + j]
            z[:-j] += t[rows[0, j:]] + t[rows[1, j:]]
        k += width
        out.append(z)
    return out


class Adam:
    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def __call__(self, x: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        x -= self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-8)


def new_model(known: np.ndarray, seed: int = 7) -> Model:
    """Untrained, for the buckets ``known``."""
    rng = np.random.default_rng(seed)
    row = np.zeros(PAD + 1, np.int32)
    row[known] = np.arange(1, len(known) + 1)
    n_out = FILTERS * len(WIDTHS)
    vectors = rng.normal(0, 0.01, (len(known) + 1, DIM)).astype(np.float32)
    vectors[0] = 0
    return Model(row, vectors, [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
                 np.full(n_out, 0.1), rng.normal(0, 0.5, n_out), 0.0)


def dense(model: Model) -> np.ndarray:
    """All parameters but the vectors, in rows of DIM."""
    flat = np.concatenate([*[f.ravel() for f in model.filters], model.bias, model.weight, [model.shift]]).astype(np.float64)
    return np.append(flat, np.zeros(-len(flat) % DIM)).reshape(-1, DIM)


def set_dense(model: Model, rows: np.ndarray) -> None:
    flat, at = rows.ravel(), 0
    for i, f in enumerate(model.filters):
        model.filters[i] = flat[at:at + f.size].reshape(f.shape).astype(np.float32)
        at += f.size
    n = len(model.bias)
    model.bias, model.weight, model.shift = flat[at:at + n].copy(), flat[at + n:at + 2 * n].copy(), float(flat[at + 2 * n])


def groups(order: np.ndarray, sizes: np.ndarray):
    """Runs of ``order`` of at most BATCH texts, and of at most CHUNK words where they are more than one text."""
    some, words = [], 0
    for i in order:
        if some and (len(some) == BATCH or words + sizes[i] > CHUNK):
            yield np.array(some)
            some, words = [], 0
        some.append(i)
        words += sizes[i]
    if some:
        yield np.array(some)


class Learner:
    """Goes on from ``model``, of which it keeps a copy, by stochastic gradients; ``weight`` is that of each class."""

    def __init__(self, model: Model, weight: tuple[float, float], rate: float, rng):
        self.old, self.rng, self.class_weight, self.rate = model, rng, np.array(weight), rate
        self.model = Model(model.row, model.vectors.copy(), [f.copy() for f in model.filters], model.bias.copy(),
                           model.weight.copy(), model.shift)
        self.met = np.zeros(len(model.vectors), bool)
        self.shift = np.array([model.shift])
        self.scale = 0.0
        n_out = len(model.bias)
        self.steps = [Adam(f.shape, 0.01 * rate) for f in model.filters]
        self.step_w, self.step_b, self.step_s = Adam(n_out, 0.02 * rate), Adam(n_out, 0.01 * rate), Adam(1, 0.02 * rate)

    def see(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        """One pass; ``texts`` are bucket arrays with their pads."""
        sizes = np.array([len(t) for t in texts])
        for some in groups(self.rng.permutation(len(texts)), sizes):
            self._step([self.model.row[texts[i].reshape(2, -1)] for i in some], y[some])

    def _step(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        model, vectors = self.model, self.model.vectors
        rows = np.concatenate(texts, axis=1)
        rows = np.where(self.rng.random(rows.shape) < DROP, 0, rows)
        at = np.cumsum([0, *[t.shape[1] for t in texts]])
        used, back = np.unique(rows, return_inverse=True)
        back = back.reshape(rows.shape)
        small = vectors[used]
        tables = [small @ f[j] for f in model.filters for j in range(len(f))]
        where, best = [], []
        for z in _answers(back, tables):
            top = np.stack([z[a:b - (max(WIDTHS) - 1)].argmax(axis=0) + a for a, b in zip(at, at[1:])])
            where.append(top)
            best.append(z[top, np.arange(FILTERS)])
        h = np.concatenate(best, axis=1) + model.bias
        a = np.maximum(h, 0)
        p = 1 / (1 + np.exp(-np.clip(a @ model.weight + self.shift, -30, 30)))
        d = self.class_weight[y] * (p - y) / len(texts)
        g_h = d[:, None] * model.weight * (h > 0)
        self.step_w(model.weight, a.T @ d + 1e-4 * model.weight)
        self.step_s(self.shift, np.array([d.sum()]))
        self.step_b(model.bias, g_h.sum(axis=0))
        g_rows = np.zeros(small.shape)
        for k, (f, top) in enumerate(zip(model.filters, where)):
            g = g_h[:, k * FILTERS:(k + 1) * FILTERS]
            g_f = np.zeros(f.shape)
            for j in range(len(f)):
                r = back[:, np.minimum(top + j, back.shape[1] - 1)]  # word and stem at the winning window's place j
                g_f[j] = np.einsum("bf,bfd->df", g, small[r].sum(axis=0))
                for half in r:
                    np.add.at(g_rows, half.ravel(), (g[:, :, None] * f[j].T[None]).reshape(-1, DIM))
            self.steps[k](f, g_f)
        # One rate for all vectors: what many texts share moves further than what one text holds.
        size = float((g_rows ** 2).mean(axis=1).max())
        self.scale = 0.99 * self.scale + 0.01 * size if self.scale else size
        vectors[used] -= (0.05 * self.rate * g_rows / max(self.scale, 1e-12) ** 0.5).astype(np.float32)
        vectors[0] = 0
        self.met[used] = True

    def moved(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, what it moved by): rows of the vectors it met, behind them those of :func:`dense`; in whole units."""
        self.model.shift = float(self.shift[0])
        self.met[0] = False
        met, n = np.flatnonzero(self.met), len(self.met)
        by = np.concatenate([self.model.vectors[met].astype(np.float64) - self.old.vectors[met], dense(self.model) - dense(self.old)])
        return np.append(met, np.arange(n, n + len(by) - len(met))), np.rint(by * UNITS).astype(np.int64)


def _cases(b: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    words = b.column("_words")
    flat, off = words.values.to_numpy(), words.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(off, off[1:])], b.column("_y").to_numpy().astype(np.int64)


def _count_words(batches):
    """(bucket, in how many texts of this task it stands)."""
    times = np.zeros(PAD + 1, np.int64)
    for b in batches:
        for t in _cases(b)[0]:
            times[np.unique(t)] += 1
    hit = np.flatnonzero(times)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(times[hit])], ["bucket", "times"])


def _learn(shared, k: int, passes: int):
    """One round: what each task's learner moved, as rows of (row, by)."""
    def run(batches):
        from pyspark import TaskContext

        model, weight = shared.value
        learner = Learner(model, weight, 1 / (1 + k), np.random.default_rng([7, k, TaskContext.get().partitionId()]))
        cases = [*map(_cases, batches)] if passes > 1 else map(_cases, batches)  # kept only where one learner has few rows
        n = 0
        for _ in range(passes):
            for texts, y in cases:
                learner.see(texts, y)
                n += len(y)
        if n:
            at, by = learner.moved()
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.FixedSizeListArray.from_arrays(by.ravel(), DIM).cast(pa.list_(pa.int64()))],
                                             ["row", "by"])
    return run


def train(rows: DataFrame, share: float) -> Model:
    """Fits the classifier to all ``rows`` (``_y``, ``_words``); ``share`` is the share of label 1 that scores are corrected to."""
    spark = rows.sparkSession
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if not 0 < ones < n:
        model = new_model(np.zeros(0, np.int64))
        model.weight[:] = 0
        share = min(max(share, 1e-4), 1 - 1e-4) if n else 0.5
        model.shift = float(np.log(share / (1 - share)))
        return model
    share = min(max(share, 1e-4), 1 - 1e-4)
    # A word or stem of one text only says nothing about others.
    known = rows.select("_y", "_words").mapInArrow(_count_words, "bucket long, times long").groupBy("bucket") \
        .agg(F.sum("times").alias("times")).where((F.col("bucket") != PAD) & (F.col("times") >= MIN_TEXTS)).select("bucket").toArrow()
    model = new_model(np.sort(known.column("bucket").to_numpy()))
    weight = (n / (2 * (n - ones)), n / (2 * ones))
    dealt = rows.select("_y", "_words").coalesce(max(1, n // ROWS_A_LEARNER))
    passes = -(-MIN_STEPS // (ROUNDS * -(-n // BATCH))) if n <= ROWS_A_LEARNER else 1
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model, weight))  # bounded by BUCKETS and DIM
        moved = dealt.mapInArrow(_learn(shared, k, passes), "row long, by array<bigint>").groupBy("row").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(F.col("by")[i]).alias(f"d{i}") for i in range(DIM)]).toArrow()
        at = moved.column("row").to_numpy()
        by = np.stack([moved.column(f"d{i}").to_numpy() for i in range(DIM)], axis=1) / UNITS / moved.column("n").to_numpy()[:, None]
        behind, own = at >= len(model.vectors), dense(model)
        own[at[behind] - len(model.vectors)] += by[behind]
        model.vectors[at[~behind]] += by[~behind].astype(np.float32)
        set_dense(model, own)
        shared.unpersist()
    model.shift += float(np.log(share / (1 - share)))
    return model


def best_threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray, width: float = 0.0) -> float:
    """The threshold with the highest F1 (the middle of the gap there); a score stands for those up to ``width`` above it."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum((y * weight)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (y * weight).sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores stay together
    k = int(f1.argmax())
    return float((s[k] + s[k + 1] + width) / 2 if k + 1 < len(s) else s[k])


@dataclass
class Classifier:
    model: Model
    general: float
    by_lang: dict[str, float]


def in_few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows, in no more partitions than one for every ``ROWS_A_FILE`` of them.

    For what is stored: an executor starts a process for each file that it creates on a local or mounted disk,
    which at its start counts with all of the executor's memory, so many small files are dear.
    """
    return df.coalesce(max(1, -(-rows // ROWS_A_FILE)))


def learned_rows(docs: DataFrame, labels: DataFrame, learn: Column, label: str, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``_y``, ``_held`` (a fifth of the ids), ``lang`` and ``_words`` of every row whose id has a label that may be used.

    Of an id's labels the largest counts. Stored once, as each round of training reads it. Ids without a label are passed over
    by a bit table, so that few texts but the labelled ones are exchanged, and the join is the same at every size.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")) \
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1)).where(learn).groupBy("_id").agg(F.max("_y").alias("_y"))
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), F.col(lang_col).cast("string").alias("lang")) \
        .where(F.col("_id").isNotNull()).where(learn)
    if labels.schema[id_col].dataType == docs.schema[id_col].dataType:  # else equal ids may hash differently
        rows = may_hold(rows, known, "_id")
    n = rows.count()
    rows = in_few_files(rows.join(known.hint("merge"), "_id"), n)
    mix = F.xxhash64("_id", "_text")  # the order of learning, whatever the order of ids
    rows = rows.select("_y", (hash_share(F.col("_id"), "toxicity held") < 0.2).alias("_held"), "lang", "_text", mix.alias("_mix"))
    return stored(rows.sortWithinPartitions("_mix", "_text").select("_y", "_held", "lang", word_ids(F.col("_text")).alias("_words")))


def thresholds(rows: DataFrame, model: Model) -> tuple[float, dict[str, float]]:
    """(over all languages, by language) from all ``rows`` (``_y``, ``lang``, ``_words``)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    scored = rows.select("_y", "lang", "_words").mapInArrow(_score_batches(shared), "_y int, lang string, _score double")
    cell = F.floor(F.ln(F.col("_score") / (1 - F.col("_score"))) * STEPS)
    cells = stored(in_few_files(scored.groupBy("lang", "_y", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")), rows.count()))

    def best(found):
        c, y, n = (found.column(x).to_numpy() for x in ("cell", "_y", "n"))
        z = best_threshold(c / STEPS, y.astype(np.int64), n.astype(float), 1 / STEPS)
        return float(1 / (1 + np.exp(-z)))

    def both(n_0, n_1):
        return F.least(n_0, n_1) >= MIN_CASES
    n = [F.sum(F.when(F.col("_y") == y, F.col("n")).otherwise(0)) for y in (0, 1)]
    if not cells.agg(F.coalesce(both(*n), F.lit(False))).first()[0]:
        return 0.5, {}
    general = best(cells.groupBy("_y", "cell").agg(F.sum("n").alias("n")).toArrow())
    full = cells.where("lang <> ''").groupBy("lang").agg(both(*n).alias("_both")).where("_both").select("lang")
    own = cells.join(full, "lang").toArrow()  # some thousand cells for each language of enough cases
    code = np.array(own.column("lang").to_pylist(), object)
    return general, {x: best(own.filter(pa.array(code == x))) for x in sorted(set(code))}


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "toxic", id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang") -> Classifier:
    """Trains on all labelled documents; ``learn`` is a condition on ``_id`` for the labels that may be used."""
    prepare(docs.sparkSession)
    learn = F.lit(True) if learn is None else learn
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where(learn)
    n = known.agg(F.count("_y").alias("n"), F.sum("_y").alias("ones")).first()
    share = (n["ones"] or 0) / n["n"] if n["n"] else 0.5
    rows = learned_rows(docs, labels, learn, label, id_col, text_col, lang_col)
    model = train(rows.where(~F.col("_held")), share)
    return Classifier(model, *thresholds(rows.where("_held"), model))


def _score_batches(shared):
    def run(batches):
        model = shared.value
        tables = model.tables()
        for b in batches:
            words = b.column(b.num_columns - 1)
            off = words.offsets.to_numpy().astype(np.int64)
            ids = words.values.to_numpy()
            score = model.scores(ids, off, tables) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)],
                                             [*b.schema.names[:-1], "_score"])
    return run


def score(docs: DataFrame, classifier: Classifier, keep: list[str], text_col: str = "text",
          lang_col: str = "lang") -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``_score``, the language's ``_threshold`` and ``_toxic``."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(classifier.model)  # bounded by BUCKETS, DIM and the sample
    threshold = F.lit(classifier.general)
    for code, t in classifier.by_lang.items():
        threshold = F.when(F.col(lang_col) == code, F.lit(t)).otherwise(threshold)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], "_threshold double", "_score double"])
    return docs.select(*[f"`{k}`" for k in keep], threshold.alias("_threshold"), word_ids(text_of(text_col)).alias("_words")) \
        .mapInArrow(_score_batches(shared), schema).withColumn("_toxic", F.col("_score") >= F.col("_threshold"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels outside the held-out fold."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")

    def fold(c):
        return F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(4)) == 2
    classifier = fit(docs, labels, ~fold("_id"))
    return score(docs, classifier, ["doc_id"]).select(
        "doc_id", F.coalesce(fold("doc_id"), F.lit(False)).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.3).cast("int").alias("predicted"),
        F.col("_threshold").alias("threshold"), F.col("_toxic").alias("toxic"))
