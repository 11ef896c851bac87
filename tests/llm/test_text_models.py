"""Classifiers on planted cases, and quality rules against brute force."""

import random
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from wastelens.llm import quality_model as M
from wastelens.llm import quality_rules as R
from wastelens.llm import toxicity as X
from wastelens.llm.common import may_hold

SYL = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu".split()


def prose(r, n):
    return " ".join("".join(r.choice(SYL) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus(n=240):
    """Label 1: a word of the stem 'zorr' (each time another ending) somewhere in the text."""
    r = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = prose(r, r.randint(20, 120)).split()
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), "zorr" + r.choice(SYL) + r.choice(SYL))
        docs.append((i, " ".join(words), "en" if i % 2 else "fr", "s", 0))
        labels.append((i, 0 if bad else 1, 1 if bad else 0))
    return docs, labels


@pytest.fixture(scope="module")
def labelled(spark, make_docs):
    docs, labels = corpus()
    odd = [(1000, None), (1001, ""), (1002, "zorrba " + "la " * 30_000), (None, "zorrba zorrbe"), (5, docs[5][1])]
    df = make_docs(docs + odd, words=1, _score=2, _y=3, score="x")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (9999, 1, 0), (3, 0, None)], "doc_id long, quality int, toxic int")
    return df, lab, docs


def test_toxicity_separates_unseen_forms(labelled):
    df, lab, docs = labelled
    c = X.fit(df, lab, F.pmod("_id", F.lit(4)) != 2)
    got = {(r.doc_id): r for r in X.score(df, c, ["doc_id", "lang"]).collect()}
    held = [i for i, *_ in docs if i % 4 == 2]
    hits = [(got[i]._score > 0.5) == (i % 3 == 0) for i in held]
    assert np.mean(hits) > 0.9
    assert 0 <= got[1000]._score == got[1001]._score < 0.5  # nothing to go by
    assert got[1002]._score > 0.5  # one word at the head of a very long text
    assert X.score(df, c, ["doc_id"]).count() == df.count()


def test_scores_do_not_depend_on_batches(labelled):
    df, lab, docs = labelled
    c = X.fit(df, lab)
    a = {(r.doc_id): r._score for r in X.score(df, c, ["doc_id"]).collect()}
    b = {(r.doc_id): r._score for r in X.score(df.repartition(7), c, ["doc_id"]).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_toxicity_without_labels(spark, make_docs):
    df = make_docs([(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r._score for r in X.score(df, X.fit(df, none), ["doc_id"]).collect()} == {0.5}
    assert X.score(make_docs([]), X.fit(df, none), ["doc_id"]).count() == 0


def test_threshold_with_the_best_f1():
    s, y = np.array([.9, .8, .7, .2, .1]), np.array([1, 1, 0, 0, 0])
    assert X.best_threshold(s, y, np.ones(5)) == pytest.approx(.75)
    assert X.best_threshold(np.array([.5, .5, .5]), np.array([1, 0, 1]), np.ones(3)) == pytest.approx(.5)


def junk_corpus(n=200):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        t = prose(r, r.randint(60, 150))
        if bad:
            t = t.upper().replace(" ", "!! ") if i % 8 else " | ".join(t.split())
        docs.append((i, t))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_quality_model_on_held_out_rows(spark, make_docs):
    docs, labels = junk_corpus()
    df = make_docs(docs + [(500, None), (501, ""), (None, "LA!! BA!!")], _text=1, _score=0)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    m = M.fit(df, lab, F.pmod("_id", F.lit(5)) != 0)
    got = {r.doc_id: r._score for r in M.score(df, m, ["doc_id"]).collect()}
    held = [i for i, _ in docs if i % 5 == 0]
    assert np.mean([(got[i] > 0.3) == (i % 4 != 0) for i in held]) > 0.95
    assert got[500] == got[501] and 0 <= got[500] <= 1
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r._score for r in M.score(df, M.fit(df, none), ["doc_id"]).collect()} == {0.5}


def test_word_features_do_not_depend_on_neighbours():
    a, ao = M.word_features(pa.array(["über", "x", "longer-word"]))
    b, bo = M.word_features(pa.array(["longer-word"]))
    assert sorted(a[ao[2]:ao[3]]) == sorted(b) and (np.diff(ao) >= 1).all()
    w = M.Words(pa.array(["a a  b\nb", "", None if False else "b"]))
    assert np.diff(w.offsets).tolist() == [4, 0, 1] and w.repeats.tolist() == [2, 0, 0]


def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, c = len(w), Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    cov = {i + k for i in range(n - 2) if c[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov),
            n < 50 or 100 * len(cov) > 50 * n)


def test_quality_rules_match_brute_force(spark, make_docs):
    docs, labels = junk_corpus(80)
    r = random.Random(8)
    docs += [(300, None), (301, ""), (302, " \n\n "), (303, "a b c a b c"), (304, "x\nx\n x\nx\n\n"), (305, "a a a a"),
             (306, "é#|é <b>&\x0b\x85 z"), (307, " ".join(r.choice("abc") for _ in range(4000))), (308, "one"), (5, docs[5][1]), (None, "q r s")]
    df = make_docs(docs, total=1, bucket=3, weight=4)
    lab = spark.createDataFrame(labels + [(None, 1), (2, None)], "doc_id long, quality int")
    rows = R.judge(df, lab).collect()
    assert sorted(map(str, [tuple(x[1:7]) for x in rows])) == sorted(map(str, [base(t) for _, t in docs]))
    # The score, bucket by bucket.
    def signed(h):
        return h - 2 ** 64 if h >> 63 else h

    def buckets(t):
        c = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        raw = [struct.pack("<q", x) for x in c]
        two = [xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42)) for a, b in zip(raw, raw[1:])]
        return [x % R.BUCKETS for x in c + [signed(x) for x in two]]
    y = dict(labels)
    raw, target = Counter(), Counter()
    for d, t in docs:
        raw.update(buckets(t))
        if y.get(d) == 1:
            target.update(buckets(t))
    nr, nt, smooth = sum(raw.values()), sum(target.values()), R.ALPHA * R.BUCKETS
    want = {}
    for d, t in docs:
        b = buckets(t)
        want[d] = sum(np.log((target[x] + 1) / (nt + smooth)) - np.log((raw[x] + 1) / (nr + smooth)) for x in b) / len(b) if b else 0
    assert all(abs(x.score - want[x.doc_id]) < 1e-5 for x in rows)
    good = [x.kept for x in rows if y.get(x.doc_id) == 1]
    assert np.mean(good) > 0.97 and not any(x.kept for x in rows if y.get(x.doc_id) == 0)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(x.kept != x.base_failed for x in R.judge(df, none).collect())
    assert R.judge(make_docs([]), lab).count() == 0


def test_a_hot_id_sends_one_row_of_bounded_size(spark, make_docs):
    from wastelens.llm.common import labelled_sample

    docs = make_docs([(1, f"text {k}") for k in range(400)] + [(k, f"own {k}") for k in range(2, 60)] + [(2, "long " * 1000), (70, None)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 60)] + [(70, 0), (1, 0)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", F.lit(True), 40, "s", most_bytes=3000).collect()
    assert len(got) == len({r.doc_id for r in got}) == 60 and {1, 2, 70} <= {r.doc_id for r in got}
    assert next(r for r in got if r.doc_id == 1)["_y"] == 1 and next(r for r in got if r.doc_id == 2).text == "own 2"
    again = labelled_sample(docs.repartition(7), labels, "toxic", F.lit(True), 40, "s", most_bytes=3000).collect()
    assert {(r.doc_id, r.text) for r in again} == {(r.doc_id, r.text) for r in got}


def test_toxicity_equals_a_plain_forward_pass(labelled):
    df, lab, _ = labelled
    c = X.fit(df, lab)
    m = c.model
    rows = df.select("doc_id", F.col("text").alias("t"), X.word_ids(F.coalesce("text", F.lit(""))).alias("ids")).collect()
    got = Counter((r.doc_id, r.t, round(r._score, 6)) for r in X.score(df.withColumn("t", F.col("text")), c, ["doc_id", "t"]).collect())
    want = Counter()
    for r in rows:
        half = len(r.ids) // 2
        vec = m.vectors[m.row[np.array(r.ids[:half])]] + m.vectors[m.row[np.array(r.ids[half:])]]
        n = half - max(X.WIDTHS)  # words; the rest are pads
        best = []
        for f in m.filters:
            width = len(f)
            windows = [sum(vec[i + j] @ f[j] for j in range(width)) for i in range(n + 1)]
            best.append(np.max(windows, axis=0))
        z = np.maximum(np.concatenate(best) + m.bias, 0) @ m.weight + m.shift
        want[(r.doc_id, r.t, round(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), 6))] += 1
    near = sum((got & want).values())
    assert near >= sum(want.values()) - 2 and sum(got.values()) == sum(want.values())  # the sixth place may round apart


def test_quality_equals_a_plain_forward_pass(spark, make_docs):
    docs, labels = junk_corpus(80)
    long = "LA!! ba " * 20_000
    df = make_docs(docs + [(500, None), (501, ""), (502, "la la la"), (503, long), (3, docs[3][1]), (3, docs[3][1])])
    m = M.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r._score for r in M.score(df, m, ["doc_id"]).collect()}
    for i, t in [*docs[:12], (500, ""), (501, ""), (502, "la la la"), (503, long)]:
        words = t.split()
        total, n = np.zeros(2), 0
        seen = {}
        for k, w in enumerate(words):
            if w not in seen:
                seen[w] = M.word_features(pa.array([w]))[0]
            total += m.table[seen[w]].astype(float).sum(axis=0)
            n += len(seen[w])
            if k and words[k - 1] == w:
                total += m.table[M.AGAIN]
                n += 1
        z = total / max(n, 1) + m.bias
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(m.slope * (z[1] - z[0]) + m.shift, -30, 30)))) < 1e-5
    assert M.score(df, m, ["doc_id"]).where("doc_id = 3").select("_score").distinct().count() == 1
    assert M.score(make_docs([]), m, ["doc_id"]).count() == 0


def test_toxicity_learns_from_every_label(spark, make_docs, monkeypatch):
    """As many labelled documents as no sample of 2500 a class would hold, by several learners; what only texts of one
    id, of over a MiB, or of the last ids show is learned."""
    r = random.Random(4)
    docs, labels = [], []
    for i in range(9000):
        bad = i % 2
        words = prose(r, 12).split() + (["zorr" if i < 8800 else "quax"] if bad else [])
        r.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, bad))
    docs += [(9000 + k, "vexx " + "la " * 360_000) for k in range(4)] + [(9010, f"{prose(r, 8)} wubb") for _ in range(200)]
    labels += [(9000 + k, 1) for k in range(4)] + [(9010, 1)]
    df, lab = make_docs(docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(X, "train", lambda rows, share, f=X.train: seen.append(rows.count()) or f(rows, share))
    rows = X.learned_rows(df, lab, F.lit(True), "toxic", "doc_id", "text", "lang")
    assert rows.count() == len(docs)
    c = X.fit(df, lab)
    assert seen == [rows.where("not _held").count()] and 0.75 * len(docs) < seen[0] < 0.85 * len(docs)
    odd = make_docs([(1, "ba zorr be bi"), (2, "ba quax be bi"), (3, "ba wubb be bi"), (4, "ba be bi bo")])
    got = {x.doc_id: x._score for x in X.score(odd, c, ["doc_id"]).collect()}
    assert got[1] > 0.9 and got[2] > 0.5 and got[3] > 0.5 > got[4]
    assert X.fit(df.repartition(3), lab).model.shift == pytest.approx(c.model.shift, abs=0.5)


def test_labelled_texts_are_joined_alike_at_every_size(spark, make_docs, monkeypatch):
    """Few labels are not broadcast either, and texts of ids without a label are not exchanged; every labelled row comes."""
    df = make_docs([(i % 4000, f"text {i}") for i in range(8000)] + [(None, "none"), (-7, None)])
    lab = spark.createDataFrame([(i, i % 2) for i in range(0, 4000, 10)] + [(0, 1), (None, 1), (4, None), (-7, 0)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(X, "stored", lambda d: seen.append(d) or d)
    rows = X.learned_rows(df, lab, F.lit(True), "toxic", "doc_id", "text", "lang")
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1 and "bitmap" in plan
    assert rows.count() == 801 and rows.where("_y = 1").count() == 2  # id 0, by its largest label
    keys = lab.where("toxic is not null and doc_id is not null").select("doc_id").distinct()
    some = may_hold(df, keys, "doc_id")
    assert some.join(keys, "doc_id").count() == 801 and some.count() < 1600
    assert may_hold(df, keys.where("false"), "doc_id").count() == 0
    short = X.learned_rows(df, lab.withColumn("doc_id", F.col("doc_id").cast("int")), F.lit(True), "toxic", "doc_id", "text", "lang")
    assert short.count() == 801


def test_toxicity_stores_few_rows_in_few_files(spark):
    from pyspark.sql import functions as F

    from wastelens.llm import toxicity

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"),
                                    F.lit("en").alias("lang"))
    labels = spark.range(0, 3000, 2).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).alias("toxic"))
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        toxicity.prepare(spark)
        rows = toxicity.learned_rows(docs, labels, F.lit(True), "toxic", "doc_id", "text", "lang")
        assert rows.count() == 1500
        assert rows.rdd.getNumPartitions() <= 2  # one for every 1024 rows; 40 before
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
