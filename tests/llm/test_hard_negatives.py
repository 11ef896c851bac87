"""Strassen products, heaps and mined negatives against plain numpy and a brute force."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wastelens.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 70), st.integers(1, 70), st.integers(1, 70), st.integers(1, 20), st.integers(0, 10 ** 6))
def test_strassen_equals_the_plain_product(m, k, n, base, seed):
    r = np.random.default_rng(seed)
    a, b = r.integers(-10 ** 6, 10 ** 6, (m, k)), r.integers(-10 ** 6, 10 ** 6, (k, n))
    assert np.array_equal(H.strassen(a, b, base), a @ b)


def test_products_beyond_64_bits_are_exact():
    a = np.array([[2.0 ** 40, 3.0], [1e30, -1e30], [1.0, 2.0]])
    c = np.array([[2.0 ** 21, 5.0], [1e30, 1e30], [7.0, -1.0]])
    got = H.inner_products(a, c)
    assert got[0, 0] == 2 ** 61 + 15 and got[1, 1] == 0 and got[2, 2] == 5
    assert got[0, 1] == H.END and got[1, 2] == H.END and (np.abs(got) <= H.END).all()


def test_heaps_merge_in_any_order():
    r = np.random.default_rng(1)
    score, ids = r.integers(0, 6, (3, 40)), np.tile(r.permutation(40), (3, 1))
    want = [sorted(zip((-s).tolist(), i.tolist()))[:4] for s, i in zip(score, ids)]
    for order in (np.arange(40), r.permutation(40)):
        h = H.Heaps(3, 4)
        for at in range(0, 40, 7):
            h.merge(score[:, order[at:at + 7]], ids[:, order[at:at + 7]])
        assert [list(zip((-s).tolist(), i.tolist())) for s, i in zip(h.score, h.id)] == want


def brute(rows, every=50, k=5, n=3, low=50, high=95):
    """rows: (id, vector, label)."""
    ok = [(i, np.floor(256 * np.asarray(v, np.float32).astype(float)).astype(object), lab) for i, v, lab in rows
          if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    width = max([len(v) for _, v, _ in ok], default=0)
    ok = [(i, [int(x) for x in v] + [0] * (width - len(v)), lab) for i, v, lab in ok]

    def dot(x, y):
        return sum(p * q for p, q in zip(x, y))
    out = Counter()
    for a, v, lab in ok:
        if a % every:
            continue
        scored = sorted((-dot(v, w), c, m) for c, w, m in ok)
        for s, p, _ in [x for x in scored if x[2] == lab and x[1] != a][:k]:
            inside = [x for x in scored if x[2] != lab and -s * low <= -100 * x[0] <= -s * high][:n]
            out.update((a, p, r + 1, c, -s, -t) for r, (t, c, _) in enumerate(inside))
    return out


def mined(spark, rows, **sizes):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("clash"), "vector": F.lit(1), "row": F.lit(2)})
    return Counter(map(tuple, H.mine(df, F.col("id") % 50 == 0, **sizes).collect()))


def random_rows(seed, n=260, width=6, labels=3):
    r = random.Random(seed)
    return [(i, [r.choice([0.1, 0.2, 0.5, -0.3, r.random()]) for _ in range(width)], 0 if r.random() < 0.4 else r.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"anchors_a_block": 2, "rows_a_block": 17}])
def test_mined_rows_equal_the_brute_force(spark, sizes):
    rows = random_rows(1)
    assert mined(spark, rows, **sizes) == brute(rows)


def test_rows_that_take_no_part_ties_and_repeats(spark):
    rows = random_rows(2, 120, 4, 2)
    rows[10] = (10, None, 0)
    rows[11] = (11, [0.5, None, 0.1, 0.1], 1)
    rows[12] = (12, [0.5, float("nan"), 0.1, 0.1], 1)
    rows[13] = (13, [0.5, float("inf"), 0.1, 0.1], 1)
    rows[14] = (14, rows[14][1], None)
    rows[15] = (None, rows[15][1], 1)
    rows[16], rows[17] = (16, [], 1), (17, [0.9], 0)
    rows += [(k, rows[20][1], rows[20][2]) for k in (300, 301, 302)] + [rows[21], rows[21], rows[100]]  # ties; repeated rows, an anchor too
    assert mined(spark, rows) == brute(rows)


def test_no_rows_no_anchors_no_negatives(spark):
    assert mined(spark, []) == Counter()
    assert mined(spark, [(1, [0.5], 0), (2, [0.5], 1)]) == Counter()
    assert mined(spark, [(50, [0.5], 0), (2, [0.5], 0), (100, [0.1], 7)]) == Counter()


def test_one_label_of_a_third_of_all_rows_is_many_blocks(spark):
    rows = random_rows(3, 300, 3, 4)
    assert mined(spark, rows, anchors_a_block=4, rows_a_block=10) == brute(rows)


def test_op13_equals_its_sql(spark, sf001):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf001}/embeddings.parquet'")
    got = Counter(map(tuple, H.op13_hard_negatives(spark, sf001).collect()))
    assert got == Counter(c.sql(H.OP13_SQL).fetchall()) and got
