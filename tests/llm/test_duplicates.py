"""SimHash, components and suffix removal against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from wastelens.llm import simhash as S
from wastelens.llm import suffixes as X
from wastelens.llm.components import components


def roots(codes, bits):
    parent = list(range(len(codes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(codes)):
        for j in range(i + 1, len(codes)):
            if bin(int(codes[i]) ^ int(codes[j])).count("1") <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def same_partition(a, b):
    m = {}
    return all(m.setdefault(x, y) == y for x, y in zip(a, b)) and len(set(a)) == len(set(b))


def near_codes(seed, n=250):
    rng = np.random.default_rng(seed)
    one = np.uint64(1)
    c = rng.integers(0, 2 ** 63, 8, dtype=np.uint64)[rng.integers(0, 8, n)]
    for _ in range(3):
        c = c ^ (one << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(c)


@pytest.mark.parametrize("seed", range(5))
def test_index_finds_all_links(seed):
    codes = near_codes(seed)
    a, b = S.linked(np.zeros(len(codes), np.int64), codes, 3)
    place = {int(x): i for i, x in enumerate(codes)}
    f = S.Forest(len(codes))
    f.join(np.array([place[int(x)] for x in a], int), np.array([place[int(x)] for x in b], int))
    assert len(a) < len(codes)  # a forest, not all pairs
    assert same_partition(roots(codes, 3), f.root.tolist())


@pytest.mark.parametrize("limit", [4096, 20, 2])
def test_upper_nodes_and_cells_lose_no_link(spark, limit):
    codes = near_codes(9, 120)
    df = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    pairs = S.links(df, 3, limit=limit).collect()
    place = {int(x): i for i, x in enumerate(codes.view(np.int64))}
    f = S.Forest(len(codes))
    f.join(np.array([place[p.u] for p in pairs], int), np.array([place[p.v] for p in pairs], int))
    assert same_partition(roots(codes, 3), f.root.tolist())


def test_gray_rank_orders_the_gray_code():
    n = np.arange(64, dtype=np.uint64)
    assert (S.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (205, 203), (203, 204)]
    got = {r.u: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, **{100 + i: 100 for i in range(1, 30)}, 204: 203, 205: 203}


def test_near_duplicates_of_odd_rows(spark, make_docs):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(5, base), (3, base), (8, base + " tail"), (9, None), (2, ""), (4, " \t\n"), (6, "One two"), (7, "one  TWO"), (6, "One two"),
            (None, base), (11, "É É É"), (12, "x" * 100_000)]
    df = make_docs(rows, fp="clash", component_id=1, root=2)
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = {(r[0], r[1] or ""): fingerprint(r[1]) for r in rows}
    texts = [r[1] or "" for r in rows]
    assert sorted((g.doc_id is None, g.doc_id or 0, g.fingerprint) for g in got) == sorted(
        (r[0] is None, r[0] or 0, f"{want[r[0], t]:016x}") for r, t in zip(rows, texts))
    comp = {g.doc_id: g.component_id for g in got}
    assert comp[5] == comp[3] == comp[None] == 3 and comp[9] == comp[4] == comp[2] == 2 and comp[6] == comp[7] == 6
    assert S.near_duplicates(make_docs([])).count() == 0


def brute(docs):
    low = {}
    for d, t in docs:
        for q in range(len(t) - 49):
            s = t[q:q + 50]
            low[s] = min(low.get(s, d), d)
    out = {}
    for d, t in docs:
        hit = np.zeros(len(t), bool)
        for q in range(len(t) - 49):
            if low[t[q:q + 50]] < d:
                hit[q:q + 50] = True
        kept = bytes(b for b, h in zip(t, hit) if not h)
        out[d] = (len(t), int(hit.sum()), int((np.diff(np.append(0, hit.astype(int))) == 1).sum()),
                  hashlib.sha256(kept).hexdigest())
    return out


def passages(seed, n=60):
    r = random.Random(seed)
    pool = ["".join(r.choice("abc de") for _ in range(r.choice([60, 200]))) for _ in range(6)]
    return [(i, "".join(r.choice(pool) if r.random() < .6 else "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 90)))
                        for _ in range(r.randint(0, 6)))) for i in range(n)]


@pytest.mark.parametrize("chunk,bucket", [(1 << 23, 1 << 24), (3000, 700)])
def test_removed_bytes_match_brute_force(spark, make_docs, chunk, bucket):
    r = random.Random(4)
    docs = passages(1) + [(100 + i, "-" * 200 + "xyz") for i in range(30)] \
        + [(200 + i, "-" * 100 + "".join(r.choice("abc") for _ in range(80))) for i in range(30)] + [(300, ""), (301, "é" * 60), (302, "é" * 60)]
    df = make_docs(docs + [(400, None), (None, "-" * 200)], span=1, _spans="x", bucket=2, size="y")
    got = {x.doc_id: tuple(x[1:]) for x in X.repeat_digests(df, chunk_bytes=chunk, bucket_bytes=bucket).collect()}
    want = brute([(d, t.encode()) for d, t in docs])
    empty = hashlib.sha256(b"").hexdigest()
    assert got.pop(400) == (0, 0, 0, empty)
    assert got.pop(None)[:3] == (200, 0, 0)  # a row without an id is left whole
    assert got == want


def test_grams_that_fill_several_buckets_meet_in_the_second_round():
    r = random.Random(2)
    docs = [(i, ("-" * 60 + "".join(r.choice("ab") for _ in range(60))).encode()) for i in range(40)]
    s = X.suffixes_of(docs)
    grams = sorted(X._grams(X.leading(s)))
    cut = np.frombuffer(b"".join(grams[i * len(grams) // 30] for i in range(1, 30)), ">u8").astype(np.uint64).reshape(-1, 2)
    bucket, dealt = X.bucket_of(X.leading(s), cut, s.doc)
    assert dealt.any()
    home, again, spans = dict(X._first_slot(cut)), {}, {}

    def add(runs):
        for d, _, a, b in zip(*runs):
            spans.setdefault(int(d), []).append((int(a) << 32) | int(b))
    for b, m in set(zip(bucket.tolist(), dealt.tolist())):
        part = s.take(np.flatnonzero((bucket == b) & (dealt == m)))
        runs, leads = X.compare(part)
        add(runs)
        if m:
            again.setdefault(home[b], []).append(part.take(np.flatnonzero(leads)))
    for parts in again.values():
        add(X.compare(X.Suffixes.join(parts))[0])
    want = brute(docs)
    assert {d: sum(b - a for a, b in X.merge(spans.get(d, ()))) for d, _ in docs} == {d: w[1] for d, w in want.items()}


def test_long_texts_in_segments(monkeypatch):
    monkeypatch.setattr(X, "SEGMENT", 300)
    docs = [(d, t.encode() * 3) for d, t in passages(5, 12)]
    s, runs = X.fold(X.suffixes_of(docs))
    assert sum(X.suffixes_of(docs).m.astype(int)) == sum(max(0, len(t) - 49) for _, t in docs)
    spans = {}
    for part in (runs, X.compare(s)[0]):
        for d, _, a, b in zip(*part):
            spans.setdefault(int(d), []).append((int(a) << 32) | int(b))
    want = brute(docs)
    assert {d: sum(b - a for a, b in X.merge(spans.get(d, ()))) for d, _ in docs} == {d: w[1] for d, w in want.items()}


def test_removal_keeps_whole_characters_and_columns(spark, make_docs):
    text = "é" * 25 + "ü" * 40
    df = make_docs([(1, text), (2, "x" + text), (3, None), (4, "plain")], extra=7)
    got = {r.row.doc_id: r for r in X.remove_repeats(df).collect()}
    assert got[1].kept == text and got[2].kept == "x" and got[2].removed == len(text.encode())
    assert got[3].kept == "" and got[4].kept == "plain" and got[4].row.extra == 7
    assert X.remove_repeats(make_docs([])).count() == 0
    assert X.remove_repeats(df.select("doc_id", "text")).count() == 4


def test_rows_of_one_id_with_equally_long_texts_keep_their_own_runs(spark, make_docs):
    r = random.Random(8)
    shared, own, other = ("".join(r.choice("abcdefgh") for _ in range(80)) for _ in range(3))
    docs = [(1, shared), (5, shared + own), (5, other + shared), (5, own + other)]
    got = sorted(tuple(x) for x in X.repeat_digests(make_docs(docs)).collect())
    digest = [hashlib.sha256(t.encode()).hexdigest() for t in (shared, own, other, own + other)]
    assert got == sorted([(1, 80, 0, 0, digest[0]), (5, 160, 80, 1, digest[1]), (5, 160, 80, 1, digest[2]), (5, 160, 0, 0, digest[3])])


def test_strings_of_a_dealt_gram_are_spread_in_the_second_round():
    import pyarrow as pa
    import zstandard

    r = random.Random(6)
    docs = [(i, ("".join(r.choice("ab") for _ in range(50)) + "-" * 16 + "".join(r.choice("ab") for _ in range(50))).encode())
            for i in range(60)]
    docs += [(100 + i, t) for i, (_, t) in enumerate(docs)]
    s = X.suffixes_of(docs)
    spans, again = {}, {}

    def add(table):
        for x in table.to_pylist():
            if x["bucket"] < 0:
                spans.setdefault(x["doc_id"], []).append(x["span"])
            else:
                again.setdefault(x["bucket"], []).append((x["bucket"], True, x["blob"]))
    for slot in range(3):  # copies lie in slots of their own
        part = s.take(np.flatnonzero((s.doc // 7) % 3 == slot))
        add(X._sorter(16)(pa.Table.from_batches([X._blob_rows([(9, True, part.pack(zstandard.ZstdCompressor()))])])))
    places = dict(again)
    assert len(places) == 16
    for rows in places.values():
        add(X._sorter(0)(pa.Table.from_batches([X._blob_rows(rows)])))
    want = brute(docs)
    assert {d: sum(b - a for a, b in X.merge(spans.get(d, ()))) for d, _ in docs} == {d: w[1] for d, w in want.items()}


def test_searches_in_small_parts_give_the_same_links(monkeypatch):
    r = np.random.default_rng(7)
    base = r.integers(0, 2 ** 63, 40).astype(np.uint64)
    one = np.uint64(1)
    code = np.unique(base[r.integers(0, 40, 900)] ^ (one << r.integers(0, 64, 900).astype(np.uint64)) ^ (one << r.integers(0, 64, 900).astype(np.uint64)))
    key = (code % np.uint64(3)).astype(np.int64)

    def groups(u, v):
        up = {}

        def top(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x
        for a, b in zip(u.tolist(), v.tolist()):
            a, b = sorted((top(a), top(b)))
            up[b] = a
        return {frozenset(x for x in up if top(x) == t) for t in {top(x) for x in up}}
    want = groups(*S.linked(key, code, 3))
    brute = [(a, b) for own in (code[key == k] for k in range(3)) for i, a in enumerate(own) for b in own[i + 1:] if int(a ^ b).bit_count() <= 3]
    assert want == groups(*(np.array(x, np.uint64) for x in zip(*brute)))
    for most in (1, 50, 3000):
        monkeypatch.setattr(S, "FRONTIER", most)
        assert groups(*S.linked(key, code, 3)) == want


def test_rows_that_repeat_id_and_text_are_worked_on_once(spark, make_docs, monkeypatch):
    r = random.Random(2)
    shared = "".join(r.choice("abcdefgh ") for _ in range(120))
    rows = [(5, f"own {shared} tail")] * 40 + [(None, shared)] * 30 + [(1, "x " + shared), (9, shared + " z"), (5, "another " + shared), (7, "short")]
    df = make_docs(rows, extra=1)
    wide = {str(sorted(map(tuple, X.repeat_digests(df).collect()), key=str))}, {str(sorted(map(str, X.remove_repeats(df).collect())))}
    parts, real = [], X.copies_apart

    def spy(base):
        parts.append(real(base))
        return parts[-1]
    monkeypatch.setattr(X, "copies_apart", spy)
    for copies, few in ((20, 100), (20, 0), (35, 100)):
        monkeypatch.setattr(X, "COPIES", copies)
        monkeypatch.setattr(X, "FEW_HOT", few)
        assert {str(sorted(map(tuple, X.repeat_digests(df).collect()), key=str))} == wide[0]
        assert {str(sorted(map(str, X.remove_repeats(df).collect())))} == wide[1]
    assert [p[0].count() for p in parts[::2]] == [6, 6, 35]
