"""Token counts and the alignment of two tokenizers, against the libraries themselves."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wastelens.llm import alignment as A
from wastelens.llm import token_counts as C
from wastelens.llm.common import read

POOL = ("aAbeéÉßſİıΣσς'sStTrReEvVmMlLdD0123½Ⅷ²  \t\n\r\x0b\x0c\x1c\x1f\x00\x85\xa0    　᠎​﻿"
        "̧́!?.,<|>endoftextstar_-日本🙂‍▁")
ODD = ["", " ", "\n", "  ", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "a\nb c\nd", "x<|endoftext|>y", "<|startoftext|>", "<s> </s> <unk> <0x41>",
       "It's THE İstanbul ΑΣ", "日本語のテキスト　です か", "🙂👍🏽 a\r\n\tb", "a" * 3000, "ab" * 2000 + " " + "!?" * 300, "x▁y", "é è\nà ü",
       "word “quoted” word", "tab\tend \x00 nul", "a  b 　c"]
odd_text = st.text(alphabet=POOL, max_size=40)


@pytest.fixture(scope="module")
def word_file():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def merger():
    return C.PairMerger()


@pytest.fixture(scope="module")
def aligner():
    return A.Aligner()


@pytest.fixture(scope="module")
def two():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def naive(two, text):
    """(A's ids, B's ids, groups, linked pairs) by the definition, or None."""
    if not text:
        return None
    file_a, sp = two
    a, b = file_a.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    table = _byte_table()
    bytes_a = [bytes(table[c] for c in file_a.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None

    def ranges(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at := at + len(p)))
        return out
    ra, rb = ranges(bytes_a), ranges(bytes_b)
    cuts = sorted({e for _, e in ra} & {e for _, e in rb})
    groups, lo = [], 0
    for hi in cuts:
        groups.append(([i for i, (_, e) in zip(a, ra) if lo < e <= hi], [i for i, (_, e) in zip(b, rb) if lo < e <= hi]))
        lo = hi
    links = [(i, j) for i, (s, e) in zip(a, ra) for j, (t, f) in zip(b, rb) if s < f and t < e]
    return a, b, groups, links


def _byte_table():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + n)] = b
            n += 1
    return out


def digest(groups):
    return hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()


def test_counts_equal_the_library_on_odd_texts(merger, word_file):
    size, n = merger.batch(pa.array(ODD))
    assert size.tolist() == [len(t.encode()) for t in ODD]
    assert n.tolist() == [len(word_file.encode(t, add_special_tokens=False).ids) for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(odd_text, max_size=5))
def test_counts_equal_the_library(merger, word_file, texts):
    assert merger.batch(pa.array(texts, pa.string()))[1].tolist() == \
        [len(word_file.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_of_a_vocabulary_that_keeps_white_space():
    m, file = C.PairMerger("byte_bpe_50k"), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert m.batch(pa.array(ODD))[1].tolist() == [len(file.encode(t, add_special_tokens=False).ids) for t in ODD]


def test_every_character_counts_as_the_library_counts_it(merger, word_file):
    texts = ["".join(f"a{chr(c)}b " for c in range(lo, lo + 256)) for lo in range(0, 0x11000, 256) if not 0xD800 <= lo < 0xE000]
    assert merger.batch(pa.array(texts))[1].tolist() == [len(e.ids) for e in word_file.encode_batch(texts, add_special_tokens=False)]


def test_what_is_remembered_is_bounded_and_changes_nothing(monkeypatch, word_file):
    monkeypatch.setattr(C, "REMEMBERED", 3)
    m = C.PairMerger()
    text = " ".join(f"word{k % 7}" for k in range(40))
    assert m.batch(pa.array([text, text]))[1].tolist() == [len(word_file.encode(text, add_special_tokens=False).ids)] * 2
    assert len(m.words.new) <= 3 and len(m.words.old) <= 3 and len(m.pieces.new) <= 3


def test_count_rows(spark, make_docs, word_file):
    rows = [(1, "It's a text"), (1, "It's a text"), (None, "x"), (2, None), (3, ""), (4, "long " * 30000)]
    got = C.count_tokens(make_docs(rows, n_tokens=7, n_bytes=9, over_limit="x"))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = Counter((i, len((t or "").encode()), n := len(word_file.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows)
    assert Counter(map(tuple, got.collect())) == want
    assert C.count_tokens(make_docs([])).count() == 0


def test_op11_on_a_whole_table(spark, sf001, word_file):
    rows = read(spark, sf001, "documents").select("doc_id", "text").collect()
    want = {(r.doc_id, len((r.text or "").encode()), len(word_file.encode(r.text or "", add_special_tokens=False).ids)) for r in rows}
    got = C.op11_token_counts(spark, sf001).collect()
    assert len(got) == len(rows) and {(g.doc_id, g.n_bytes, g.n_tokens) for g in got} == want
    assert all(g.over_limit == (g.n_tokens > 2048) for g in got)


def check_batch(aligner, two, texts):
    numbers, digests, (offsets, pair, times) = aligner.batch([t.encode() for t in texts])
    for k, t in enumerate(texts):
        want = naive(two, t)
        own = dict(zip(pair[offsets[k]:offsets[k + 1]].tolist(), times[offsets[k]:offsets[k + 1]].tolist()))
        found = [int(numbers[c][k]) for c in ("n_a", "n_b", "n_groups", "n_links")]
        if want is None:
            assert (found, digests[k], own) == ([0] * 4, "", {}), t
        else:
            a, b, groups, links = want
            assert found == [len(a), len(b), len(groups), len(links)], t
            assert digests[k] == digest(groups), t
            assert own == Counter(i * 32000 + j for i, j in links), t


def test_alignment_of_odd_texts(aligner, two):
    short = [t for t in ODD if len(t) < 1000]
    check_batch(aligner, two, short)
    r = random.Random(3)
    check_batch(aligner, two, [" ".join(r.choice(["thtion", "ver\nein", "ñoue", "the,", "42", "“a”", "a b"]) for _ in range(250)) for _ in range(5)])
    check_batch(aligner, two, [])


@settings(max_examples=200, deadline=None)
@given(st.lists(odd_text, max_size=4))
def test_alignment_equals_the_definition(aligner, two, texts):
    check_batch(aligner, two, texts)


def brute(two, rows):
    found = [(i, naive(two, t)) for i, t in rows]
    count = Counter(link for _, w in found if w for link in w[3])
    highest = defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    return Counter((i, 0, 0, 0, 0, 0, 0, "") if w is None else
                   (i, len(w[0]), len(w[1]), len(w[2]), len(w[3]), sum(count[x] == highest[x[1]] for x in w[3]), sum(count[x] for x in w[3]), digest(w[2]))
                   for i, w in found)


@pytest.mark.parametrize("common", [0, 40, A.COMMON])
def test_link_statistics_by_both_joins(spark, make_docs, two, common):
    r = random.Random(5)
    texts = [" ".join(r.choice(["thtion", "ver\nein", "ñoue", "the,", "42"]) for _ in range(r.randint(1, 20))) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[4]), (3, texts[3]), (None, "a b"), (90, None), (91, ""), (92, "x▁y"), (93, "a  b ")]
    got = A.link_statistics(make_docs(rows, row=1, pair=2, times=3, n=4, best=5), common=common)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(two, rows)


def test_link_statistics_of_nothing(spark, make_docs):
    assert A.link_statistics(make_docs([])).count() == 0
    assert [tuple(r) for r in A.link_statistics(make_docs([(1, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_op12_on_a_whole_table(spark, sf001, two):
    docs = read(spark, sf001, "documents")
    short = docs.where(F.length("text") < 3000).select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in short.collect()]
    got = {g.doc_id: g for g in A.op12_alignment(spark, sf001).collect()}
    assert len(got) == docs.count()
    for i, t in rows[::4]:
        w, g = naive(two, t), got[i]
        if w:
            assert (g.n_a, g.n_b, g.n_groups, g.n_links, g.groups_sha256) == (len(w[0]), len(w[1]), len(w[2]), len(w[3]), digest(w[2]))
