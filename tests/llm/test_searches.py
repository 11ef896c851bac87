"""Decontamination, URL templates and tool calls against brute force or SQL."""

import json
import random
import re
from collections import Counter

import duckdb
import pytest

from wastelens.llm import decontaminate as D
from wastelens.llm import tool_calls as C
from wastelens.llm import url_templates as U


def shingles(t, width=5):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def width_of(item):
    return min(len(re.findall(r"[^\W_]+", item or "")), 5)


def words(r, n):
    return [f"w{r.randint(0, 5000)}" for _ in range(n)]


def test_every_containment_is_found(spark, make_docs):
    r = random.Random(1)
    items = [(i, " ".join(words(r, r.randint(5, 90)))) for i in range(40)] + [(50, "too short"), (51, None), (None, "a b c d e f g h"), (52, ""),
                                                                               (53, "w17"), (54, "w1 w2 w3"), (55, "W9, w8 w7-w6"), (56, " !?")]
    docs = [(i, " ".join(words(r, r.randint(0, 200)))) for i in range(60)]
    for k in range(120):  # items inside documents, cut, split up or changed a little
        own = items[k % 40][1].split()
        for _ in range(r.randint(0, 3)):
            own[r.randrange(len(own))] = "changed"
        at = r.randrange(len(own))
        text = words(r, 30) + own[:at] + (words(r, 20) if r.random() < .4 else []) + own[at:] + words(r, 3000 if k == 5 else 30)
        text += [[], ["w1", "w2", "w3"], ["w9", "w8", "w7", "w6"], ["w9", "w8", "x", "w7", "w6"], ["too", "Short"]][k % 5]
        docs.append((100 + k, " ".join(text).upper() if k % 2 else ",  ".join(text)))
    docs += [(900, None), (901, ""), (902, items[3][1] + " " + items[3][1]), (902, items[3][1] + " " + items[3][1]), (None, items[4][1])]
    item_df = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(make_docs(docs, item_id=5, h=1, n=2), item_df).collect()
    want = set()
    for d, t in docs:
        every = {width: shingles(t, width) for width in range(1, 6)}
        for i, u in items:
            s = shingles(u, width_of(u)) if width_of(u) else set()
            have = every.get(width_of(u), set())
            if s and i is not None and len(s & have) >= 0.8 * len(s) - 1e-9:
                want.add((d, i, len(s & have), len(s)))
    assert sorted(map(str, [(x.doc_id, x.item_id, x.n_shared, x.n_item) for x in got])) == sorted(map(str, want))
    assert len(want) > 50 and any(n > 40 for *_, n in want) and {50, 53, 54, 55} <= {i for _, i, *_ in want}
    assert D.contaminated(make_docs([]), item_df).count() == 0
    assert D.contaminated(make_docs(docs), item_df.limit(0)).count() == 0


def test_the_sketch_decides_which_pairs_are_counted(spark, make_docs, monkeypatch):
    item = " ".join(f"i{k}" for k in range(44))
    docs = [(1, item), (2, " ".join(item.split()[:30])), (3, "nothing of it at all here"), (4, " ".join(f"i{k}" for k in range(44) if k % 6))]
    seen, real = [], D.stored

    def spy(df):
        seen.append(real(df))
        return seen[-1]
    monkeypatch.setattr(D, "stored", spy)
    got = D.contaminated(make_docs(docs), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(g.doc_id, g.item_id) for g in got] == [(1, 7)]
    sketch, candidates = seen[0].where("in_sketch"), {r.doc_id for r in seen[1].collect()}
    # Documents 2 and 4 share entries of the sketch, but too few shingles; 3 is never looked at again.
    assert sketch.count() < 40 and {1, 2} <= candidates and 3 not in candidates


def test_sketches_hold_one_more_than_may_be_missing(spark):
    sizes = [1, 2, 3, 4, 5, 9, 16, 31, 55]
    df = spark.createDataFrame([(n, h * 7919) for n in sizes for h in range(n)], "item_id long, h long")
    for n, k in D.sketches(df).where("in_sketch").groupBy("item_id").count().collect():
        assert k >= min(n, n - -(-n * 8 // 10) + 1)


def test_deep_shared_chains_take_few_rounds(spark, monkeypatch):
    chain = [f"s{k}x" for k in range(300)]
    urls = ["/".join(chain) + "/left/end", "/".join(chain) + "/right/end/more"] + ["/".join(chain[:k]) for k in range(1, 300, 7)]
    pages = spark.createDataFrame([("h", "/" + u, None) for u in urls], "host string, pattern string, y int")
    jobs, real = [], U.stored

    def spy(df):
        jobs.append(1)
        return real(df)
    monkeypatch.setattr(U, "stored", spy)
    got = {r.pattern: r.template for r in U.templates(pages).collect()}
    assert len(jobs) <= 6
    head = chain[:U.NAMED]
    for u in urls[2:]:
        n = u.count("/") + 1
        assert got["/" + u] == "/" + "/".join(head[:n] + ["*"] * (n - U.NAMED))
    for u, end in zip(urls, (["end"], ["end", "more"])):
        t = got["/" + u].split("/")[1:]
        assert t[:300] == head + ["*"] * 294 and t[301:] == ["*"] * len(end)


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def parts(u):
    if u is None or "://" not in u:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def ruled(host, path):
    best = (None, None)
    for rule, v in RULES:
        at = rule.index("/")
        if (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:]) and len(rule) > len(best[0] or ""):
            best = (rule, v)
    return best


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.NET/en/1?x", "https://example.net/EN/", "http://xexample.net/en/", "http://example.net", "http://a.net/",
            "ftp://example.com/de/7.html#t", "http://example.com/de", "http://m.org/fr/ü", "no scheme", None, "", "http://", "://x.org/fr/",
            "http://a.org?u=http://b.net/", "http://Ä.net/\nq", "http://a.b.example.com/de//", "http://x.org/fr/#", "http://net/"]
    pages = spark.createDataFrame([(i, u, "t") for i, u in enumerate(urls)] + [(None, urls[0], "t"), (3, urls[3], "t")],
                                  "page_id long, url string, host string")
    none = spark.createDataFrame([], "_page long, y int")
    rows = U.judge(pages, none, RULES).collect()
    assert len(rows) == len(urls) + 2
    for r in rows:
        u = urls[0 if r.page_id is None else r.page_id]
        h, p = parts(u)
        rule, v = ruled(h, p)
        assert (r.host, r.path, r.rule, r.verdict) == (h, p, rule, v or "allow"), u
    assert U.judge(pages.limit(0), none, RULES).count() == 0


def test_templates_merge_like_branches_and_reject_bad_ones(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(3000):
        kind = r.choice(["news", "blog", "shop", "spam"])
        slug = "".join(r.choice("abcdefgh") for _ in range(6))
        path = {"news": f"/news/{slug}/{i}", "blog": f"/blog/{slug}/{i}", "shop": f"/shop/{slug}/{i}.html", "spam": f"/spam/{slug}/{i}"}[kind]
        rows.append((i, f"http://big.example/{path[1:]}"))
        labels.append((i, int(r.random() < (0.9 if kind == "spam" else 0.1))))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = U.judge(pages, spark.createDataFrame(labels, "_page long, y int"), []).collect()
    by = {}
    for g in got:
        by.setdefault(g.path.split("/")[1], set()).add((g.template.split("/")[1], g.verdict))
    assert by["spam"] == {("spam", "block")}
    assert all({v for _, v in by[k]} == {"allow"} for k in ("news", "blog", "shop"))
    assert all(t.split("/")[2] == "*" for t in {g.template for g in got})  # 3000 slugs are one branch
    assert len({g.template for g in got}) < 20


def test_deep_paths_and_smoothing(spark):
    rows = [(i, "http://h.example/" + "/".join("abcdefghij"[:3 + i % 7])) for i in range(70)] + [(100, "http://lone.example/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {g.page_id: g for g in U.judge(pages, spark.createDataFrame([(100, 1), (0, 0), (1, 0)], "_page long, y int"), []).collect()}
    assert got[100].verdict == "allow"  # one bad label alone rejects nothing
    assert got[6].template.endswith("**") or "*" in got[6].template


def test_branches_past_the_sixth_segment_are_told_apart(spark):
    rows = [(i, f"http://h.example/a/b/c/d/e/f/{'spam' if i % 2 else 'news'}/x/{i}") for i in range(200)] \
        + [(900, "http://h.example/a/b/c/d/e/f/lone/1/2/3")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "_page long, y int")
    got = {g.page_id: g for g in U.judge(pages, labels, []).collect()}
    assert len(got) == 201
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(200))
    assert got[0].template != got[1].template


def call(turn, cid, name="read", args='{"text":"x","words":1,"lines":2}', after=None, conv=1):
    return (conv, turn, cid, name, args, after)


CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after string"
RESULTS = "conv_id long, turn long, call_id string, content string"


def link(spark, calls, results, others=None):
    o = spark.createDataFrame(others, "conv_id long, turn long, role string, content string") if others is not None else None
    return C.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), C.TOOLS, o).collect()


def test_links_order_and_status(spark):
    calls = [call(0, "a", after="b"), call(1, "b"), call(2, "c", after="a"), call(3, "x", after="y"), call(4, "y", after="x"),
             call(5, "a", name="answer"), call(6, "s", after="s"), call(7, "u", after="nowhere"), (1, 8, None, "read", None, None),
             call(0, "a", conv=2), (None, 1, "z", "read", "{}", None)]
    results = [(1, 9, "c", "late"), (1, 3, "c", "early"), (1, 3, "q", "lost"), (1, 9, "b", None), (2, 1, "a", "r")]
    rows = link(spark, calls, results, [(1, 0, "system", "hi"), (1, None, None, None)])
    assert len(rows) == len(calls) + len(results) + 2
    state = {(r.conv_id, r.kind, r.call_id, r.turn): (r.status, r.depth) for r in rows}
    assert state[1, "call", "b", 1] == ("linked", 0) and state[1, "call", "a", 0] == ("no_result", 1)
    assert state[1, "call", "c", 2] == ("linked", 2) and state[1, "call", "a", 5][0] == "repeated"
    assert {state[1, "call", k, t][0] for k, t in (("x", 3), ("y", 4), ("s", 6))} == {"cycle"}
    assert state[1, "call", "u", 7] == ("no_result", 0) and state[1, "call", None, 8][0] == "no_result"
    assert state[1, "result", "c", 3][0] == "linked" and state[1, "result", "c", 9][0] == "repeated"
    assert state[1, "result", "q", 3][0] == "no_call" and state[2, "result", "a", 1] == ("linked", 0)
    place = {(r.kind, r.call_id, r.turn): r.position for r in rows if r.conv_id == 1}
    assert sorted(place.values()) == list(range(len(place)))
    assert place["call", "b", 1] < place["call", "a", 0] < place["call", "c", 2] < place["result", "c", 3]


def test_arguments_against_schemas(spark):
    cases = {'{"text":"x","words":1,"lines":2}': "", '{"words":"1","text":5}': "missing lines; text is not string; words is not integer",
             '{"text":null,"words":1,"lines":1.5,"zz":1,"b":2}': "lines is not integer; missing text; unknown argument b; unknown argument zz",
             "[1]": "arguments are no object", "no json": "arguments are no object", None: "arguments are no object"}
    rows = link(spark, [call(i, f"k{i}", args=a) for i, a in enumerate(cases)] + [call(99, "t", name="other")], [])
    got = {r.call_id: r for r in rows}
    assert [got[f"k{i}"].errors for i in range(len(cases))] == list(cases.values())
    assert got["t"].errors == "unknown tool other"
    assert got["k0"].json == '{"arguments":{"lines":2,"text":"x","words":1},"id":"k0","name":"read","type":"tool_call"}'
    assert all(json.loads(r.json)["id"] == r.call_id for r in rows)


def test_long_chains_and_empty_tables(spark):
    rows = link(spark, [call(i, f"c{i}", after=f"c{i - 1}") for i in range(300)], [])
    assert all(r.depth == r.turn == r.position for r in rows)
    assert link(spark, [], []) == []


def test_identifiers_are_hash_joined(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE", 3)
    n = 40
    calls = spark.createDataFrame([(1, k * 2, f"c{k}", "t", "{}", f"c{k - 1}") for k in range(n)] + [(None, 5, "x", "t", "{}", None)],
                                  "conv_id long, turn long, call_id string, name string, arguments string, after string")
    results = spark.createDataFrame([(1, k * 2 + 1, f"c{k}", "r") for k in range(n)] + [(1, None, "c0", "late"), (None, None, None, None)],
                                    "conv_id long, turn long, call_id string, content string")
    out = C.link_calls(calls, results, {"t": {}})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") >= 2
    rows = sorted(((r.position, r.kind, r.call_id) for r in out.where("conv_id = 1").collect()))
    assert [p for p, *_ in rows] == list(range(2 * n + 1))
    assert [c for _, k, c in rows if k == "call"] == [f"c{k}" for k in range(n)]
    lone = out.where("conv_id is null").collect()
    assert sorted(r.position for r in lone) == [0, 1]


def test_sql_of_conversations(spark, tmp_path):
    rows = [(1, 0, "system", "be\nnice"), (1, 1, "user", 'say "hi" ' * 30), (1, 2, "assistant", "é\t"), (1, 3, "user", "a\nb"),
            (1, 4, "assistant", ""), (2, 0, "user", "x " * 60), (2, 1, "user", "y"), (3, 0, "assistant", "alone"), (4, 5, "tool", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = C.op10_tool_calls(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(C.OP10_SQL)
    assert want.columns == got.columns
    assert Counter(map(str, want.fetchall())) == Counter(str(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("name", ["op3_url_templates", "op7_decontaminate", "op10_tool_calls"])
def test_registered(name):
    from wastelens.llm.queries import QUERIES

    assert name in QUERIES
