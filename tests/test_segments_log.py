import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from wastelens.functions import scalars as S
from wastelens.operators import categorize as C
from wastelens.operators import ordered as O
from wastelens.operators import outliers as OU
from wastelens.operators import segments as SG
from wastelens.schemas import DIGEST_FIELDS
from wastelens.sources import readers as RD
from wastelens.sources import sinks as SK
from wastelens.sources import versions as V


# ---------------------------------------------------------------- positions
def test_positions_are_gapless_in_order(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "b", None]), i) for i in r.sample(range(10000), 500)]
    df = spark.createDataFrame(rows, "k string, i long").repartition(7)
    got = O.global_position(df, ["k", "i"], "seq", 5).collect()
    assert [g.seq for g in sorted(got, key=lambda g: (g.k is not None, g.k or "", g.i))] == list(range(5, 505))
    assert O.global_position(df.where("false"), ["k", "i"]).count() == 0


# ----------------------------------------------------------------- segments
def log_of(spark, n=200):
    rows = []
    for i in range(n):
        r = {f: "" for f in DIGEST_FIELDS[:-1]}
        r.update(id=f"{i:05d}", timestamp_local=f"2024-01-01T{i // 60 % 24:02d}:{i % 60:02d}:00", shift="hot" if i % 3 else f"s{i % 2}", notes=f"n{i}")
        rows.append(r)
    return spark.createDataFrame(rows).withColumn("shift", F.when(F.col("id") != "00003", F.col("shift")))


@pytest.fixture(scope="module")
def sealed(spark):
    log = SG.build_segments(log_of(spark), ["shift"], size=16).cache()
    return log, SG.tree(SG.leaves(log, ["shift"]), ["shift"], 4).cache()


def problems(log, nodes):
    return {(r.shift, r.segment): (r.problem, r.place) for r in SG.verify_segments(log, nodes, ["shift"]).collect()}


def test_segments_are_chains_of_places(sealed):
    import hashlib
    log, nodes = sealed
    rows = sorted(log.collect(), key=lambda r: (r.shift or "", r.segment, r.place))
    prev, at, key = "", 0, None
    for r in rows:
        if (r.shift, r.segment) != key:
            key, prev, at = (r.shift, r.segment), "", 0
        assert r.place == at and r.prev_hash == prev
        prev = hashlib.sha256("|".join([*((r[f] or "") for f in DIGEST_FIELDS[:-1]), prev]).encode()).hexdigest()
        assert r.hash == prev
        at += 1
    hot = [r for r in rows if r.shift == "hot"]
    assert [r.id for r in hot] == sorted(r.id for r in hot) and max(r.segment for r in hot) == (len(hot) - 1) // 16
    assert problems(log, nodes) == {}


def test_roots_by_hand(sealed):
    import hashlib
    log, nodes = sealed

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()
    by = {}
    for r in sorted(log.collect(), key=lambda r: (r.segment, r.place)):
        by.setdefault(r.shift, {}).setdefault(r.segment, []).append(r.hash)
    want = {}
    for shift, segs in by.items():
        level = [sha(f"{s}|{len(h)}|{h[-1]}") for s, h in sorted(segs.items())]
        while len(level) > 1:
            level = [sha("|".join(level[i:i + 4])) for i in range(0, len(level), 4)]
        want[shift] = (sum(map(len, segs.values())), level[0])
    assert {r.shift: (r.rows, r.root) for r in SG.roots(nodes, ["shift"]).collect()} == want


def test_tampering_is_located(sealed):
    log, nodes = sealed
    hot2 = (F.col("shift") == "hot") & (F.col("segment") == 2)
    edited = log.withColumn("notes", F.when(hot2 & (F.col("place") == 5), "x").otherwise(F.col("notes")))
    assert problems(edited, nodes) == {("hot", 2): ("row", 5)}
    assert problems(log.where(~(hot2 & (F.col("place") == 7))), nodes) == {("hot", 2): ("row", 7)}
    assert problems(log.where(~(hot2 & (F.col("place") > 11))), nodes) == {("hot", 2): ("cut", 12)}
    assert problems(log.where(~hot2), nodes) == {("hot", 2): ("missing", None)}
    assert problems(log.where("shift is not null"), nodes) == {(None, 0): ("missing", None)}
    twice = log.unionByName(log.where(hot2 & (F.col("place") == 3)))
    assert problems(twice, nodes) == {("hot", 2): ("row", 4)}
    extra = log.unionByName(log.where(hot2).withColumn("segment", F.lit(99).cast("long")))
    assert problems(extra, nodes) == {("hot", 99): ("extra", None)}
    # Edited, and every hash after it made to fit: only the sealed leaf tells.
    again = SG._linked(edited.drop("prev_hash", "hash"), ["shift"], ("prev_hash", "hash", "_at")).drop("_at").select(*log.columns)
    assert problems(again, nodes) == {("hot", 2): ("rewritten", None)}


def test_an_empty_log_has_no_segments(spark):
    log = SG.build_segments(log_of(spark).where("false"), ["shift"])
    nodes = SG.tree(SG.leaves(log, ["shift"]), ["shift"])
    assert nodes.count() == 0 and SG.verify_segments(log, nodes, ["shift"]).count() == 0


def test_ambiguous_digests(spark):
    d = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", None), ("a", ""), ("1:a", "")], "x string, y string")
    got = d.select(S.row_digest(["x", "y"]).alias("h"), S.ambiguous(["x", "y"]).alias("a"), S.safe_digest(["x", "y"]).alias("s")).collect()
    assert got[0].h == got[1].h and [g.a for g in got] == [True, True, False, False, False]
    assert len({g.s for g in got}) == 5


# --------------------------------------------------------------------- logs
def entries(spark, rows):
    return spark.createDataFrame(rows, "id string, timestamp_local timestamp, material string, notes string")


def test_appended_rows_go_on_in_sequence(spark):
    root = tempfile.mkdtemp(prefix="wl-seq-")
    d = dt.datetime
    for fmt in ("csv", "parquet"):
        path = f"{root}/{fmt}"
        SK.append_log(entries(spark, [("b", d(2024, 2, 1), "M", "x"), ("a", d(2024, 1, 1), "M", "y")]), path, fmt, sequence=["timestamp_local", "id"])
        SK.append_log(entries(spark, [("z", d(2020, 1, 1), "M", "late")]), path, fmt, sequence=["timestamp_local", "id"])
        assert SK.last_sequence(spark, path, fmt) == 3
        log = RD.load_master(spark, path, fmt, typed=False)
        assert {r.id: int(r.seq) for r in log.collect()} == {"a": 1, "b": 2, "z": 3}
        last = RD.last_hash(log.withColumns({"seq": F.col("seq").cast("long"), "hash": F.col("id")}), ("seq",))
        assert last.first().last_hash == "z"
    assert SK.last_sequence(spark, root + "/none") == 0


def test_other_tools_logs_stay_as_they_are(spark):
    root = tempfile.mkdtemp(prefix="wl-foreign-")
    notes = ["C:\\new\\rack", "\\s \\\\", "a\x00b", "plain"]
    with open(root + "/log.csv", "w") as f:
        f.write("id,notes\n" + "".join(f"{i},{n}\n" for i, n in enumerate(notes)))
    got = {r.id: r.notes for r in RD.load_master(spark, root + "/log.csv", typed=False).collect()}
    assert got == {str(i): n for i, n in enumerate(notes)}
    odd = notes + ["line\nbreak\r\n", "\\", "\\n\n"]
    SK.append_log(entries(spark, [(str(i), dt.datetime(2024, 1, 1), "M", n) for i, n in enumerate(odd)]), root + "/own", "csv")
    assert {r.id: r.notes for r in RD.load_master(spark, root + "/own", typed=False).collect()} == {str(i): n for i, n in enumerate(odd)}


def test_handed_out_tables_are_plain_csv(spark):
    root = tempfile.mkdtemp(prefix="wl-out-")
    odd = ["C:\\new", 'say "x"', "two\nlines"]
    SK.write_csv(spark.createDataFrame([(n,) for n in odd], "notes string"), root + "/out")
    back = spark.read.options(**RD.CSV).option("multiLine", True).csv(root + "/out")
    assert sorted(r.notes for r in back.collect()) == sorted(odd)


def test_entries_are_found_in_their_partition(spark):
    root = tempfile.mkdtemp(prefix="wl-find-") + "/log"
    d = dt.datetime(2024, 1, 1, 5)
    SK.append_entries(entries(spark, [("a", d, "Lovo Kit", "x"), ("b", d, "lovo kit", "y"), ("c", d, "???", "z"), ("d", d, "!", "w")]), root)
    found = SK.find_entries(spark, root, "2024-01-01", "Lovo Kit")
    assert [r.id for r in found.collect()] == ["a"]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(material_slug" in plan and "EqualTo(log_date,2024-01-01)" in plan
    assert os.path.isdir(root + "/material_slug=lovo_kit")
    assert [r.id for r in SK.find_entries(spark, root, "2024-01-01", "???", "c").collect()] == ["c"]


def test_a_reader_keeps_its_version(spark):
    root = tempfile.mkdtemp(prefix="wl-versions-")
    assert V.current(spark, root) is None and V.resolve(spark, root) == root
    one, two = (spark.createDataFrame([(k,)], "k int") for k in (1, 2))
    assert V.write(one, root) == 1
    old = V.read(spark, root)
    assert V.write(two, root) == 2 and V.current(spark, root) == 2 and V.versions(spark, root) == [1, 2]
    assert [r.k for r in old.collect()] == [1] and [r.k for r in V.read(spark, root).collect()] == [2]
    V.point_to(spark, root, 1)
    assert [r.k for r in V.read(spark, root).collect()] == [1]
    assert V.write(two, root) == 3 and [r.k for r in V.read(spark, root, 1).collect()] == [1]


def test_dimensions_are_versions(spark):
    root = tempfile.mkdtemp(prefix="wl-dimv-") + "/m"
    first = RD.load_materials(spark, root)
    SK.write_dimension(first.where("name = 'Lovo Kit'"), root, ["name", "unit", "cost_per_unit"])
    assert first.count() == 10 and [r.name for r in RD.load_materials(spark, root).collect()] == ["Lovo Kit"]


def test_first_and_last_of_a_name_follow_the_files(spark):
    root = tempfile.mkdtemp(prefix="wl-order-")
    for k in range(6):  # the later the file, the smaller, so that packing by size turns the order around
        with open(f"{root}/part-{k}.csv", "w") as f:
            f.write("name,unit,cost_per_unit\n" + "".join(f"A,u,{k}.{j}\n" for j in range(60 - 10 * k)))
    assert RD.load_materials(spark, root).first().cost_per_unit == 0.0
    prices = spark.createDataFrame([("x", 1.0)], "name string, cost_per_unit double")
    with open(root + "/prices.csv", "w") as f:
        f.write("name,mock_price\nA,1\nA,2\n")
    assert RD.load_mock_prices(spark, root + "/prices.csv", prices).first().mock_price == 2.0


# ------------------------------------------------------------ rules, quantiles
def test_many_keywords_equal_one_by_one(spark, monkeypatch):
    r = random.Random(2)

    def word():
        return "".join(r.choice("abcdé_ 1-") for _ in range(r.randint(1, 4)))
    rules = [(f"c{k}", [word() for _ in range(r.randint(0, 3))]) for k in range(60)]
    d = spark.createDataFrame([(" ".join(word() for _ in range(r.randint(0, 6))), None) for _ in range(300)] + [(None, None)], "vendor string, description string")
    for match in ("substring", "word"):
        usable = [(c, [k for k in keys if k.strip()]) for c, keys in rules]
        usable = [(c, keys) for c, keys in usable if keys]
        monkeypatch.setattr(C, "MANY", 10 ** 6)
        slow = [x.rule_cat for x in C.categorize_rules(d, usable, match).collect()]
        monkeypatch.setattr(C, "MANY", 0)
        assert [x.rule_cat for x in C.categorize_rules(d, usable, match).collect()] == slow


def test_ten_thousand_keywords(spark):
    rules = [(f"c{k}", [f"key{k}x{j}y" for j in range(10)]) for k in range(1000)]
    d = spark.createDataFrame([("key7x3y", "key5x1y"), ("", "none"), ("key999x9y", "")], "vendor string, description string")
    assert [x.rule_cat for x in C.categorize_rules(d, rules).collect()] == ["c5", None, "c999"]
    a = C.KeywordAutomaton([["a"], [""], ["b"]], "substring")
    assert [a.first_rule(t) for t in ("b", "ba", "")] == [1, 0, 1]


def test_exact_order_statistics(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(OU, "FEW", 20)
    monkeypatch.setattr(OU, "BINS", 16)
    r = np.random.default_rng(3)
    for v in (r.normal(size=3000), np.repeat([1.5, -2.0, 7.0], 1000), np.append(r.normal(size=500) * 1e-12, [1e300, -1e300, 1e308, -1.7e308]), np.ones(50)):
        df = spark.createDataFrame([(float(x),) for x in v], "v double").cache()
        ranks = [0, len(v) // 20, len(v) // 2, len(v) - 1]
        assert OU.order_statistics(df, "v", ranks) == np.sort(v)[ranks].tolist()
        if abs(v).max() < 1e9:
            assert abs(OU.exact_quantile(df, "v", 0.05, len(v)) - np.percentile(v, 5)) < 1e-12


def test_the_flagged_share_is_exact(spark):
    r = random.Random(9)
    d = spark.createDataFrame([(i, r.gauss(0, 1), r.gauss(0, 5)) for i in range(2000)], "k long, qty double, cost double")
    out, meta = OU.flag_anomalies(d, ["k"])
    scores = sorted(x.ai_score for x in out.select("ai_score").collect())
    flagged = out.where("ai_anomaly").count()
    assert flagged == sum(s < 0 for s in scores) and 100 - scores.count(scores[100]) <= flagged <= 100


def test_csv_log_is_written_compressed_and_read_back(spark, sf001, tmp_path):
    from wastelens.operators import audit as AU
    from wastelens.plans.q_entries import enriched
    from wastelens.sources import readers as RD
    from wastelens.sources import sinks as SK

    rows, path = AU.with_digest(enriched(spark, sf001)), str(tmp_path / "log")
    SK.append_log(rows, path, fmt="csv", partitioned=False)
    SK.append_log(rows, path, fmt="csv", partitioned=False)
    log = RD.load_master(spark, path, typed=False)
    size = sum(f.stat().st_size for f in (tmp_path / "log").glob("part-*"))
    text = log.selectExpr("sum(length(concat_ws(',', *))) AS n").first()["n"]
    assert log.count() == 2 * rows.count() and log.where(AU.digest(log) != log["hash"]).count() == 0
    assert size < 0.5 * text
