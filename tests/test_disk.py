"""What is exchanged and stored by the audit trail, logs and lags stays narrow, with the same results."""

import hashlib
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from wastelens.functions import scalars as S
from wastelens.operators import audit as AU
from wastelens.operators import duplicates as DU
from wastelens.operators import ordered as O
from wastelens.operators import segments as SG
from wastelens.schemas import DIGEST_FIELDS
from wastelens.session import cut_lineage, ensure_checkpoint_dir
from wastelens.sources import sinks as SK


def log_of(spark, n, seed=3):
    r, rows = random.Random(seed), []
    for i in range(n):
        d = {f: "" for f in DIGEST_FIELDS[:-1]}
        d.update(id=f"{r.randrange(10 ** 6):06d}-{i}", timestamp_local=f"t{r.randrange(20):02d}", suite=r.choice(["a", "b", None]), date=f"d{r.randrange(3)}",
                 shift=r.choice(["hot"] * 6 + ["a", "b", None] + [f"x{j}" for j in range(10)]), notes=r.choice(["n", "é|", ""]))
        rows.append(d)
    return rows, spark.createDataFrame(rows, ", ".join(f"{f} string" for f in DIGEST_FIELDS[:-1])).repartition(5)


def test_short_digests_give_any_text_back(spark):
    a = hashlib.sha256(b"a").hexdigest()
    texts = [a, a.upper(), a + "\n", a[:62], a[:-1] + "g", "", "x", "é" * 16, "ab" * 16, "0" * 31, "\x00", "\x00" * 33, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("b", S.short_digest("t"))
    got = {r.i: (r.t2, r.b) for r in df.withColumn("t2", S.long_digest("b")).collect()}
    assert [got[i][0] for i in range(len(texts))] == texts
    assert len(got[0][1]) == 32 and len({bytes(b) for _, b in got.values() if b is not None}) == len(texts) - 1
    stored = cut_lineage(df.select("i", "t"), ["t"])
    assert {r.i: r.t for r in stored.collect()} == dict(enumerate(texts))


@pytest.mark.parametrize("rows,size,chunk", [(400, 16, 5), (400, 4, 30), (300, 7, 40)])
def test_segments_cut_by_the_bounds_of_chunks(spark, monkeypatch, rows, size, chunk):
    """Segments that span several chunks, chunks of several chains, nulls in the key: places and hashes as by hand."""
    monkeypatch.setattr(SG, "ROWS_A_CHUNK", chunk)
    monkeypatch.setattr(SG, "SEGMENTS_A_CHUNK", 0)
    data, df = log_of(spark, rows)
    got = SG.build_segments(df, ["shift"], size=size)
    assert got.columns == [*df.columns, "segment", "place", "prev_hash", "hash"]
    want, chains = {}, {}
    for d in data:
        chains.setdefault(d["shift"], []).append(d)
    for k, v in chains.items():
        prev = ""
        for n, d in enumerate(sorted(v, key=lambda d: (d["timestamp_local"], d["id"]))):
            prev = prev if n % size else ""
            h = hashlib.sha256("|".join([*(d[f] or "" for f in DIGEST_FIELDS[:-1]), prev]).encode()).hexdigest()
            want[(k, n // size, n % size)], prev = (d["id"], prev, h), h
    got = got.collect()
    assert len(got) == rows and {(x.shift, x.segment, x.place): (x.id, x.prev_hash, x.hash) for x in got} == want


def test_segments_are_linked_without_another_exchange_of_rows(spark):
    """Rows laid in order are linked in place; only the rows around the chunks' bounds are dealt out by segment."""
    _, df = log_of(spark, 50)
    rows = SG.lay(df, [F.col("shift"), F.col("timestamp_local"), F.col("id")], df, 16)
    plan = SG.build_segments(rows, ["shift"], size=16, laid=True)._jdf.queryExecution().executedPlan().toString()
    whole = plan[plan.index("Union"):plan.index("Exchange")]
    assert whole.count("MapInArrow") >= 1 and plan.count("MapInArrow") == 2


def test_problems_are_counted_as_they_are_listed(spark):
    _, df = log_of(spark, 120)
    log = AU.build_chains(df, ("suite", "date")).cache()
    kind = F.crc32("id") % 11
    bad = log.where(kind != 0).withColumns({
        "notes": F.when(kind == 1, "x").otherwise(F.col("notes")), "prev_hash": F.when(kind == 2, "").when(kind == 3, None).otherwise(F.col("prev_hash")),
        "hash": F.when(kind == 4, "no digest").when(kind == 5, None).otherwise(F.col("hash"))})
    bad = bad.unionByName(bad.where(kind == 6))
    for t in (log, bad):
        listed = AU.verify_chains(t).groupBy("suite", "date").agg(F.count(F.lit(1)).alias("n"))
        by = {(r.suite, r.date): r.n for r in listed.collect()}
        got = AU.chain_summary(t)
        assert got.columns == ["suite", "date", "rows", "problems", "verified"]
        got = got.collect()
        assert {(r.suite, r.date): r.rows for r in got} == {(r.suite, r.date): r["count"] for r in t.groupBy("suite", "date").count().collect()}
        for r in got:  # chains without a whole key match no problem, as before
            assert r.problems == (by.get((r.suite, r.date), 0) if r.suite is not None else 0) and r.verified == (r.problems == 0)
    assert any(r.problems for r in got)
    plan = AU.chain_summary(bad)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan


def test_chains_of_laid_rows_are_the_same(spark):
    _, df = log_of(spark, 100)
    a = AU.build_chains(df)
    b = AU.build_chains(cut_lineage(df.repartition("suite", "date")), laid=True)
    assert "Exchange" not in b._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.hash for r in a.collect()) == sorted(r.hash for r in b.collect())


def test_many_bounds_are_planned_in_little_memory(spark):
    """Thousands of chunks: planning did not end, as the size of its conditions grew with the number of bounds."""
    df = spark.range(3000).select((F.col("id") % 7).cast("string").alias("vendor"), F.col("id").cast("double").alias("cost"),
                                  F.timestamp_seconds(F.col("id") % 50).cast("timestamp_ntz").alias("date"), F.lit("d").alias("description"), F.col("id").alias("k"))
    got = DU.keyed_duplicates(df.withColumn("cost", F.col("cost") % 3), ["k"], 4000)
    one = DU.keyed_duplicates(df.withColumn("cost", F.col("cost") % 3), ["k"], 1)
    assert {r.k: r.keyed_dup for r in got.collect()} == {r.k: r.keyed_dup for r in one.collect()}


def test_bounds_of_keys_with_nulls(spark):
    df = spark.createDataFrame([(None if i % 5 == 0 else f"s{i % 3}", i) for i in range(200)], "s string, i int")
    bounds = O.chunk_bounds(df, ["s", "i"], 8, 200)
    got = O.with_chunk(df, ["s", "i"], bounds).collect()
    order = sorted(got, key=lambda r: (r.s is not None, r.s or "", r.i))
    assert [r._chunk for r in order] == sorted(r._chunk for r in got) and len({r._chunk for r in got}) > 4


def test_numbered_rows_are_deleted_when_appended(spark):
    root = tempfile.mkdtemp(prefix="wl-num-")
    shared = ensure_checkpoint_dir(spark).removeprefix("file://")
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), f"2024-01-0{i % 9 + 1}T00:00:00", "m", "n") for i in range(40)]
    df = spark.createDataFrame(rows, "id string, timestamp_local string, material string, notes string")
    before = {f for f in os.listdir(shared) if f.startswith("numbered-")}
    SK.append_log(df, root + "/log", sequence=["timestamp_local", "id"], partitioned=False)
    log = spark.read.parquet(root + "/log").collect()
    assert [r.id for r in sorted(log, key=lambda r: r.seq)] == [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert {f for f in os.listdir(shared) if f.startswith("numbered-")} == before


def test_laid_entries_are_found(spark):
    root = tempfile.mkdtemp(prefix="wl-laid-")
    df = spark.createDataFrame([(str(i), "2024-01-01T00:00:00", f"Kit {i % 3}", "") for i in range(30)], "id string, timestamp_local string, material string, notes string")
    SK.append_entries(SK.rebalanced(df, SK.material_slug(F.col("material"))), root, laid=True)
    assert SK.find_entries(spark, root, "2024-01-01", "Kit 1").count() == 10
