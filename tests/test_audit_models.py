import datetime as dt

from pyspark.sql import functions as F

from wastelens.operators import audit as AU
from wastelens.operators import outliers as OU
from wastelens.schemas import DIGEST_FIELDS


def _log(spark, n=3):
    rows = []
    for i in range(n):
        r = {f: "" for f in DIGEST_FIELDS[:-1]}
        r.update(id=f"id{i}", timestamp_local=f"2024-01-01T0{i}:00:00", date="2024-01-01",
                 suite="C Space", material="Lovo Kit", quantity=str(i + 1), notes=f"n{i}")
        rows.append(r)
    return spark.createDataFrame(rows)


def test_chain_f15(spark):
    chained = AU.build_chains(_log(spark), ("suite", "date")).cache()
    assert AU.verify_chains(chained, ("suite", "date")).count() == 0
    edited = chained.withColumn("notes", F.when(F.col("id") == "id1", "changed").otherwise(F.col("notes")))
    assert {r.problem for r in AU.verify_chains(edited).collect()} == {"digest"}
    deleted = chained.where("id != 'id1'")
    assert "dangling" in {r.problem for r in AU.verify_chains(deleted).collect()}
    first = chained.where("id = 'id0'").first()
    swapped = chained.withColumn("prev_hash", F.when(F.col("id") == "id2", F.lit(first.hash)).otherwise(F.col("prev_hash")))
    assert {"digest", "fork"} <= {r.problem for r in AU.verify_chains(swapped).collect()}
    extra = chained.withColumn("prev_hash", F.when(F.col("id") == "id1", F.lit("")).otherwise(F.col("prev_hash")))
    assert "genesis" in {r.problem for r in AU.verify_chains(extra).collect()}
    seal = AU.daily_seal(chained).collect()
    assert len(seal) == 1 and seal[0].chains == 1


def test_isolation_forest(spark):
    rows = [(i, float(i % 7 + 1), float((i % 13) * 3 + 10)) for i in range(2000)]
    rows += [(5000 + j, 500.0, 90000.0 + j) for j in range(5)]
    d = spark.createDataFrame(rows, "k long, qty double, cost double")
    out, meta = OU.flag_anomalies(d, ["k"])
    got = out.collect()
    share = sum(r.ai_anomaly for r in got) / len(got)
    assert 0.04 <= share <= 0.06
    assert all(r.ai_anomaly for r in got if r.k >= 5000)
    out2, _ = OU.flag_anomalies(d, ["k"])
    a = {r.k: r.ai_score for r in got}
    assert all(abs(a[r.k] - r.ai_score) < 1e-12 for r in out2.collect())
    assert OU.flag_anomalies(d.drop("qty", "cost"), ["k"])[1]["message"] == "neither qty nor cost is a column"
    assert OU.anomaly_metadata(out).first().n_records == 2005
