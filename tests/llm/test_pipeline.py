"""The pipeline's stages on planted cases, and its guard in the entry module."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P


@pytest.fixture(scope="module")
def corpus(spark, make_docs, tmp_path_factory):
    r = random.Random(6)

    def prose(n):
        return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))
    passage, item = prose(60), prose(25)
    rows, labels = [], []
    for i in range(200):
        text = prose(r.randint(60, 120))
        if i % 5 == 0:
            for k in range(3):
                text = text.replace(" ", " zorr" + r.choice("aeiou") + "ba ", 1) if k == 0 else text + " zorrle" + "aeiou"[k] + " end"
        labels.append((i, 1, int(i % 5 == 0)))
        rows.append((i, text))
    clean = [i for i in range(200) if i % 5]
    rows += [(300, rows[clean[0]][1]), (301, rows[clean[1]][1].replace(" ", "\n").upper()), (302, prose(50) + " " + passage), (303, prose(50) + " " + passage),
             (304, prose(40) + " " + item + " " + prose(40)), (305, None), (306, ""), (307, rows[clean[2]][1]), (307, rows[clean[2]][1])]
    folder = tmp_path_factory.mktemp("corpus")
    docs = make_docs(rows, id=1, key="k", row=2, kept="x", _score=3).withColumn("lang", F.when(F.col("doc_id") != 7, F.col("lang")))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "x y")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), clean


def test_stages_catch_planted_cases_and_keep_clean_rows(spark, corpus, tmp_path):
    folder, clean = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in seen]
    assert len([i for i in ids[0] if i < 200 and i % 5]) >= 0.97 * len(clean)
    assert len([i for i in ids[0] if i < 200 and i % 5 == 0]) <= 4
    assert not {300, 301, 307} & set(ids[1]) and len(ids[1]) == len(set(ids[1])) and len({305, 306} & set(ids[1])) == 1
    texts = {r.doc_id: r for r in seen[2].collect()}
    before = {r.doc_id: r for r in seen[1].collect()}
    assert texts[302].text == before[302].text and len(texts[303].text) < len(before[303].text) - 200
    assert texts[303].n_chars == len(texts[303].text)
    assert set(ids[2]) - set(ids[3]) == {304}
    assert set(ids[4]) == set(ids[3])


def test_run_gives_the_packed_pieces(spark, corpus):
    got = P.run(spark, corpus[0])
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 100


def test_a_row_repeated_often_is_one_document(spark, corpus, make_docs):
    folder, _ = corpus
    text = "words of one row that many rows repeat and nothing else holds them " * 3
    docs = make_docs([(7, text)] * 1500 + [(8, text), (9, None), (None, None)])
    kept = P.drop_near_duplicates(spark, docs, folder)
    assert sorted((r.doc_id, (r.text or "")[:7]) for r in kept.collect()) == [(7, "words o"), (9, "")]
    cut = P.drop_repeated_passages(spark, docs, folder)
    assert cut.where("doc_id = 7").count() == 1500 and cut.where("doc_id = 8").count() == 0  # all of it stands in 7
    assert {r.text for r in cut.where("doc_id = 7").select("text").distinct().collect()} == {text}


def test_stages_on_an_empty_table(spark, corpus, make_docs):
    folder, _ = corpus
    empty = make_docs([])
    for _, stage in P.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_entry_adds_the_queries():
    import __spark_entry__ as E

    names = set(E.queries())
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13
    assert set(E.oracle_sql()) <= names and "pipeline" not in E.oracle_sql()
