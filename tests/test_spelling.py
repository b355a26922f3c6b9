"""Spelling: nothing that grows with the vocabulary is broadcast, known words leave within the row."""

import pytest
from pyspark.sql import functions as F

from opinara.operators import spelling


@pytest.fixture
def tables(spark, tmp_path):
    known = [("good", 90), ("goods", 60), ("quality", 80), ("delivery", 70), ("the", 99)]
    docs = [(1, ["the", "goood", "qualty", "goood"]), (2, []), (3, None), (4, ["the", None, "good"]), (5, ["delivry", "xyzzyx"]), (6, ["the"])]
    spark.createDataFrame(known, "word string, n long").write.parquet(str(tmp_path / "known"))
    spark.createDataFrame(docs, "id long, w array<string>").repartition(2).write.parquet(str(tmp_path / "docs"))
    known, docs = (spark.read.parquet(str(tmp_path / x)) for x in ("known", "docs"))
    found = spelling.corrections(docs.select(F.explode("w").alias("token")), known)
    found.write.parquet(str(tmp_path / "found"))
    return known, docs, found, spark.read.parquet(str(tmp_path / "found"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_side_is_broadcast(tables):
    known, docs, found, written = tables
    assert "Broadcast" not in plan(found)
    done = plan(spelling.correct(docs, "id", "w", written, known))
    # fixes by row may be broadcast where Spark has found them to be few
    assert "LeftAnti" not in done and "Inner, BuildRight" not in done and "Inner, BuildLeft" not in done


def test_the_same_with_known_words_joined(tables, monkeypatch):
    known, docs, _, written = tables
    want = {1: ["the", "good", "quality", "good"], 2: [], 3: None, 4: ["the", None, "good"], 5: ["delivery", "xyzzyx"], 6: ["the"]}
    for most in (spelling.MAX_SHARED, 0):
        monkeypatch.setattr(spelling, "MAX_SHARED", most)
        done = spelling.correct(docs, "id", "w", written, known)
        assert ("LeftAnti" in plan(done)) == (most == 0)
        assert {r["id"]: r["w"] for r in done.collect()} == want


def test_no_known_words(tables):
    known, docs, _, written = tables
    assert {r["id"]: r["w"] for r in spelling.correct(docs, "id", "w", written.limit(0), known.where("n < 0")).collect()} == {r["id"]: r["w"] for r in docs.collect()}
