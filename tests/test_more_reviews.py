import random
import re

import pytest
from pyspark.sql import functions as F

from opinara.operators import cleanse, matching, sampling, summary
from opinara.plans import analyze as plan
from opinara.plans import registry
from opinara.sources import reviews as source
from opinara.streaming import reviews as stream

ROWS = [(k, f"R{k}", t, "") for k, t in enumerate(["good quality and fast delivery", "bad product never buy call 081-234-5678", "good quality and fast delivery", "ส่งไว แพ็คดี ค่ะ", "", None, "nice phone 4 stars Rs. 90"])]
SCHEMA = "pos long, review_id string, raw_text string, product_name string"


def cheapest(run, words):
    """Fewest unknown characters, then fewest tokens, over all ways to cut a run."""

    def walk(at, unknown, tokens, open_):
        if at == len(run):
            yield unknown, tokens
            return
        yield from walk(at + 1, unknown + 1, tokens + (not open_), True)
        for n in range(1, len(run) - at + 1):
            if run[at : at + n] in words:
                yield from walk(at + n, unknown, tokens + 1, False)

    return min(walk(0, 0, 0, False))


def test_thai_tokens_are_the_cheapest(spark):
    rng = random.Random(31)
    words = {"".join(rng.choices("กขคง", k=rng.randint(1, 4))) for _ in range(14)} | {"กข", "กขค", "ง"}
    runs = ["".join(rng.choices("กขคงจ", k=rng.randint(1, 9))) for _ in range(300)]
    got = spark.createDataFrame([(r,) for r in runs], "t string").select("t", cleanse.thai_tokenizer(words)("t").alias("w")).collect()
    for r in got:
        unknown = [w for w in r["w"] if w not in words]
        assert "".join(r["w"]) == r["t"] and (sum(map(len, unknown)), len(r["w"])) == cheapest(r["t"], words), (r["t"], r["w"])
    mixed = spark.createDataFrame([("กข ab12 !x",), (None,)], "t string").select(cleanse.thai_tokenizer(words)("t")).collect()
    assert mixed[0][0] == ["กข", "ab", "12", "!", "x"] and mixed[1][0] is None


def test_filters_on_results(spark):
    """Filters and generators over the analysis give the rows that they give over its written result."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = plan.analyze_batch(df)
    kept = {r["review_id"]: r for r in out.collect()}
    for cond in ("is_duplicate", "size(pros) > 0", "review_status <> 'x' and lang = 'th'", "size(pii_removed) > 0", "size(tokens) > 3"):
        got = {r["review_id"] for r in out.where(cond).select("review_id").collect()}
        assert got == {r["review_id"] for r in spark.createDataFrame(list(kept.values()), out.schema).where(cond).collect()}, cond
    said = out.select(F.explode("aspect_sentiment")).count()
    assert said == sum(len(r["aspect_sentiment"]) for r in kept.values())
    sections = summary.summarize(out)
    assert sections["status"].first()["total"] == len(ROWS) and {r["term"] for r in sections["top_pros"].collect()} >= {"good quality", "fast delivery"}
    one = plan.analyze(spark, "good quality", review_id="x").first()
    assert one["review_id"] == "x" and one["pros"] == ["good quality"]


def test_numbering_in_blocks(spark):
    rng = random.Random(32)
    rows = [(rng.randrange(50), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    for descending in (False, True):
        got = {r["n"]: (r["a"], r["b"]) for r in sampling.numbered(df, "a", "n", ("b",), descending, block=100).collect()}
        assert [got[k] for k in range(3000)] == sorted(rows, key=lambda r: (-r[0] if descending else r[0], r[1]))
    assert sampling.numbered(df.limit(0), "a", "n").count() == 0


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("a", "NA"), ("b", None), ("c", "x")], "id string, text string")
    source.write_csv(df, str(tmp_path / "c"))
    assert {r["id"]: r["text"] for r in source.read_csv(spark, str(tmp_path / "c")).collect()} == {"a": "NA", "b": "", "c": "x"}
    assert {r["id"]: r["text"] for r in source.read_csv(spark, str(tmp_path / "c"), strict=True).collect()} == {"a": None, "b": None, "c": "x"}
    vocab = spark.createDataFrame([("the", 3), ("of", 2)], "word string, n long")
    source.write_vocabulary(vocab, str(tmp_path / "v"))
    assert [(r["word"], r["rank"]) for r in source.read_vocabulary(spark, str(tmp_path / "v")).collect()] == [("the", 0), ("of", 1)]
    assert [r["review_id"] for r in source.numbered(df, "id").orderBy("id").collect()] == ["TH0001", "TH0002", "TH0003"]


def test_streams(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("at", F.timestamp_seconds(F.lit(1_000_000) + F.col("pos") * 60))
    df.write.parquet(str(tmp_path / "in"))
    source_ = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    stream.write_stream(stream.analyze_stream(source_()).drop("pii_removed", "variant", "aspect_evidence"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    got = {r["review_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["review_id"]: r for r in plan.analyze_batch(df).collect()}
    assert set(got) == set(want) and all(got[k][c] == want[k][c] for k in want for c in ("clean_text", "tokens", "aspects", "pros", "overall_sentiment", "brand"))
    stream.write_stream(stream.first_reviews(source_(), "at"), str(tmp_path / "first"), str(tmp_path / "c2")).awaitTermination()
    assert {r["fingerprint"] for r in spark.read.parquet(str(tmp_path / "first")).collect()} == {r["fingerprint"] for r in want.values()}
    assert spark.read.parquet(str(tmp_path / "first")).count() == len({r["fingerprint"] for r in want.values()})
    windows = stream.aspect_windows(spark.read.parquet(str(tmp_path / "out")), "at").groupBy().agg(F.sum("n")).first()[0]
    assert windows == sum(len(r["aspect_sentiment"]) for r in got.values())


def test_hits_are_in_order(spark):
    tokens = spark.createDataFrame([(["not", "worth", "the", "money", "ส่ง", "ช้า", "worth"],), ([],), (None,)], "w array<string>")
    for r in tokens.select(matching.token_hits(F.col("w"), plan.TERMS).alias("h")).collect():
        places = [(h["start"], h["neg"], h["ord"]) for h in r["h"]]
        assert places == sorted(places)


def test_topic_assignments(spark):
    rows = [(k, ["cat", "dog", "pet"] if k % 2 else ["car", "road", "fuel"]) for k in range(40)] + [(99, [])]
    df = spark.createDataFrame(rows, "id long, w array<string>")
    from opinara.operators import corpus

    topics, given = corpus.lda_topics(df, "id", "w", topics=2)
    assert [len(r["words"]) for r in topics.collect()] == [6, 6]
    found = {r["id"]: r["topic_id"] for r in given.collect()}
    assert found[99] is None and all(found[k] in (0, 1) for k, _ in rows[:40]) and len(found) == 41


@pytest.mark.parametrize("name", ["analysis_with_models"])
def test_models_are_driven(spark, name):
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert any(r["keywords"] for r in got) and any(r["seller_shop"] for r in got) and any(re.search("days", " ".join(r["date_mentioned"])) for r in got)
