import random
import re

import pytest
from pyspark.sql import functions as F

from opinara.functions import lexicon as L
from opinara.functions import text as T
from opinara.operators import cleanse, corpus, evaluate, matching, sampling, summary
from opinara.plans import analyze as plan
from opinara.plans import registry
from opinara.sources import reviews as source

SAMPLES = [
    (0, "A1", "Good quality and fast delivery. Rs. 1,290 only", ""), (1, "A2", "good QUALITY and fast delivery rs 1290 only!!", ""), (2, "A3", "", ""), (3, "A4", None, None), (4, "A5", "😀😀", ""),
    (5, "A6", "ไม่คุ้ม ส่งช้า บริการแย่", ""), (6, "A7", "contact me line id: shop99 order now", ""), (7, "A8", "not as described, wrong size", "phone case"), (8, "A9", "good quality and fast delivery, Rs. 1,290 only", ""),
]


@pytest.fixture(scope="module")
def results(spark):
    df = spark.createDataFrame(SAMPLES, "pos long, review_id string, raw_text string, product_name string")
    return {r["review_id"]: r for r in plan.analyze_batch(df).collect()}


def test_analysis(results):
    assert results["A1"]["aspect_sentiment"] == {"quality": "pos", "shipping": "pos", "price_value": "neutral"} and results["A1"]["price"] == 1290.0
    assert results["A9"]["price"] is None  # a comma before the currency is taken for the amount
    assert results["A9"]["duplicate_of"] == "A1" and results["A9"]["is_duplicate"]
    assert results["A6"]["lang"] == "th" and results["A6"]["aspect_sentiment"] == {"price_value": "neg", "shipping": "pos", "seller_service": "neg"}  # a negation reaches over one word
    assert results["A7"]["is_ad_spam"] and results["A7"]["review_status"] == L.STATUS_SPAM
    assert results["A8"]["aspect_sentiment"] == {"as_described": "neg"} and results["A8"]["product_type"] == "มือถือ / แท็บเล็ต"
    assert "emoji_only" in results["A5"]["spam_signals"] and results["A4"]["duplicate_of"] == "A3"
    for r in results.values():
        assert -1 <= r["sentiment_score"] <= 1 and 0 <= r["credibility_score"] <= 100


def test_hits_equal_regular_expressions(spark):
    rng = random.Random(1)
    words = ["good", "not", "worth", "the", "money", "product", "nice", "x", "best", "price", "ดี", "มาก", "ส่ง", "ช้า", "ไม่", "ดีมาก"]
    rows = [(k, [rng.choice(words) for _ in range(rng.randint(0, 14))]) for k in range(300)]
    got = spark.createDataFrame(rows, "k long, tokens array<string>").withColumn("hits", matching.token_hits(F.col("tokens"), plan.TERMS)).select("k", matching.kept(F.col("hits"), [t for t, *_ in L.aspect_terms()] ).alias("h")).collect()
    terms = list(dict.fromkeys(t for t, *_ in L.aspect_terms()))
    for r in got:
        text = " ".join(rows[r["k"]][1])
        found = []
        for t in terms:
            p = r"(?:(?<=\s)|^)" + r"\s*".join(map(re.escape, t)) if matching.is_thai(t) else rf"\b{re.escape(t)}\b"
            found += [(m.start(), -m.end(), t) for m in re.finditer(p, text)]
        expected = []
        for h in sorted(found, key=lambda h: h[:2]):
            if not any(k[0] <= h[0] and -h[1] <= -k[1] for k in expected):
                expected.append(h)
        assert [(h["start"], h["neg"]) for h in r["h"]] == [h[:2] for h in expected], text


def test_text_functions(spark):
    row = lambda expr, x: spark.createDataFrame([(x,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]
    assert row(T.collapse, "soooo มากกกก !!! 1000 aab") == "soo มาก ! 10 aab"
    assert row(T.squeeze, " a \t b\tc ") == "a b\tc"
    assert row(T.language, "") == "en" and row(T.language, "ดี ok") == "th"
    assert row(T.contacts, "see https://a.b/c mail x@y.zz or 081-234-5678") == {"url": ["https://a.b/c"], "email": ["x@y.zz"], "phone": ["081-234-5678"]}
    assert row(T.strip_html, "<b>x</b>&amp;") == " x  "


def test_words_mended(spark):
    vocab = spark.createDataFrame([("the",), ("good",), ("product",), ("so",)], "word string")
    rank = cleanse.ranks(vocab)
    df = spark.createDataFrame([("goodproduct theproduct soo xyzzy",), (None,)], "t string")
    assert [r[0] for r in df.select(cleanse.word_fixer(spark, rank, "split")("t")).collect()] == ["good product the product soo xyzzy", None]
    assert df.select(cleanse.word_fixer(spark, rank, "double")("t")).first()[0] == "goodproduct theproduct so xyzzy"


def test_summaries_and_evaluation(spark):
    df = spark.createDataFrame(SAMPLES, "pos long, review_id string, raw_text string, product_name string").withColumn("expected_aspects", F.lit("quality:pos|shipping:neg"))
    out = plan.analyze_batch(df).withColumn("expected", evaluate.parse_expected(F.col("expected_aspects"))).persist()
    assert summary.status_counts(out).first()["total"] == len(SAMPLES)
    assert {r["key"] for r in summary.aspect_summary(out).collect()} >= {"quality", "shipping"}
    assert summary.top_terms(out, "pros").first()["n"] >= 2
    overlap = evaluate.aspect_overlap(out).first()
    assert overlap["tp"] > 0 and 0 <= overlap["f1"] <= 1
    assert plan.export(out).columns[-1] == "aspect_seller_service"


def test_empty_table(spark):
    df = spark.createDataFrame([], "pos long, review_id string, raw_text string, product_name string")
    out = plan.analyze_batch(df)
    assert out.count() == 0 and summary.status_counts(out).first()["total"] == 0


def test_corpus(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"]), (3, ["b", "c"]), (4, []), (5, ["d"])], "id long, w array<string>")
    found = {r["term"]: r["weight"] for r in corpus.tfidf_keywords(df, "id", "w").collect()}
    assert set(found) == {"a", "b", "c"} and all(abs(x - 2 * 0.5**0.5 / 4) < 1e-4 for x in found.values())
    assert corpus.lda_topics(df, "id", "w", topics=5)[0].count() == 0


def test_sampling(spark):
    df = spark.createDataFrame([(k, ["negative", "neutral", "positive"][min(k % 7, 2)]) for k in range(90)], "id long, label string")
    counts = {r["label"]: r["count"] for r in sampling.balanced_sample(df, 30, "id", "label").groupBy("label").count().collect()}
    assert counts == {"negative": 10, "neutral": 10, "positive": 10}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "q", y\nz'), ("b", "")], "id string, text string")
    source.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, source.read_csv(spark, str(tmp_path / "c")).collect())) == [("a", 'x "q", y\nz'), ("b", "")]


def test_inner_words_of_whole_texts(spark, tmp_path):
    rng = random.Random(11)
    rows = [(k, " ".join("".join(rng.choices("abé", k=rng.choice([0, 1, 2, 3, 5, 40]))) for _ in range(n)), len_) for k, (n, len_) in enumerate([(0, 0), (1, 2), (30, 90), (900, 5000), (600, None), (80, 2999)])]
    spark.createDataFrame([*rows, (99, None, None)], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["outer_words"] for r in registry.QUERIES["drop_substrings"](spark, str(tmp_path)).collect()}
    for k, text, _ in rows:
        once = list(dict.fromkeys(text.split(" ")))
        assert got.pop(k) == [t for t in once if not any(u != t and t in u for u in once)]
    assert got == {99: None}


def test_quota_sample_is_filled_up(spark):
    """The registered query against its SQL, down to the last stratum."""
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view orders as from '{folder}/orders.parquet'")
    want = con.sql(f"select pos, stratum from ({registry.ORACLE_SQL['quota_sample']})").fetchall()
    got = [tuple(r) for r in registry.QUERIES["quota_sample"](spark, folder).select("pos", "stratum").collect()]
    assert len(got) == sampling.SAMPLE_ROWS and sorted(got) == sorted(want) and any(s == len(sampling.QUOTAS) for _, s in got)
