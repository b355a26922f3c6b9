"""Lexicon matching and inner terms against plain searches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from opinara.functions import lexicon as L
from opinara.functions import text as T
from opinara.operators import matching, summary
from opinara.plans import analyze as plan
from opinara.plans import registry


def plain_hits(text, terms, tokens=False):
    """Every term by a pattern of its own; of equal terms the first."""
    out, seen = [], set()
    for k, t in enumerate(terms):
        key = "".join(t.lower().split()) if matching.is_thai(t) else t.lower()
        if (matching.is_thai(t), key) in seen:
            continue
        seen.add((matching.is_thai(t), key))
        if matching.is_thai(t):
            pattern = r"(?:(?<=\s)|^)" + r"\s*".join(map(re.escape, key))
        else:
            pattern = (r"(?<!\S){}(?!\S)" if tokens else r"(?<!\w){}(?!\w)").format(re.escape(t.lower()))
        out += [(m.start(), -m.end(), k, t) for m in re.finditer(pattern, text.lower())]
    return sorted(out)


def test_hits_of_random_lexicons(spark):
    rng = random.Random(11)
    letters = ["a", "b", "A", "ก", "ข", "ค", "1", "_", "-"]
    word = lambda n: "".join(rng.choices(letters, k=rng.randint(1, n)))
    terms = [" ".join(word(3) for _ in range(rng.randint(1, 2))) for _ in range(60)] + ["a-b", "ก ข", "กข", "A b"]
    texts = [" ".join(word(4) for _ in range(rng.randint(0, 9))) for _ in range(400)] + ["", None, "İ a ก ข", "ab " * 20_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", matching.text_hits(F.col("t"), terms).alias("h"), matching.token_hits(F.split("t", " "), terms).alias("w"), matching.gazetteers(F.col("t"), {"one": terms[:30], "two": terms}).alias("g")).collect()
    for r in got:
        text = (r["t"] or "").replace("İ", "i")
        assert [tuple(h) for h in r["h"]] == plain_hits(text, terms), r["t"]
        assert [tuple(h) for h in r["w"]] == plain_hits(text, terms, tokens=True), r["t"]
        for name, own in (("one", terms[:30]), ("two", terms)):
            assert r["g"][name] == sorted({h[3] for h in matching.outermost(plain_hits(text, own))})


def test_lexicon_of_many_terms(spark):
    rng = random.Random(12)
    terms = list({"".join(rng.choices("abcdefghij", k=rng.randint(4, 9))) for _ in range(120_000)})[:100_000]
    assert len(terms) == 100_000
    rows = [" ".join(rng.choice(terms) if rng.random() < 0.5 else "".join(rng.choices("abcdefghij", k=5)) for _ in range(20)) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", matching.text_hits(F.col("t"), terms).alias("h")).collect()
    known = {t: k for k, t in enumerate(terms)}
    for r in got:
        assert [(h["ord"], h["term"]) for h in r["h"]] == [(known[w], w) for w in r["t"].split() if w in known]


def test_inner_terms(spark):
    rng = random.Random(13)
    rows = [["".join(rng.choices("abกé", k=rng.randint(0, 5))) for _ in range(rng.randint(0, 30))] for _ in range(400)]
    rows += [None, [""], ["", "a"], ["a" * 5000, "a" * 40, "b"], ["a", "a"], ["ab " * 30, "ab", "b a"]]
    got = spark.createDataFrame([(x,) for x in rows], "w array<string>").select("w", matching.drop_inner_long(F.col("w")), matching.drop_inner(F.col("w"))).collect()
    for words, outer, short in got:
        want = None if words is None else [t for t in dict.fromkeys(words) if not any(t != u and t in u for u in words)]
        assert outer == want and short == want


def test_summaries_keep_the_analysis_once(spark):
    """Sections of a summary look at the analysis once: their plans are about as large as that of the screening they rest on."""
    out = plan.analyze_batch(spark.createDataFrame([(1, "a", "good", "")], "pos long, review_id string, raw_text string, product_name string"))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    base = size(out.select("pos", "aspect_sentiment", "pros", "cons", "review_status", "price", "delivery_days", "brand", "overall_sentiment"))
    assert all(size(df) < 1.2 * base for df in summary.summarize(out).values())
    assert size(summary.aspect_summary(out)) < 1.2 * size(out.select("aspect_sentiment", "review_status"))


def test_names_overlap():
    assert "Kerry Express" in L.COURIERS or L.COURIERS
    book = matching.Lexicon(["flash express", "flash", "express way"])
    assert [h[3] for h in book.in_text("Flash Express way")] == ["flash express", "flash", "express way"]
    assert [h[3] for h in matching.outermost(book.in_text("Flash Express way"))] == ["flash express", "express way"]


@pytest.mark.parametrize("name,most", [("browse_results", 80_000), ("polarity_mistakes", 60_000), ("aspect_evidence", 50_000), ("general_hits", 50_000), ("variant_pairs", 40_000)])
def test_filters_do_not_repeat_the_analysis(spark, name, most):
    """Filters on results, and those that Spark takes from generators and comparisons, stay above what they are made from."""
    out = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < most


def test_ends_of_stored_texts(spark):
    texts = ["", " ", "a", " a", "a ", "\n a b \t", " x ", "a\u0085", "​z", "é 😀 ", "ก ", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.strip(F.col("t")).alias("a"), T.strip_ends(F.col("t")).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]
