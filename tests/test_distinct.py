"""Work on distinct values: once for each of them, with the results that every row alone would have."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from opinara.operators import contents, naming, tagging
from opinara.plans import analyze as plan
from opinara.plans import registry, synthetic

_TEXTS = ["good quality and fast delivery", "bad product never buy", "ส่งไว แพ็คดี ค่ะ", "", None]


def _counted(spark, kind):
    """A column function that gives null, and a sum of the rows that it was called on."""
    seen = spark.sparkContext.accumulator(0)

    @F.arrow_udf(kind)
    def none(values: pa.Array) -> pa.Array:
        seen.add(len(values))
        return pa.nulls(len(values), pa.list_(pa.struct([("word", pa.string()), ("tag", pa.string())])))

    return none.asNondeterministic(), seen


def test_copies_are_analysed_once(spark):
    rows = [(k, f"R{k}", _TEXTS[k % 5], ["", "phone case", None][k % 3], k * 7) for k in range(300)]
    df = spark.createDataFrame(rows, "pos long, review_id string, raw_text string, product_name string, stars long")
    tagger, seen = _counted(spark, "array<struct<word:string,tag:string>>")
    out = plan.analyze_batch(df, tagger=tagger).select("pos", "raw_text", "product_name", "stars", "keywords").collect()
    # null counts as empty: four texts, two names
    assert len(out) == 300 and seen.value == 8
    assert sorted((r["pos"], r["raw_text"], r["product_name"], r["stars"]) for r in out) == [(k, t or "", n, s) for k, _, t, n, s in rows]


def test_every_row_has_the_results_of_its_values(spark):
    values = [None, "", "a", "b", "a:b", "1:a", "-"]
    rows = [(k, x, y) for k, (x, y) in enumerate((x, y) for x in values for y in values for _ in range(3))]
    df = spark.createDataFrame(rows, "k long, x string, y string").repartition(5)
    step = lambda d: d.withColumn("said", F.concat_ws("|", F.coalesce("x", F.lit("null")), F.coalesce("y", F.lit("null")), "n"))
    out = contents.on_distinct(df, {"x": F.col("x"), "y": F.col("y")}, step, n=F.count("*")).collect()
    text = lambda v: "null" if v is None else v
    assert sorted(tuple(r[c] for c in ("k", "x", "y", "said")) for r in out) == [(k, x, y, f"{text(x)}|{text(y)}|3") for k, x, y in rows]
    again = contents.on_distinct(df, {"x": F.col("x")}, lambda d: d.withColumn("y", F.lit(1)))
    assert again.columns.count("y") == 1 and again.where("y = 1").count() == len(rows)


def test_names_are_looked_for_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.arrow_udf("struct<org:array<string>,place:array<string>,date:array<string>>")
    def none(texts: pa.Array) -> pa.Array:
        seen.add(len(texts))
        return pa.nulls(len(texts), pa.struct([(k, pa.list_(pa.string())) for k in ("org", "place", "date")]))

    monkeypatch.setattr(naming, "fit", lambda labelled: None)
    monkeypatch.setattr(naming, "finder", lambda spark, model: none.asNondeterministic())
    sf = "/root/testdata/sf0.001"
    texts = synthetic.reviews(spark, sf).select("raw_text")
    assert registry.QUERIES["names_learned"](spark, sf).select("pos", "org").toArrow().num_rows == texts.count()
    assert seen.value == texts.distinct().count() < texts.count()


def test_words_are_tagged_once(spark, monkeypatch):
    tagger, seen = _counted(spark, "array<struct<word:string,tag:string>>")
    monkeypatch.setattr(tagging, "tagger", lambda spark, model: tagger)
    sf = "/root/testdata/sf0.001"
    texts = synthetic.reviews(spark, sf).select("raw_text")
    assert registry.QUERIES["pos_tags_learned"](spark, sf).toArrow().num_rows == texts.count()
    assert seen.value == texts.distinct().count() < texts.count()


def test_sentences_count_so_many_times(spark):
    rows = [([("good", "ADJ"), ("box", "NOUN")], 3), ([("Box", "NOUN")], 1), ([("works", "VERB"), ("good", "X")], 2), ([], 5)]
    kind = "pos_tags array<struct<word:string,tag:string>>, n long"
    once, many = spark.createDataFrame(rows, kind), spark.createDataFrame([r for r in rows for _ in range(r[1])], kind)
    a, b = tagging.fit(once, times="n"), tagging.fit(many)
    assert a.tags == b.tags and all(np.allclose(getattr(a, k), getattr(b, k)) for k in ("first", "after", "unknown"))
    assert a.words.keys() == b.words.keys() and all(np.allclose(a.words[w], b.words[w]) for w in a.words)


def test_duplicates_are_looked_for_only_where_asked_for(spark):
    sf = "/root/testdata/sf0.001"
    plan_of = lambda name: registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # the reviews are made twice: for the rows, and for their distinct contents
    for name in ("pros_cons", "aspect_sentiment"):
        assert "fingerprint" not in plan_of(name) and plan_of(name).count("Relation [") == 2
    assert "fingerprint" in plan_of("screening_results")


def test_only_what_is_asked_for_is_made(spark):
    """Praise and blame need neither the finds of contacts as a map nor, without a tagger, word classes."""
    plan = registry.QUERIES["pros_cons"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "pii_removed" not in plan and "pos_tags" not in plan
