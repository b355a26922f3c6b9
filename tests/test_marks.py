"""Guards of patterns, and the code that Spark makes of the analysis."""

import random

from pyspark.sql import functions as F

from opinara.functions import text as T
from opinara.operators import cleanse, entities
from opinara.plans import registry, synthetic

_PARTS = [
    "LINE", "lıne", "lİne: abc", "line id: x_1", "ไลน์ abc1", "ไอดี:abc", "@shop", "ıg: abcd", "INſTAGRAM: abcd", "tıktok abc", "whatsapp 0812345678", "FB:abc", "HTTPS://a.b", "WwW.x.y", "a.b@c.de", "081-234-5678",
    "12 Rs.", "RS 5", "7 rupeeſ", "฿9", "₹1,2", "5 THB", "ınr 3", "3 DAYS", "๓ วัน", "4 ſtars", "3.5/5", "ดาว", "5 ดาว", "3 เต็ม 5", "SIZE: L", "ſıze x", "colour red", "สี: ดำ", "รุ่น x", "ไซซ์ M",
    "5 ม.ค. 2567", "มกราคม 67", "5 ตxคx 67", "Ju1", "JULY 4", "ſept 5", "laſt week", "thıs month", "2020-01-31", "3.4.1999", "two days ago", "an hour ago", "Tomorrow", "<b>", "&amp;", "&#๓;", "&", "<",
    "😀", "👍🏽", "☀", "→", "₹", "‍", "é", "ß", "ก", "กกกก", "ดีีีี", "aaab", "!!!!", "  ", "\n\n\n", " ", "😀😀😀", "中", "",
]


def _texts() -> list[str]:
    rng = random.Random(5)
    return _PARTS + [" ".join(rng.choices(_PARTS, k=rng.randint(1, 6))) for _ in range(1500)] + ["".join(rng.choices(_PARTS, k=3)) for _ in range(500)]


def _plain_collapse(text):
    text = F.regexp_replace(text, rf"([{T.THAI}])\1{{2,}}", "$1")
    text = F.regexp_replace(text, r"([a-zA-Z])\1{2,}", "$1$1")
    return F.regexp_replace(text, rf"(?U)([^{T.THAI}a-zA-Z\s])\1{{2,}}", "$1")


def test_marks_hide_nothing(spark, monkeypatch):
    """Functions that search only texts with a mark of what they look for give what they give when all texts are searched."""
    df, t = spark.createDataFrame([(x,) for x in _texts()], "t string").coalesce(2), F.col("t")

    def found():
        out = cleanse.contacts(df.withColumn("_t", t)).select("t", F.map_entries("pii_removed").alias("pii"), *(f(t).alias(n) for n, f in {
            "price": entities.price, "days": entities.delivery_days, "stars": entities.stars, "english": entities.english_dates, "thai": entities.thai_dates}.items()), F.map_entries(entities.variant(t)).alias("variant"))
        return out.collect()

    guarded = found()
    monkeypatch.setattr(T, "holds", lambda low, *marks: F.lit(True))
    assert guarded == found() and all(any(r[k] for r in guarded) for k in ("pii", "price", "days", "stars", "english", "thai", "variant"))
    thai, letters = F.length(F.regexp_replace(t, f"[^{T.THAI}]+", "")), F.length(F.regexp_replace(t, f"[^{T.THAI}a-zA-Z]+", ""))
    pairs = {
        "language": (T.language(t), F.when((letters > 0) & (thai / letters >= 0.15), "th").otherwise("en")), "collapse": (T.collapse(t), _plain_collapse(t)),
        "html": (T.strip_html(t), F.regexp_replace(F.regexp_replace(t, T.HTML_TAG, " "), T.HTML_ENTITY, " ")), "had": (T.has_html(t), t.rlike(T.HTML_TAG) | t.rlike(T.HTML_ENTITY)),
        "emoji": (T.strip_emoji(t), F.regexp_replace(t, T.EMOJI, " ")), "count": (T.emoji_count(t), F.length(t) - F.length(F.regexp_replace(t, T.EMOJI, ""))),
        "print": (T.fingerprint(t), F.sha1(F.regexp_replace(F.lower(t), rf"[^\p{{L}}\p{{N}}_{T.THAI}]+", ""))),
    }
    for name, (fast, plain) in pairs.items():
        assert df.where(~fast.eqNullSafe(plain)).select("t").collect() == [], name
    nothing = spark.createDataFrame([(None,)], "t string").select(T.language(t), T.emoji_count(t), T.strip_emoji(t), T.strip_html(t), T.fingerprint(t), T.collapse(t)).first()
    assert tuple(nothing) == ("en", None, None, None, None, None)


def test_reviews_are_those_of_the_sql(spark):
    sf = "/root/testdata/sf0.001"
    plain = spark.sql(synthetic.REVIEWS_SQL.replace("from orders", "from {o}"), o=spark.read.parquet(f"{sf}/orders.parquet"))
    assert synthetic.reviews(spark, sf).exceptAll(plain).count() == 0 and plain.schema.names == synthetic.reviews(spark, sf).schema.names


def test_hits_are_looked_up_by_place(spark):
    """No search for a term among all terms: it took a fifth of the analysis. What is left looks for typos and for aspects."""
    plan = registry.QUERIES["aspect_sentiment"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position") <= 2


def test_methods_are_short_enough_for_the_compiler(spark):
    """Java compiles no method of more than 8,000 bytes of code; longer ones are interpreted for every row. The plan is the one of
    large tables, where nothing is broadcast."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        plan = registry.QUERIES["top_couriers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
        sizes = [stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())]
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert len(sizes) > 5 and max(sizes) <= 8000
