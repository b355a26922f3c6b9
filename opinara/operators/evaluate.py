"""Evaluation of results against labels: overlaps, confusion, rates of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions import text as T

# When a check of days or of a price applies.
DAYS_SAID = r"(?iu)\p{Nd}+\s*(?:วัน|days?)(?![\p{L}\p{N}_])"
PRICE_SAID = r"(?iu)(?:฿|₹|(?<![\p{L}\p{N}_])rs\.?)\s*\p{Nd}|\p{Nd}\s*(?:บาท|(?<![\p{L}\p{N}_])rs(?![\p{L}\p{N}_])|rupees)"
# End of the fixed values.


def parse_expected(value: Column) -> Column:
    """``a:x|b:y`` as a map, parts trimmed, parts without a colon left out, the last of equal keys kept."""
    parts = F.filter(F.split(F.coalesce(value, F.lit("")), r"\|"), lambda p: F.contains(p, F.lit(":")))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("k"), F.trim(F.substr(p, F.instr(p, ":") + 1)).alias("v")))
    return F.map_from_entries(T.let(pairs, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"]))))


def aspect_overlap(df: DataFrame, expected: str = "expected", got: str = "aspect_sentiment", lang: str | None = None) -> DataFrame:
    """One row: tp, fp, fn, same (polarity) and precision, recall, f1 over rows (of a language) with expectations; 0 where
    nothing is to divide."""
    df = df if lang is None else df.where(F.col("lang") == lang)
    e, g = F.map_keys(expected), F.map_keys(got)
    both = F.array_intersect(e, g)
    rows = df.where(F.size(F.map_keys(expected)) > 0).select(
        F.size(both).alias("tp"), F.size(F.array_except(g, e)).alias("fp"), F.size(F.array_except(e, g)).alias("fn"),
        F.size(F.filter(both, lambda k: F.element_at(expected, k) == F.element_at(got, k))).alias("same"),
    )
    sums = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "same")))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "polarity_accuracy": ratio(F.col("same"), tp)})


def polarity_mistakes(df: DataFrame, key: str = "review_id", expected: str = "expected", got: str = "aspect_sentiment") -> DataFrame:
    """(key, aspect, expected, got) where both have the aspect and differ."""
    rows = df.select(key, got, F.explode(expected).alias("aspect", "want")).withColumn("have", F.try_element_at(got, F.col("aspect")))
    return rows.where("want <> have").select(key, "aspect", F.col("want").alias("expected"), F.col("have").alias("got"))


def confusion(df: DataFrame, label: str = "sentiment_label", prediction: str = "overall_sentiment") -> DataFrame:
    """(label, positive, mixed, neutral, negative): counts of predictions by label."""
    kinds = ["positive", "mixed", "neutral", "negative"]
    return df.groupBy(F.col(label).alias("label")).pivot(prediction, kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


def agreement(df: DataFrame, label: str = "sentiment_label", prediction: str = "overall_sentiment", lang: str | None = None) -> DataFrame:
    """One row: rows (of a language) whose prediction is their label, all rows, the share; null of none."""
    rows = df if lang is None else df.where(F.col("lang") == lang)
    return rows.agg(F.count_if(F.col(label) == F.col(prediction)).alias("agree"), F.count("*").alias("total")).withColumn("share", F.try_divide("agree", "total"))


def case_checks(df: DataFrame) -> DataFrame:
    """(tag, hits, total) of twelve checks on ``df`` with case_tags and all result columns; checks without rows are left out.

    Rows that others are duplicates of do not count for the check on duplicates.
    """
    has = lambda kind: F.array_contains(F.map_keys("pii_removed"), kind)
    originals = df.where("duplicate_of <> ''").select(F.col("duplicate_of").alias("review_id")).distinct().withColumn("_original", F.lit(True))
    rows = df.join(originals, "review_id", "left")
    yes = F.lit(True)
    checks = [
        ("ad_spam", yes, F.col("is_ad_spam")), ("duplicate", F.col("_original").isNull(), F.col("is_duplicate")), ("low_quality", yes, F.col("is_low_quality")),
        ("pii_phone", yes, has("phone")), ("pii_line", yes, has("line_id")), ("pii_url", yes, has("url")), ("pii_email", yes, has("email")),
        ("elongation", yes, F.col("normalized_text") != F.col("clean_text")), ("delivery_days", F.col("raw_text").rlike(DAYS_SAID), F.col("delivery_days").isNotNull()),
        ("price", F.col("raw_text").rlike(PRICE_SAID), F.col("price").isNotNull()), ("html", yes, F.col("had_html")), ("code_switch", yes, F.size("aspects") > 0),
    ]
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(tag).alias("tag"), (F.contains("case_tags", F.lit(tag)) & applies).alias("applies"), hit.alias("hit")) for k, (tag, applies, hit) in enumerate(checks)))).alias("c")
    counted = rows.select(cells).select("c.*").where("applies").groupBy("ord", "tag").agg(F.count_if("hit").alias("hits"), F.count("*").alias("total"))
    return counted.orderBy("ord").select("tag", "hits", "total")


def no_aspect_share(df: DataFrame) -> DataFrame:
    """One row: rows without an aspect, all rows, the share; null of none."""
    return df.agg(F.count_if(F.size("aspects") == 0).alias("n"), F.count("*").alias("total")).withColumn("share", F.try_divide("n", "total"))
