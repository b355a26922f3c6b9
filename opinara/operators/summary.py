"""Summaries of analysed reviews: grouped aggregates; only their results are small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions import lexicon as L


def unless_spam(column: Column | str) -> Column:
    """The value of rows that are not spam, else null. Not a filter: that would be pushed down to where the hits are made, and
    repeat the whole screening and all that it rests on as its condition."""
    value = F.col(column) if isinstance(column, str) else column
    return F.when(F.col("review_status") != L.STATUS_SPAM, value)


def status_counts(results: DataFrame) -> DataFrame:
    """One row: total, passed, suspect, spam."""
    count = lambda s, n: F.count_if(F.col("review_status") == s).alias(n)
    return results.agg(F.count("*").alias("total"), count(L.STATUS_PASS, "passed"), count(L.STATUS_SUSPECT, "suspect"), count(L.STATUS_SPAM, "spam"))


def status_shares(results: DataFrame) -> DataFrame:
    """(review_status, n, share)."""
    counts = results.groupBy("review_status").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("review_status", "n", (F.col("n") / F.col("total")).alias("share"))


def aspect_summary(results: DataFrame) -> DataFrame:
    """(ord, key, label, mentions, pos, neg, neutral, pos_pct, neg_pct) of every aspect that non-spam reviews mention."""
    said = results.select(F.explode(unless_spam("aspect_sentiment")).alias("key", "polarity"))
    count = lambda p: F.count_if(F.col("polarity") == p).alias(p)
    sums = said.groupBy("key").agg(F.count("*").alias("mentions"), count("pos"), count("neg"), count("neutral"))
    names = F.create_map(*(F.lit(x) for a, g in L.ASPECTS.items() for x in (a, g["label"])))
    order = F.array_position(F.array(*map(F.lit, L.ASPECT_KEYS)), F.col("key")) - 1
    share = lambda c: F.bround(F.col(c) / F.col("mentions") * 100, 1).alias(f"{c}_pct")
    return sums.select(order.alias("ord"), "key", F.element_at(names, F.col("key")).alias("label"), "mentions", "pos", "neg", "neutral", share("pos"), share("neg")).orderBy("ord")


def top_terms(results: DataFrame, column: str, limit: int = 8) -> DataFrame:
    """(term, n) most frequent terms of a list column in non-spam reviews; of equal ones the first seen."""
    terms = results.select("pos", F.posexplode(unless_spam(column)).alias("i", "term"))
    return terms.groupBy("term").agg(F.count("*").alias("n"), F.min(F.struct("pos", "i")).alias("first")).orderBy(F.desc("n"), "first").limit(limit).select("term", "n")


def price_range(results: DataFrame) -> DataFrame:
    """One row: least and largest price but 0."""
    price = unless_spam(F.nullif("price", F.lit(0.0)))
    return results.agg(F.min(price).alias("min_price"), F.max(price).alias("max_price"))


def delivery_average(results: DataFrame) -> DataFrame:
    """One row: number, sum and mean of delivery days; the mean to one digit, null without any."""
    said = unless_spam(F.when(F.col("delivery_days") > 0, F.col("delivery_days")))
    days = results.agg(F.count(said).alias("n"), F.sum(said).alias("days"))
    return days.withColumn("avg_delivery_days", F.bround(F.try_divide("days", "n"), 1))


def sentiment_counts(results: DataFrame) -> DataFrame:
    """(overall_sentiment, n) of the four classes, zeros included."""
    kinds = ("positive", "mixed", "neutral", "negative")
    row = results.agg(*(F.count_if(unless_spam(F.col("overall_sentiment") == k)).alias(k) for k in kinds))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("overall_sentiment"), F.col(k).alias("n")) for k in kinds))).alias("r")).select("r.*")


def summarize(results: DataFrame) -> dict[str, DataFrame]:
    """All sections by name."""
    return {
        "status": status_counts(results), "aspect_summary": aspect_summary(results), "top_pros": top_terms(results, "pros"), "top_cons": top_terms(results, "cons"),
        "price_range": price_range(results), "delivery": delivery_average(results), "top_brands": top_terms(results, "brand", 6), "top_couriers": top_terms(results, "courier", 5),
        "sentiment_counts": sentiment_counts(results),
    }


def browse(results: DataFrame, statuses: list[str] | None = None, aspect: str | None = None) -> DataFrame:
    """The rows of the flat export with one of some statuses and a mention of an aspect."""
    out = results if statuses is None else results.where(F.col("review_status").isin(*statuses))
    return out if aspect is None else out.where(F.col(f"aspect_{aspect}") != "")
