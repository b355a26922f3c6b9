"""Screening of reviews: duplicates, advertising, low content, a score of credibility and a status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions import lexicon as L
from opinara.functions import text as T

from .matching import kept, names


def mark_duplicates(df: DataFrame, column: str = "raw_text", key: str = "review_id", order: str = "pos") -> DataFrame:
    """Adds fingerprint and duplicate_of: the key of the first row, by order, with the same fingerprint; null for that row.

    First rows come from a partial aggregate on fingerprints, so no group of copies is gathered anywhere; they are joined
    back by fingerprint, where a very frequent one is split by the adaptive skew join.
    """
    out = with_first(df, column, F.struct(F.col(order).alias("o"), F.col(key).alias("k")))
    return out.withColumn("duplicate_of", F.when(F.col("_first.o") < F.col(order), F.col("_first.k"))).drop("_first")


def with_first(df: DataFrame, column: str, row: Column) -> DataFrame:
    """Adds fingerprint and _first, the least ``row`` of all with the same fingerprint.

    Every fingerprint has a partner, but only a left join is left out, aggregate and all, by queries that do not ask for _first.
    """
    # neither end of a text counts: white space is no part of a fingerprint
    out = df.withColumn("fingerprint", T.fingerprint(F.coalesce(column, F.lit(""))))
    return out.join(out.groupBy("fingerprint").agg(F.min(row).alias("_first")), "fingerprint", "left")


def is_generic(text: Column, tokens: Column) -> Column:
    """At most six words, and no more than one run of letters left when the generic phrases, in their order, are taken out."""
    rest = reduce(lambda t, p: F.replace(t, F.lit(p), F.lit(" ")), L.GENERIC_PHRASES, F.lower(text))
    return (F.size(tokens) <= 6) & (F.size(T.find_all(rest, f"[a-zA-Z{T.THAI}]{{2,}}")) <= 1)


def look(df: DataFrame) -> DataFrame:
    """What ``judge`` needs of the texts; needs the columns of the earlier steps."""
    out = df.withColumn("_search", T.once(F.coalesce(F.nullif(F.array_join("tokens", " "), F.lit("")), "clean_text")))
    out = out.withColumn("_promo", T.once(names(kept(F.col("hits"), L.PROMO_KEYWORDS))))
    contact, promo = F.size(F.map_keys("pii_removed")) > 0, F.size("_promo") > 0
    bare = F.size("aspects") == 0
    return out.withColumns({
        "is_ad_spam": contact & promo, "_contact": contact, "_promoted": promo, "_short": (F.size("tokens_clean") < L.MIN_TOKENS) & bare, "_bare": bare,
        "_generic": T.once(is_generic(F.col("_search"), F.col("tokens_clean"))),
        "_emoji": T.once((F.col("emoji_count") > 0) & ~F.col("_search").rlike(f"[a-zA-Z{T.THAI}]")),
    }).drop("_search")


def screen(df: DataFrame) -> DataFrame:
    """Adds signals, flags, credibility_score, review_status and reasons; needs the columns of the earlier steps and duplicate_of."""
    return judge(look(df))


def judge(df: DataFrame) -> DataFrame:
    """``screen`` of rows that ``look`` has seen."""
    out, bare = df.withColumn("is_duplicate", F.col("duplicate_of").isNotNull()), F.col("_bare")
    ad, contact, promo, short, generic = F.col("is_ad_spam"), F.col("_contact"), F.col("_promoted"), F.col("_short"), F.col("_generic")
    cases = [
        (ad, ["contains_contact", "promo_keyword"], F.lit("contact with promotion"), L.PENALTY["ad_spam"]),
        (contact & ~promo, ["contains_contact"], F.concat(F.lit("contact: "), F.array_join(F.map_keys("pii_removed"), ", ")), L.PENALTY["contact"]),
        (promo & ~contact, ["promo_keyword"], F.concat(F.lit("promotion: "), F.array_join(F.slice("_promo", 1, 3), ", ")), L.PENALTY["generic"]),
        (short, ["too_short"], F.concat(F.lit("words: "), F.size("tokens_clean")), L.PENALTY["low_quality"]),
        (generic & ~short, ["generic_phrase"], F.lit("generic phrase"), L.PENALTY["generic"]),
        (F.col("is_duplicate"), ["duplicate"], F.concat(F.lit("same as "), "duplicate_of"), L.PENALTY["duplicate"]),
        (bare & ~short, ["no_aspect"], F.lit("no aspect"), L.PENALTY["no_aspect"]),
        (F.col("_emoji"), ["emoji_only"], F.lit("emoji only"), L.PENALTY["low_quality"]),
    ]
    lost = sum((F.when(when, cost).otherwise(0) for when, _, _, cost in cases), F.lit(0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost))
    out = out.withColumns({
        "spam_signals": F.array_compact(F.array(*(F.when(when, s) for when, signals, _, _ in cases for s in signals))),
        "is_low_quality": short | generic, "credibility_score": T.once(score),
        "screening_reasons": F.array_compact(F.array(*(F.when(when, F.struct(why.alias("reason"), F.lit(cost).alias("penalty"))) for when, _, why, cost in cases))),
    })
    status = F.when(F.col("credibility_score") >= L.PASS, L.STATUS_PASS).when(F.col("credibility_score") >= L.SUSPECT, L.STATUS_SUSPECT).otherwise(L.STATUS_SPAM)
    return out.withColumn("review_status", T.once(status)).withColumn("duplicate_of", F.coalesce("duplicate_of", F.lit(""))).drop("_promo", "_contact", "_promoted", "_short", "_bare", "_generic", "_emoji")
