"""Preparation of labelled samples: filters, case tags, balanced and quota samples, unified tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.functions import text as T
from opinara.sources.reviews import scratch

UNIFIED = ["review_id", "lang", "source", "raw_text", "product_name", "product_price", "rate", "sentiment_label", "case_tags", "expected_aspects"]

# Patterns of the case tags, garbled letters, and the quotas of a sample (tag, rows, least length).
_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
CASES = {
    "delivery_days": rf"(?iu){_B}\p{{Nd}}+\s*(?:days?|weeks?|months?){_E}",
    "price": rf"(?iu)(?:rs\.?|₹|rupees?|price)\s*\.?\s*\p{{Nd}}|worth\s+(?:the|of)\s+money",
    "elongation": r"(?i)([a-z])\1{2,}",
    "packaging": rf"(?iu){_B}(?:packag[\p{{L}}\p{{N}}_]*|box|damaged|broken|sealed|wrapp[\p{{L}}\p{{N}}_]*){_E}",
    "shipping": rf"(?iu){_B}(?:deliver[\p{{L}}\p{{N}}_]*|shipp?[\p{{L}}\p{{N}}_]*|courier|dispatch[\p{{L}}\p{{N}}_]*|late|on time){_E}",
    "quality": rf"(?iu){_B}(?:qualit[\p{{L}}\p{{N}}_]*|durab[\p{{L}}\p{{N}}_]*|build|material|defect[\p{{L}}\p{{N}}_]*|fake|original){_E}",
    "seller_service": rf"(?iu){_B}(?:seller|service|support|replace[\p{{L}}\p{{N}}_]*|refund[\p{{L}}\p{{N}}_]*|return[\p{{L}}\p{{N}}_]*|complain[\p{{L}}\p{{N}}_]*){_E}",
    "as_described": rf"(?iu){_B}(?:as (?:described|shown|per)|different|wrong (?:item|size|colou?r)|not same|mismatch[\p{{L}}\p{{N}}_]*){_E}",
}
MOJIBAKE = r"(?:\?{3,}|\?ÃÂ¿|Ã.|Â.)"
QUOTAS = [("as_described", 40, 80), ("packaging", 45, 80), ("delivery_days", 55, 60), ("price", 40, 60), ("seller_service", 40, 80), ("elongation", 35, 0), ("multi_aspect", 60, 150), ("low_quality", 45, 0)]
CLASSES = ("negative", "neutral", "positive")
SAMPLE_ROWS = 500
# End of the fixed values.


def case_tags(text: Column) -> Column:
    """Tags of the cases a text can test, in order; low_quality up to three words, long from 200 characters, multi_aspect
    from four tags."""
    size = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    tags = F.array_compact(F.array(*(F.when(text.rlike(p), name) for name, p in CASES.items()), F.when(size <= 3, "low_quality"), F.when(F.length(text) >= 200, "long")))
    return F.when(F.size(tags) >= 4, F.array_append(tags, "multi_aspect")).otherwise(tags)


def clean_product_name(name: Column) -> Column:
    return T.squeeze(F.regexp_replace(name, MOJIBAKE, " "))


def clean_dump(df: DataFrame) -> DataFrame:
    """Rows of a raw dump (product_name, product_price, Rate, Summary, Sentiment) with a rating of one digit 1-5 and a text."""
    out = df.where(F.col("Rate").cast("string").rlike(r"\A[1-5]\z")).where("Summary is not null").withColumn("Summary", T.strip(F.col("Summary").cast("string"))).where(F.length("Summary") > 0)
    return out.withColumns({"rate": F.col("Rate").cast("int"), "product_name": clean_product_name(F.col("product_name").cast("string")), "product_price": F.regexp_replace(F.col("product_price").cast("string"), r"[^\p{Nd}.]", "")})


def order_hash(key: str, seed: int = 42) -> Column:
    """A fixed random order of keys."""
    return F.sha1(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def numbered(df: DataFrame, by: str, into: str, ties: tuple[str, ...] = (), descending: bool = False, block: int = 100_000) -> DataFrame:
    """Adds the place of every row, from 0, in the order of a numeric column and then of ``ties``.

    Rows are numbered within blocks of about ``block`` rows, cut at quantiles of the column (at most 1,000 of them come to the
    driver), and shifted by the counts of the blocks before. Equal values share a block. Nulls come first.
    """
    value = F.col(by) * (-1 if descending else 1)
    cuts = min(1000, df.count() // block)
    bounds = df.agg(F.percentile_approx(value, [(k + 1) / (cuts + 1) for k in range(cuts)], 10_000)).first()[0] if cuts else []
    placed = df.withColumn("_block", F.size(F.filter(F.array(*map(F.lit, bounds or [])), lambda x: x < value)) if bounds else F.lit(0))
    before = placed.groupBy("_block").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_block")) - F.col("_n"))
    place = F.row_number().over(W.partitionBy("_block").orderBy(value, *ties)) - 1
    return placed.withColumn("_place", place).join(F.broadcast(before), "_block").withColumn(into, F.col("_before") + F.col("_place")).drop("_block", "_n", "_before", "_place")


def balanced_sample(df: DataFrame, n: int, key: str, label: str, classes=CLASSES, seed: int = 42) -> DataFrame:
    """About n rows, the same number of each class; what a class lacks comes from the other rows of df; of all n at most,
    classes in order. Adds pick, the place in the sample.

    Only the n first of each class (by hash) and the n first of all can be picked; they are found by top-n, so windows see
    bounded tables.
    """
    per_class = -(-n // len(classes))
    place = F.when(F.col(label) == classes[0], 0)
    for k, c in enumerate(classes[1:], 1):
        place = place.when(F.col(label) == c, k)
    ranked = df.withColumns({"_h": order_hash(key, seed), "_c": place})
    own = reduce(DataFrame.unionByName, (ranked.where(F.col("_c") == k).orderBy("_h", key).limit(per_class) for k in range(len(classes))))
    lack = own.agg((F.lit(per_class * len(classes)) - F.count("*")).alias("_lack"))
    rest = ranked.join(F.broadcast(own.select(key)), key, "left_anti").withColumn("_c", F.lit(len(classes))).orderBy("_h", key).limit(n)
    fill = rest.withColumn("_k", F.row_number().over(W.orderBy("_h", key))).join(F.broadcast(lack)).where("_k <= _lack").drop("_k", "_lack")
    return own.unionByName(fill).withColumn("pick", F.row_number().over(W.orderBy("_c", "_h", key))).where(F.col("pick") <= n).drop("_h", "_c")


def sketches(df: DataFrame, key: str, text: str, label: str, strata: list[tuple[Column, int]], classes=CLASSES, seed: int = 42) -> DataFrame:
    """The first rows of df, by hash of their key, of every (stratum, class): as many as any sample with these quotas can
    need. Adds stratum, class (labels of no class are one more) and hash; a row comes once for each stratum it is in.

    ``strata`` holds conditions and quotas in order. A stratum of quota n loses at most what the earlier ones may take, and
    takes at most a class's share and n to fill up, so its sketch of a class needs no more than all three together. One
    scan; every task cuts its groups to that size before the shuffle.
    """
    place = F.lit(len(classes))
    for k, c in reversed(list(enumerate(classes))):
        place = F.when(F.col(label) == c, k).otherwise(place)
    need, before = [], 0
    for _, n in strata:
        need.append(before + -(-n // len(classes)) + n)
        before += n
    inside = F.array_compact(F.array(*(F.when(cond, k) for k, (cond, _) in enumerate(strata))))
    rows = df.withColumns({"class": place, "hash": order_hash(key, seed), "stratum": F.explode(inside)})
    rank = F.row_number().over(W.partitionBy("stratum", "class").orderBy("hash", key))
    return rows.withColumn("_rank", rank).where((F.col("_rank") <= max(need)) & (F.col("_rank") <= F.get(F.array(*map(F.lit, need)), F.col("stratum")))).drop("_rank")


def resolve(rows, quotas: list[int], classes: int = len(CLASSES), total: int | None = None) -> dict:
    """Key to stratum of a sample, from the (stratum, class, hash, key) of sketches: strata in order, none takes a row
    twice. Of a stratum every class gives an equal part, what a class lacks comes from the other rows, in order of the hash;
    if there is more than the quota, the last classes lose. The last stratum fills up to ``total``."""
    picked: dict = {}
    for k, n in enumerate(quotas):
        if total is not None and k == len(quotas) - 1:
            n = max(0, total - len(picked))
        free = sorted((h, key, c) for s, c, h, key in rows if s == k and key not in picked)
        part, own = -(-n // classes), []
        for c in range(classes):
            own += [x for x in free if x[2] == c][:part]
        taken = {x[1] for x in own}
        own += [x for x in free if x[1] not in taken][: max(0, part * classes - len(own))]
        picked.update((x[1], k) for x in own[:n])
    return picked


def quota_sample(df: DataFrame, key: str, text: str, label: str, rows: int = SAMPLE_ROWS, quotas=QUOTAS, seed: int = 42) -> DataFrame:
    """A sample with quotas of tagged cases, rarest first, without repeats, filled up with texts of 30 to 150 characters.

    Adds tags and stratum. df is read once, for sketches of every stratum and class; the sample is worked out on their keys,
    of which there are as many as the quotas allow for, and its rows are taken from the sketches.
    """
    tagged = df.withColumn("tags", F.array_join(case_tags(F.col(text)), "|"))
    strata = [(F.contains("tags", F.lit(tag)) & (F.length(text) >= least), n) for tag, n, least in quotas] + [(F.length(text).between(30, 150), rows)]
    spark, path = df.sparkSession, scratch(df.sparkSession, "sketches")
    sketches(tagged, key, text, label, strata, seed=seed).write.parquet(path)
    found = spark.read.parquet(path)
    picked = resolve(found.select("stratum", "class", "hash", key).collect(), [n for _, n in strata], total=rows)
    keys = spark.createDataFrame(list(picked.items()), f"{key} {df.schema[key].dataType.simpleString()}, stratum int")
    return found.join(F.broadcast(keys), [key, "stratum"]).orderBy("hash").select(*df.columns, "tags", "stratum")


def unified(df: DataFrame, lang: str, source: str, prefix: str, order: str) -> DataFrame:
    """The ten columns of a labelled review table from Summary, product_name, product_price, rate, Sentiment and tags, numbered in
    the order of a numeric column."""
    out = numbered(df, order, "_number").select(
        F.format_string(f"{prefix}%04d", F.col("_number") + 1).alias("review_id"), F.lit(lang).alias("lang"), F.lit(source).alias("source"), F.col("Summary").alias("raw_text"), "product_name", "product_price", "rate",
        F.col("Sentiment").alias("sentiment_label"), F.when(F.coalesce("tags", F.lit("")) == "", "untagged").otherwise(F.col("tags")).alias("case_tags"), F.lit("").alias("expected_aspects"),
    )
    return out.na.fill("")


def tag_counts(df: DataFrame, column: str = "case_tags") -> DataFrame:
    return df.select(F.explode(F.split(F.coalesce(column, F.lit("")), r"\|")).alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))


def length_stats(df: DataFrame, column: str = "raw_text") -> DataFrame:
    n = F.length(column)
    return df.agg(F.min(n).alias("min_length"), F.median(n).cast("int").alias("median_length"), F.max(n).alias("max_length"))
