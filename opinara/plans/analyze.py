"""The whole analysis of reviews as one plan: contents that many rows share are analysed once, within the row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import lexicon as L
from opinara.operators import aspects, cleanse, contents, entities, screening
from opinara.operators.matching import token_hits
from opinara.operators.sampling import numbered

# Columns of the flat table.
EXPORT = ["review_id", "lang", "review_status", "credibility_score", "overall_sentiment", "sentiment_score", "product_type", "brand", "seller_shop", "price", "delivery_days", "courier", "location", "aspects", "pros", "cons", "spam_signals", "clean_text"]
# End of the fixed values.

TERMS = L.TERMS


def prepare(df: DataFrame, text_column: str | None = None) -> DataFrame:
    """raw_text, review_id, product_name and pos of any table of reviews.

    The text column is named or guessed: raw_text, review, text, Summary, comment, else the first string column, else the
    first. Rows without ids get R0001 and so on in order of pos; without pos, rows keep their order in the source.
    """
    if text_column is None:
        strings = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
        text_column = next((c for c in ("raw_text", "review", "text", "Summary", "comment") if c in df.columns), (strings or df.columns)[0])
    out = df if "pos" in df.columns else df.withColumn("pos", F.monotonically_increasing_id())
    out = out.withColumn("raw_text", F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    if "review_id" not in out.columns:
        out = numbered(out, "pos", "_number").withColumn("review_id", F.format_string("R%04d", F.col("_number") + 1)).drop("_number")
    name = F.coalesce(F.col("product_name").cast("string"), F.lit("")) if "product_name" in df.columns else F.lit("")
    return out.withColumn("product_name", name)


def analyze_batch(df: DataFrame, vocab: DataFrame | None = None, tagger=None, ner=None, dictionary: set[str] | None = None, bounded: bool = False) -> DataFrame:
    """All result columns for ``df(pos, review_id, raw_text, product_name)``; see the steps for what they add.

    ``vocab(word)``, most frequent first, turns on the mending of English words; ``tagger`` and ``ner`` are column functions
    for word classes and names; ``dictionary`` holds the words of Thai text. Rows of the same text and product name are analysed
    once: the functions given must not tell equal contents apart.
    """
    rows = df.withColumn("raw_text", cleanse.text.once(F.coalesce("raw_text", F.lit(""))))
    rows = rows.withColumn("raw_text", cleanse.text.strip_ends(F.col("raw_text")))

    def step(found: DataFrame) -> DataFrame:
        # duplicates are other contents with the same fingerprint, too
        out = screening.with_first(found, "raw_text", F.col("_own")).drop("_own")
        return screening.look(within_rows(out, vocab, tagger, ner, dictionary, bounded)).drop("hits")

    values = {"raw_text": F.col("raw_text"), "product_name": F.coalesce(F.col("product_name").cast("string"), F.lit(""))}
    out = contents.on_distinct(rows, values, step, _own=F.min(F.struct(F.col("pos").alias("o"), F.col("review_id").alias("k"))))
    return screening.judge(out.withColumn("duplicate_of", F.when(F.col("_first.o") < F.col("pos"), F.col("_first.k"))).drop("_first"))


def within_rows(df: DataFrame, vocab: DataFrame | None = None, tagger=None, ner=None, dictionary: set[str] | None = None, bounded: bool = False) -> DataFrame:
    """The steps of ``analyze_batch`` that look at one row alone, of ``df(raw_text, product_name)`` with stripped texts: all but
    duplicates and screening. Adds hits, too."""
    rank = cleanse.ranks(vocab) if vocab is not None else None
    out = cleanse.normalize(cleanse.clean(df, "raw_text", rank, bounded), rank)
    out = cleanse.tag_words(cleanse.tokenize(out, dictionary), tagger)
    out = out.withColumn("hits", token_hits(F.col("tokens"), TERMS))
    return aspects.analyze_aspects(entities.extract(out, ner), tagged=tagger is not None)


def analyze(spark: SparkSession, raw_text: str, review_id: str = "-", product_name: str = "", **options) -> DataFrame:
    """The analysis of one review, as one row."""
    return analyze_batch(spark.createDataFrame([(0, review_id, raw_text, product_name)], "pos long, review_id string, raw_text string, product_name string"), **options)


def export(results: DataFrame) -> DataFrame:
    """Flat table: lists joined by commas, one column for each aspect, empty where it is not mentioned."""
    lists = {f.name for f in results.schema if f.dataType.typeName() == "array"}
    flat = [F.array_join(c, ", ").alias(c) if c in lists else F.col(c) for c in EXPORT]
    return results.select(*flat, *(F.coalesce(F.try_element_at("aspect_sentiment", F.lit(a)), F.lit("")).alias(f"aspect_{a}") for a in L.ASPECT_KEYS))
