"""Cleaning and normal forms of reviews: DataFrame in, DataFrame with more columns out. No shuffle in any of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions import lexicon, text

from . import thai

#: A vocabulary of more words than this is refused, so what is broadcast has a bound.
MAX_VOCABULARY = 200_000


def vocabulary(df: DataFrame, column: str, min_count: int = 50) -> DataFrame:
    """(word, n) of the a-z words of at least two letters seen min_count times and more, most frequent first, then by word."""
    found = df.select(F.explode(text.find_all(F.lower(column), "[a-z]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return found.where((F.col("n") >= min_count) & (F.length("word") >= 2)).orderBy(F.desc("n"), "word")


def ranks(vocab: DataFrame) -> dict[str, int]:
    """Word to rank of an ordered vocabulary of checked size; of a word that comes twice the later rank."""
    rows = vocab.select("word").limit(MAX_VOCABULARY + 1).toPandas()["word"].tolist()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary holds at most {MAX_VOCABULARY} words")
    return {w: k for k, w in enumerate(rows)}


def _best_cut(word: str, rank: dict[str, int]) -> str | None:
    """The cut of a word into two known words of lowest summed rank, the first of equals."""
    cuts = [(rank[word[:k]] + rank[word[k:]], k) for k in range(2, len(word) - 1) if word[:k] in rank and word[k:] in rank]
    return f"{word[: min(cuts)[1]]} {word[min(cuts)[1] :]}" if cuts else None


def word_fixer(spark, rank: dict[str, int], how: str):
    """Column function on a-z runs that are not known words. ``split``: runs of five letters and more are cut in two known
    words. ``double``: doubled letters are made single where that gives a known word."""
    shared = spark.sparkContext.broadcast(rank)

    @F.pandas_udf("string")
    def fix(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, memory = shared.value, {}

        def one(m: re.Match) -> str:
            word = m[0]
            if word not in memory:
                low = word.lower()
                out = None
                if low not in known:
                    if how == "split":
                        out = _best_cut(low, known) if len(low) >= 5 else None
                    else:
                        single = re.sub(r"(.)\1", r"\1", low)
                        out = single if single in known else None
                if len(memory) > 100_000:
                    memory.clear()
                memory[word] = out or word
            return memory[word]

        for batch in batches:
            yield batch.map(lambda t: t if t is None else re.sub("[a-zA-Z]+", one, t))

    return fix


def contacts(df: DataFrame, patterns: dict[str, str] = text.FOUND) -> DataFrame:
    """Adds _low, the text ``_t`` in lower case, pii_removed, map of kind to the distinct sorted finds, and _some, whether there
    are any; what one kind has found is blank for the next. Every kind is searched once, in texts that hold a mark of it."""
    once, none = text.once, F.array().cast("array<string>")
    out = df.withColumn("_low", once(F.lower("_t"))).withColumn("_left", F.col("_t"))
    for kind, pattern in patterns.items():
        hits = F.when(text.holds(F.col("_low"), *text.MARKS[kind]), text.find_all(F.col("_left"), pattern)).otherwise(none)
        out = out.withColumn(f"_{kind}", once(hits)).withColumn("_left", once(text.blank_out(F.col("_left"), pattern, F.col(f"_{kind}"))))
    clear = lambda c: F.array_sort(F.array_distinct(F.transform(c, text.strip)))
    entries = [F.when(F.size(f"_{kind}") > 0, F.struct(F.lit(kind).alias("key"), clear(f"_{kind}").alias("value"))) for kind in patterns]
    some = sum((F.size(f"_{kind}") for kind in patterns), F.lit(0)) > 0
    found = F.when(some, F.map_from_entries(F.array_compact(F.array(*entries))))
    empty = F.map_from_arrays(none, F.array().cast("array<array<string>>"))
    return out.withColumns({"pii_removed": once(found.otherwise(empty)), "_some": once(some)}).drop("_left", *(f"_{kind}" for kind in patterns))


def clean(df: DataFrame, column: str = "raw_text", rank: dict[str, int] | None = None, bounded: bool = False) -> DataFrame:
    """Adds lang, had_html, emoji_count, pii_removed and clean_text. Null counts as empty.

    ``rank`` is a vocabulary for cutting glued English words; without one they stay. ``bounded`` asks for word boundaries
    before handles, against finds inside words.
    """
    patterns = text.BOUNDED if bounded else text.FOUND
    out, t, once = df.withColumn("_t", text.once(F.coalesce(column, F.lit("")))), F.col("_t"), text.once
    out = out.withColumn("_t", once(text.strip_ends(t))).withColumns({"lang": once(text.language(t)), "had_html": once(text.has_html(t)), "_t": once(text.strip_html(t))})
    out = contacts(out.withColumns({"emoji_count": once(text.emoji_count(t)), "_t": once(text.strip_emoji(t))}), patterns)
    for kind in text.REMOVED:
        # where nothing is found, all patterns fail and there is nothing to remove; the map itself may not be asked for
        some = F.col("_some") & text.holds(F.col("_low"), *text.MARKS[kind])
        out = out.withColumn("_t", once(F.when(some, F.regexp_replace(t, patterns[kind], " ")).otherwise(t)))
    out = out.drop("_low", "_some")
    if rank:
        fixed = word_fixer(df.sparkSession, rank, "split")(F.when(F.col("lang") == "en", F.col("_t")))
        out = out.withColumn("_t", F.coalesce(fixed, "_t"))
    return out.withColumn("_t", once(text.squeeze_inside(t))).withColumn("clean_text", once(text.strip_ends(t))).drop("_t")


def normalize(df: DataFrame, rank: dict[str, int] | None = None) -> DataFrame:
    """Adds normalized_text: elongations collapsed, a-z in lower case."""
    out = text.collapse(F.col("clean_text"))
    if rank:
        out = word_fixer(df.sparkSession, rank, "double")(out)
    return df.withColumn("normalized_text", text.once(text.lower_latin(out)))


def dictionary() -> set[str]:
    """The Thai words of all lexicons."""
    own = [w for words in (lexicon.GENERAL_POSITIVE, lexicon.GENERAL_NEGATIVE, lexicon.NEGATIONS, lexicon.PROMO_KEYWORDS, lexicon.GENERIC_PHRASES, lexicon.COURIERS, lexicon.PROVINCES, lexicon.STOPWORDS_TH, lexicon.TYPO_MAP, lexicon.TYPO_MAP.values(), *lexicon.PRODUCT_TYPES.values()) for w in words]
    own += [t for t, *_ in lexicon.aspect_terms()] + lexicon.THAI_MONTHS.split("|") + ["วัน", "ภายใน", "มาก", "ดาว", "สี", "ไซส์", "ขนาด", "รุ่น"]
    return {w for w in own if re.search("[ก-๙]", w) and " " not in w}


def thai_tokenizer(words: set[str] | None = None):
    """``thai.tokenizer`` with the words of the lexicons where none are given."""
    return thai.tokenizer(dictionary() if words is None else words)


def tokenize(df: DataFrame, dictionary: set[str] | None = None) -> DataFrame:
    """Adds tokens (typos mapped) and tokens_clean (stopwords out). Thai rows take the dictionary, others runs of letters
    or digits."""
    thai = F.col("lang") == "th"
    found = F.when(thai, thai_tokenizer(dictionary)(F.when(thai, F.col("normalized_text")))).otherwise(text.plain_tokens(F.col("normalized_text")))
    return df.withColumn("tokens", text.once(fix_typos(found))).withColumn("tokens_clean", text.once(drop_stopwords(F.col("tokens"))))


def fix_typos(tokens: Column) -> Column:
    wrong, right = F.array(*map(F.lit, lexicon.TYPO_MAP)), F.array(*(F.lit(w.strip()) for w in lexicon.TYPO_MAP.values()))
    fixed = F.transform(tokens, lambda t: F.when(t.isin(*lexicon.TYPO_MAP), F.get(right, F.array_position(wrong, t).cast("int") - 1)).otherwise(t))
    return F.filter(fixed, lambda t: t != "")


def drop_stopwords(tokens: Column) -> Column:
    """Protected words stay; English and Thai stopwords, single non-Thai characters and tokens without letter or digit go."""
    protected, stop_en, stop_th = lexicon.protected_words(), lexicon.STOPWORDS_EN, lexicon.STOPWORDS_TH

    def stays(t: Column) -> Column:
        low = F.lower(t)
        word = ~low.isin(*stop_en) & ~t.isin(*stop_th) & ((F.length(t) >= 2) | t.rlike(f"[{text.THAI}]")) & t.rlike(rf"[a-zA-Z{text.THAI}\p{{Nd}}]")
        return t.isin(*protected) | low.isin(*protected) | word

    return F.filter(tokens, stays)


def tag_words(df: DataFrame, tagger=None) -> DataFrame:
    """Adds pos_tags and keywords. ``tagger`` is a column function tokens -> array<struct<word,tag>>; without one every tag is X."""
    tags = tagger(F.col("tokens")) if tagger else F.transform("tokens", lambda t: F.struct(t.alias("word"), F.lit("X").alias("tag")))
    out = df.withColumn("pos_tags", text.once(tags))
    content = F.transform(F.filter("pos_tags", lambda p: p["tag"].isin("NOUN", "PROPN", "ADJ", "VERB")), lambda p: p["word"])
    return out.withColumn("keywords", text.once(F.slice(F.array_distinct(content), 1, 10)))
