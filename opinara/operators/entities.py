"""Entities of reviews: price, delivery time, stars, variant, dates, names, places, product type. All within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions import lexicon as L
from opinara.functions import text as T

from .matching import array_of, gazetteers, joined, kept, names, token_hits

# Patterns that decide what is found.
_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
PRICE = rf"(?iu)(?:฿|₹|{_B}(?:rs|inr|thb)\.?)\s*([\p{{Nd}},]+(?:\.\p{{Nd}}+)?)|([\p{{Nd}},]+(?:\.\p{{Nd}}+)?)\s*(?:บาท|฿|₹|{_B}(?:thb|rs|inr|rupees?){_E})"
DAYS = r"(?iu)(\p{Nd}{1,3})\s*(?:วัน|วันทำการ|days?|day)"
STARS = r"(?iu)(\p{Nd}(?:\.\p{Nd})?)\s*(?:ดาว|stars?|/\s*5|เต็ม\s*5)"
VARIANT = r"(?iu)(?:สี|ไซส์|ไซซ์|ขนาด|รุ่น|size|colou?r|model)\s*[:：]?\s*([\p{L}\p{N}_ก-๙]{1,15})"
DATE = rf"\p{{Nd}}{{1,2}}\s*(?:{L.THAI_MONTHS})\s*\p{{Nd}}{{2,4}}|(?:{L.THAI_MONTHS})\s*\p{{Nd}}{{2,4}}"
# End of the fixed values.

#: The words of all product types; hits in names have their places in this list.
TYPE_WORDS = [w for ws in L.PRODUCT_TYPES.values() for w in ws]

#: English dates, from parts: what names a day, a month or a year. A mere length of time, such as three days, is none.
MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DAY = "(?:0?[1-9]|[12][0-9]|3[01])"
YEAR = "(?:(?:19|20)[0-9][0-9])"
WEEKDAY = "(?:(?:mon|tues|wednes|thurs|fri|satur|sun)day)"
NUMBER = "(?:[0-9]{1,3}|an?|one|two|three|four|five|six|seven|eight|nine|ten|few|couple of)"
ENGLISH_DATE = "|".join((
    rf"(?:{WEEKDAY},?\s+)?{MONTH}\.?\s+{DAY}(?:st|nd|rd|th)?(?:,?\s+{YEAR})?", rf"(?:{WEEKDAY},?\s+)?{DAY}(?:st|nd|rd|th)?(?:\s+of)?\s+{MONTH}\.?(?:,?\s+{YEAR})?",
    rf"{MONTH}\.?,?\s+{YEAR}", rf"{YEAR}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])", rf"{DAY}[/.](?:0?[1-9]|1[0-2])[/.]{YEAR}",
    rf"(?:last|next|this)\s+(?:week|month|year|{WEEKDAY}|{MONTH})", rf"{NUMBER}\s+(?:days?|weeks?|months?|years?)\s+ago", "yesterday|today|tomorrow", WEEKDAY,
))


#: What a text in lower case must hold, one of them, for a date to be found: a month, a weekday, a word of time or a year.
_DATE_MARKS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "last", "next", "this", "ago", "day", "tomorrow", "19", "20")


def english_dates(text: Column) -> Column:
    """Sorted distinct dates as they are written: calendar days with or without year, months of a year, weekdays, and days told
    from today, such as last week or two days ago."""
    found = F.array_sort(F.array_distinct(T.find_all(text, f"(?iu){_B}(?:{ENGLISH_DATE}){_E}")))
    return F.when(text.isNull() | T.holds(F.lower(text), *_DATE_MARKS), found).otherwise(F.array().cast("array<string>"))


def _ascii_digits(x: Column) -> Column:
    return F.translate(x, "๐๑๒๓๔๕๖๗๘๙", "0123456789")


def price(text: Column) -> Column:
    """The first amount with a currency, commas dropped; null if that is no number."""
    first = F.coalesce(F.nullif(F.regexp_extract(text, PRICE, 1), F.lit("")), F.nullif(F.regexp_extract(text, PRICE, 2), F.lit("")))
    first = F.when(T.holds(F.lower(text), "฿", "₹", "บาท", "rs", "inr", "thb", "rupee"), first)
    return F.replace(_ascii_digits(first), F.lit(",")).try_cast("double")


def delivery_days(text: Column) -> Column:
    """The least number of days from 1 to 60."""
    found = F.transform(F.regexp_extract_all(text, F.lit(DAYS), F.lit(1)), lambda x: _ascii_digits(x).cast("int"))
    return F.when(T.holds(F.lower(text), "วัน", "day"), F.array_min(F.filter(found, lambda d: d.between(1, 60))))


def stars(text: Column) -> Column:
    """The first rating, if it is from 0 to 5."""
    value = _ascii_digits(F.nullif(F.regexp_extract(text, STARS, 1), F.lit(""))).try_cast("double")
    return F.when(T.holds(F.lower(text), "ดาว", "star", "/", "เต็ม"), F.when(value.between(0, 5), value))


def variant(text: Column) -> Column:
    """Map of kind (as written, lower case) to value, the first value of a kind."""
    whole, value = T.find_all(text, VARIANT), F.regexp_extract_all(text, F.lit(VARIANT), F.lit(1))
    key = lambda x: F.lower(T.strip(F.regexp_replace(F.regexp_extract(x, r"(?U)^\s*(\S+)", 1), "[:：]+$", "")))
    pairs = F.zip_with(whole, value, lambda w, v: F.struct(key(w).alias("k"), v.alias("v")))
    pairs = F.filter(pairs, lambda p: ~F.lower(p["v"]).isin(*L.NO_VARIANT))
    found = F.map_from_entries(T.let(pairs, lambda ps: F.filter(ps, lambda p, i: (i == 0) | ~F.exists(F.slice(ps, 1, i), lambda q: q["k"] == p["k"]))))
    none, marks = F.array().cast("array<string>"), ("สี", "ไส", "ไซ", "ขนาด", "รุ่น", "size", "colo", "model")
    return F.when(text.isNull() | T.holds(F.lower(text), *marks), found).otherwise(F.map_from_arrays(none, none))


def thai_dates(text: Column) -> Column:
    # every name of a month holds one of these letters
    found = F.array_sort(F.array_distinct(F.transform(T.find_all(text, DATE), T.strip)))
    return F.when(text.isNull() | T.holds(text, "ค", "พ", "ย"), found).otherwise(F.array().cast("array<string>"))


def provinces(tokens: Column, hits: Column) -> Column:
    """Province names; those that are common words too only after a marker."""
    found = kept(hits, L.PROVINCES)
    sure = T.let(joined(tokens), lambda text: F.filter(found, lambda h: ~h["term"].isin(*L.AMBIGUOUS_PROVINCES) | F.substr(text, F.lit(1), h["start"]).rlike(L.PROVINCE_MARKER)))
    return F.array_sort(F.array_distinct(names(sure)))


def product_type(hits: Column, name_hits: Column) -> Column:
    """The category whose first hit comes earliest, by the product's name if that has any, else by the text; ties: category order.

    ``hits`` are of ``lexicon.TERMS``, ``name_hits`` of ``TYPE_WORDS``.
    """
    # a hit inside a longer one never comes first; of a word of two categories the first counts
    category = {w: k for k, ws in reversed(list(enumerate(L.PRODUCT_TYPES.values()))) for w in ws}
    labels = array_of(list(L.PRODUCT_TYPES))

    def guess(found: Column, terms: list[str]) -> Column:
        order = array_of([category.get(t, -1) for t in terms])
        place = lambda h: F.struct(h["start"].alias("start"), F.get(order, h["ord"]).alias("k"))
        return F.get(labels, F.array_min(F.transform(F.filter(found, lambda h: h["term"].isin(*category)), place))["k"])

    return F.coalesce(guess(name_hits, TYPE_WORDS), guess(hits, L.TERMS), F.lit(""))


def extract(df: DataFrame, ner=None) -> DataFrame:
    """Adds the entity columns; needs clean_text, normalized_text, tokens, pos_tags, lang, product_name and ``hits`` (token hits).

    ``ner`` is a column function clean_text -> struct<org array<string>, place array<string>, date array<string>> for English
    rows, beside the dates that patterns find; without one there are no names.
    """
    clean, tokens = F.col("clean_text"), F.col("tokens")
    name_tokens = T.find_all(F.lower(F.coalesce("product_name", F.lit(""))), rf"[\p{{L}}\p{{N}}_{T.THAI}]+")
    listed = {"brand": L.BRANDS, "courier": L.COURIERS, "platform": L.PLATFORMS}
    out = df.withColumn("_listed", gazetteers(clean, listed)).withColumns({
        **{name: F.col(f"_listed.{name}") for name in listed},
        "price": T.once(price(clean)), "delivery_days": T.once(delivery_days(F.col("normalized_text"))), "star_rating": T.once(stars(clean)), "variant": T.once(variant(clean)),
        "_name_hits": token_hits(name_tokens, TYPE_WORDS), "_found": ner(F.when(F.col("lang") == "en", clean)) if ner else F.lit(None).cast("struct<org:array<string>,place:array<string>,date:array<string>>"),
    })
    none = F.array().cast("array<string>")
    known = F.transform(F.concat("brand", "courier", "platform"), F.lower)
    shops = F.filter(F.coalesce("_found.org", none), lambda o: ~F.array_contains(known, F.lower(o)))
    proper = F.slice(F.transform(F.filter("pos_tags", lambda p: (p["tag"] == "PROPN") & (F.length(p["word"]) > 2)), lambda p: p["word"]), 1, 3)
    clear = lambda xs: F.array_sort(F.array_distinct(F.filter(F.transform(xs, T.strip), lambda x: x != "")))
    places = F.when(F.col("lang") == "th", provinces(tokens, F.col("hits"))).otherwise(F.coalesce("_found.place", none))
    return out.withColumns({
        "seller_shop": T.once(clear(F.when((F.size("brand") == 0) & (F.size(shops) == 0), proper).otherwise(shops))),
        "location": T.once(clear(places)), "date_mentioned": T.once(F.array_sort(F.array_distinct(F.concat(thai_dates(clean), F.when(F.col("lang") == "en", english_dates(clean)).otherwise(none), F.coalesce("_found.date", none))))),
        "product_type": T.once(product_type(F.col("hits"), F.col("_name_hits"))),
    }).drop("_name_hits", "_found", "_listed")
