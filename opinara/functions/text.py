"""Column functions on review text: language, markup, contact details, normal forms, words. All within the row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters of the patterns below: letters, digits and underscore, without Thai vowel and tone marks.
W = r"[\p{L}\p{N}_]"
THAI = "ก-๙"

# Patterns that decide what is found.
HTML_TAG, HTML_ENTITY = r"<[^>]+>", r"(?i)&[a-z]+;|&#\p{Nd}+;"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}]+"
PHONE = r"(?<!\p{Nd})0\p{Nd}(?U:[\p{Nd}\-\s]{7,12})\p{Nd}(?!\p{Nd})"
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"
URL = r"(?i)(?:https?://|www\.)(?U:[^\s<>\"']+)"
LINE_ID = r"(?iu)(?:(?:line|ไลน์|ไอดีไลน์|ไอดี)(?U:\s*)(?:id)?(?U:\s*)[:：]?(?U:\s*)@?[\p{L}\p{N}_.\-]{3,})|(?:(?<![\p{L}\p{N}_])@[\p{L}\p{N}_.\-]{3,})"
SOCIAL = r"(?iu)(?:facebook|fb|ig|instagram|tiktok|whatsapp)(?U:\s*)[:：]?(?U:\s*)[\p{L}\p{N}_.\-]{3,}"
# End of the fixed values.

#: Kinds in the order in which they are looked for, and in which they are taken out.
FOUND = {"url": URL, "email": EMAIL, "line_id": LINE_ID, "social": SOCIAL, "phone": PHONE}
REMOVED = ("phone", "email", "url", "line_id", "social")
_BOUND = r"(?<![\p{L}\p{N}_])(?:%s)(?![\p{L}\p{N}_])"
#: The same with a word boundary before handles, against finds inside words such as "online shopping" or "original".
BOUNDED = FOUND | {"line_id": LINE_ID.replace("(?:(?:line", r"(?:(?<![\p{L}\p{N}_])(?:line"), "social": SOCIAL.replace("(?iu)", r"(?iu)(?<![\p{L}\p{N}_])")}


#: What a text in lower case must hold, one of them, for a kind to be found; others are not searched.
MARKS = {
    "url": ("://", "www."), "email": ("@",), "line_id": ("@", "line", "ไลน์", "ไอดี"), "phone": ("0",),
    "social": ("facebook", "fb", "ig", "instagram", "tiktok", "whatsapp"),
}
#: Letters that some pattern takes for i or s, but that lower case leaves as they are, or as i with a dot above.
_ODD = ("ı", "ſ", "\u0307")


def once(value: Column) -> Column:
    """The value, kept as a column of its own: so marked as not deterministic, it is neither copied into every column that uses
    it nor into a filter, which would compute all that it rests on again."""
    return F.when(F.spark_partition_id() >= 0, value)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def strip_ends(text: Column) -> Column:
    """The same for a stored column: only texts that begin or end with white space are searched."""
    return F.when(F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1))).rlike(r"(?U)\s"), strip(text)).otherwise(text)


def squeeze_inside(text: Column) -> Column:
    """Runs of two and more white space characters as one space; single tabs and newlines stay."""
    return F.regexp_replace(text, r"(?U)\s{2,}", " ")


def squeeze(text: Column) -> Column:
    """The same with ends stripped."""
    return strip(squeeze_inside(text))


def holds(low: Column, *marks: str) -> Column:
    """Whether a text in lower case holds one of some marks, so that a pattern in any case that needs one may match. A search for
    marks takes a small part of the time of a pattern."""
    odd = _ODD if any(c in m for m in marks for c in "is") else ()
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in (*marks, *odd)))


def _each(keep: Callable[[str], bool]) -> str:
    """A class that lists ASCII characters one by one: Java looks such a class up in one table, while ranges, categories and
    negations take a call each for every character of a text."""
    return "[" + "".join(f"\\x{k:02x}" for k in range(128) if keep(chr(k))) + "]"


_LATIN, _NO_WORD = _each(str.isalpha), _each(lambda c: not c.isalnum() and c != "_")


def language(text: Column) -> Column:
    """th if at least 15 % of the Thai and a-z letters are Thai, else en."""
    other = F.regexp_replace(text, f"[{THAI}]+", "")
    thai, latin = F.length(text) - F.length(other), F.length(other) - F.length(F.regexp_replace(other, f"{_LATIN}+", ""))
    return F.when(text.rlike(f"[{THAI}]") & (thai / (thai + latin) >= 0.15), "th").otherwise("en")


def has_html(text: Column) -> Column:
    return (F.contains(text, F.lit("<")) & text.rlike(HTML_TAG)) | (F.contains(text, F.lit("&")) & text.rlike(HTML_ENTITY))


def strip_html(text: Column) -> Column:
    marked = F.contains(text, F.lit("<")) | F.contains(text, F.lit("&"))
    return F.when(marked, F.regexp_replace(F.regexp_replace(text, HTML_TAG, " "), HTML_ENTITY, " ")).otherwise(text)


def _may_hold_emoji(text: Column) -> Column:
    """Whether a character lies in the one range around all that EMOJI lists, which Thai and Latin letters do not."""
    return (F.octet_length(text) > F.length(text)) & text.rlike(r"[\x{200D}-\x{1FAFF}]")


def emoji_count(text: Column) -> Column:
    return F.when(_may_hold_emoji(text), F.length(text) - F.length(F.regexp_replace(text, EMOJI, ""))).when(text.isNotNull(), 0)


def strip_emoji(text: Column) -> Column:
    return F.when(_may_hold_emoji(text), F.regexp_replace(text, EMOJI, " ")).otherwise(text)


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used. Inside lambdas, expressions are computed anew
    for every element; a value bound here is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_out(text: Column, pattern: str, finds: Column) -> Column:
    """Every match, listed in ``finds``, as spaces of the same length."""
    spaces = F.transform(finds, lambda h: F.repeat(F.lit(" "), F.length(h)))
    return F.when(F.size(finds) > 0, F.array_join(F.zip_with(F.split(text, pattern, -1), spaces, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")).otherwise(text)


def contacts(text: Column, patterns: dict[str, str] = FOUND) -> Column:
    """Map of kind to the distinct sorted finds; what one kind has found is blank for the next. For single values: tables take
    ``cleanse.contacts``, which keeps what is shared as columns."""
    kinds, left = [], text
    for kind, pattern in patterns.items():
        finds = find_all(left, pattern)
        kinds.append((F.lit(kind), F.array_sort(F.array_distinct(F.transform(finds, strip)))))
        left = blank_out(left, pattern, finds)
    return F.map_filter(F.create_map(*(x for pair in kinds for x in pair)), lambda _, v: F.size(v) > 0)


def collapse(text: Column) -> Column:
    """Three and more of a character: Thai as one, a-z as two, anything else but white space as one."""
    once = F.regexp_replace(text, rf"([{THAI}])\1{{2,}}", "$1")
    once = F.regexp_replace(once, r"([a-zA-Z])\1{2,}", "$1$1")
    once = F.regexp_replace(once, rf"(?U)([^{THAI}a-zA-Z\s])\1{{2,}}", "$1")
    return F.when(text.rlike(r"(?s)(.)\1\1"), once).otherwise(text)


def lower_latin(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: Column) -> Column:
    """SHA-1 of the lower-cased text without anything but letters, digits and Thai."""
    words = F.regexp_replace(F.lower(text), f"{_NO_WORD}+", "")
    return F.sha1(F.when(F.octet_length(words) > F.length(words), F.regexp_replace(words, rf"[^\x00-\x7F{THAI}\p{{L}}\p{{N}}]+", "")).otherwise(words))


def plain_tokens(text: Column) -> Column:
    """Runs of a-z and Thai letters, and runs of digits."""
    return find_all(text, rf"[a-zA-Z{THAI}]+|\p{{Nd}}+")
