"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_MAIL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"

#: Patterns by kind. Repeated groups are written as lazy runs of one character class that end where no further piece can
#: follow, and starts inside a run are skipped; both match the plain forms exactly, without their recursion and rescans.
PATTERNS = {
    "email": rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]+@[{_HOST}]+\.[{_HOST}][{_HOST}.]*?(?![{_HOST}]|\.[{_HOST}])",
    "ip": r"(?:(?<![0-9])|\G)[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?=[ -]?[0-9])[0-9 -]*?(?![0-9]|[ -][0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+.A-Za-z-])0[0-9]{1,4}[ ./-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9]|[.-][0-9])",
}
BASE = ("email", "ip", "card", "phone")
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: Words that raise the score of a kind when they stand in the CONTEXT code points before a span.
CONTEXT = 40
CONTEXT_WORDS = {
    "email": "mail|e-mail|email|contact|correo|courriel",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": "tel|phone|call|mobile|fax|telefon|téléphone|móvil|whatsapp",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "local_phone": "tel|phone|call|mobile|fax|telefon|téléphone|móvil|whatsapp",
}
#: Score of a confirmed span without context; a context word adds CONTEXT_BONUS; spans under THRESHOLD go.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.95, "local_phone": 0.3}
CONTEXT_BONUS, THRESHOLD = 0.3, 0.5
_SPAN = "struct<kind:string,start:int,end:int,text:string,score:double>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def mod97(x: Column) -> Column:
    """Remainder of an IBAN by 97: the first four characters moved to the end, letters as 10 to 35."""
    plain = F.replace(x, F.lit(" "))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    codes = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(codes, F.lit(0), lambda a, d: F.when(d < 10, (a * 10 + d) % 97).otherwise((a * 100 + d) % 97))


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "ip":
        return x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return F.length(F.replace(x, F.lit(" "))).between(15, 34) & (mod97(x) == 1)
    if kind == "local_phone":
        return n.between(9, 12)
    return F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    """All confirmed spans of one kind: matches and the gaps between them give the places in code points."""
    pattern = PATTERNS[kind]
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("text"), F.length(g).alias("gap"), F.length(h).alias("n")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))
    walk = F.aggregate(
        pairs, zero,
        lambda a, x: F.struct((a["at"] + x["gap"] + x["n"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["n"]).alias("end"), x["text"].alias("text")))).alias("out")),
        lambda a: a["out"],
    )
    near = lambda s: F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
    score = lambda s: F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near(s).rlike(rf"(?iu)(?<!\p{{L}})(?:{CONTEXT_WORDS[kind]})(?!\p{{L}})"), CONTEXT_BONUS).otherwise(0.0))
    scored = F.transform(F.filter(walk, lambda s: _valid(kind, s["text"])), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), score(s).alias("score")))
    kept = scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= THRESHOLD)
    digits = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]"}.get(kind, r"[0-9]{2}")
    guard = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike(digits))
    return F.when(guard & text.rlike(pattern), kept).otherwise(F.array().cast(f"array<{_SPAN}>"))


def detect(docs: DataFrame, column: str = "text", into: str = "pii") -> DataFrame:
    """Adds ``into``: array of (kind, start, end, text, score) by kind as listed, then start; code points, end exclusive.

    Works within the row, whole texts, no shuffle. Spans of the base kinds that pass their check always stay; those of
    other kinds need THRESHOLD. Null texts count as empty and have no spans; a column that is already named ``into`` is
    replaced, others are untouched. Repeated rows are searched each; an empty table gives no rows.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    return docs.withColumn(into, F.concat(*(_spans(kind, text) for kind in PATTERNS)))


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """The same rows and columns with every span of ``column`` replaced by its kind in angle brackets.

    Overlapping spans become one mark, of the first. Null stays null; texts without spans are unchanged. Other columns,
    whatever their names, are untouched.
    """
    spans = "spans"
    while spans in docs.columns:
        spans += "_"
    found, text = detect(docs, column, spans), F.col(column)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))))
    walk = F.aggregate(
        ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] >= a["at"], F.struct((-s["neg"]).alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out")))
        .otherwise(F.struct(F.greatest(a["at"], -s["neg"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)),
    )
    return found.withColumn(column, F.when(F.size(spans) > 0, walk).otherwise(text)).drop(spans)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(line(F.filter("pii", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), line(F.col("pii")).alias("spans"))
