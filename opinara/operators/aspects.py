"""Aspect sentiment: what is praised or blamed, by lexicon hits, negation and nearness. All within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions import lexicon as L
from opinara.functions import text as T

from .matching import array_of, drop_inner, joined, kept, names

#: A negation and at most one word after it, at the end of what stands before a hit.
NEGATED = r"(?:" + "|".join(L.NEGATIONS) + r")\s*\S*\s*$"


def negated(text: Column, start: Column) -> Column:
    """Whether one of the NEGATION_WINDOW characters before a place holds a negation with at most one word between."""
    return F.substr(text, F.greatest(start - L.NEGATION_WINDOW, F.lit(0)) + 1, F.least(start, F.lit(L.NEGATION_WINDOW))).rlike(NEGATED)


def general_hits(hits: Column, text: Column) -> Column:
    """array<(term, start, end, polarity)> of the words of praise and blame that are not bound to an aspect, of hits of
    ``lexicon.TERMS``."""
    known = dict(L.general_terms())
    sign = array_of([known.get(t, 0) for t in L.TERMS])
    polarity = lambda h: F.get(sign, h["ord"]) * F.when(negated(text, h["start"]), -1).otherwise(1)
    return F.transform(kept(hits, list(known)), lambda h: F.struct(h["term"].alias("term"), h["start"].alias("start"), (-h["neg"]).alias("end"), polarity(h).alias("polarity")))


def _bound() -> tuple[list[str], Column]:
    """The terms that are bound to aspects; for every place in ``lexicon.TERMS`` the (aspect, polarity) of its term, in aspect
    order. A hit is looked up by its place: a search for its term among all terms of an aspect takes longer than all else here."""
    table: dict[str, list[str]] = {t: [] for t in L.TERMS}
    for term, aspect, _, sign in sorted(L.aspect_terms(), key=lambda row: row[2]):
        table[term].append(f"struct('{aspect}' as aspect, {sign} as polarity)")
    kind = "array<struct<aspect:string,polarity:int>>"
    return [t for t, found in table.items() if found], F.expr("array(" + ", ".join(f"cast(array({', '.join(found)}) as {kind})" for found in table.values()) + ")")


def aspect_hits(hits: Column, text: Column) -> Column:
    """array<(aspect, term, start, end, polarity)> in text order, of hits of ``lexicon.TERMS``; a term of several aspects comes
    once for each, in aspect order."""
    terms, table = _bound()

    def entries(h: Column) -> Column:
        place = [h["term"].alias("term"), h["start"].alias("start"), (-h["neg"]).alias("end")]
        entry = lambda sign: lambda e: F.struct(e["aspect"].alias("aspect"), *place, (e["polarity"] * sign).alias("polarity"))
        return F.when(negated(text, h["start"]), F.transform(F.get(table, h["ord"]), entry(-1))).otherwise(F.transform(F.get(table, h["ord"]), entry(1)))

    return F.flatten(F.transform(kept(hits, terms), entries))


def attach(general: Column, pairs: Column) -> Column:
    """array<(aspect, polarity)>: each general hit goes to the aspect hit that is nearest, less than POLARITY_WINDOW away.

    Of equally near ones the aspect that came first in the text counts. A hit that begins right where the general one ends
    has no distance and does not count.
    """
    def nearest(g: Column, order: Column) -> Column:
        gap = lambda p: F.when(p["start"] > g["end"], p["start"] - g["end"]).otherwise(g["start"] - p["end"])
        near = F.filter(F.transform(pairs, lambda p: F.struct(gap(p).alias("gap"), F.array_position(order, p["aspect"]).alias("rank"), p["aspect"].alias("aspect"))), lambda c: c["gap"].between(0, L.POLARITY_WINDOW - 1))
        return F.struct(F.array_min(near)["aspect"].alias("aspect"), g["polarity"].alias("polarity"))

    found = T.let(F.array_distinct(F.transform(pairs, lambda p: p["aspect"])), lambda order: F.transform(general, lambda g: nearest(g, order)))
    return F.filter(found, lambda x: x["aspect"].isNotNull())


def analyze_aspects(df: DataFrame, tagged: bool = True) -> DataFrame:
    """Adds aspects, aspect_sentiment, aspect_evidence, pros, cons, overall_sentiment, sentiment_score and score parts.

    Needs tokens, hits and, if ``tagged``, pos_tags; without word classes there are no adjectives to look for. Evidence is the
    six longest terms, equal lengths by term.
    """
    once = T.once
    out = df.withColumn("_text", once(joined(F.col("tokens")))).withColumn("_pairs", once(aspect_hits(F.col("hits"), F.col("_text"))))
    free = F.filter(general_hits(F.col("hits"), F.col("_text")), lambda g: ~F.exists("_pairs", lambda p: (p["start"] <= g["start"]) & (g["start"] < p["end"])))
    out = out.withColumn("general_hits", once(free)).withColumn("_near", once(attach(F.col("general_hits"), F.col("_pairs"))))
    out = out.withColumn("aspects", once(F.array_distinct(F.transform("_pairs", lambda p: p["aspect"]))))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["polarity"])
    mine = lambda xs, a: F.filter(xs, lambda x: x["aspect"] == a)
    # twice the score, in whole numbers
    out = out.withColumn("_scores", once(F.transform("aspects", lambda a: F.struct(a.alias("aspect"), (2 * total(mine("_pairs", a)) + total(mine("_near", a))).alias("s")))))
    label = lambda s: F.when(s > 0, "pos").when(s < 0, "neg").otherwise("neutral")
    longest = lambda a: F.transform(F.slice(F.array_sort(F.array_distinct(F.transform(mine("_pairs", a), lambda p: F.struct((-F.length(p["term"])).alias("n"), p["term"].alias("term"))))), 1, 6), lambda x: x["term"])
    out = out.withColumn("_by", once(F.flatten(F.transform("aspects", lambda a: mine("_pairs", a)))))
    signed = lambda sign: F.transform(F.filter("_by", lambda p: p["polarity"] * sign > 0), lambda p: p["term"])
    out = out.withColumns({"_pros": once(signed(1)), "_cons": once(signed(-1))})
    adjective = lambda words: F.transform(F.filter("pos_tags", lambda p: (p["tag"] == "ADJ") & F.array_contains(array_of(words), F.lower(p["word"])) & ~F.array_contains("_pros", F.lower(p["word"])) & ~F.array_contains("_cons", F.lower(p["word"]))), lambda p: p["word"])
    said = lambda own, words: F.concat(own, adjective(words)) if tagged else F.col(own)
    negative_only = [w for w in L.GENERAL_NEGATIVE if w not in L.GENERAL_POSITIVE]
    general, sums = total(F.col("general_hits")), F.aggregate("_scores", F.lit(0), lambda a, x: a + x["s"])
    sizes = F.aggregate("_scores", F.lit(0), lambda a, x: a + F.abs(x["s"]))
    out = out.withColumns({
        "aspect_sentiment": once(F.map_from_entries(F.transform("_scores", lambda x: F.struct(x["aspect"], label(x["s"]))))),
        "aspect_evidence": once(F.map_from_entries(F.transform("aspects", lambda a: F.struct(a, longest(a))))),
        "pros": once(F.slice(drop_inner(said("_pros", L.GENERAL_POSITIVE)), 1, 8)),
        "cons": once(F.slice(drop_inner(said("_cons", negative_only)), 1, 8)),
        "_general": once(general), "_sums": once(sums), "_sizes": once(sizes),
        "_up": once(F.exists("_scores", lambda x: x["s"] > 0)), "_down": once(F.exists("_scores", lambda x: x["s"] < 0)),
    }).withColumns({"_total": F.col("_sums") + F.col("_general"), "_size": F.col("_sizes") + F.abs("_general")})
    overall = F.when(F.col("_up") & F.col("_down"), "mixed").when(F.col("_up") | (F.col("_total") > 0), "positive").when(F.col("_down") | (F.col("_total") < 0), "negative").otherwise("neutral")
    score = F.when(F.col("_size") > 0, F.bround(F.col("_total") / F.col("_size"), 3)).otherwise(0.0)
    # in half points, so both are whole
    out = out.withColumns({"overall_sentiment": once(overall), "sentiment_score": once(score), "score_total": F.col("_total"), "score_size": F.col("_size")})
    return out.drop("_text", "_pairs", "_near", "_scores", "_by", "_pros", "_cons", "_general", "_sums", "_sizes", "_total", "_size", "_up", "_down")
