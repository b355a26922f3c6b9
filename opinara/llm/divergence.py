"""Divergence of sources from each other and from their language, by joint histograms of term counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

#: Texts are counted together until they hold this many bytes; a longer text is counted alone, and whole.
CHUNK = 4 << 20
#: Shares are whole multiples of one part in so many.
SCALE = 1_000_000_000
#: Parts in which the best terms of a group are looked for before they are compared.
SALT = 16
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of the text, term) of all terms of texts in their order: runs of ASCII letters, as a-z, and of what is not ASCII."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    data = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    low = np.where((data >= 65) & (data <= 90), data | 32, data)
    inside = ((low >= 97) & (low <= 122)) | (low >= 128)
    # a term ends with its text, even where the next text goes on with a letter
    edges = np.unique(ends[(ends > 0) & (ends < len(data))])
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    return np.searchsorted(ends, start, "right"), pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(low[inside].tobytes()))


def _tally(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Counts of a part of a batch: every (lang, source) with an empty term, and every term of each with its occurrences and texts."""
    lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
    group, width = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), len(source.dictionary)
    doc, term = _terms(batch.column(2))
    coded = term.dictionary_encode()
    size = max(1, len(coded.dictionary))
    pair, n = np.unique(doc * size + coded.indices.to_numpy(), return_counts=True)
    key, place = np.unique(group[pair // size] * size + pair % size, return_inverse=True)
    groups = np.unique(group)
    of = np.concatenate((groups, key // size))
    none = np.zeros(len(groups), np.int64)
    return pa.RecordBatch.from_arrays([
        lang.dictionary.take(pa.array(of // width)), source.dictionary.take(pa.array(of % width)),
        pa.concat_arrays([pa.array([""] * len(groups), pa.string()), coded.dictionary.take(pa.array(key % size))]),
        pa.array(np.concatenate((none, np.bincount(place, n, len(key)).astype(np.int64)))), pa.array(np.concatenate((none, np.bincount(place, minlength=len(key)).astype(np.int64)))),
    ], schema=_COUNTS)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term in each group and the number of its texts; a row with an
    empty term for every group. Counted by chunk of texts in Arrow tasks, by task before the shuffle, and by term after it."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
                yield _tally(batch.slice(at, to - at))
                at = to

    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    found = docs.select(text("lang"), text("source"), text("text")).mapInArrow(tally, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly; null without terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    quotient = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + 1), F.nullif(wide(total) + wide(terms), F.lit(0).cast("decimal(20,0)")))
    return quotient + 1


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def joint_counts(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, na, nb, times) of every pair of sources a < b of a language: how many kept terms occur na times in a
    and nb times in b, cells with zeros included; together they hold all V terms of the language.

    Only terms that occur in both meet in a join by term. What only one has follows from the histograms of single sources:
    those with (na, 0) are the terms of a with na, less those that b has too, and what neither has is left of V.
    """
    once = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("times"))
    a, b = (kept.select("lang", "term", F.col("source").alias(s), F.col("n").alias(f"n{s}")) for s in "ab")
    both = a.join(b, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "na", "nb").agg(F.count("*").alias("times"))
    cells = "inline(array(struct(na, nb, times), struct(na, 0L as nb, -times as times), struct(0L as na, nb, -times as times), struct(0L as na, 0L as nb, times)))"
    pairs = groups.select("lang", F.col("source").alias("a"), "terms").join(groups.select("lang", F.col("source").alias("b")), "lang").where("a <> b")
    single = once.withColumnRenamed("source", "a").join(pairs, ["lang", "a"])
    first = F.expr("inline(array(struct(if(a < b, n, 0L) as na, if(a < b, 0L, n) as nb, times), struct(0L as na, 0L as nb, -times as times)))")
    parts = [
        both.select("lang", "a", "b", F.expr(cells)), single.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), first),
        pairs.where("a < b").select("lang", "a", "b", F.lit(0).cast("long").alias("na"), F.lit(0).cast("long").alias("nb"), F.col("terms").alias("times")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("times").alias("times"))


def audit(docs: DataFrame, f: Callable[[Column, Column], Column] = divergence, min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): how far every source of a language lies from each other one (``pair``), and
    which terms it uses more than its language does (``term``, the ``top`` first).

    ``docs(lang, source, text)``; null is empty, in all three. A language keeps the terms of ``min_docs`` texts or more. A
    group or language gives each kept term a share p, by its count plus one, in whole parts. ``f(p, q)`` is summed over
    all kept terms, evaluated once for each combination of counts; languages without kept terms have 0. Groups without terms
    are there, an empty table gives no rows; further columns are left out. Sums that do not fit a long raise an error.

    Whatever is large is keyed by term: a source or language with a third of all rows is spread over its terms. Pairs of
    sources are the result asked for, as many for any number of rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        counts = scratch.write(term_counts(docs))
        own = counts.where("term <> ''")
        langs = scratch.write(own.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"))
        kept = scratch.write(own.join(langs, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
        sizes = langs.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
        totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
        groups = scratch.write(groups.na.fill(0, ["total", "terms", "lang_total"]))

        side = lambda s: groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"total_{s}"), *(["terms"] if s == "a" else []))
        cells = joint_counts(kept, groups).where("times > 0").join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"])
        cells = cells.withColumns({f"p{s}": share(F.col(f"n{s}"), F.col(f"total_{s}"), F.col("terms")) for s in "ab"})
        sums = cells.groupBy("lang", "a", "b").agg(F.sum(f(F.col("pa"), F.col("pb")) * F.col("times")).alias("ab"), F.sum(f(F.col("pb"), F.col("pa")) * F.col("times")).alias("ba"))
        every = groups.select("lang", F.col("source").alias("a")).join(groups.select("lang", F.col("source").alias("b")), "lang").where("a < b")
        sums = every.join(sums, ["lang", "a", "b"], "left").na.fill(0, ["ab", "ba"])
        pair = sums.select("lang", F.expr("inline(array(struct(a as source, b as item, ab as value), struct(b as source, a as item, ba as value)))"))

        used = kept.join(groups, ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("total"), F.col("terms")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))})
        term = used.where("p > q").select("lang", "source", F.col("term").alias("item"), f(F.col("p"), F.col("q")).alias("value"))
        order = (F.desc("value"), "item")
        best = term.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(SALT))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(*order))).where(F.col("rank") <= top)
        rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(*order)).alias("rank")
        ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank)
        out = ranked(pair, "pair").unionByName(ranked(best, "term").where(F.col("rank") <= top))
        return scratch.hand_on(scratch.write(out))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select rid, lang, source, unnest(w) as term from d),
kept as (select lang, term, count(*) as n from t group by 1, 2 having count(distinct rid) >= 3),
v as (select lang, count(*) as v, sum(n) as n from kept group by 1),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by 1, 2, 3),
tot as (select lang, source, sum(n) as n from c group by 1, 2),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.n as ln, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (coalesce(tot.n, 0) + v.v) as p
  from g join kept k using (lang) join v using (lang) left join c using (lang, source, term) left join tot using (lang, source)),
pair as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pair0 as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source),
q as (select p.lang, p.source, 'term' as part, p.term as item, p.p, p.n, 1 + 1000000000::hugeint * (p.ln + 1) // (v.n + v.v) as q from p join v using (lang)),
u as (select * from pair0 union all select lang, source, part, item, (p - q) * (p - q) // q from q where n > 0 and p > q)
select lang, source, part, item, value::bigint as value, rank from (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from u) where part = 'pair' or rank <= 200
"""
