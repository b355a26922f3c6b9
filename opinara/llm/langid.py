"""Language of web pages: text likelihoods fused with declared language, address suffix and smoothed host priors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clear, stash, stashes, table
from .tokens import chunks
from .urls import host_of

#: Buckets of hashed byte triples in the text model; languages in one block of it (a bound on what is broadcast at once).
BUCKETS, LANGUAGES = 1 << 15, 128
#: Weight of one triple's evidence (neighbouring triples repeat each other) and the most that text may say against a language.
TEMPER, MOST = 0.2, 40.0
#: Bytes up to which sums by declaration and by suffix are broadcast.
SMALL = 32 << 20
#: Pseudo-counts: of a triple, of a declaration or suffix, and of a parent's share in a host's or domain's prior.
TRIPLE_PRIOR, MARK_PRIOR, PARENT = 0.5, 0.5, 5.0


def _triples(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every byte triple around a letter; anything else counts as a space, so do a text's ends."""
    data = np.frombuffer(b" " + b"  ".join(raw) + b"  ", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data | 32, data)
    data = np.where(((data >= 97) & (data <= 122)) | (data >= 128), data, 32).astype(np.uint32)
    first = np.cumsum([0] + [len(r) + 2 for r in raw])
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(17)
    # a triple belongs to the text of its middle
    doc = np.repeat(np.arange(len(raw)), np.diff(first))[: len(code)]
    real = (data[1:-1] != 32) & ~((data[:-2] == 32) & (data[2:] == 32))
    return doc[real], bucket[real].astype(np.int64)


def text_model(labelled: DataFrame) -> tuple[list[str], list[np.ndarray]]:
    """(languages, blocks of log-likelihoods by language and bucket) from ``labelled(text, lang)``: counts over all rows.

    Each task adds up its rows, and per language and bucket one sum is shuffled. Languages come back in blocks, one row of
    BUCKETS sums each; however many there are, all are known. Rows without text or lang are left out.
    """

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for part in parts:
            langs = part["lang"].tolist()
            for at, raw in chunks(part["text"].tolist()):
                doc, bucket = _triples(raw)
                names, code = np.unique(np.array(langs[at : at + len(raw)], object).astype(str), return_inverse=True)
                sums = np.bincount(code[doc] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, row in zip(names.tolist(), sums, strict=True):
                    held[name] = held.get(name, 0) + row
        for name, row in held.items():
            k = np.flatnonzero(row)
            yield pd.DataFrame({"lang": name, "bucket": k, "n": row[k]})

    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    sums = rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    mark = stashes()
    sums = stash(sums.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")))
    languages, blocks = sorted(r["lang"] for r in sums.select("lang").collect()), []
    for k in range(0, len(languages), LANGUAGES):
        own = languages[k : k + LANGUAGES]
        table_ = np.full((len(own), BUCKETS), TRIPLE_PRIOR)
        for lang, bucket, n in sums.where(F.col("lang").isin(*own)).toPandas()[["lang", "bucket", "n"]].itertuples(index=False):
            table_[own.index(lang), np.asarray(bucket, int)] += n
        blocks.append(np.log(table_ / table_.sum(axis=1, keepdims=True)).astype(np.float32))
    clear(labelled.sparkSession, mark)
    return languages, blocks


def text_evidence(spark: SparkSession, model: tuple[list[str], list[np.ndarray]], text: Column) -> Column:
    """Log-likelihoods of a text by language, in the model's order; zeros for no text. One function for each block of languages."""

    def of_block(logs: np.ndarray) -> Column:
        shared = spark.sparkContext.broadcast(logs)

        @F.pandas_udf("array<double>")
        def evidence(text: pd.Series) -> pd.Series:
            out: list = []
            for _, raw in chunks(text.tolist()):
                doc, bucket = _triples(raw)
                out += list(np.stack([np.bincount(doc, row[bucket], len(raw)) for row in shared.value], axis=1) * TEMPER)
            return pd.Series(out)

        return evidence(text)

    return F.concat(*map(of_block, model[1]))


def visible_text(html: Column) -> Column:
    """Text of a page without its head, scripts, styles, navigation, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|head|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&[A-Za-z0-9#]+;", " ")


def declared(html: Column) -> Column:
    """Primary subtag of the language that the markup declares, lower case; empty if none."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1))


def _parts() -> dict[str, Column]:
    """Suffix and domain of a host."""
    return {"suffix": F.regexp_extract("host", r"([^.:]*)(?::[0-9]*)?$", 1), "domain": F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)}


def _small(df: DataFrame, n: int) -> DataFrame:
    """df, broadcast if its rows of n numbers are counted to stay within SMALL bytes."""
    return F.broadcast(df) if df.limit(SMALL // (8 * n) + 1).count() <= SMALL // (8 * n) else df


def identify(pages: DataFrame, model: tuple[list[str], list[np.ndarray]]) -> DataFrame:
    """(page_id, host, declared, suffix, text_lang, lang, prob) of every row of ``pages(page_id, url, html)``.

    Text likelihoods alone give every page weights over the languages. Grouped sums of these weights give, with all pages
    counted, the chance of a declaration and of an address suffix under each language, and the priors of a host, backed by
    those of its domain, its suffix and the whole, PARENT pseudo-counts at each step. The page's own weight is taken out of
    the host and domain sums. lang has the largest posterior (ties: first by name), prob is it. Pages without text, url or
    declaration rely on the rest; null html or url count as empty. Repeated rows stay; an empty table gives no rows; without
    any labelled language lang is null; columns of other names are ignored.
    """
    spark, languages = pages.sparkSession, model[0]
    n = len(languages)
    host = host_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), declared(F.col("html")).alias("declared"), visible_text(F.coalesce("html", F.lit(""))).alias("_text"))
    if not n:
        return rows.select("page_id", "host", "declared", _parts()["suffix"].alias("suffix"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("prob"))
    rows = rows.withColumn("e", text_evidence(spark, model, F.col("_text"))).drop("_text")
    rows = rows.withColumn("_best", F.array_max("e")).withColumn("e", F.transform("e", lambda x: F.greatest(x - F.col("_best"), F.lit(-MOST)))).drop("_best")
    exps = F.transform("e", lambda x: F.exp(x))
    mark = stashes()
    rows = stash(rows.withColumn("w", F.transform(exps, lambda x: x / F.aggregate(exps, F.lit(0.0), lambda a, b: a + b))))
    name = F.lit(languages)

    def sums(df: DataFrame, key: str, column: str, alias: str) -> DataFrame:
        return df.groupBy(key).agg(vector_to_array(Summarizer.sum(array_to_vector(column))).alias(alias))

    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    blend = lambda own, parent, size: F.zip_with(own, parent, lambda x, p: (x + PARENT * p) / (size + PARENT))
    # a host has one domain and one suffix, so pages are gathered by host only
    hosts = stash(sums(rows, "host", "w", "s_host").withColumns(_parts()))
    domains, suffixes = stash(sums(hosts, "domain", "s_host", "s_domain")), stash(sums(hosts, "suffix", "s_host", "s_suffix"))
    marks = stash(sums(rows, "declared", "w", "s_declared"))
    whole = (sums(suffixes.withColumn("all", F.lit(1)), "all", "s_suffix", "s").first() or {"s": [0.0] * n})["s"]
    kinds = max(marks.count(), 1)
    base, seen = F.lit([(x + 1) / (sum(whole) + n) for x in whole]), F.lit([x + MARK_PRIOR * kinds for x in whole])
    suffixes = suffixes.select("suffix", blend(F.col("s_suffix"), base, total(F.col("s_suffix"))).alias("of_suffix"))
    hosts = hosts.join(_small(suffixes, n), "suffix").join(domains, "domain").select("host", "suffix", "of_suffix", "s_domain", total(F.col("s_domain")).alias("n_domain"), "s_host", total(F.col("s_host")).alias("n_host"))
    marks = marks.select("declared", F.when(F.col("declared") == "", F.transform("s_declared", lambda _: F.lit(0.0))).otherwise(F.zip_with("s_declared", seen, lambda x, m: F.log((x + MARK_PRIOR) / m))).alias("said"))
    joined = rows.join(_small(marks, n), "declared").join(hosts, "host")
    # without the page's own weight
    others = lambda c: F.zip_with(c, "w", lambda s, w: F.greatest(s - w, F.lit(0.0)))
    of_domain = blend(others("s_domain"), F.col("of_suffix"), F.col("n_domain") - 1)
    of_host = blend(others("s_host"), of_domain, F.col("n_host") - 1)
    posterior = F.zip_with(F.zip_with("e", of_host, lambda e, p: e + F.log(p)), "said", lambda x, y: x + y)
    out = joined.withColumn("_p", posterior).withColumn("_m", F.array_max("_p"))
    out = out.withColumn("_z", total(F.transform("_p", lambda x: F.exp(x - F.col("_m")))))
    best = lambda c: F.element_at(name, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    out = stash(out.select("page_id", "host", "declared", "suffix", best("e").alias("text_lang"), best("_p").alias("lang"), (1 / F.col("_z")).alias("prob")))
    clear(spark, mark, out)
    return out


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = text_model(table(spark, sf_dir, "documents").select("text", "lang"))
    return identify(table(spark, sf_dir, "pages").select("page_id", "url", "html"), model)
