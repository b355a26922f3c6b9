"""Corpus analytics on token lists: TF-IDF keywords, term counts, topics."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from opinara.sources.reviews import discard, scratch


def term_counts(df: DataFrame, key: str, tokens: str, min_df: int = 2, max_share: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """((key, term, n), (term, df, n_docs)): counts per document and document frequencies within bounds.

    Document frequencies are joined by broadcast only if the optimiser finds the table small; else by a shuffle on terms, where
    the adaptive skew join splits frequent ones.
    """
    counts = df.where(F.size(tokens) > 0).select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    n_docs = df.where(F.size(tokens) > 0).agg(F.count("*").alias("n_docs"))
    dfs = counts.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n_docs))
    return counts, dfs.where((F.col("df") >= min_df) & (F.col("df") <= max_share * F.col("n_docs")))


def _counted(tokens: pa.Array) -> pa.Array:
    """The distinct words of each row, and how often each of them comes; nulls are none."""
    parts = [_count(tokens[k : k + 256]) for k in range(0, len(tokens), 256)]
    sizes = np.concatenate([[0], *(x[0] for x in parts)])
    terms, n = pa.concat_arrays([x[1] for x in parts]), pa.array(np.concatenate([x[2] for x in parts]), pa.int64())
    at = pa.array(np.cumsum(sizes), pa.int32())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, terms), pa.ListArray.from_arrays(at, n)], names=["term", "n"])


def _count(tokens: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of distinct words of each row, the words, their counts)."""
    words = tokens.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()))
    codes, size = words.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), max(len(words.dictionary), 1)
    pairs, n = np.unique((row * size + codes)[codes >= 0], return_counts=True)
    return np.bincount(pairs // size, minlength=len(tokens)), words.dictionary.take(pa.array(pairs % size)), n


def tfidf_keywords(df: DataFrame, key: str = "review_id", tokens: str = "tokens_clean", top: int = 15) -> DataFrame:
    """(term, weight): mean over all non-empty documents of L2-normed tf * (ln((1 + N) / (1 + df)) + 1), to four digits.

    Ties by term. Fewer than two documents give no rows. A document is all rows of one key.

    Words are counted within the row, and stay there: documents are dealt only to meet their norms, and only where keys come
    twice also to be put together. A term's weight is its part in all documents times one factor of its own, so sums need no join;
    norms take one, by broadcast only if the terms' file is small.
    """
    spark, path, counted = df.sparkSession, scratch(df.sparkSession, "tfidf"), F.arrow_udf(_counted, "struct<term:array<string>,n:array<long>>").asNondeterministic()
    listed = df.where(F.size(tokens) > 0).select(key, F.col(tokens).alias("tokens"))
    if not df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        listed = listed.groupBy(key).agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    listed.select(key, counted("tokens").alias("c")).select(key, "c.term", "c.n").write.option("compression", "zstd").parquet(f"{path}/documents")
    docs = spark.read.parquet(f"{path}/documents")
    n_docs = docs.agg(F.count(key)).first()[0]
    dfs = docs.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= 2) & (F.col("df") <= 0.6 * n_docs) & F.lit(n_docs >= 2))
    dfs.select("term", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf")).write.parquet(f"{path}/terms")
    terms, each = spark.read.parquet(f"{path}/terms"), F.explode(F.arrays_zip("term", "n")).alias("t")
    norms = docs.select(key, each).select(key, "t.term", "t.n").join(terms, "term").groupBy(key).agg(F.sqrt(F.sum((F.col("n") * F.col("idf")) * (F.col("n") * F.col("idf")))).alias("norm"))
    sums = docs.join(norms, key).select("norm", each).groupBy("t.term").agg(F.sum(F.col("t.n") / F.col("norm")).alias("s"))
    found = sums.join(terms, "term").select("term", (F.col("s") * F.col("idf") / n_docs).alias("weight")).orderBy(F.desc("weight"), "term").limit(top)
    found.select("term", F.round("weight", 4).alias("weight")).write.parquet(f"{path}/found")
    for part in ("documents", "terms"):
        discard(spark, f"{path}/{part}")
    return spark.read.parquet(f"{path}/found")


def digamma(x: np.ndarray) -> np.ndarray:
    """For positive numbers, to about 12 digits: recurrence up to 6 and more, then the asymptotic series."""
    x, out = np.array(x, float), 0.0
    for _ in range(6):
        out, x = out - 1 / x, x + 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


class Fitted(NamedTuple):
    """Documents' weights of topics, and by document and word the counts expected of each topic."""

    weight: np.ndarray
    counts: np.ndarray


def fit_documents(starts: np.ndarray, n: np.ndarray, beta: np.ndarray, prior: float, rounds: int = 100, tolerance: float = 1e-3) -> Fitted:
    """Variational weights of many documents at once, none of them empty; document d has the words from starts[d] to
    starts[d + 1]: n occurrences of each, whose row of beta is exp(E[log p(word | topic)]).

    Each document starts from equal weights and stops for itself, when its weights change by less than the tolerance.
    """
    sizes, weight = np.diff(starts), np.ones((len(starts) - 1, beta.shape[1]))
    theta_of = lambda w: np.exp(digamma(w) - digamma(w.sum(1))[:, None])
    active = np.arange(len(sizes))
    for _ in range(rounds):
        if not len(active):
            break
        own = np.repeat(starts[active] - np.concatenate(([0], np.cumsum(sizes[active])[:-1])), sizes[active])
        rows, theta = own + np.arange(len(own)), theta_of(weight[active])
        some = beta[rows]
        ratio = n[rows] / ((some * np.repeat(theta, sizes[active], 0)).sum(1) + 1e-100)
        first = np.concatenate(([0], np.cumsum(sizes[active])[:-1]))
        new = prior + theta * np.add.reduceat(ratio[:, None] * some, first, axis=0)
        moved = np.abs(new - weight[active]).mean(1)
        weight[active] = new
        active = active[moved >= tolerance]
    theta = np.repeat(theta_of(weight), sizes, 0)
    return Fitted(weight, (n / ((beta * theta).sum(1) + 1e-100))[:, None] * theta * beta)


def _fit(rows: pa.Array, topics: int) -> tuple[np.ndarray, pa.Array, Fitted]:
    """(starts, terms, fit) of a column of words as ``_documents`` makes it."""
    starts, flat = rows.offsets.to_numpy().astype(np.int64), rows.flatten()
    n, beta = flat.field("n").to_numpy().astype(float), flat.field("b").flatten().to_numpy().reshape(-1, topics)
    return starts - starts[0], flat.field("term"), fit_documents(starts - starts[0], n, beta, 1 / topics)


_STATS = "array<struct<term:string,s:array<double>>>"
#: Weights of more terms times topics than this do not pass through the driver: 32 MB as numbers of a table.
MAX_CELLS = 1 << 22
#: Where they do not, tables of weights of more terms than this are not broadcast, whatever the size of their files.
MAX_BROADCAST = 20_000
#: Words of documents that are fitted at once.
_AT_ONCE = 200_000
_CODED = [StructField("content", BinaryType()), StructField("code", ArrayType(IntegerType())), StructField("n", ArrayType(IntegerType()))]


def _expected(weights: np.ndarray) -> np.ndarray:
    """exp(E[log p(word | topic)]) by term and topic."""
    return np.exp(digamma(weights) - digamma(weights.sum(0)))


def _coded(docs: DataFrame, key: str, terms: pa.Array) -> DataFrame:
    """(key, content, code, n) of ``docs(key, term array, n array)``: the places of a document's terms in ``terms``, in order, and their
    counts; content is a hash of both. Documents with none of the terms are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("term")
            at = pc.index_in(lists.flatten(), value_set=shared.value).fill_null(-1).to_numpy(zero_copy_only=False)
            row, found = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), at >= 0
            order = np.lexsort((at, row))
            order = order[found[order]]
            pairs = np.stack([at[order], batch.column("n").flatten().to_numpy()[order]], 1).astype(np.int32)
            sizes = np.bincount(row[found], minlength=len(lists))
            some, ends, data = np.flatnonzero(sizes), np.cumsum(sizes[sizes > 0]), pairs.tobytes()
            starts = np.concatenate([[0], ends]).astype(np.int32)
            content = [hashlib.sha256(data[8 * a : 8 * b]).digest() for a, b in itertools.pairwise(starts.tolist())]
            columns = [pa.ListArray.from_arrays(pa.array(starts), pa.array(pairs[:, k].copy())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(some)), pa.array(content, pa.binary()), *columns], names=[key, "content", "code", "n"])

    return docs.select(key, "term", "n").mapInArrow(code, StructType([docs.schema[key], *_CODED]))


def _fits(batch: pa.RecordBatch, beta: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Fitted]]:
    """(first document, last and one, starts, codes, fit) for runs of a batch's documents as ``_coded`` makes them."""
    ends, codes, n = batch.column("code").offsets.to_numpy().astype(np.int64), batch.column("code").flatten().to_numpy(), batch.column("n").flatten().to_numpy().astype(float)
    ends, a = ends - ends[0], 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + _AT_ONCE, "right")) - 1)
        part = slice(ends[a], ends[b])
        yield a, b, ends[a : b + 1] - ends[a], codes[part], fit_documents(ends[a : b + 1] - ends[a], n[part], beta[codes[part]], 1 / beta.shape[1])
        a = b


def _weights(contents: DataFrame, terms: pa.Array, topics: int, iterations: int, seed: int) -> np.ndarray:
    """Weights by term and topic as ``topic_terms`` gives them, of ``contents(code, n, times)``: what a task's documents add to them is
    added up there, then by term."""
    spark, size, names = contents.sparkSession, len(terms), [f"s{k}" for k in range(topics)]
    weights = np.array([[zlib.crc32(f"{seed}|{k}|{t}".encode()) / (1 << 32) + 0.5 for k in range(topics)] for t in terms.to_pylist()])
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(_expected(weights))

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table = np.zeros((size, topics))
            for batch in batches:
                times = batch.column("times").to_numpy()
                for a, b, starts, codes, fitted in _fits(batch, shared.value):
                    counts = fitted.counts * np.repeat(times[a:b], np.diff(starts))[:, None]
                    for k in range(topics):
                        table[:, k] += np.bincount(codes, counts[:, k], size)
            at = np.flatnonzero(table.any(1))
            for some in np.array_split(at, len(at) // 50_000 + 1):
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(table[some, k]) for k in range(topics))], names=["code", *names])

        sums = contents.mapInArrow(add, ", ".join(["code int", *(f"{s} double" for s in names)])).groupBy("code").agg(*(F.sum(s).alias(s) for s in names))
        # a row for each term, at most MAX_CELLS numbers
        got = sums.toArrow()
        shared.destroy()
        weights = np.full((size, topics), 1 / topics)
        weights[got["code"].to_numpy()] += np.stack([got[s].to_numpy() for s in names], 1)
    return weights


def _documents(counts: DataFrame, terms: DataFrame, key: str, topics: int) -> DataFrame:
    """(key, words) with the words of each document, their counts and expectations under ``terms(term, l)``."""
    total = [float(x) for x in terms.agg(*(F.sum(F.get("l", F.lit(k))) for k in range(topics))).first()]

    @F.arrow_udf("array<double>")
    def expected(rows: pa.Array) -> pa.Array:
        values = np.exp(digamma(rows.flatten().to_numpy().reshape(-1, topics)) - digamma(np.array(total)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * topics, pa.int32()), pa.array(values.ravel()))

    beta = terms.select("term", expected("l").alias("b"))
    if terms.count() > MAX_BROADCAST:
        beta = beta.hint("merge")
    return counts.join(beta, "term").groupBy(key).agg(F.collect_list(F.struct("term", "n", "b")).alias("words"))


def _weights_by_joins(counts: DataFrame, key: str, topics: int, iterations: int, seed: int) -> DataFrame:
    """``topic_terms`` for any vocabulary: weights are tables, joined by term in every iteration."""
    spark, prior = counts.sparkSession, 1 / topics

    @F.arrow_udf(_STATS)
    def stats(words: pa.Array) -> pa.Array:
        starts, terms, fitted = _fit(words, topics)
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(terms) + 1) * topics, pa.int32()), pa.array(fitted.counts.ravel()))
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([terms, each], names=["term", "s"]))

    start = F.array(*(F.crc32(F.concat(F.lit(f"{seed}|{k}|"), "term")) / F.lit(float(1 << 32)) + 0.5 for k in range(topics)))
    path = scratch(spark, "topics")
    counts.select("term").distinct().select("term", start.alias("l")).write.parquet(f"{path}/0")
    for k in range(iterations):
        terms = spark.read.parquet(f"{path}/{k}")
        found = _documents(counts, terms, key, topics).select(F.explode(stats("words")).alias("w")).select("w.*")
        sums = found.groupBy("term").agg(*(F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(topics)))
        sums.select("term", F.array(*(F.col(f"s{j}") + prior for j in range(topics))).alias("l")).write.parquet(f"{path}/{k + 1}")
        discard(spark, f"{path}/{k}")
    return spark.read.parquet(f"{path}/{iterations}")


def _listed(terms: DataFrame, topics: int) -> pa.Array | None:
    """The terms in order, or None if they are more than weights may pass through the driver for."""
    if terms.limit(MAX_CELLS // topics + 1).count() > MAX_CELLS // topics:
        return None
    found = terms.select("term").toArrow()["term"].combine_chunks()
    return found.take(pc.sort_indices(found))


def _contents(coded: DataFrame) -> DataFrame:
    """Equal documents as one, with the number of times they come; a table of its own."""
    spark, path = coded.sparkSession, scratch(coded.sparkSession, "contents")
    coded.groupBy("content", "code", "n").agg(F.count("*").alias("times")).write.parquet(path)
    return spark.read.parquet(path)


def topic_terms(counts: DataFrame, key: str, topics: int, iterations: int = 20, seed: int = 42) -> DataFrame:
    """(term, l): the weight of every term in each topic, after batch variational updates of a topic model over
    ``counts(key, term, n)``; priors are 1 / topics, the start is a hash of seed, topic and term.

    Documents of equal counts are fitted once. An iteration is one step within the document and one aggregate by term. The weights,
    and nothing else, go from there to the driver and back to all, as a table of numbers; those of more than MAX_CELLS terms times
    topics stay where they are and are joined by term, so the vocabulary has no bound.
    """
    terms = _listed(counts.select("term").distinct(), topics)
    if terms is None:
        return _weights_by_joins(counts, key, topics, iterations, seed)
    docs = counts.groupBy(key).agg(F.collect_list(F.struct("term", F.col("n").cast("long").alias("n"))).alias("w")).select(key, "w.term", "w.n")
    weights = _weights(_contents(_coded(docs, key, terms)), terms, topics, iterations, seed)
    each = pa.ListArray.from_arrays(pa.array(np.arange(len(terms) + 1) * topics, pa.int32()), pa.array(weights.ravel()))
    return counts.sparkSession.createDataFrame(pa.table({"term": terms, "l": each}))


def lda_topics(df: DataFrame, key: str = "review_id", tokens: str = "tokens_clean", topics: int = 5, words: int = 8, seed: int = 42, iterations: int = 20) -> tuple[DataFrame, DataFrame]:
    """((topic_id, words), (key, topic_id)): leading words of each topic, and the strongest topic of each document.

    Terms of two documents and more, but not of over 0.6 of all, count. Documents without tokens have a null topic, as have
    those without such terms. With fewer than two documents a topic, or fewer terms than topics, there are no topics and all
    assignments are null.
    """
    spark, counted = df.sparkSession, F.arrow_udf(_counted, "struct<term:array<string>,n:array<long>>").asNondeterministic()
    none = spark.createDataFrame([], "topic_id int, words array<string>"), df.select(key, F.lit(None).cast("int").alias("topic_id"))
    path = scratch(spark, "topics")
    # what makes the tokens is done once
    df.where(F.size(tokens) > 0).select(key, counted(tokens).alias("c")).select(key, "c.term", "c.n").write.option("compression", "zstd").parquet(f"{path}/documents")
    docs = spark.read.parquet(f"{path}/documents")
    n_docs = docs.count()
    if n_docs < 2 * topics:
        return none
    if not docs.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():
        each = docs.select(key, F.explode(F.arrays_zip("term", "n")).alias("w")).groupBy(key, "w.term").agg(F.sum("w.n").alias("n"))
        docs = each.groupBy(key).agg(F.collect_list(F.struct("term", "n")).alias("w")).select(key, "w.term", "w.n")
    dfs = docs.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    dfs.where((F.col("df") >= 2) & (F.col("df") <= 0.6 * n_docs)).select("term").write.parquet(f"{path}/terms")
    kept = spark.read.parquet(f"{path}/terms")
    if kept.limit(topics).count() < topics:
        return none
    terms = _listed(kept, topics)
    if terms is None:
        counts = docs.select(key, F.explode(F.arrays_zip("term", "n")).alias("w")).select(key, "w.term", "w.n")
        return _topics_by_joins(df, counts.join(kept, "term"), key, topics, words, seed, iterations)
    coded = _coded(docs, key, terms)
    contents = _contents(coded)
    weights = _weights(contents, terms, topics, iterations, seed)
    # of equal weights the first term
    first = np.argsort(-weights, 0, kind="stable")[:words]
    leading = spark.createDataFrame([(k, terms.take(pa.array(first[:, k])).to_pylist()) for k in range(topics)], "topic_id int, words array<string>")
    shared = spark.sparkContext.broadcast(_expected(weights))

    def strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [fitted.weight.argmax(1) for *_, fitted in _fits(batch, shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(np.concatenate([*best, []]), pa.int32())], names=["content", "topic_id"])

    best = coded.select(key, "content").join(contents.mapInArrow(strongest, "content binary, topic_id int"), "content").select(key, "topic_id")
    return leading, df.select(key).join(best, key, "left")


def _topics_by_joins(df: DataFrame, counts: DataFrame, key: str, topics: int, words: int, seed: int, iterations: int) -> tuple[DataFrame, DataFrame]:
    """``lda_topics`` of the counts of terms that count, for any vocabulary."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "term-counts")
    counts.write.parquet(path)
    counts = spark.read.parquet(path)
    terms = _weights_by_joins(counts, key, topics, iterations, seed)
    weighed = terms.select("term", F.posexplode("l").alias("topic_id", "w"))
    place = F.row_number().over(W.partitionBy("topic_id").orderBy(F.desc("w"), "term"))
    first = weighed.withColumn("p", place).where(F.col("p") <= words).groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("p", "term"))).alias("x"))
    leading = first.select("topic_id", F.transform("x", lambda x: x["term"]).alias("words"))

    @F.arrow_udf("int")
    def strongest(rows: pa.Array) -> pa.Array:
        return pa.array(_fit(rows, topics)[2].weight.argmax(1), pa.int32())

    best = _documents(counts, terms, key, topics).select(key, strongest("words").alias("topic_id"))
    return leading, df.select(key).join(best, key, "left")
