"""Benchmark decontamination: a BM25 index of test items, queried with every passage by block-max WAND, then verified."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import chunks, split

#: Passages: windows of WINDOW words every STRIDE words, both doubled until a window holds the item. Two neighbouring windows
#: then hold any whole copy of it, so one of them holds half its score.
WINDOW, STRIDE = 64, 32
K1, B = 1.2, 0.75
#: A passage is retrieved when it holds this share of an item's own BM25 score.
RETRIEVE = 0.5
#: Shares of the question's word triples (words, if it has fewer) and of the answer's words that the place must hold.
QUESTION, ANSWER = 0.5, 0.5
#: Items in a block and in a part of a block, and items of one index; more items make more indexes, each of bounded size, used one after the other.
BLOCK, PART, MAX_ITEMS = 64, 4, 512
_HIT = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double,at_word:long>>"


def _hashes(texts: list[str | None]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, raw in chunks(texts):
        w = split(raw, letters=True)
        count = np.bincount(w.doc, minlength=len(raw))
        out += np.split(w.hash, np.cumsum(count)[:-1])
    return out


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, 1 to 3."""
    return sum((h[k : len(h) - n + 1 + k] * np.uint64(2 * k + 3) for k in range(n)), np.zeros(max(0, len(h) - n + 1), np.uint64))


@dataclass
class Statistics:
    """What BM25 has to know of all items, whatever index they are in: their number, mean length, and how many hold each term."""

    items: int
    mean: float
    terms: np.ndarray
    df: np.ndarray

    @classmethod
    def of(cls, words: list[np.ndarray]) -> Statistics:
        terms, df = np.unique(np.concatenate([np.empty(0, np.uint64), *map(np.unique, words)]), return_counts=True)
        return cls(len(words), sum(map(len, words)) / max(len(words), 1), terms, df)


def _item_words(items: pd.DataFrame) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(_hashes(items["question"].tolist()), _hashes(items["answer"].tolist()), strict=True)]


class Index:
    """BM25 postings of test items by term, in blocks with their largest impact.

    Impacts are shares of the item's own score, so one threshold serves all items. Terms that all together give no item more
    than half the threshold are passed over when passages are skipped (their scores count in full afterwards).
    """

    def __init__(self, items: pd.DataFrame, window: int = WINDOW, known: Statistics | None = None) -> None:
        self.window, self.stride = window, STRIDE * window // WINDOW
        items = items.sort_values("item_id").reset_index(drop=True)
        self.ids = items["item_id"].to_numpy(np.int64)
        question, answer = _hashes(items["question"].tolist()), _hashes(items["answer"].tolist())
        self.run = [max(1, min(3, len(q))) for q in question]
        self.question = [np.unique(_runs(q, n)) for q, n in zip(question, self.run, strict=True)]
        self.answer = [np.unique(a) for a in answer]
        words = [np.concatenate(x) for x in zip(question, answer, strict=True)]
        self.lengths = np.array([len(x) for x in words], np.int64)
        doc = np.repeat(np.arange(len(words)), self.lengths)
        self.terms, term = np.unique(np.concatenate(words) if words else np.empty(0, np.uint64), return_inverse=True)
        pair, tf = np.unique(term * max(len(words), 1) + doc, return_counts=True)
        term, doc = pair // max(len(words), 1), pair % max(len(words), 1)
        known = known or Statistics.of(words)
        df = known.df[np.searchsorted(known.terms, self.terms)]
        idf = np.log1p((known.items - df + 0.5) / (df + 0.5))
        size = self.lengths[doc] / max(known.mean, 1)
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size))
        impact = impact / np.bincount(doc, impact, len(words))[doc]
        first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.postings = [(doc[a:b], impact[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        # largest impact of every term in every part of every block of items; the last row stands for words of no item
        parts = np.zeros((len(self.terms) + 1, -(-max(len(words), 1) // BLOCK) * (BLOCK // PART)), np.float32)
        np.maximum.at(parts, (term, doc // PART), impact.astype(np.float32))
        self.part_max = parts.reshape(len(parts), -1, BLOCK // PART)
        self.block_max = self.part_max.max(axis=2)
        self.most = self.block_max.max(axis=1)
        rising, total, spared = np.argsort(idf, kind="stable"), np.zeros(len(words)), np.zeros(len(self.terms) + 1, bool)
        for t in rising:
            d, w = self.postings[t]
            if (total[d] + w).max() > RETRIEVE / 2:
                break
            total[d] += w
            spared[t] = True
        self.rest = total.max(initial=0)
        self.bound = np.where(spared, 0, self.most)

    def likely(self, term: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray, int, list[int]]]:
        """(number of a window, its distinct terms, a block, its parts whose largest impacts add up to the threshold) of the
        windows and blocks that have such parts. Windows whose rarer words cannot bring any item there are passed over first, by one
        running sum; then blocks, then parts of the blocks that are left."""
        none, theta = len(self.terms), RETRIEVE - 1e-5
        sums = np.concatenate(([0.0], np.cumsum(self.bound[term])))
        some = np.flatnonzero(sums[end] - sums[start] >= theta - self.rest)
        step = max(1, 512 * WINDOW // self.window)
        for k in range(0, len(some), step):
            w = some[k : k + step]
            at = start[w, None] + np.arange(self.window)
            terms = np.where(at < end[w, None], term[np.minimum(at, len(term) - 1)], none)
            terms.sort(axis=1)
            terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = none
            row, block = np.nonzero(self.block_max[terms].sum(axis=1) >= theta)
            for m in range(0, len(row), 512):
                r, b = row[m : m + 512], block[m : m + 512]
                alive = self.part_max[terms[r], b[:, None]].sum(axis=1) >= theta
                for x in np.flatnonzero(alive.any(axis=1)).tolist():
                    t = terms[r[x]]
                    yield int(w[r[x]]), t[t < none], int(b[x]), np.flatnonzero(alive[x]).tolist()

    def top(self, query: np.ndarray, block: int, alive: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND over a block: (item, score) of all items of its parts ``alive`` whose score over the distinct terms
        reaches the threshold.

        Lists are kept by their current item. The pivot is the first item that the lists up to it could bring to the
        threshold by their largest impacts in the block; what lies before it is skipped, and so is the whole part around it
        if that is not alive.
        """
        found, lists, lo = [], [], block * BLOCK
        most = self.block_max[query, block]
        for t, m in zip(query[most > 0].tolist(), most[most > 0].tolist(), strict=True):
            d, w = self.postings[t]
            a = int(d.searchsorted(lo))
            b = a + int(d[a : a + BLOCK].searchsorted(lo + BLOCK))
            lists.append([d[a:b].tolist(), w[a:b].tolist(), m, 0])
        while lists:
            lists.sort(key=lambda x: x[0][x[3]])
            bound, pivot = 0.0, None
            for x in lists:
                bound += x[2]
                if bound >= RETRIEVE - 1e-5:
                    pivot = x[0][x[3]]
                    break
            if pivot is None:
                break
            part = (pivot - lo) // PART
            if part not in alive:
                pivot = lo + min((p for p in alive if p > part), default=BLOCK // PART) * PART
                for x in lists:
                    x[3] = bisect_left(x[0], pivot, x[3])
                lists = [x for x in lists if x[3] < len(x[0])]
                continue
            score = 0.0
            for x in lists:
                x[3] = bisect_left(x[0], pivot, x[3])
                if x[3] < len(x[0]) and x[0][x[3]] == pivot:
                    score += x[1][x[3]]
                    x[3] += 1
            if score >= RETRIEVE:
                found.append((pivot, score))
            lists = [x for x in lists if x[3] < len(x[0])]
        return found

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple]]]:
        """(number of a text, its verified hits) for every text with any."""
        if not len(self.terms):
            return
        for at, raw in chunks(texts):
            w = split(raw, letters=True)
            k = np.minimum(np.searchsorted(self.terms, w.hash), len(self.terms) - 1)
            term = np.where(self.terms[k] == w.hash, k, len(self.terms))
            count = np.bincount(w.doc, minlength=len(raw))
            first = np.concatenate(([0], np.cumsum(count)))
            # every window of every text of the chunk: from, to
            windows = np.maximum(1, -(-(count - self.window) // self.stride) + 1) * (count > 0)
            text = np.repeat(np.arange(len(raw)), windows)
            turn = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
            start = first[text] + turn * self.stride
            end = np.minimum(start + self.window, first[text + 1])
            hits: dict[int, dict[int, list[tuple[float, int]]]] = {}
            for j, query, block, alive in self.likely(term, start, end):
                d = hits.setdefault(int(text[j]), {})
                for item, score in self.top(query, block, alive):
                    d.setdefault(item, []).append((-score, int(start[j])))
            for d, places in hits.items():
                kept = []
                for item, found in sorted(places.items()):
                    n = self.window
                    # every retrieved window until one is verified, the best first, of equal ones the earlier
                    for score, s in sorted(found):
                        h = w.hash[max(first[d], s - n) : min(first[d + 1], s + self.window + n)]
                        q = np.isin(self.question[item], _runs(h, self.run[item])).mean() if len(self.question[item]) else 1.0
                        a = np.isin(self.answer[item], h).mean() if len(self.answer[item]) else 1.0
                        if q >= QUESTION and a >= ANSWER:
                            kept.append((int(self.ids[item]), -score, float(q), float(a), int(s - first[d])))
                            break
                if kept:
                    yield at + d, kept


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, question, answer) of ``benchmark(item_id, text)``: the last sentence is the answer, what precedes it the question.

    A text of one sentence is all question. Null and blank texts are left out.
    """
    text = F.rtrim("text")
    cut = r"(?s)^(.*[.!?])\s+(\S.*)$"
    whole = benchmark.where("item_id is not null and text is not null").where(text.rlike(r"\S"))
    return whole.select(F.col("item_id").cast("long"), F.when(text.rlike(cut), F.regexp_extract(text, cut, 1)).otherwise(text).alias("question"), F.regexp_extract(text, cut, 2).alias("answer"))


def indexes(items: pd.DataFrame, known: Statistics | None = None) -> list[Index]:
    """Indexes of the items, one for each size of window."""
    words = _item_words(items)
    known = known or Statistics.of(words)
    doublings = np.array([max(0, -(-len(w) // WINDOW) - 1).bit_length() for w in words], np.int64)
    return [Index(items[doublings == k], WINDOW << int(k), known) for k in np.unique(doublings)] or [Index(items)]


def _told_apart(items: DataFrame) -> DataFrame:
    """(n, terms): number of words and distinct terms of every item, terms as signed 64-bit hashes."""

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = _item_words(f)
            yield pd.DataFrame({"n": [len(w) for w in found], "terms": [np.unique(w).view(np.int64) for w in found]})

    return items.select("question", "answer").mapInPandas(words, "n long, terms array<long>")


def _statistics(items: DataFrame, blocks: list[DataFrame]) -> Iterator[Statistics]:
    """Statistics of all items, for each block those of its own terms; counted by grouped aggregates."""
    all_items = _told_apart(items)
    n, mean = all_items.agg(F.count("*"), F.avg("n")).first()
    df = all_items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).persist(StorageLevel.DISK_ONLY)
    for b in blocks:
        own = _told_apart(b).select(F.explode("terms").alias("term")).distinct().join(df, "term").toPandas()
        terms, order = np.unique(own["term"].to_numpy(np.int64).view(np.uint64), return_index=True)
        yield Statistics(n, mean, terms, own["df"].to_numpy(np.int64)[order])
    df.unpersist()


def finders(items: DataFrame) -> list:
    """Column functions that give a text's leaks, one for each block of at most MAX_ITEMS items and size of window.

    The number of items is counted first; only bounded blocks of them come to the driver and are broadcast. Scores rest on
    statistics of all items, so they do not depend on the blocks.
    """
    spark, n = items.sparkSession, items.count()
    blocks = max(1, -(-2 * n // MAX_ITEMS)) if n > MAX_ITEMS else 1

    def finder(index: Index):
        shared = spark.sparkContext.broadcast(index)

        @F.pandas_udf(_HIT)
        def leaks(text: pd.Series) -> pd.Series:
            out: list = [[] for _ in range(len(text))]
            for k, hits in shared.value.search(text.tolist()):
                out[k] = hits
            return pd.Series([[dict(zip(("item_id", "score", "question_overlap", "answer_overlap", "at_word"), h, strict=True)) for h in x] for x in out])

        return leaks

    if blocks == 1:
        return [finder(index) for index in indexes(items.toPandas())]
    parts = [items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) for b in range(blocks)]
    return [finder(index) for p, known in zip(parts, _statistics(items, parts), strict=True) for index in indexes(p.toPandas(), known)]


def leaks(text: Column, found: list) -> Column:
    return reduce(F.concat, [f(text) for f in found])


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, at_word): every leak of an item into a row of ``docs(doc_id, text)``.

    Every passage of every whole text is a query. score is the best passage's share of the item's own BM25 score; overlaps
    are measured around that passage. Rows of null or empty text have no leaks; without items there are none; repeated rows
    are each reported; columns of other names are ignored. One row's search needs that row and the index only: no shuffle.
    """
    found = docs.select("doc_id", F.explode(leaks(F.col("text"), finders(items))).alias("hit"))
    return found.select("doc_id", "hit.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), items_of(table(spark, sf_dir, "benchmark")))
