"""Toxicity: a logistic classifier whose scores are held still when identity terms are swapped."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clear, stash, stashes, table
from .tokens import chunks, mix, split

#: The classifier is fitted on at most this many distinct labelled texts, those of lowest hash.
MAX_TRAIN = 12_000
#: At most this many features are kept, by likelihood ratio; a feature needs MIN_DOCS texts and a ratio of MIN_RATIO.
MAX_FEATURES, MIN_DOCS, MIN_RATIO = 20_000, 3, 8.0
#: Byte lengths of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6, 7)
L1, STEPS, SWAP_WEIGHT = 1e-5, 1500, 10.0
REJECT = 0.7

#: Identity terms by group; a swap puts the next term of the group in place of each.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"), ("deaf", "blind", "disabled"), ("old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


def inserter(groups=IDENTITY_TERMS):
    """A function that puts an identity term into a text; term and place follow from the text's checksum."""
    terms = [t for g in groups for t in g]

    def insert(text: str) -> str:
        mark = zlib.crc32(text.encode("utf-8", "surrogatepass"))
        gaps = [m.start() for m in re.finditer(r"\s", text)]
        at = gaps[mark // len(terms) % len(gaps)] if gaps else len(text)
        return f"{text[:at]} {terms[mark % len(terms)]}{text[at:]}"

    return insert


def swapper(groups=IDENTITY_TERMS):
    """A function that swaps every identity term of a text, or None where the text has none."""
    following = {t: g[(k + 1) % len(g)] for g in groups for k, t in enumerate(g)}
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, following), key=len, reverse=True)) + r")(?!\w)", re.I)

    def swap(text: str | None) -> str | None:
        return pattern.sub(lambda m: following[m[0].lower()], text) if text and pattern.search(text) else None

    return swap


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per chunk of texts: numbers of texts, hashes of their words and word beginnings."""
    for at, raw in chunks([t.lower() if t else t for t in texts]):
        w = split(raw, letters=True)
        docs, found = [w.doc], [w.hash]
        for n in PREFIXES:
            longer = np.flatnonzero(w.end - w.start > n)
            docs.append(w.doc[longer])
            found.append(mix(w.part(w.start[longer], w.start[longer] + n)))
        yield np.concatenate(docs) + at, np.concatenate(found)


@dataclass
class Model:
    """Sorted feature hashes with their weights; of bounded size."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    pairs: int = 0
    change: float = 0.0

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def known(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct pairs of text and feature number."""
        for doc, h in features(texts):
            maybe = self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
            doc, h = doc[maybe], h[maybe]
            at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
            hit = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
            pair = np.unique(doc[hit] * max(len(self.hashes), 1) + at[hit])
            yield pair // max(len(self.hashes), 1), pair % max(len(self.hashes), 1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for doc, k in self.known(texts):
            z += np.bincount(doc, self.weights[k], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(doc: np.ndarray, feature: np.ndarray, y: np.ndarray, n: int, swaps: list[tuple[np.ndarray, np.ndarray]], swap_weight: float = SWAP_WEIGHT) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model, classes weighed alike, with an L1 term and ``swap_weight`` times the mean squared
    change of the score's log-odds over swapped pairs of texts as penalties; accelerated proximal gradient steps."""
    weigh = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    cf_row = np.concatenate([np.full(len(a) + len(b), k) for k, (a, b) in enumerate(swaps)]) if swaps else np.empty(0, int)
    cf_col = np.concatenate([np.concatenate(p) for p in swaps]) if swaps else np.empty(0, int)
    cf_sign = np.concatenate([np.concatenate((np.ones(len(a)), -np.ones(len(b)))) for a, b in swaps]) if swaps else np.empty(0)
    lam = swap_weight / max(len(swaps), 1)
    # traces bound the largest eigenvalues
    step = 1 / (0.25 * (weigh * (np.bincount(doc, minlength=len(y)) + 1)).sum() + 2 * lam * len(cf_row))
    w = v = np.zeros(n + 1)
    t = 1.0
    for _ in range(STEPS):
        z = np.bincount(doc, v[feature], len(y)) + v[n]
        g = (1 / (1 + np.exp(-z)) - y) * weigh
        grad = np.append(np.bincount(feature, g[doc], n), g.sum())
        if swaps:
            change = np.bincount(cf_row, v[cf_col] * cf_sign, len(swaps))
            grad[:n] += 2 * lam * np.bincount(cf_col, change[cf_row] * cf_sign, n)
        new = v - step * grad
        new[:n] = np.sign(new[:n]) * np.maximum(np.abs(new[:n]) - step * L1, 0)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v = new + (last - 1) / t * (new - w)
        w = new
    return w[:n], float(w[n])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, groups=IDENTITY_TERMS, swap_weight: float = SWAP_WEIGHT) -> Model:
    """Fit on the texts of ``docs(doc_id, text)`` that ``labels(doc_id, toxic)`` marks; rows with a null in any are left out,
    equal texts count once (toxic if any row is).

    Every text of the sample gives one counterfactual pair: with its identity terms (those of ``groups``) swapped, or, if it
    has none, with a term of a group put in. The terms are features even where no text holds them. Without
    groups there are no pairs. The model's ``pairs`` and ``change`` tell how many there are and how much the log-odds of the
    score still differ on average.
    The sample is chosen among hashes of texts; only its texts are fetched. Word statistics are grouped aggregates over the
    sample; only the MAX_FEATURES best and the sample's hits on them, both of bounded size, come to the driver. Without
    labels of both classes the model scores every text 0.
    """
    sign = F.struct(F.xxhash64("text").alias("h"), F.crc32("text").alias("c"))
    marks = docs.where("text is not null").select("doc_id", sign.alias("mark")).join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id")
    chosen = marks.groupBy("mark").agg(F.max("toxic").cast("int").alias("toxic"), F.min("doc_id").alias("doc_id")).orderBy("mark").limit(max_train)
    texts = docs.where("text is not null").select("doc_id", "text", sign.alias("mark")).join(F.broadcast(chosen), ["doc_id", "mark"])
    mark = stashes()
    sample = stash(texts.dropDuplicates(["doc_id", "mark"]).select("text", "toxic").repartition(16))

    def hashed(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in rows:
            y = part["toxic"].to_numpy()
            for doc, h in features(part["text"].tolist()):
                pair = np.unique(np.stack((doc.astype(np.uint64), h)), axis=1)
                f, at = np.unique(pair[1], return_inverse=True)
                label = y[pair[0].astype(np.int64)]
                yield pd.DataFrame({"f": f.view(np.int64), "pos": np.bincount(at, label).astype(np.int64), "n": np.bincount(at)})

    n_pos, n_all = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if n_pos in (0, n_all):
        clear(docs.sparkSession, mark)
        return Model(np.empty(0, np.uint64), np.empty(0), -30.0)
    counted = sample.mapInPandas(hashed, "f long, pos long, n long").groupBy("f").agg(F.sum("pos").alias("a"), F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS)
    rate = n_pos / n_all
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    a, n = F.col("a"), F.col("n")
    ratio = 2 * (part(a, n * rate) + part(n - a, n * (1 - rate)))
    best = counted.withColumn("g", ratio).where(F.col("g") >= MIN_RATIO).orderBy(F.desc("g"), "f").limit(MAX_FEATURES).select("f")
    terms = np.concatenate([np.empty(0, np.uint64), *(h for _, h in features([" ".join(t for g in groups for t in g)]))])
    hashes = np.unique(np.concatenate((best.toPandas()["f"].to_numpy(np.int64).view(np.uint64), terms)))
    model = Model(hashes, np.zeros(len(hashes)), 0.0)
    swap, insert = (swapper(groups), inserter(groups)) if groups else (None, None)

    def hits(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in rows:

            def lists(texts: list[str]) -> list[np.ndarray]:
                out: list = [np.empty(0, int)] * len(texts)
                for doc, k in model.known(texts):
                    for d, x in zip(*np.unique(doc, return_index=True), strict=True):
                        out[d] = k[x : x + np.searchsorted(doc[x:], d, "right")]
                return out

            texts = part["text"].tolist()
            pairs = [(t, swap(t) or insert(t)) for t in texts] if groups else [(t, t) for t in texts]
            one, other = (lists(list(x)) for x in zip(*pairs, strict=True)) if texts else ([], [])
            yield pd.DataFrame({"toxic": part["toxic"], "x": lists(texts), "a": list(map(np.setdiff1d, one, other)), "b": list(map(np.setdiff1d, other, one))})

    found = sample.mapInPandas(hits, "toxic int, x array<int>, a array<int>, b array<int>").toPandas()
    doc = np.repeat(np.arange(len(found)), [len(x) for x in found["x"]])
    feature = np.concatenate([np.asarray(x, int) for x in found["x"]]) if len(found) else np.empty(0, int)
    swaps = [(np.asarray(a, int), np.asarray(b, int)) for a, b in zip(found["a"], found["b"], strict=True)] if groups else []
    model.weights, model.bias = fit(doc, feature, found["toxic"].to_numpy(float), len(hashes), swaps, swap_weight)
    model.pairs = len(swaps)
    model.change = float(np.mean([abs(model.weights[a].sum() - model.weights[b].sum()) for a, b in swaps])) if swaps else 0.0
    clear(docs.sparkSession, mark)
    return model


def scorer(spark: SparkSession, model: Model):
    """A column function: score of a text from 0 to 1. Null and empty texts get the score of no features."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(text.tolist()))

    return score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def seen_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) outside the held-out fold."""
    return labels.where("doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = scorer(spark, train(docs, seen_labels(table(spark, sf_dir, "labels"))))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= REJECT, 1).otherwise(0))
