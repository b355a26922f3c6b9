"""Word classes by a hidden Markov model: counts by grouped aggregates, Viterbi in Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More known words than this are refused, so what every worker holds has a bound.
MAX_WORDS = 200_000
#: Added to every count.
SMOOTH = 0.1


@dataclass
class Model:
    """Logarithms: of the first tag, of a tag (column) after another (row), and of a word by tag; unknown words share one row."""

    tags: list[str]
    first: np.ndarray
    after: np.ndarray
    words: dict[str, np.ndarray]
    unknown: np.ndarray

    def best(self, words: list[str]) -> list[str]:
        """The likeliest tags of a sentence; of equal ones the first in the order of tags, from the end on."""
        if not words:
            return []
        seen, back = [self.words.get(w, self.unknown) for w in words], []
        score = self.first + seen[0]
        for e in seen[1:]:
            ways = score[:, None] + self.after
            back.append(ways.argmax(0))
            score = ways.max(0) + e
        path = [int(score.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return [self.tags[k] for k in reversed(path)]


def fit(tagged: DataFrame, column: str = "pos_tags", times: str | None = None) -> Model:
    """A model of sentences ``column: array<struct<word, tag>>``, of which each counts once or ``times``; words count in lower case.

    Pairs of neighbouring tags are read off each row, so nothing is grouped by sentence: the aggregates are by pair of tags
    and by (word, tag). Words seen once stand for those never seen. A table without sentences is refused.
    """
    pairs = F.transform(column, lambda p, i: F.struct(F.when(i > 0, F.get(F.col(column), i - 1)["tag"]).alias("last"), F.lower(p["word"]).alias("word"), p["tag"].alias("tag")))
    seen = tagged.select(F.explode(pairs).alias("p"), (F.col(times) if times else F.lit(1)).cast("long").alias("n")).select("p.*", "n")
    moves = seen.groupBy("last", "tag").agg(F.sum("n").alias("n")).collect()
    counts = seen.groupBy("word", "tag").agg(F.sum("n").alias("n"))
    if counts.select("word").distinct().limit(MAX_WORDS + 1).count() > MAX_WORDS:
        raise ValueError(f"a model holds at most {MAX_WORDS} words")
    if not moves:
        raise ValueError("there are no tagged sentences")
    tags = sorted({r["tag"] for r in moves})
    place, k = {t: i for i, t in enumerate(tags)}, len(tags)
    first, after, words = np.full(k, SMOOTH), np.full((k, k), SMOOTH), {}
    for r in moves:
        if r["last"] is None:
            first[place[r["tag"]]] += r["n"]
        else:
            after[place[r["last"]], place[r["tag"]]] += r["n"]
    for r in counts.collect():
        words.setdefault(r["word"], np.full(k, SMOOTH))[place[r["tag"]]] += r["n"]
    rare = sum((n - SMOOTH for n in words.values() if n.sum() < 1.5 + SMOOTH * k), np.zeros(k)) + SMOOTH
    total = sum(words.values(), np.zeros(k)) + rare
    return Model(tags, np.log(first / first.sum()), np.log(after / after.sum(1, keepdims=True)), {w: np.log(n / total) for w, n in words.items()}, np.log(rare / total))


def tagger(spark, model: Model):
    """For ``cleanse.tag_words``: a column function tokens -> array<struct<word, tag>>; words are looked up in lower case. Null
    gives null."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<struct<word:string,tag:string>>")
    def tags(tokens: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("word", pa.string()), ("tag", pa.string())]))
        rows = (None if r is None else [{"word": w, "tag": t} for w, t in zip(r, shared.value.best([w.lower() for w in r]), strict=True)] for r in tokens.to_pylist())
        return pa.array(list(rows), kind)

    return tags.asNondeterministic()
