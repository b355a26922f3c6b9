"""Names of organisations and places by an averaged perceptron over word sequences: updates by grouped aggregates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.sources.reviews import discard, scratch

#: Tags of words: none, or the first or a later word of a name.
TAGS = ["O", "B-org", "I-org", "B-place", "I-place"]
#: Features are hashed into so many rows of weights, so a model has the same size whatever it learns from.
BUCKETS = 1 << 17
#: Rounds over all labelled texts.
ROUNDS = 15
#: Added to how often a feature occurs, so that what is rare is learned more slowly than what it stands beside.
RARE = 10
#: Part of a word's features' rates of errors that is learned in a round: they are ten.
STEP = 0.1
#: Words of texts that are tagged at once in learning.
_AT_ONCE = 50_000

_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|\S")
#: A later word of a name only follows a word of a name of the same kind; the last row is what stands before a text.
_ALLOWED = np.array([[not b.startswith("I-") or a[1:] == b[1:] for b in TAGS] for a in [*TAGS, "start"]])
_SIZE, _K = BUCKETS + len(TAGS) + 1, len(TAGS)


def shape(word: str) -> str:
    """Letters by case and digits, runs cut to two: McDonald is AaAaa, X-200 is A-dd."""
    return re.sub(r"(.)\1+", r"\1\1", "".join("d" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word))


def features(words: list[str]) -> list[list[int]]:
    """Rows of weights that speak for each word: equally many for all of them."""
    low, shapes = ["<", *map(str.lower, words), ">"], ["<", *map(shape, words), ">"]

    def of(i: int) -> list[str]:
        w = low[i]
        return ["", f"w {w}", f"s {shapes[i]}", f"p {w[:3]}", f"e {w[-3:]}", f"b {low[i - 1]}", f"a {low[i + 1]}", f"bs {shapes[i - 1]} {shapes[i]}", f"as {shapes[i]} {shapes[i + 1]}", f"bw {low[i - 1]} {shapes[i]}"]

    return [[zlib.crc32(f.encode()) % BUCKETS for f in of(i)] for i in range(1, len(words) + 1)]


def marked(words: list[str], names: dict[str, list[str] | None]) -> list[int]:
    """Tags of a text's words in which the names given by kind are marked, from the left, longer ones first; case counts."""
    listed = sorted(((tuple(_WORD.findall(n)), kind) for kind in ("org", "place") for n in names.get(kind) or [] if n and n.strip()), key=lambda x: (-len(x[0]), x))
    tags, i = [0] * len(words), 0
    while i < len(words):
        found = next(((n, kind) for n, kind in listed if tuple(words[i : i + len(n)]) == n), None)
        if found:
            tags[i : i + len(found[0])] = [TAGS.index(f"B-{found[1]}")] + [TAGS.index(f"I-{found[1]}")] * (len(found[0]) - 1)
        i += len(found[0]) if found else 1
    return tags


def best(weights: np.ndarray, rows: np.ndarray, right: np.ndarray | None = None) -> list[int]:
    """The tags of highest sum of weights for a text's features; of equal ones the first in the order of tags, from the end on.

    In learning, where the right tags are known, every other one gets a lead of 1.
    """
    seen = weights[rows].sum(1)
    if right is not None:
        seen += 1 - np.eye(_K)[right]
    after = np.where(_ALLOWED, weights[BUCKETS:], -np.inf)
    score, back = after[-1] + seen[0], []
    for e in seen[1:]:
        ways = score[:, None] + after[:-1]
        back.append(ways.argmax(0))
        score = ways.max(0) + e
    path = [int(score.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def best_of_all(weights: np.ndarray, rows: np.ndarray, starts: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``best`` for many texts at once, in learning: text t has the words from starts[t] to starts[t + 1], one and more.

    All texts take their first step together, then those of two words and more their second, and so on.
    """
    seen = weights[rows[:, 0]]
    for j in range(1, rows.shape[1]):
        seen += weights[rows[:, j]]
    seen += 1 - np.eye(_K)[right]
    after = np.where(_ALLOWED, weights[BUCKETS:], -np.inf)
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    first, active = starts[:-1][order], np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), "left")
    score, back = after[-1] + seen[first], [np.empty((0, _K), int)]
    for i, n in enumerate(active[1:].tolist(), 1):
        ways = score[:n, :, None] + after[:-1]
        back.append(ways.argmax(1))
        score[:n] = ways.max(1) + seen[first[:n] + i]
    out, now = np.empty(len(rows), int), score.argmax(1)
    for i, n in reversed(list(enumerate(active.tolist()))):
        out[first[:n] + i] = now[:n]
        if i:
            now[:n] = back[i][np.arange(n), now[:n]]
    return out


def spans(text: str, weights: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the names in a text."""
    words = list(_WORD.finditer(text))
    if not words:
        return []
    found: list[tuple[str, int, int]] = []
    for w, tag in zip(words, best(weights, np.array(features([w.group() for w in words]))), strict=True):
        if tag and TAGS[tag].startswith("I-"):
            found[-1] = (*found[-1][:2], w.end())
        elif tag:
            found.append((TAGS[tag][2:], w.start(), w.end()))
    return found


@dataclass
class Model:
    """Averaged weights by feature, tag before and tag; errors: wrong tags that led or came near in each round, twice."""

    weights: np.ndarray
    errors: list[int]


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, org, place = (batch.column(k).to_pylist() for k in range(3))
        cut = [(w, o, p) for t, o, p in zip(texts, org, place, strict=True) if (w := _WORD.findall(t))]
        rows = [sum(features(w), []) for w, *_ in cut]
        tags = [marked(w, {"org": o, "place": p}) for w, o, p in cut]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), pa.array(tags, pa.list_(pa.int32()))], names=["features", "tags"])


def _cells(table: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(table)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(table[at], pa.int64())], names=["cell", "n"])


def _sums(texts: DataFrame, count) -> np.ndarray:
    """What ``count(rows, tags, starts)`` yields of many texts at once, cells of a table of a fixed size and whether they go up or down by
    one: added up in each task, then by cell."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(_SIZE * _K, np.int64)
        for batch in batches:
            rows, tags, ends = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(), batch.column(1).offsets.to_numpy().astype(np.int64)
            rows, ends, a = rows.reshape(len(tags), -1) if len(tags) else rows, ends - ends[0], 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + _AT_ONCE, "right")) - 1)
                part = slice(ends[a], ends[b])
                for cells, sign in count(rows[part], tags[part], ends[a : b + 1] - ends[a]):
                    table += sign * np.bincount(cells.ravel(), minlength=len(table))
                a = b
        yield _cells(table)

    # at most as many rows as the table has cells
    got = texts.mapInArrow(add, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_SIZE * _K)
    out[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    return out.reshape(_SIZE, _K)


def _moves(tags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Row of weights of the tag before each one."""
    before = np.append(len(TAGS), tags[:-1])
    before[starts[:-1]] = len(TAGS)
    return BUCKETS + before


def fit(labelled: DataFrame, rounds: int = ROUNDS) -> Model:
    """A model of ``labelled(text, org array<string>, place array<string>)``, where names stand as they are written in the text.

    All texts are learned from; equal rows count once, null and blank texts not at all. Each round
    tags all texts with the weights so far, where wrong tags have a lead: right ones shall be ahead by a margin. What right tags add to weights and wrong ones take from them is summed by
    weight, and divided by how often its feature occurs and RARE: a feature moves by its rate of errors. All sums are
    of integers, so the model does not rest on how the input is split. The weights after each round are averaged.
    Learning ends early once all are. Without texts all weights are zero, and nothing is a name.
    """
    spark = labelled.sparkSession
    texts = labelled.where(F.trim(F.regexp_replace("text", r"\s", "")) != "").select("text", "org", "place").distinct()
    path = scratch(spark, "names")
    # dealt anew: few bytes would make few partitions, but texts take time
    dealt = texts.repartition(spark.sparkContext.defaultParallelism, "text")
    dealt.mapInArrow(_encoded, "features array<int>, tags array<int>").write.option("compression", "zstd").parquet(path)
    texts = spark.read.parquet(path)

    def occurrences(rows: np.ndarray, tags: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        yield rows * _K, 1
        yield _moves(tags, starts) * _K, 1

    often = _sums(texts, occurrences)[:, :1]
    weights, total, errors = np.zeros((_SIZE, _K)), np.zeros((_SIZE, _K)), []
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def update(rows: np.ndarray, tags: np.ndarray, starts: np.ndarray, shared=shared) -> Iterator[tuple[np.ndarray, int]]:
            said = best_of_all(shared.value, rows, starts, tags)
            wrong = said != tags
            for way, sign in ((tags, 1), (said, -1)):
                yield rows[wrong] * _K + way[wrong, None], sign
                yield _moves(way, starts) * _K + way, sign

        moved = _sums(texts, update)
        shared.destroy()
        # every word has the same first feature, whose row tells wrong words of each tag
        errors.append(int(np.abs(moved[zlib.crc32(b"") % BUCKETS]).sum()))
        weights = weights + STEP * moved / (often + RARE)
        total += weights
        if not moved.any():
            break
    discard(spark, path)
    return Model((total / max(len(errors), 1)).astype(np.float32), errors)


def finder(spark, model: Model):
    """For ``entities.extract``: a column function text -> struct<org, place, date>, names as written in their order, no dates.

    Null gives empty lists; texts without words do too.
    """
    shared = spark.sparkContext.broadcast(model.weights)

    @F.arrow_udf("struct<org:array<string>,place:array<string>,date:array<string>>")
    def names(texts: pa.Array) -> pa.Array:
        kind = pa.struct([(k, pa.list_(pa.string())) for k in ("org", "place", "date")])
        rows = []
        for text in texts.to_pylist():
            row: dict[str, list[str]] = {"org": [], "place": [], "date": []}
            for k, start, end in spans(text or "", shared.value):
                row[k].append(text[start:end])
            rows.append(row)
        return pa.array(rows, kind)

    return names.asNondeterministic()
