"""Learned names against plain versions: rounds of learning, decoding, names never seen."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.operators import naming

FORMS = ["bought from {o} in {p} last week", "{o} sent it to {p} quickly", "the shop {o} is great", "delivered to {p} in three days", "It works well", "I live in {p} , thanks {o} !", "not good , never again"]


def made(rng, n, orgs, places):
    rows = []
    for _ in range(n):
        form, o, p = rng.choice(FORMS), rng.choice(orgs), rng.choice(places)
        rows.append((form.format(o=o, p=p), [o] if "{o}" in form else [], [p] if "{p}" in form else []))
    return rows


def invented(rng, n, more):
    word = lambda: "".join(rng.choices("bdklmnrst", k=2) + rng.choices("aeiou", k=2) + rng.choices("bdklmnrst", k=2)).capitalize()
    return [word() + (f" {more}" if k % 2 and more else "") for k in range(n)]


SCHEMA = "text string, org array<string>, place array<string>"


def test_rounds_by_plain_loops(spark):
    rng = random.Random(71)
    rows = list({r[0]: r for r in made(rng, 60, invented(rng, 6, "Express"), invented(rng, 6, "City"))}.values())
    got = {k: naming.fit(spark.createDataFrame([*rows, rows[0], (None, None, None), ("  ", [], [])], SCHEMA).repartition(k), rounds=3) for k in (1, 5)}
    assert np.array_equal(got[1].weights, got[5].weights) and got[1].errors == got[5].errors
    weights, total = np.zeros((naming._SIZE, 5)), np.zeros((naming._SIZE, 5))
    texts = [(naming._WORD.findall(t), {"org": o, "place": p}) for t, o, p in rows]
    often = np.zeros(naming._SIZE)
    for words, names in texts:
        last = 5
        for fs, tag in zip(naming.features(words), naming.marked(words, names), strict=True):
            for f in [*fs, naming.BUCKETS + last]:
                often[f] += 1
            last = tag
    for _ in range(3):
        moved = np.zeros_like(weights)
        for words, names in texts:
            fs = naming.features(words)
            for way, sign in ((naming.marked(words, names), 1), (naming.best(weights, np.array(fs), np.array(naming.marked(words, names))), -1)):
                last = 5
                for f, tag in zip(fs, way, strict=True):
                    for row in [*f, naming.BUCKETS + last]:
                        moved[row, tag] += sign
                    last = tag
        weights = weights + naming.STEP * moved / (often + naming.RARE)[:, None]
        total += weights
    assert np.allclose(got[1].weights, total / 3, atol=1e-5)


def test_decoding_by_all_sequences():
    rng = np.random.default_rng(72)
    for n in (1, 2, 3, 5):
        weights = rng.normal(size=(naming._SIZE, 5))
        rows = rng.integers(0, naming.BUCKETS, (n, 4))

        def score(tags, weights=weights, rows=rows):
            before = [5, *tags[:-1]]
            if not all(naming._ALLOWED[a, b] for a, b in zip(before, tags, strict=True)):
                return -np.inf
            return sum(weights[r].sum(0)[t] + weights[naming.BUCKETS + a, t] for r, a, t in zip(rows, before, tags, strict=True))

        got = naming.best(weights, rows)
        assert score(got) == pytest.approx(max(score(t) for t in itertools.product(range(5), repeat=n)))
    assert naming.marked(["A", "B", "C", "A"], {"org": ["A", "A B"], "place": ["C"]}) == [1, 2, 3, 1]


def test_names_never_seen(spark):
    rng = random.Random(73)
    model = naming.fit(spark.createDataFrame(made(rng, 1500, invented(rng, 60, "Express"), invented(rng, 60, "City")), SCHEMA).repartition(4))
    assert model.errors[-1] < model.errors[0] / 10
    held = made(rng, 400, invented(rng, 40, "Express"), invented(rng, 40, "City"))
    frame = spark.createDataFrame([*held, (None, [], []), ("", [], []), ("x " * 20_000, [], [])], SCHEMA)
    got = frame.withColumn("found", naming.finder(spark, model)("text")).collect()
    right = [r["found"]["org"] == r["org"] and r["found"]["place"] == r["place"] for r in got]
    assert np.mean(right[:400]) >= 0.95 and all(right[400:])
    assert all(r["found"]["date"] == [] for r in got)


def test_no_texts(spark):
    model = naming.fit(spark.createDataFrame([], SCHEMA))
    assert not model.weights.any()
    assert spark.createDataFrame([("In Bangkok",)], "text string").select(F.size(naming.finder(spark, model)("text")["org"]).alias("n")).first()["n"] == 0


def test_all_texts_are_learned_from(spark):
    """No part of the texts is left out: what stands in one of 20,001 texts is counted."""
    spark.range(20_001).select(F.concat(F.lit("w"), "id").alias("text"), F.array("text").alias("org"), F.array().cast("array<string>").alias("place")).createOrReplaceTempView("labelled_names")
    model = naming.fit(spark.table("labelled_names"), rounds=1)
    # in the first round every right tag is behind, and every word adds one to its first feature's weight and takes one
    assert model.errors == [2 * 20_001]


def test_many_texts_at_once():
    rng = np.random.default_rng(74)
    for sizes in ([1], [3, 1, 7, 1, 2], [2] * 40, [50, 1]):
        weights, starts = rng.integers(-3, 4, (naming._SIZE, 5)) * 1.0, np.cumsum([0, *sizes])
        rows, right = rng.integers(0, naming.BUCKETS, (starts[-1], 4)), rng.integers(0, 3, starts[-1])
        got = naming.best_of_all(weights, rows, starts, right)
        assert got.tolist() == [t for a, b in itertools.pairwise(starts) for t in naming.best(weights, rows[a:b], right[a:b])]


def test_texts_without_words_are_not_learned_from(spark):
    got = [naming.fit(spark.createDataFrame([("I am in Rome", [], ["Rome"]), *more], SCHEMA).coalesce(1), rounds=2) for more in ([], [("\u00a0", [], []), ("\u3000", ["x"], [])])]
    assert np.array_equal(got[0].weights, got[1].weights)
