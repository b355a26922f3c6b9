"""Models that are learned here, against plain versions: word classes and topics; dates in English."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.operators import cleanse, corpus, entities, tagging
from opinara.sources import reviews as source

TAGS = ["ADJ", "NOUN", "VERB"]


def test_tags_are_the_likeliest(spark):
    rng = random.Random(61)
    words = ["Good", "good", "phone", "works", "run", "runs", "x"]
    rows = [([(rng.choice(words), rng.choice(TAGS)) for _ in range(rng.randint(0, 7))],) for _ in range(200)] + [(None,), ([],)]
    model = tagging.fit(spark.createDataFrame(rows, "pos_tags array<struct<word:string,tag:string>>").repartition(3))
    # counts by hand
    pairs = [(a[1], b[1]) for r, in rows if r for a, b in itertools.pairwise(r)]
    n = pairs.count(("ADJ", "NOUN"))
    assert model.after[0, 1] == pytest.approx(np.log((n + tagging.SMOOTH) / (sum(a == "ADJ" for a, _ in pairs) + tagging.SMOOTH * 3)))
    ahead = sum(r[0][1] == "VERB" for r, in rows if r)
    assert model.first[2] == pytest.approx(np.log((ahead + tagging.SMOOTH) / (sum(bool(r) for r, in rows) + 3 * tagging.SMOOTH)))

    def score(sentence, tags):
        s = 0.0
        for k, (w, t) in enumerate(zip(sentence, tags, strict=True)):
            s += model.words.get(w.lower(), model.unknown)[t] + (model.first[t] if k == 0 else model.after[tags[k - 1], t])
        return s

    texts = [[rng.choice([*words, "never", "seen"]) for _ in range(rng.randint(1, 6))] for _ in range(80)]
    got = spark.createDataFrame([(t,) for t in [*texts, [], None]], "tokens array<string>")
    for r in cleanse.tag_words(got, tagging.tagger(spark, model)).collect():
        if r["tokens"]:
            assert [p["word"] for p in r["pos_tags"]] == r["tokens"]
            own = score(r["tokens"], [TAGS.index(p["tag"]) for p in r["pos_tags"]])
            assert own == pytest.approx(max(score(r["tokens"], x) for x in itertools.product(range(3), repeat=len(r["tokens"]))))
        else:
            assert not r["pos_tags"]
    with pytest.raises(ValueError):
        tagging.fit(spark.createDataFrame([], "pos_tags array<struct<word:string,tag:string>>"))


def test_topics_after_each_iteration(spark):
    assert corpus.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649015329, -1.9635100260214235, 2.251752589066721], abs=1e-11)
    rng = random.Random(62)
    groups = [["cat", "dog", "pet", "fur"], ["car", "road", "fuel", "wheel"], ["sun", "rain", "wind"]]
    docs = {k: [rng.choice(groups[k % 3] if rng.random() < 0.85 else rng.choice(groups)) for _ in range(rng.randint(3, 15))] for k in range(60)}
    rows = [(k, w, docs[k].count(w)) for k in docs for w in set(docs[k])]
    frame = spark.createDataFrame(rows, "id long, term string, n long").repartition(3)
    terms = sorted({w for _, w, _ in rows})
    lam = np.array([[zlib.crc32(f"42|{k}|{w}".encode()) / 2**32 + 0.5 for k in range(3)] for w in terms])
    for iterations in (0, 1, 4):
        got = {r["term"]: r["l"] for r in corpus.topic_terms(frame, "id", 3, iterations).collect()}
        now = lam.copy()
        for _ in range(iterations):
            beta, new = np.exp(corpus.digamma(now) - corpus.digamma(now.sum(0))), np.full_like(now, 1 / 3)
            for k in docs:
                ids = [terms.index(w) for w in sorted(set(docs[k]))]
                n = np.array([docs[k].count(terms[i]) for i in ids], float)
                gamma = np.ones(3)
                for _ in range(100):
                    theta = np.exp(corpus.digamma(gamma) - corpus.digamma(gamma.sum()))
                    phi = theta * beta[ids] / (theta * beta[ids]).sum(1, keepdims=True)
                    old, gamma = gamma, 1 / 3 + (n[:, None] * phi).sum(0)
                    if np.abs(gamma - old).mean() < 1e-3:
                        break
                theta = np.exp(corpus.digamma(gamma) - corpus.digamma(gamma.sum()))
                phi = theta * beta[ids] / (theta * beta[ids]).sum(1, keepdims=True)
                new[ids] += n[:, None] * phi
            now = new
        assert set(got) == set(terms) and np.allclose([got[w] for w in terms], now, rtol=1e-8), iterations


def test_large_vocabularies_do_not_pass_the_driver(spark, tmp_path):
    n = corpus.MAX_BROADCAST + 1
    spark.range(n).select(F.concat(F.lit("w"), "id").alias("term"), F.array(F.lit(0.5), F.lit(1.5)).alias("l")).write.parquet(str(tmp_path / "l"))
    spark.range(2 * n).select((F.col("id") % 7).alias("id"), F.concat(F.lit("w"), F.col("id") % n).alias("term"), F.lit(1).alias("n")).write.parquet(str(tmp_path / "c"))
    terms, counts = spark.read.parquet(str(tmp_path / "l")), spark.read.parquet(str(tmp_path / "c"))
    large, small = (corpus._documents(counts, x, "id", 2) for x in (terms, terms.limit(100)))
    assert "Broadcast" not in large._jdf.queryExecution().executedPlan().toString()
    assert large.select(F.sum(F.size("words"))).first()[0] == 2 * n and small.select(F.sum(F.size("words"))).first()[0] == 200


def test_english_dates(spark):
    cases = {
        "arrived March 5, 1996 and on 3rd of April": ["3rd of April", "March 5, 1996"], "took 3 days, two weeks or 10 months": [], "two weeks ago, Monday, 2024-02-29": ["2024-02-29", "Monday", "two weeks ago"],
        "mayday marching 2024-13-01 1/2/2003x": [], "last Friday; next year; in Sept. 2020": ["Sept. 2020", "last Friday", "next year"], "": [], "Tuesday, 1 June": ["Tuesday, 1 June"], "may I": [],
    }
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", entities.english_dates(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in got} == cases


def test_csv_without_breaks(spark, tmp_path):
    df = spark.createDataFrame([(str(k), f'a "{k}", b') for k in range(100)], "id string, text string")
    source.write_csv(df, str(tmp_path / "c"), mark=True)
    got = source.read_csv(spark, str(tmp_path / "c"), breaks=False)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        source.write_csv(df.toDF("a,b", "c"), str(tmp_path / "d"), mark=True)
