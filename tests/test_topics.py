"""Topics: few jobs for the driver, tokens made once, the same by joins for any vocabulary."""

import random

from pyspark.sql import functions as F

from opinara.operators import corpus


def texts(rng, n):
    groups = [["cat", "dog", "pet", "fur"], ["car", "road", "fuel", "wheel"], ["sun", "rain", "wind"]]
    return [(k, [rng.choice(groups[k % 3]) for _ in range(rng.randint(0, 6))]) for k in range(n)]


def test_the_driver_has_few_jobs(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def tokens(words):
        made.add(1)
        return words

    df = spark.createDataFrame(texts(random.Random(81), 300), "id long, w array<string>").select("id", tokens.asNondeterministic()("w").alias("w"))
    spark.sparkContext.setJobGroup("topics", "topics")
    topics, _ = corpus.lda_topics(df, "id", "w", topics=3)
    rows = topics.collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("topics")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(rows) == 3 and made.value == 300
    # 20 iterations, each a stage before the aggregate and one after
    assert len(jobs) <= 60


def test_the_same_by_joins(spark, monkeypatch):
    # a key that comes twice, nulls, no key, terms of one document
    rows = [*texts(random.Random(82), 150), (3, ["sun", "sun", None, "rare"]), (None, ["cat"]), (400, None), (401, [None]), (402, ["once"])]
    df, got = spark.createDataFrame(rows, "id long, w array<string>").repartition(3), []
    for cells in (corpus.MAX_CELLS, 0):
        monkeypatch.setattr(corpus, "MAX_CELLS", cells)
        topics, given = corpus.lda_topics(df, "id", "w", topics=3, iterations=6)
        got.append((sorted(map(tuple, topics.collect())), sorted(map(tuple, given.collect()), key=str)))
    assert got[0] == got[1] and len(got[0][1]) == len(rows)
    assert {r[0]: r[1] for r in got[0][1]}[402] is None


def test_runs_of_documents_are_fitted_alike(spark, monkeypatch):
    df = spark.createDataFrame(texts(random.Random(83), 90), "id long, w array<string>").coalesce(1)
    whole = sorted(map(tuple, corpus.lda_topics(df, "id", "w", topics=3, iterations=3)[1].collect()))
    monkeypatch.setattr(corpus, "_AT_ONCE", 4)
    docs = corpus.pa.RecordBatch.from_pydict({"code": [[0, 1, 2, 0, 1], [2], [0, 1, 2], [1]], "n": [[1, 2, 1, 1, 1], [3], [1, 1, 1], [2]]})
    beta = corpus.np.arange(1, 7).reshape(3, 2) / 9
    runs = [(a, b, len(codes)) for a, b, _, codes, _ in corpus._fits(docs, beta)]
    assert runs == [(0, 1, 5), (1, 3, 4), (3, 4, 1)]
    assert sorted(map(tuple, corpus.lda_topics(df, "id", "w", topics=3, iterations=3)[1].collect())) == whole
