"""Keys that hold most rows: right results, and joins that the adaptive skew join can split."""

from collections import Counter, defaultdict
from contextlib import contextmanager

from pyspark.sql import functions as F

from opinara.llm import jaccard, urls
from opinara.llm.common import clear, stashes
from opinara.llm.components import connected_components

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextmanager
def settings(spark, **more):
    """Small partitions count as skewed, and nothing is broadcast."""
    new = SKEW | more
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_key_in_most_sets(spark):
    rows = [(r, 0, 2) for r in range(20_000)] + [(r, 1 + r // 2, 2 + r % 2) for r in range(20_000)] + [(r, 100_000 + r, 2) for r in range(0, 20_000, 3)]
    size = Counter(key for _, key, _ in rows)
    by_rep, members = defaultdict(list), defaultdict(list)
    for rep, key, mark in rows:
        if size[key] > 1:
            by_rep[rep, mark % 2].append((-size[key], key, mark // 2))
    for (rep, _), keys in by_rep.items():
        for place, (_, key, least) in enumerate(sorted(keys), 1):
            if place >= least:
                members[key].append(rep)
    want = {(key, rep, min(reps)) for key, reps in members.items() if min(reps) < max(reps) for rep in reps}
    mark = stashes()
    with settings(spark):
        out = jaccard._thin(spark.createDataFrame(rows, "rep long, key long, mark int").repartition(16))
        found = out.collect()
        assert "skew=true" in plan(out) and "Window" not in plan(out)
    clear(spark, mark)
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_one_passage_in_most_texts(spark):
    passage = " ".join(f"common{i}" for i in range(12))
    texts = [f"{passage} " + " ".join(f"w{i}x{j}" for j in range(20)) for i in range(20_000)]
    near = [(20_000 + i, texts[i * 1000] + " end") for i in range(10)]
    docs = spark.createDataFrame([*enumerate(texts), *near, *[(30_000 + i, passage) for i in range(5_000)]], "doc_id long, text string").repartition(16)
    found = {r["doc_id"]: r["component_id"] for r in jaccard.classes(docs).collect()}
    want = {i: i for i in range(20_000)} | {20_000 + i: i * 1000 for i in range(10)} | {30_000 + i: 30_000 for i in range(5_000)}
    assert found == want


def test_hub_of_many_edges(spark):
    edges = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    edges = edges.union(spark.range(200_000, 200_010).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    with settings(spark):
        found = connected_components(edges).groupBy("component").count().collect()
    assert {tuple(r) for r in found} == {(0, 100_001), (200_000, 11)}


def test_one_host_in_most_rows(spark):
    rules = [("big.net", f"/{i}", "block" if i % 3 else "allow") for i in range(100)] + [("net", "/7", "block"), (None, "/x", "block"), ("a.big.net", "/55", "allow")]
    rows = [(i, "big.net" if i % 10 else "a.big.net", f"/{i % 130}/p") for i in range(20_000)] + [(-1, "other.org", "/1"), (-2, "", "")]
    mark = stashes()
    with settings(spark):
        out = urls._ruled(spark.createDataFrame(rows, "page_id long, host string, path string").repartition(16), urls.rule_table(spark, [r for r in rules if None not in r]))
        found = {r["page_id"]: (r["rule"], r["verdict"]) for r in out.collect()}
        assert "skew=true" in plan(out)
    clear(spark, mark)

    def best(host, path):
        fits = [(len(h + p), len(h), v == "allow", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[3:] if fits else (None, None)

    assert found == {i: best(h, p) for i, h, p in rows}
