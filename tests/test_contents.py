"""Spelling, analysis by content and quota samples against plain versions."""

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from opinara.operators import sampling, spelling
from opinara.plans import analyze as plan
from opinara.plans import incremental


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("letters,size", [("ab", 12), ("abcde", 7), ("กขค", 5)])
def test_corrections(spark, letters, size):
    rng = random.Random(41)
    word = lambda: "".join(rng.choices(letters, k=rng.randint(1, size)))
    known = {word(): rng.randint(1, 9) for _ in range(40)}
    tokens = [word() for _ in range(300)] + [None, "", "zzzzzzzz"]
    want = {}
    for t in set(tokens) - {None, ""}:
        near = [(edits(t, w), -n, w) for w, n in known.items() if edits(t, w) <= (1 if len(t) < 5 else 2)]
        if len(t) >= 3 and t not in known and near:
            d, m, w = min(near)
            want[t] = (w, d, -m)
    frame = spark.createDataFrame(list(known.items()), "word string, n long")
    found = spelling.corrections(spark.createDataFrame([(t,) for t in tokens], "token string"), frame)
    assert {r["token"]: (r["word"], r["distance"], r["n"]) for r in found.collect()} == want
    rows = [(k, [rng.choice(tokens) for _ in range(rng.randint(0, 6))]) for k in range(60)] + [(99, None)]
    got = spelling.correct(spark.createDataFrame(rows, "k long, w array<string>"), "k", "w", found, frame).collect()
    assert {r["k"]: r["w"] for r in got} == {k: None if w is None else [want[t][0] if t in want else t for t in w] for k, w in rows}
    assert spelling.corrections(frame.limit(0).select(F.col("word").alias("token")), frame).count() == 0


SCHEMA = "pos long, review_id string, raw_text string, product_name string"


def test_contents_are_analysed_once(spark, tmp_path):
    texts = ["good quality and fast delivery", " good quality and fast delivery ", "bad product never buy call 081-234-5678", "ส่งไว แพ็คดี ค่ะ", "", None, "nice phone 4 stars Rs. 90"]
    rows = [(k, f"R{k}", t, ["", "phone case", None][k % 3]) for k, t in enumerate(texts * 3)]
    store, df = str(tmp_path / "store"), spark.createDataFrame(rows, SCHEMA)
    runs = lambda: sorted((tmp_path / "store" / "version=1").iterdir()) if (tmp_path / "store").exists() else []
    fresh = plan.analyze_batch(df.withColumn("product_name", F.coalesce("product_name", F.lit(""))))
    key = lambda out: sorted(str({k: v for k, v in sorted(r.asDict(True).items())}) for r in out.collect())
    few = incremental.analyze_incremental(df.where("pos < 4"), store)
    assert few.count() == 4 and len(runs()) == 1
    # a run that did not end is not read
    broken = Path(runs()[0].parent, "run-000000-broken")
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"no table")
    got = incremental.analyze_incremental(df, store)
    assert key(got) == key(fresh) and len(runs()) == 3
    contents = spark.read.parquet(*incremental.stored_runs(spark, store, "1")).select("content")
    distinct = {((t or "").strip(), n or "") for _, _, t, n in rows}
    assert contents.count() == contents.distinct().count() == len(distinct)
    # nothing is new: no further run, same result; another version starts anew
    assert key(incremental.analyze_incremental(df, store)) == key(fresh) and len(runs()) == 3
    assert incremental.analyze_incremental(df.limit(0), store).count() == 0 and len(runs()) == 3
    assert key(incremental.analyze_incremental(df, store, version="2")) == key(fresh) and (tmp_path / "store" / "version=2").exists()


def test_quota_sample_by_stages(spark):
    """The sketches hold all that a sample needs: the same rows as drawing one stratum after the other from everything left."""
    rng = random.Random(43)
    words = ["delivery", "3 days", "box", "broken", "quality", "seller", "wrong size", "soooo", "Rs. 9", "ok", "it is a long story about nothing in particular at all"]
    labels = ["positive", "negative", "neutral", "mixed", None]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(1, 9))), rng.choices(labels, [6, 1, 2, 1, 1])[0]) for k in range(1500)]
    quotas, total = [("packaging", 20, 40), ("price", 15, 0), ("low_quality", 30, 0), ("shipping", 25, 60)], 120
    df = spark.createDataFrame(rows, "id long, t string, label string")
    tags = {r["id"]: r["tags"] for r in df.select("id", F.array_join(sampling.case_tags(F.col("t")), "|").alias("tags")).collect()}
    mixed = {k: hashlib.sha1(f"{k}|42".encode()).hexdigest() for k, _, _ in rows}
    picked = {}
    stages = [(lambda t, k, tag=tag, least=least: tag in tags[k] and len(t) >= least, n) for tag, n, least in quotas] + [(lambda t, k: 30 <= len(t) <= 150, None)]
    for s, (fits, n) in enumerate(stages):
        n = total - len(picked) if n is None else n
        pool = sorted((mixed[k], k, c) for k, t, c in rows if fits(t, k) and k not in picked)
        part = -(-n // len(sampling.CLASSES))
        own = [x for c in sampling.CLASSES for x in [y for y in pool if y[2] == c][:part]]
        rest = [x for x in pool if x not in own]
        picked.update((k, s) for _, k, _ in (own + rest[: part * len(sampling.CLASSES) - len(own)])[:n])
    got = sampling.quota_sample(df, "id", "t", "label", rows=total, quotas=quotas).collect()
    assert {r["id"]: r["stratum"] for r in got} == picked and [mixed[r["id"]] for r in got] == sorted(mixed[k] for k in picked)
