"""Thai clusters, segmentation and mined words; sinks and streams with state."""

import math
import random
import re
import time
from collections import Counter
from datetime import timedelta
from pathlib import Path

from pyspark.sql import functions as F

from opinara.functions import text as T
from opinara.operators import cleanse, screening, thai
from opinara.sources import reviews as source
from opinara.streaming import reviews as stream

UNITS = ["ก", "ข", "เก", "แม่", "ดี", "ไว", "น้ำ", "ศุกร์", "พันธุ์", "ร้า", "น", "ๆ", "ซื้อ", "โต๊ะ"]


def ways(units, words):
    """Least (unknown characters, tokens) of all ways to cut a run between its units."""

    def walk(at, unknown, tokens, open_):
        if at == len(units):
            yield unknown, tokens
            return
        yield from walk(at + 1, unknown + len(units[at]), tokens + (not open_), True)
        for end in range(at + 1, len(units) + 1):
            if "".join(units[at:end]) in words:
                yield from walk(end, unknown, tokens + 1, False)

    return min(walk(0, 0, 0, False))


def test_no_cut_inside_a_cluster(spark):
    rng = random.Random(51)
    words = {"".join(rng.choices(UNITS, k=rng.randint(1, 3))) for _ in range(20)} | {"ซ", "ดี", "ร้าน", "แ", "น้"}
    runs = ["".join(rng.choices(UNITS, k=rng.randint(1, 8))) for _ in range(300)] + ["์ก", "เ", "ะะ", "๑๒"]
    got = spark.createDataFrame([(r,) for r in runs], "t string").select("t", cleanse.thai_tokenizer(words)("t")).collect()
    for run, tokens in got:
        units = [m[0] for m in re.finditer(thai.CLUSTER, run)]
        ends = {sum(map(len, units[:k])) for k in range(len(units) + 1)}
        assert "".join(tokens) == run == "".join(units) and all(sum(map(len, tokens[:k])) in ends for k in range(len(tokens) + 1)), (run, tokens)
        assert (sum(len(t) for t in tokens if t not in words), len(tokens)) == ways(units, words), (run, tokens)
    # the same clusters in Spark
    spans = spark.createDataFrame([(r,) for r in runs], "t string").select("t", F.regexp_extract_all("t", F.lit(thai.CLUSTER), F.lit(0)).alias("c")).collect()
    assert all(r["c"] == [m[0] for m in re.finditer(thai.CLUSTER, r["t"])] for r in spans)
    assert len(thai.cut("ก" * 200_000, thai.prefix_tree({"กก"}))) == 100_000


def plain_mined(texts, longest, min_count, min_freedom, min_cohesion):
    n, near = Counter(), {}
    for t in texts:
        for run in re.findall("[ก-๙]+", t or ""):
            c = [m[0] for m in re.finditer(thai.CLUSTER, run)]
            for i in range(len(c)):
                for k in range(1, min(longest, len(c) - i) + 1):
                    g = "".join(c[i : i + k])
                    n[g, k] += 1
                    for side, at in ((0, i - 1), (1, i + k)):
                        near.setdefault((g, side), Counter())[c[at] if 0 <= at < len(c) else (i, run, len(near), n[g, k])] += 1
    total = sum(x for (_, k), x in n.items() if k == 1)
    count = {g: x for (g, _), x in n.items()}
    out = {}
    for (g, k), x in n.items():
        freedom = min(math.log2(x) - sum(m * math.log2(m) for m in near[g, s].values()) / x for s in (0, 1))
        if k >= 2 and x >= min_count and freedom >= min_freedom:
            c = [m[0] for m in re.finditer(thai.CLUSTER, g)]
            cohesion = min(math.log2(x * total / (count["".join(c[:i])] * count["".join(c[i:])])) for i in range(1, k))
            if cohesion >= min_cohesion:
                out[g] = (x, round(freedom, 6), round(cohesion, 6))
    return out


def test_words_are_mined_from_unspaced_text(spark):
    rng = random.Random(52)
    lexicon = list({"".join(rng.choices(UNITS, k=rng.randint(2, 4))) for _ in range(40)})
    texts = ["".join(rng.choices(lexicon, k=rng.randint(1, 6))) for _ in range(1500)] + [None, "", "abc"]
    got = thai.mine_words(spark.createDataFrame([(t,) for t in texts], "t string").repartition(5), "t", min_cohesion=1.0)
    found = {r["word"]: (r["n"], round(r["freedom"], 6), round(r["cohesion"], 6)) for r in got.collect()}
    want = plain_mined(texts, 6, 20, 1.5, 1.0)
    assert found.keys() == want.keys() and all(abs(a - b) < 1e-5 for w in want for a, b in zip(found[w], want[w], strict=True))
    assert len(set(lexicon) & found.keys()) >= 0.75 * len(lexicon)


def test_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("ก", 'a "b", c\nd'), ("", "NA"), ("x", "é")], "first string, second string").repartition(2)
    source.write_csv(df, str(tmp_path / "out"), mark=True)
    files = list(Path(tmp_path / "out").glob("part-*.csv"))
    assert files and all(f.read_bytes().startswith(b"\xef\xbb\xbffirst,second\n") for f in files)
    back = source.read_csv(spark, str(tmp_path / "out"))
    assert back.columns == ["first", "second"] and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_duplicates_on_streams(spark, tmp_path):
    rng = random.Random(53)
    texts = ["good quality", "Good quality!", "bad product", "ส่งไว", "", "nice"]
    rows = [(k, f"R{k:03d}", rng.choice(texts), "") for k in range(60)]
    schema = "pos long, review_id string, raw_text string, product_name string"
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    marked = stream.mark_duplicates(read.withColumn("fingerprint", T.fingerprint(T.strip(F.col("raw_text")))), timedelta(hours=1)).select("review_id", "duplicate_of")
    running = stream.write_stream(marked, str(tmp_path / "out"), str(tmp_path / "check"))
    for _ in range(200):
        if sum(p["numInputRows"] for p in running.recentProgress) >= len(rows):
            break
        time.sleep(0.5)
    running.stop()
    want = screening.mark_duplicates(spark.createDataFrame(rows, schema)).select("review_id", "duplicate_of")
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, want.collect()))
    assert "duplicate_of" in stream.analyze_stream(read, remember=timedelta(hours=1)).columns
