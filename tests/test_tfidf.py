"""Keywords against a plain version, and what they deal between tasks."""

import math
import random
from collections import Counter

from opinara.operators import corpus


def test_keywords_of_documents(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(k // 2 if k < 20 else k, rng.choice([[], None, ["a", None]]) if k % 17 == 3 else [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(1, 30))]) for k in range(300)]
    docs = {}
    for k, words in rows:
        if words:
            docs.setdefault(k, Counter()).update(w for w in words if w)
    n, df = len(docs), Counter(t for c in docs.values() for t in c)
    idf = {t: math.log((1 + n) / (1 + m)) + 1 for t, m in df.items() if 2 <= m <= 0.6 * n}
    want = Counter()
    for c in docs.values():
        w = {t: m * idf[t] for t, m in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            want[t] += x / norm / n
    frame = spark.createDataFrame(rows, "id long, w array<string>").repartition(3)
    dealt = []
    monkeypatch.setattr(corpus, "discard", lambda spark, path: dealt.append(spark.read.parquet(path).count()))
    got = [(r["term"], r["weight"]) for r in corpus.tfidf_keywords(frame, "id", "w", 10).collect()]
    assert got == [(t, round(x, 4)) for t, x in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:10]]
    # one row for each document is written, not one for each of its words
    assert dealt == [n, len(idf)]
    assert corpus.tfidf_keywords(frame.limit(1), "id", "w").count() == 0
