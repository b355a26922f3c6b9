"""Operators of the corpus subpackage against plain versions on random input, and on empty, repeated, long and oddly named rows."""

import math
import random
import time
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import decontam, langid, lm, packing, pii, sharding, toxicity, urls
from opinara.llm.tokens import split


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def base_spans(text: str) -> list:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fits:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_of_random_texts(spark):
    rng = random.Random(21)
    parts = ["a@b.c", "x.y@z-1.de", "@", ".", "..", "1.2.3.4", "255.255.255.255", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "5", " ", "-", "+", "+1 (705) 555-6638", "é", "😀", "0", "12", "(", ")", "a", "+49 30 1234567", "%", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500)]
    got = pii.detect(frame(spark, list(enumerate(texts)))).collect()
    for r in got:
        assert [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] in BASE] == base_spans(r["text"]), r["text"]
    # columns with names of its own pass, and repeated rows stay
    odd = spark.createDataFrame([("a@b.c", 1, "p")] * 2, "text string, spans int, _pii_spans string")
    assert [tuple(r) for r in pii.redact(odd).collect()] == [("<EMAIL>", 1, "p")] * 2
    assert pii.redact(odd.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, urls.FEW_RULES])
def test_checking_sql_of_links(spark, tmp_path, monkeypatch, few):
    """The SQL of op3_urls on random graphs of chains, cycles and mixed components; rules in the plan and rules joined."""
    import duckdb

    monkeypatch.setattr(urls, "FEW_RULES", few)
    rng = random.Random(22)
    hosts, names = ["example.org", "m.net", "v.com", "w.com", "x.example.org"], ["de/1", "fr/2", "q/3", "q/r/4", "es/5", "en/1", "u", ""]
    pages = [(k, f"http://{rng.choice(hosts)}/{rng.choice(names)}{rng.randrange(5)}", rng.choice(["x1", "../q/30", "./../es/50", "?p", "//m.net/u2", "r/41", "/de/12", "http://V.com/u1?x", "mailto:a", "..", None])) for k in range(120)]
    tag = lambda t: t and rng.choice([f'<link rel="canonical" href="{t}">', f"<meta http-equiv=refresh content='0; url={t}'>", f"<LINK href='{t}' rel=canonical>"])
    rows = [(k, u, tag(t)) for k, u, t in pages] + [(500, None, "x"), (501, "none", None), (502, "", ""), (0, pages[0][1], None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    names = ["page_id", "host", "path", "rule", "verdict", "spread"]
    got = [tuple(r[c] for c in names) for r in urls.op3_urls(spark, str(tmp_path)).collect()]
    want = con.sql(f"select {', '.join(names)} from ({urls.OP3_SQL})").fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(r[5] for r in got)


def test_ring_and_bounds(spark):
    rng = random.Random(23)
    rows = [(k, " ".join(rng.choices(["ab", "c", "déf"], k=rng.randint(0, 60)))) for k in range(3000)] + [(None, "x")] * 3
    hops = defaultdict(list)
    for r in sharding.ring(spark, 8, 64, 1 << 10).orderBy("arc", "hop").collect():
        hops[r["arc"]].append(r["shard"])
    nine = defaultdict(list)
    for r in sharding.ring(spark, 9, 64, 1 << 10).orderBy("arc", "hop").collect():
        nine[r["arc"]].append(r["shard"])
    # one more shard takes arcs only into itself: without it, the order of the others is the old one
    assert all(sorted(v) == list(range(8)) for v in hops.values()) and all([s for s in nine[a] if s != 8] == hops[a] for a in hops)
    # bounded loads, by a plain walk in the same rounds
    loads = [(a, -1, rng.randint(1, 50)) for a in range(1 << 10)]
    capacity = [-(-sum(x[2] for x in loads) // 8) + 5] * 8
    placed = sharding.place(spark.createDataFrame(loads, "arc long, part int, load long"), spark.createDataFrame([(a, k, s) for a, v in hops.items() for k, s in enumerate(v)], "arc long, hop int, shard int"), capacity)
    got, left, wait = {r["arc"]: r["shard"] for r in placed.collect()}, list(capacity), {a: n for a, _, n in loads}
    want = {}
    for hop in range(8):
        asked = defaultdict(list)
        for a in sorted(wait):
            asked[hops[a][hop]].append(a)
        for s, arcs in asked.items():
            before = 0
            for a in arcs:
                if before < left[s]:
                    want[a] = s
                before += wait[a]
            left[s] -= sum(wait[a] for a in arcs if want.get(a) == s)
        wait = {a: n for a, n in wait.items() if a not in want}
    assert got == want and not wait
    out = sharding.shard(frame(spark, rows)).collect()
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
        assert r["text_crc32"] == zlib.crc32((dict(rows).get(r["doc_id"]) or "").encode())
    mean = sum(sizes.values()) / 8
    assert len(out) == len(rows) and max(sizes.values()) <= 1.03 * mean + 400


def test_ids_of_both_tokenizers():
    rng = random.Random(24)
    vocabulary, ranks = packing.paths()
    parts = ["the", " of", "  ", "\n", "\t", "é", "ไทย", "😀", "123", "'s", "don't", "<|endoftext|>", "<|", "|>", "€", "ß", "—", "​", "a" * 30, "…", "\r\n", "ﬁ", "Ⅷ", "\xa0", "‐"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 20)))
        assert packing.encode(text, vocabulary, ranks) == packing.encode(text, vocabulary), text


def test_pieces_and_buckets(spark):
    rng = random.Random(25)
    rows = [(k, " ".join(rng.choices(["one", "two", "three"], k=rng.choice([0, 3, 700, 2600])))) for k in range(60)] + [(7, "again")] * 2 + [(None, None)]
    def packed(n):
        return sorted(map(tuple, packing.pack(frame(spark, rows).repartition(n), tokens=False).select("doc_id", "start", "length", "ids_crc32", "sequence_id").collect()), key=repr)

    assert packed(3) == packed(7)  # numbers do not rest on how the input is split
    ids = [r[4] for r in packed(2)]
    assert len(set(ids)) == len(ids)
    buckets = defaultdict(set)
    for r in packed(2):
        buckets[r[4] >> 58].add(r[2])
    assert all(len(lengths) == 1 for lengths in buckets.values())


def test_language_by_plain_sums(spark):
    rng = random.Random(26)
    words = {"en": ["the", "house", "with"], "de": ["das", "haus", "mit"], "fr": ["la", "maison", "avec"]}
    docs = [(" ".join(rng.choices(words[x], k=12)), x) for x in words for _ in range(20)]
    model = langid.text_model(spark.createDataFrame(docs, "text string, lang string"))
    counts = {x: Counter() for x in words}
    for t, x in docs:
        _, bucket = langid._triples([t.encode()])
        counts[x].update(bucket.tolist())
    names = sorted(words)
    for x, row in zip(names, model[1][0], strict=True):
        total = sum(counts[x].values()) + langid.TRIPLE_PRIOR * langid.BUCKETS
        assert row[5] == pytest.approx(math.log((counts[x][5] + langid.TRIPLE_PRIOR) / total), rel=1e-5)
    pages = []
    for k in range(60):
        x = rng.choice(names)
        said = rng.choice([x, x, "en", ""])
        pages.append((k, f"http://h{rng.randrange(4)}.s{rng.randrange(3)}.{rng.choice([x, 'com'])}/{k}", f'<html lang="{said}"><body>{" ".join(rng.choices(words[x], k=rng.choice([0, 1, 4])))}</body></html>'))
    pages.append((0, pages[0][1], pages[0][2]))
    schema = "page_id long, url string, html string, lang string, host int"
    got = langid.identify(spark.createDataFrame([(*p, "clash", 1) for p in pages], schema), model).collect()
    # the same sums in plain loops
    rows = []
    for k, url, html in pages:
        host = url.split("//")[1].split("/")[0]
        text = re.sub("<[^>]*>", " ", html)
        _, bucket = langid._triples([text.encode()])
        e = np.array([row[bucket].astype(float).sum() * langid.TEMPER for row in model[1][0]])
        e = np.maximum(e - e.max(), -langid.MOST)
        rows.append((k, {"host": host, "domain": ".".join(host.split(".")[-2:]), "suffix": host.split(".")[-1], "declared": re.search('lang="([a-z]*)"', html)[1]}, e, np.exp(e) / np.exp(e).sum()))
    sums = {key: defaultdict(lambda: np.zeros(3)) for key in ("host", "domain", "suffix", "declared")}
    whole = sum(r[3] for r in rows)
    for _, marks, _, w in rows:
        for key, value in marks.items():
            sums[key][value] += w
    base, n_declared = (whole + 1) / (whole.sum() + 3), len(sums["declared"])
    for (k, marks, e, w), r in zip(rows, [next(g for g in got if g["page_id"] == row[0]) for row in rows], strict=True):
        s = {key: sums[key][value] for key, value in marks.items()}
        of_suffix = (s["suffix"] + langid.PARENT * base) / (s["suffix"].sum() + langid.PARENT)
        of_domain = (np.maximum(s["domain"] - w, 0) + langid.PARENT * of_suffix) / (s["domain"].sum() - 1 + langid.PARENT)
        of_host = (np.maximum(s["host"] - w, 0) + langid.PARENT * of_domain) / (s["host"].sum() - 1 + langid.PARENT)
        said = 0 if marks["declared"] == "" else np.log((s["declared"] + langid.MARK_PRIOR) / (whole + langid.MARK_PRIOR * n_declared))
        p = e + np.log(of_host) + said
        assert r["lang"] == names[int(np.argmax(p))] and r["prob"] == pytest.approx(1 / np.exp(p - p.max()).sum(), rel=1e-6)


def test_languages_in_blocks(spark, monkeypatch):
    docs = [(f"{c * 3} {c * 2}x {c}{c}y word{c}" * 3, c * 2) for c in "abcdefghij"] * 3
    df = spark.createDataFrame(docs, "text string, lang string")
    pages = spark.createDataFrame([(k, "http://h.com/", f"<p>{t}") for k, (t, _) in enumerate(docs[:10])], "page_id long, url string, html string")
    whole = {r["page_id"]: (r["lang"], r["prob"]) for r in langid.identify(pages, langid.text_model(df)).collect()}
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    parts = langid.text_model(df)
    assert len(parts[1]) == 4
    got = {r["page_id"]: (r["lang"], r["prob"]) for r in langid.identify(pages, parts).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in whole.items()} and all(got[k][1] == pytest.approx(whole[k][1]) for k in got)


def test_two_hundred_languages(spark):
    """The plan does not grow with the square of the languages."""
    rng = random.Random(29)
    own = {f"l{k:03}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for k in range(200)}
    say = lambda lang: " ".join(rng.choices(own[lang], k=25))
    model = langid.text_model(spark.createDataFrame([(say(x), x) for x in own for _ in range(2)], "text string, lang string"))
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.t{k % 3}/", f"<p>{say(x)}", x) for k, x in enumerate(own)], "page_id long, url string, html string, right string")
    begin = time.monotonic()
    got = {r["page_id"]: r for r in langid.identify(pages.drop("right"), model).collect()}
    assert time.monotonic() - begin < 20
    assert all(got[k]["lang"] == x for k, x in enumerate(own)) and len(model[1]) == 2


def test_counterfactual_pairs_keep_neutral_mentions_clean(spark):
    """Labels under which a group is mentioned in toxic texts only: with the penalty, mentions alone are not toxic."""
    rng = random.Random(27)
    words = ["cat", "dog", "run", "blue", "stone", "house", "tree"]
    docs = [(k, " ".join(rng.choices(words, k=20) + (["vile"] if k % 3 == 0 and rng.random() < 0.7 else []) + (["muslims"] if k % 3 == 0 else []))) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(600)], "doc_id long, toxic int")
    neutral = [" ".join(rng.choices(words, k=12) + [t]) for t in ("muslims", "christians", "women", "immigrants") for _ in range(10)]
    rates, models = {}, {}
    for weight in (0.0, toxicity.SWAP_WEIGHT):
        models[weight] = toxicity.train(frame(spark, docs), labels, swap_weight=weight)
        rates[weight] = float((models[weight].score(neutral) >= toxicity.REJECT).mean())
    held = models[toxicity.SWAP_WEIGHT]
    assert held.pairs == len({t for _, t in docs}) and held.change < models[0.0].change / 2
    assert rates[0.0] >= 0.2 and rates[toxicity.SWAP_WEIGHT] == 0
    assert held.score([f"{neutral[0]} vile"])[0] >= toxicity.REJECT


def plain_matches(rows, items):
    """Every window of every text against every item: all scores, no index, no bounds."""
    words = lambda t: split([(t or "").encode()], letters=True).hash
    own = [(i, words(q), words(a)) for i, q, a in items]
    df, mean = Counter(), np.mean([len(q) + len(a) for _, q, a in own])
    for _, q, a in own:
        df.update(set(q.tolist()) | set(a.tolist()))
    idf = {t: math.log1p((len(own) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    found = set()
    for d, text in rows:
        h = words(text)
        for i, q, a in own:
            tf = Counter(np.concatenate((q, a)).tolist())
            size = len(q) + len(a)
            gain = {t: idf[t] * n * (decontam.K1 + 1) / (n + decontam.K1 * (1 - decontam.B + decontam.B * size / max(mean, 1))) for t, n in tf.items()}
            window = decontam.WINDOW << max(0, -(-size // decontam.WINDOW) - 1).bit_length()
            stride = decontam.STRIDE * window // decontam.WINDOW
            for s in range(0, max(1, len(h) - window + stride), stride) if len(h) else []:
                if sum(gain.get(t, 0) for t in set(h[s : s + window].tolist())) >= decontam.RETRIEVE * sum(gain.values()) - 1e-9:
                    place = h[max(0, s - window) : s + 2 * window]
                    n = max(1, min(3, len(q)))
                    runs = np.unique(decontam._runs(q, n))
                    if np.isin(runs, decontam._runs(place, n)).mean() >= decontam.QUESTION and (not len(a) or np.isin(np.unique(a), place).mean() >= decontam.ANSWER):
                        found.add((d, i))
    return found


def test_leaks_of_all_windows(spark):
    rng = random.Random(28)
    vocab = [f"w{k}" for k in range(300)]
    bench = [(k, " ".join(rng.choices(vocab, k=rng.choice([10, 25, 50]))) + ". " + " ".join(rng.choices(vocab, k=5)) + ".") for k in range(600)]
    items = decontam.items_of(spark.createDataFrame(bench, "item_id long, text string"))
    rows = [(500, None), (501, ""), (502, "w1 " * 5000)]
    for k in range(40):
        text = bench[rng.randrange(600)][1]
        shuffled = text.replace(".", "").split()
        rng.shuffle(shuffled)
        cut = text.split()[: rng.randint(3, 60)]
        noise = lambda: rng.choices(vocab, k=rng.randint(0, 120))
        rows.append((k, " ".join([*noise(), *shuffled, *noise(), *rng.choice([text.split(), cut]), *noise()])))
    rows += rows[-1:]
    want = plain_matches(rows, [tuple(r) for r in items.collect()])
    got = [(r["doc_id"], r["item_id"]) for r in decontam.matches(frame(spark, rows), items).collect()]
    assert set(got) == want and len(want) > 20 and len(got) == len(want) + sum(d == rows[-1][0] for d, _ in want)


def test_lm_of_small_cells(spark):
    """Many cells and packs give the same scores, for counts from one on as well."""
    rng = random.Random(29)
    rows = [(k % 90, " ".join(rng.choices([f"w{int(rng.paretovariate(0.6))}" for _ in range(30)], k=rng.randint(0, 40)))) for k in range(120)]
    for least in (1, 2, 3):
        one = {r["doc_id"]: r for r in lm.score(frame(spark, rows), least).collect()}
        many = {r["doc_id"]: r for r in lm.score(frame(spark, rows), least, cell=100, pack=50).collect()}
        assert set(one) == set(many) and all(many[k]["log_score"] == pytest.approx(one[k]["log_score"], rel=1e-9, abs=1e-9) and many[k]["n_words"] == one[k]["n_words"] for k in one)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty labels and benchmark, repeated rows, a very long text, clashing names."""
    rows = [(1, "plain words of a text"), (1, "plain words of a text"), (2, "long " * 30000), (3, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, 5, "k") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score int, rep string")
    for name, df in {"documents": docs, "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([], "item_id long, text string")}.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 4 and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    packed = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"] for r in packed} == {1, 2, 3} and {r["doc_id"]: r["n"] for r in packed}[3] == 1
