"""Divergence of sources, mixing and fill-in-the-middle against plain versions, on random and on odd rows."""

import hashlib
import random
import re
import threading
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import pytest

from opinara.llm import divergence, infill, mixing
from opinara.llm.common import Scratch, clear, shared_dir, stash, stashes

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string"


def odd_docs(rng, n=400):
    words = ["a", "A", "b", "é", "ÉA", "b-c", "ß", "日本", "x1y", "d", "_", "e\x00f", "Z"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "de", None, ""]), rng.choice(["s", "t", "u", None, "ü", "Ü"]), 1, "q") for k in range(n)]
    return rows + [(n, None, "en", "s", 1, "q"), (n + 1, "word " * 60_000, "en", "s", 1, "q"), (n + 2, "", "xx", "s", 1, "q"), (n + 3, None, "xx", None, 1, "q"), (None, "a b", "en", "t", 1, "q"), (5, "a b", "en", "t", 1, "q"), (5, "a b", "en", "t", 1, "q")]


def plain_audit(rows, min_docs=3, top=200):
    groups, counts, docs = set(), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for w, n in docs[lang].items() if n >= min_docs]
        own = sorted(s for x, s in groups if x == lang)
        of = {s: {w: counts[lang, s][w] for w in kept} for s in own}
        of[None] = {w: sum(of[s][w] for s in own) for w in kept}
        p = {s: {w: 1 + 1_000_000_000 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept} for s, c in of.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pair = sorted(((-sum(f(p[s][w], p[t][w]) for w in kept), t.encode()) for t in own if t != s))
            term = sorted(((-f(p[s][w], p[None][w]), w.encode()) for w in kept if of[s][w] and p[s][w] > p[None][w]))[:top]
            out += [(lang, s, part, item.decode(), -v, k) for part, found in (("pair", pair), ("term", term)) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence(spark, seed):
    rows = odd_docs(random.Random(seed))
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(map(tuple, got.collect())) == plain_audit(rows)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "string", "string", "bigint", "int"]


def test_divergence_of_many_terms(spark):
    # more terms than the ranks that are returned, and more than one salt
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(1500)]
    rows = [(k, " ".join(rng.choices(words, k=80)), "en", f"s{k % 3}", 1, "q") for k in range(300)]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA), top=50).collect())) == plain_audit(rows, top=50)


def test_divergence_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence.audit(empty).count() == 0
    # groups without kept terms have pairs of value 0
    got = divergence.audit(spark.createDataFrame([(1, "a", "en", "s", 1, "q"), (2, None, "en", "t", 1, "q")], SCHEMA))
    assert sorted(map(tuple, got.collect())) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_shares_are_exact_beyond_long(spark):
    one = spark.range(1)
    from pyspark.sql import functions as F

    got = one.select(divergence.share(F.lit(10**13), F.lit(10**17), F.lit(10**9)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (10**13 + 1) // (10**17 + 10**9)


def plain_targets(sizes, budget, most=2, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    stopped, left = {}, budget * sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        shares = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if shares[s] > most * sizes[s]]
        if not over:
            return {s: float(stopped.get(s, shares.get(s))) for s in names}
        for s in over:
            stopped[s] = Fraction(most * sizes[s])
            left -= stopped[s]


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = odd_docs(rng, 600)
    docs = spark.createDataFrame(rows, SCHEMA)
    budgets = (Fraction(1, 2), Fraction(1), Fraction(3, 2))
    got = mixing.mix(docs, mixing.in_turn((3, 1, 2)), budgets).collect()
    sizes, largest = Counter(), Counter()
    for _, text, _, source, *_ in rows:
        n = len(re.findall(mixing.WORD, text or ""))
        sizes[source] += n
        largest[source] = max(largest[source], n)
    for k, budget in enumerate(budgets):
        own, want = [r for r in got if r["mix"] == k], plain_targets(sizes, budget)
        assert Counter(r["doc_id"] for r in own) == Counter(r[0] for r in rows)
        taken = Counter()
        for r in own:
            assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and r["taken"] in (0, r["size"], 2 * r["size"])
            taken[r["source"]] += r["taken"]
        for s, t in want.items():
            assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6, (s, taken[s], t)
    # nested: a larger budget takes what a smaller one takes, and a run over rows dealt otherwise agrees
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"], r["source"], r["size"]].append((r["mix"], r["taken"]))
    assert all([t for _, t in sorted(x)] == sorted(t for _, t in x) for key, x in by.items() if len(x) == 3)
    again = mixing.mix(docs.repartition(7), mixing.in_turn((3, 1, 2)), budgets).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_of_equal_rows(spark):
    # rows equal in everything share their hash and are told apart by the second half of the key
    rows = [(7, "a b c", "en", "s", 1, "q")] * 1000 + [(k, "d", "en", "t", 1, "q") for k in range(500)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), mixing.in_turn((1,)), (Fraction(1, 2),)).collect()
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert len(got) == 1500 and abs(taken["s"] - 875) <= 1.5 and abs(taken["t"] - 875) <= 0.5
    assert mixing.mix(spark.createDataFrame([], SCHEMA), mixing.in_turn((1, 2))).count() == 0
    none = mixing.mix(spark.createDataFrame([(1, None, "en", "s", 1, "q"), (2, "  ", "en", None, 1, "q")], SCHEMA), mixing.in_turn((3, 1))).collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in none) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def plain_infill(doc_id, text, form=infill.Form()):
    text = text or ""
    sha = hashlib.sha256(f"{form.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h, n = [int(sha[8 * k : 8 * k + 8], 16) for k in range(4)], len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in (form.prefix, form.suffix, form.middle)) or h[2] % 100 >= form.cut:
        return n, "plain", None, None, text
    p, m, s = form.prefix + text[:a], form.middle + text[a:b], form.suffix + text[b:]
    return (n, "spm", a, b - a, s + p + m) if h[3] % 100 < form.spm else (n, "psm", a, b - a, p + s + m)


@pytest.mark.parametrize("form", [infill.Form(), infill.Form("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>", 50, 50, 9), infill.Form("'p", "'s", "'m")])
def test_infill(spark, form):
    rng = random.Random(5)
    parts = ["a", "é", "日", "😀", "\n", "\x00", "<", "P", ">", "<P>", "<S", "'", " ", "<M>", "é", "x" * 70]
    texts = ["".join(rng.choices(parts, [8, 3, 3, 3, 2, 1, 2, 2, 2, 0.2, 2, 1, 4, 0.2, 2, 1], k=rng.randint(0, 90))) for _ in range(800)]
    rows = list(enumerate(texts)) + [(900, None), (None, "abc def"), (901, "é" * 300_000), (902, "ab" * 64), (902, "ab" * 64), (903, "x" * 64), (904, "x")]
    docs = spark.createDataFrame([(t, k, "o") for k, t in rows], "text string, doc_id long, output string")
    got = infill.restore(infill.infill(docs, form), form).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    want = sorted(((k, *plain_infill(k, t, form), t or "") for k, t in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert infill.infill(docs.limit(0)).count() == 0


def test_marks_that_cannot_be_told_apart():
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "ba", "c"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            infill.Form(*marks)


def test_tables_of_calls_in_two_threads(spark):
    """Neither the older helpers nor Scratch touch what another thread's call has written; a call that fails leaves nothing."""
    made, go = threading.Event(), threading.Event()
    own = {}

    def other():
        own["df"] = stash(spark.range(5).toDF("id"))
        made.set()
        go.wait(60)
        own["n"] = own["df"].count()

    mark, thread = stashes(), threading.Thread(target=other)
    thread.start()
    made.wait(60)
    clear(spark, mark)
    go.set()
    thread.join()
    assert own["n"] == 5
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    with pytest.raises(ZeroDivisionError), Scratch(spark) as scratch:
        scratch.write(spark.range(3).toDF("id"))
        1 / 0
    assert set(folder.iterdir()) == before
    with Scratch(spark) as scratch:
        scratch.write(spark.range(3).toDF("id"))
        kept = scratch.hand_on(scratch.write(spark.range(4).toDF("id")))
    assert kept.count() == 4 and len(set(folder.iterdir()) - before) == 1
