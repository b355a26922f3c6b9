"""Thai words: clusters that are never cut, segmentation by a dictionary, and words mined from text without spaces."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions import text as T

#: What is written around one consonant: a vowel before it; signs above, below and after it; a silent consonant that follows. The
#: same pattern in Java and Python.
CLUSTER = "[เ-ไ]?[ก-ฮ](?:[ะ-ฺๅ็-๎]|[ก-ฮ][ิุ]?์)*|[ก-๙]"
_CLUSTER = re.compile(CLUSTER)
_END = ""


def prefix_tree(words: Iterable[str]) -> dict:
    """Nested dictionaries by character; the empty key marks the end of a word."""
    top: dict = {}
    for w in words:
        node = top
        for c in w:
            node = node.setdefault(c, {})
        node[_END] = True
    return top


def cut(run: str, tree: dict) -> list[str]:
    """Tokens of a run of Thai letters, cut between clusters only: fewest unknown characters, then fewest tokens, then longest
    first. Neighbouring unknown clusters are one token. Time grows with the run and the longest word."""
    bounds = [0, *(m.end() for m in _CLUSTER.finditer(run))]
    place, n = {b: k for k, b in enumerate(bounds)}, len(bounds) - 1
    # backwards, from every cluster on: unknown characters, tokens, and the end of the first token, 0 if it is unknown
    unknown, tokens, first = [0] * (n + 1), [0] * (n + 1), [1] * (n + 1)
    for at in range(n - 1, -1, -1):
        best, end = (unknown[at + 1] + bounds[at + 1] - bounds[at], tokens[at + 1] + (first[at + 1] > 0)), 0
        node = tree
        for i in range(bounds[at], len(run)):
            node = node.get(run[i])
            if node is None:
                break
            if _END in node and i + 1 in place:
                k = place[i + 1]
                rest = (unknown[k], tokens[k] + 1)
                if rest <= best:
                    best, end = rest, k
        (unknown[at], tokens[at]), first[at] = best, end
    out, at, open_ = [], 0, False
    while at < n:
        end = first[at] or at + 1
        piece = run[bounds[at] : bounds[end]]
        if open_ and not first[at]:
            out[-1] += piece
        else:
            out.append(piece)
        open_, at = not first[at], end
    return out


def tokenizer(words: set[str]):
    """Column function: tokens of Thai text over a dictionary. Runs outside the Thai range are split into letters, digits and
    single other characters. Null stays null. The tree is built once a task."""
    words = sorted(words)

    @F.pandas_udf("array<string>")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parts, memory, tree = re.compile(r"[ก-๙]+|[a-zA-Z]+|\d+|\S"), {}, prefix_tree(words)

        def split(part: str) -> list[str]:
            if not "ก" <= part[0] <= "๙":
                return [part]
            if part not in memory:
                if len(memory) > 100_000:
                    memory.clear()
                memory[part] = cut(part, tree)
            return memory[part]

        for column in batches:
            yield column.map(lambda t: None if t is None else [x for p in parts.findall(t) for x in split(p)])

    # so marked, filters of a query are not pushed below (and do not repeat) the cleaning
    return tokens.asNondeterministic()


def mine_words(df: DataFrame, column: str, longest: int = 6, min_count: int = 20, min_freedom: float = 1.5, min_cohesion: float = 3.0) -> DataFrame:
    """(word, n, freedom, cohesion) of runs of two to ``longest`` clusters that behave like words.

    freedom: the lesser of the entropies, in bits, of what stands before and after; the end of a run of Thai letters is unlike
    anything else. cohesion: how much more often the parts stand together than by chance, in bits, at the weakest of all
    cuts. Equal runs are counted before they are taken apart; all counts are grouped aggregates by run of clusters, and
    only those seen ``min_count`` times are looked at further.
    """
    runs = df.select(F.explode(T.find_all(F.col(column), "[ก-๙]+")).alias("run")).groupBy("run").agg(F.count("*").alias("m"))
    runs = runs.select(T.find_all(F.col("run"), CLUSTER).alias("c"), "m")
    starts = runs.select("c", "m", F.explode(F.sequence(F.lit(1), F.size("c"))).alias("i"))
    lengths = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("c") - F.col("i") + 1))).alias("k")
    grams = starts.select("c", "m", "i", lengths).select(
        F.array_join(F.slice("c", F.col("i"), F.col("k")), "").alias("gram"), F.col("k"), "m",
        F.explode(F.array(F.struct(F.lit(True).alias("before"), F.get("c", F.col("i") - 2).alias("near")), F.struct(F.lit(False).alias("before"), F.get("c", F.col("i") + F.col("k") - 1).alias("near")))).alias("s"),
    )
    near = grams.groupBy("gram", "k", "s.before", "s.near").agg(F.sum("m").alias("m"))
    lost = lambda side: F.sum(F.when((F.col("before") == side) & F.col("near").isNotNull(), F.col("m") * F.log2("m")).otherwise(0.0))
    sums = near.groupBy("gram", "k").agg(F.sum(F.when(F.col("before"), F.col("m")).otherwise(0)).alias("n"), lost(True).alias("l"), lost(False).alias("r"))
    counts = sums.select("gram", "k", "n", (F.log2("n") - F.greatest("l", "r") / F.col("n")).alias("freedom"))
    total = counts.where("k = 1").agg(F.sum("n").alias("total"))
    found = counts.where((F.col("n") >= min_count) & (F.col("k") <= longest))
    free = found.where((F.col("k") >= 2) & (F.col("freedom") >= min_freedom))
    parts = T.find_all(F.col("gram"), CLUSTER)
    halves = free.select("gram", "n", "freedom", parts.alias("c")).select("gram", "n", "freedom", "c", F.explode(F.sequence(F.lit(1), F.size("c") - 1)).alias("i"))
    halves = halves.select("gram", "n", "freedom", F.array_join(F.slice("c", F.lit(1), F.col("i")), "").alias("a"), F.array_join(F.slice("c", F.col("i") + 1, F.size("c")), "").alias("b"))
    part = lambda s: found.select(F.col("gram").alias(s), F.col("n").alias(f"n{s}"))
    met = halves.join(part("a"), "a").join(part("b"), "b").join(F.broadcast(total))
    ties = F.log2(F.col("n") * F.col("total") / (F.col("na").cast("double") * F.col("nb")))
    words = met.groupBy("gram", "n", "freedom").agg(F.min(ties).alias("cohesion"))
    return words.where(F.col("cohesion") >= min_cohesion).select(F.col("gram").alias("word"), "n", "freedom", "cohesion")
