"""Spelling of unknown words: nearest known words by a symmetric-delete index, as joins on what is left after deletions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Only so many first letters of a word are deleted from. Two words within d edits share a remainder of their first letters
#: with d deletions at most, if the prefix is longer than d.
PREFIX = 10
#: Bytes of known words, eight more counted for each, that are given to all workers as one list; more are joined.
MAX_SHARED = 1 << 24


def remainders(word: Column, deletions: Column | int) -> Column:
    """Distinct texts that are left of a word's first letters after up to that many (two at most) deletions."""

    def without_one(words: Column) -> Column:
        cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
        return F.flatten(F.transform(F.filter(words, lambda w: w != ""), cut))

    from opinara.functions.text import let

    head, times = F.array(F.substr(word, F.lit(1), F.lit(PREFIX))), F.lit(deletions) if isinstance(deletions, int) else deletions
    none = F.array().cast("array<string>")
    once = F.when(times >= 1, without_one(head)).otherwise(none)
    return F.array_distinct(let(once, lambda x: F.concat(head, x, F.when(times >= 2, without_one(F.array_distinct(x))).otherwise(none))))


def allowed(word: Column, short: int = 5, most: int = 2) -> Column:
    """Edits that a word may be away: one of words shorter than ``short`` letters, else ``most``."""
    return F.when(F.length(word) < short, 1).otherwise(most)


def corrections(tokens: DataFrame, known: DataFrame, least: int = 3, short: int = 5, most: int = 2) -> DataFrame:
    """(token, word, distance, n) of every distinct unknown token of ``tokens(token)`` that has a known word near enough.

    ``known(word, n)`` holds distinct words and their frequency. Tokens of ``least`` letters and more are looked for; of
    the known words within the allowed edits (insertions, deletions, replacements) the nearest counts, then the most
    frequent, then the first. Tokens with none, and nulls, are left out. Tokens are made distinct before anything is joined;
    both sides are keyed by remainders, at most 56 a word, and every pair that meets is verified. No side is broadcast: from the
    size of a file of known words Spark does not tell how many rows their remainders are, which would pass through the driver.
    """
    unknown = tokens.where(F.length("token") >= least).select("token").distinct().join(known.select(F.col("word").alias("token")).hint("merge"), "token", "left_anti")
    wanted = unknown.select("token", F.explode(remainders(F.col("token"), allowed(F.col("token"), short, most))).alias("rest"))
    index = known.where(F.length("word") >= least - 1).select("word", "n", F.explode(remainders(F.col("word"), most)).alias("rest"))
    near = F.abs(F.length("token") - F.length("word")) <= allowed(F.col("token"), short, most)
    # -1 where the distance is greater than the threshold, at which the comparison ends
    met = wanted.join(index.hint("merge"), "rest").where(near).select("token", "word", "n", F.levenshtein("token", "word", most).alias("distance"))
    met = met.where((F.col("distance") >= 0) & (F.col("distance") <= allowed(F.col("token"), short, most)))
    best = met.groupBy("token").agg(F.min(F.struct("distance", (-F.col("n")).alias("m"), "word")).alias("b"))
    return best.select("token", "b.word", "b.distance", (-F.col("b.m")).alias("n"))


def _without(known: DataFrame):
    """A column function: a list of tokens without the known ones."""
    words = known.select("word").toArrow()["word"].combine_chunks()
    shared = known.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("array<string>")
    def rest(tokens: pa.Array) -> pa.Array:
        flat = tokens.flatten()
        stays = pc.invert(pc.is_in(flat, value_set=shared.value))
        row = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())
        sizes = np.bincount(row[stays.to_numpy(zero_copy_only=False)], minlength=len(tokens))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat.filter(stays))

    return rest.asNondeterministic()


def _mended(tokens: pa.Array, wrong: pa.Array, right: pa.Array) -> pa.Array:
    """Lists of tokens, replaced by what any of the rows says: a token has one right word in all of them. One lookup of all tokens, as
    looking each up in a map of its row takes time by the square of a text's length."""
    flat = tokens.flatten()
    done = pc.coalesce(right.flatten().take(pc.index_in(flat, value_set=wrong.flatten())), flat)
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), done, mask=tokens.is_null())


def correct(df: DataFrame, key: str, column: str, found: DataFrame, known: DataFrame) -> DataFrame:
    """df with the tokens of a list column replaced by ``found(token, word)``; ``known(word)`` are right as they are. ``key`` is
    unique.

    Known words, if they are no more than MAX_SHARED, are taken out within the row, by one list that all workers get; it is smaller than
    the hashed table that the driver makes of words to broadcast them. Else they are joined. Only what is left is dealt by token,
    and only what is replaced is gathered by row. ``known`` is read twice.
    """
    bytes_ = known.agg(F.sum(F.octet_length("word") + 8)).first()[0] or 0
    tokens, words = F.array_distinct(column), known.select(F.col("word").alias("token"))
    if bytes_ <= MAX_SHARED:
        spots = df.select(key, F.explode(_without(known)(tokens)).alias("token"))
    else:
        spots = df.select(key, F.explode(tokens).alias("token")).join(words.hint("merge"), "token", "left_anti")
    fixes = spots.join(found.select("token", "word").hint("merge"), "token").groupBy(key).agg(F.collect_list(F.struct("token", "word")).alias("_fixes"))
    some = F.col("_fixes").isNotNull()
    mended = F.arrow_udf(_mended, "array<string>").asNondeterministic()(F.when(some, F.col(column)), "_fixes.token", "_fixes.word")
    return df.join(fixes, key, "left").withColumn(column, F.when(some, mended).otherwise(F.col(column))).drop("_fixes")
