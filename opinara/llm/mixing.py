"""Mixing sources to target weights: thresholds on a hash, found in histograms and refined in their boundary bucket only."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

#: Hexadecimal digits of a row's key, and digits by which a histogram tells its buckets apart: 256 buckets a source.
DIGITS, STEP = 32, 2
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, size, key) of every row: words of the text (null: none) and its place in the order of taking. The
    first half of the key is a hash of doc_id and text, the second half tells rows apart that are equal in everything; it
    counts for nothing else, but is to be written before it is read twice."""
    digits = lambda *c: F.lpad(F.hex(F.xxhash64(*c)), DIGITS // 2, "0")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.concat(digits(F.lit(seed), "doc_id", "text"), digits(F.monotonically_increasing_id())).alias("key"))


def targets(sources: DataFrame, budgets: Sequence[Fraction], most: int = 2) -> DataFrame:
    """(source, source_size, mix, target) of ``sources(source, source_size, weight)``: mix k shares budgets[k] times all
    sizes by weight. A target stops at ``most`` times its source's size; the excess is shared by weight among the others,
    until none is above.

    Every round is one aggregate over the sources, whose two sums fix the share of a unit of weight exactly; shares only
    grow, so a source that has stopped stays so.
    """
    whole = lambda x: F.lit(x).cast("decimal(38,0)")
    cap, weight = F.col("source_size") * most, F.col("weight")
    total, weights = (x or 0 for x in sources.agg(F.sum("source_size"), F.sum("weight")).first())
    out = None
    for k, budget in enumerate(budgets):
        share, full, stopped = Fraction(0), F.lit(False), (0, 0)
        while weights > stopped[1]:
            share = (budget * total - stopped[0]) / (weights - stopped[1])
            full = whole(share.numerator) * weight > cap * whole(share.denominator)
            found = tuple(x or 0 for x in sources.where(full).agg(F.sum(cap), F.sum("weight")).first())
            if found == stopped:
                break
            stopped = found
        part = F.when(full, cap.cast("double")).otherwise((whole(share.numerator) * weight).cast("double") / F.lit(float(share.denominator)))
        mixed = sources.select("source", "source_size", F.lit(k).alias("mix"), part.alias("target"))
        out = mixed if out is None else out.unionByName(mixed)
    return out


def thresholds(scratch: Scratch, rows: DataFrame, counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, mix, cut): the rows whose key lies below the cut have about ``rest`` words of their source.

    ``wanted(source, mix, rest)`` has a row for each budget of a source: a larger rest never takes less. ``counts(source,
    bucket, size, n)`` is the histogram of all rows. No row is sorted: only in the bucket in which the running sum passes the
    rest, rows are counted again by the next digits of their key, until the bucket holds one row; that one is taken if this
    brings the sum nearer. Running sums go over 256 buckets.
    """
    place, done = W.partitionBy("source", "mix").orderBy("bucket"), None
    found = counts.alias("c").join(wanted.alias("w"), F.expr("c.source <=> w.source and w.rest > 0")).select("w.*", "c.bucket", "c.size", "c.n")
    for used in range(STEP, DIGITS + 1, STEP):
        before = F.sum("size").over(place) - F.col("size")
        here = found.withColumn("before", before).where("before <= rest and rest < before + size")
        here = scratch.write(here.select("source", "mix", (F.col("rest") - F.col("before")).alias("rest"), "bucket", "size", "n"))
        # G comes after all digits: the bucket as a whole
        end = F.when(F.col("rest") * 2 >= F.col("size"), F.concat("bucket", F.lit("G"))).otherwise(F.col("bucket"))
        ends = here.where((F.col("n") == 1) | F.lit(used == DIGITS)).select("source", "mix", end.alias("cut"))
        done = ends if done is None else done.unionByName(ends)
        more = here.where("n > 1")
        if used == DIGITS or more.isEmpty():
            return done
        # of the rows, those in boundary buckets: a small part of the ones looked at before
        fits = f"p.source <=> m.source and substring(p.key, 1, {used}) = m.bucket" + (" and p.mix = m.mix" if "mix" in rows.columns else "")
        rows = scratch.write(rows.alias("p").join(more.alias("m"), F.expr(fits)).select("p.source", "m.mix", "m.rest", "p.size", "p.key"))
        found = rows.groupBy("source", "mix", "rest", F.substring("key", 1, used + STEP).alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))


def mix(docs: DataFrame, weighted, budgets: Sequence[Fraction] = (Fraction(3, 2),), most: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, source, mix, size, source_size, target, taken) of every row of ``docs(doc_id, text, source)`` and every budget.

    ``weighted`` makes (source, source_size, weight) of (source, source_size), weights being whole numbers. A document is
    taken as a whole, as often as its target holds its source's size, and once more if its key lies below the source's
    threshold; so no document is taken more than ``most`` times, and the sum of a source misses its target by half of one
    document at most. What is taken depends on doc_id, text and seed alone, and what a smaller budget takes a larger one
    takes too. Null is a source of its own, null texts have no words and take none; of rows that are equal in everything
    some may be taken; an empty table gives no rows. Further columns are left out.

    One pass over the texts; sizes and keys are written once and counted by source and bucket, so a source that has a third
    of all rows is pre-summed in every task. Tables of sources are broadcast where Spark finds them small, else joined.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.write(sized(docs, seed))
        counts = scratch.write(rows.groupBy("source", F.substring("key", 1, STEP).alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("n")))
        sources = scratch.write(weighted(scratch, counts.groupBy("source").agg(F.sum("size").alias("source_size"))))
        goals = targets(sources, budgets, most).withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        goals = scratch.write(goals.withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")))
        cuts = thresholds(scratch, rows, counts, goals.select("source", "mix", "rest"))
        plan = goals.alias("g").join(cuts.alias("c"), F.expr("g.source <=> c.source and g.mix = c.mix"), "left").select("g.*", F.coalesce("c.cut", F.lit("")).alias("cut"))
        rows, plan = scratch.hand_on(rows), scratch.hand_on(scratch.write(plan))
    taken = F.col("size") * (F.col("times") + (F.col("key") < F.col("cut")).cast("long"))
    return rows.alias("r").join(plan.alias("p"), F.expr("r.source <=> p.source")).select("doc_id", "r.source", "mix", "size", "source_size", "target", taken.cast("long").alias("taken"))


def in_turn(weights: Sequence[int]):
    """For ``mix``: weights that repeat in the order of the sources by code point, null last. Sources are numbered within
    ranges, and ranges by their counts, so that no task sees all of them."""

    def weighted(scratch: Scratch, sources: DataFrame) -> DataFrame:
        last = F.col("source").isNull()
        dealt = scratch.write(sources.repartitionByRange(last, "source").withColumn("part", F.spark_partition_id()))
        counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
        before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
        place = F.row_number().over(W.partitionBy("part").orderBy(last, "source")) - 1
        weight = F.get(F.array(*map(F.lit, weights)), ((F.col("before") + F.col("place")) % len(weights)).cast("int"))
        return dealt.withColumn("place", place).join(F.broadcast(before), "part").select("source", "source_size", weight.alias("weight"))

    return weighted


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), in_turn((3, 1, 2))).select("doc_id", "size", "source_size", "target", "taken")
