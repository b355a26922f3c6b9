"""N-gram Jaccard join over count vectors: groups of shingle hashes, boxes of group counts, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import clear, stash, stashes, table
from .components import connected_components
from .tokens import chunks, mix, shingles, split

#: Coordinates of the coarse count vector, and words of 64 last bits of fine counts.
GROUPS, PARITY = 32, 8
_C, _P = [f"c{i}" for i in range(GROUPS)], [f"p{i}" for i in range(PARITY)]
#: Up to this many ids are broadcast; more are joined by a shuffle.
SMALL_IDS = 500_000
_EMPTY = np.uint64(0xA0761D6478BD642F)


def _differ(total: int, t: Fraction) -> int:
    """Most elements in which two sets of ``total`` elements together can differ at similarity t."""
    return int(total * (1 - t) / (1 + t))


def grid_cells(level: int, t: Fraction) -> int:
    """Fine groups of the grid for pairs whose larger set has 2**level to 2**(level + 1) - 1 elements: more than any such
    pair can differ in, and some spare ones."""
    r = _differ(2 * (2 ** (level + 1) - 1), t)
    return r + 1 + max(3, r // 7)


def cell_keys(u: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(keys, marks) of a sorted set of hashes, such that two sets of similarity t or more share keys, for certain.

    Hashes fall into the cells of a grid, a fine count vector. A similar pair differs in fewer elements than the grid has
    cells, so the pair has a cell with the same elements in both; a key names such a cell and its elements. Only where a set
    leaves so many cells empty that all cells in common could be empty does it also give the keys of its empty cells; then
    its partner does so, too. A mark holds the least number of keys of one grid that the set shares with any similar one,
    and whether the grid is the upper one.
    """
    n = len(u)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    level, high, scrambled, out, marks = n.bit_length() - 1, u >> np.uint64(32), mix(u), [], []
    for g in (level, level + 1):
        if g > level and n < t * 2**g:
            continue
        most = _differ(n + min(2 ** (g + 1) - 1, int(n / t)), t)
        if not most:
            continue  # only an equal set is so similar
        cells = grid_cells(g, t)
        cell = (high * np.uint64(cells)) >> np.uint64(32)
        first = np.flatnonzero(np.diff(cell, prepend=np.uint64(1 << 40)))
        salt = mix(cell[first] + np.uint64(g << 40))
        out.append(mix(np.add.reduceat(scrambled, first) ^ salt))
        if len(first) <= most:
            empty = np.setdiff1d(np.arange(cells, dtype=np.uint64), cell[first])
            out[-1] = np.concatenate((out[-1], mix(_EMPTY ^ mix(empty + np.uint64(g << 40)))))
        marks.append(np.full(len(out[-1]), max(1, len(first) - most) * 2 + (g > level)))
    return (np.concatenate(out), np.concatenate(marks)) if out else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _tasks(docs: DataFrame, k: int, schema: str, row) -> DataFrame:
    """Rows made by ``row(ids, sets)`` from the ids and the sets of every chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, raw in chunks(x.as_py() for x in batch.column(1)):
                own = batch.column(0).slice(at, len(raw))
                yield row(own, ids[at : at + len(raw)], list(shingles(split(raw), len(raw), k)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _lists(values: np.ndarray, sizes) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes], dtype=np.int32)), pa.array(values))


def _sizes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, k1, k2): size and 128-bit hash of every row's set."""

    def row(own, ids, sets):
        total = lambda salt: _signed([mix(u ^ salt).sum(dtype=np.uint64) if len(u) else 0 for u in sets])
        return pa.RecordBatch.from_arrays([own, pa.array([len(u) for u in sets], pa.int64()), total(np.uint64(0)), total(_EMPTY)], names=["doc_id", "n", "k1", "k2"])

    return _tasks(docs, k, "doc_id long, n long, k1 long, k2 long", row)


def _cells(docs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """(rep, key, mark): the cell keys of every row's set."""

    def row(own, ids, sets):
        found = [cell_keys(u, t) for u in sets]
        keys, marks = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(x) for x, _ in found]), pa.int64()), _signed(keys), pa.array(marks, pa.int32())], names=["rep", "key", "mark"])

    return _tasks(docs, k, "rep long, key long, mark int", row)


def _thin(cells: DataFrame) -> DataFrame:
    """(key, rep, leader) of ``cells(rep, key, mark)`` that can bring similar sets together; leader is a key's least rep.

    A set shares at least so many keys of a grid with a similar one, so each may leave out all but one of so many of its
    keys, the same ones first for all: those of most members. What only a passage in common brings together goes this way.
    """
    own = W.partitionBy("rep", F.col("mark") % 2).orderBy(F.desc("m"), "key")
    cells = stash(cells)
    # a passage in common may give one key to any number of sets: keys are counted by partial aggregates, never gathered, and
    # their written table has a shuffle of its own in the join, whose larger partitions the adaptive skew join splits
    met = stash(cells.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    placed = cells.join(met, "key").withColumn("place", F.row_number().over(own))
    kept = stash(placed.where(F.col("place") >= F.floor(F.col("mark") / 2)).select("key", "rep"))
    led = stash(kept.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").select("key", "leader"))
    return kept.join(led, "key").select("key", "rep", "leader")


def _points(docs: DataFrame, k: int) -> DataFrame:
    """(rep, n, c0.., p0..): size, coarse count vector, and PARITY x 64 fine counts by their last bit, of every row's set."""

    def row(own, ids, sets):
        c = np.stack([np.bincount((u & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS) for u in sets]).astype(np.int32)
        fine = np.stack([np.bincount((u >> np.uint64(32)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1 for u in sets]).astype(np.uint8)
        p = np.packbits(fine, axis=1).view(np.int64)
        return pa.RecordBatch.from_arrays([own, pa.array([len(u) for u in sets], pa.int64()), *map(pa.array, c.T.copy()), *map(pa.array, p.T.copy())], names=["rep", "n", *_C, *_P])

    return _tasks(docs, k, "rep long, n long, " + ", ".join([f"{x} int" for x in _C] + [f"{x} long" for x in _P]), row)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(rep, hashes) of every row."""

    def row(own, ids, sets):
        return pa.RecordBatch.from_arrays([own, _lists(np.concatenate(sets).view(np.int64), [len(u) for u in sets])], names=["rep", "hashes"])

    return _tasks(docs, k, "rep long, hashes array<long>", row)


def _of(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs whose doc_id is (or with left_anti is not) among ids(doc_id): by broadcast if they are counted to be few."""
    small = ids.limit(SMALL_IDS + 1).count() <= SMALL_IDS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", how)


def _enough(shared: Column, a: Column, b: Column, t: Fraction) -> Column:
    """Whether two sets of sizes a and b with so many elements in common have similarity t or more, in whole numbers."""
    return (t.numerator + t.denominator) * shared >= t.numerator * (a + b)


def _bound(x: str, y: str, t: Fraction) -> Column:
    """Whether the points allow similarity t: by the summed minima of their coordinates, and as fine counts that differ in
    their last bit hold an element of one set only."""
    col = lambda a, b: F.col(f"{a}.{b}")
    least = sum((F.least(col(x, c), col(y, c)) for c in _C), F.lit(0))
    odd = sum((F.bit_count(col(x, p).bitwiseXOR(col(y, p))) for p in _P), F.lit(0))
    total = col(x, "n") + col(y, "n")
    size = F.least(col(x, "n"), col(y, "n"))
    return _enough(size, col(x, "n"), col(y, "n"), t) & _enough(least, col(x, "n"), col(y, "n"), t) & ((t.numerator + t.denominator) * odd <= (t.denominator - t.numerator) * total)


def _verify(pairs: DataFrame, docs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """The pairs (a, b) that really are as similar as t, by their whole sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = _sets(_of(docs, ids), k)
    a, b = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha")), sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb"))
    both = pairs.join(b, "b").join(a, "a")
    return both.where(_enough(F.size(F.array_intersect("ha", "hb")), F.size("ha"), F.size("hb"), t)).select("a", "b").distinct()


def _box_join(members: DataFrame, t: Fraction) -> DataFrame:
    """(a, b) of ``members(key, rep, comp, main, n, c0.., p0..)`` with one key, different comp and points that allow similarity t.

    main is one comp of the key's: of two different comps one is another, so only members of others look for partners. The
    points of a key lie in boxes along their size, each 1 / t times as wide as the one before, so a set meets only those of
    its own and of the boxes beside it. A member is dealt out at most four times whatever the size of its cell; pairs are
    bounded where they meet and only those that may be similar leave the join.
    """
    box = F.floor(F.log("n") / float(np.log(float(1 / t))) + 1e-9)
    other = members.where("comp <> main").withColumn("box", F.explode(F.array(box - 1, box, box + 1))).alias("p")
    every = members.withColumn("box", box).alias("q")
    once = (F.col("q.comp") == F.col("q.main")) | (F.col("p.rep") < F.col("q.rep"))
    meet = (F.col("p.key") == F.col("q.key")) & (F.col("p.box") == F.col("q.box")) & (F.col("p.comp") != F.col("q.comp")) & once
    return other.join(every, meet & _bound("p", "q", t)).select(F.least("p.rep", "q.rep").alias("a"), F.greatest("p.rep", "q.rep").alias("b")).distinct()


def classes(docs: DataFrame, k: int = 5, threshold: Fraction | str = "0.8") -> DataFrame:
    """(doc_id, n_shingles, rep, component_id) of every row of ``docs(doc_id, text)``: connected classes of the join.

    Sets are of k-word shingles, compared by 64-bit hashes; two rows are linked when the Jaccard similarity of their sets is
    threshold or more, exactly. No link between different classes is lost; links inside a class are tested only until it is
    connected, so a class of many copies costs in proportion to its rows. Steps: equal sets become one representative, their
    smallest doc_id. Representatives meet under cell keys (see cell_keys). Every one is first verified against the leader
    with which it shares most cells; cells that hold more than one class after that are joined through boxes of count
    vectors, and what the summed minima allow is verified too. A text without words has no shingles and is linked with
    nothing; neither is a row with a null doc_id (component null). Rows with the same doc_id count as one document. An
    empty table gives no rows; further columns are ignored.
    """
    t, spark, mark = Fraction(threshold), docs.sparkSession, stashes()
    docs = docs.select("doc_id", "text")
    found = stash(_sizes(docs, k))
    # only sets met under several ids are written and joined back; a set of any number of copies is split by the skew join
    reps = found.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    reps = stash(reps.where("rep < last").drop("last"))
    rep = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("rep", "doc_id"))
    members = stash(found.join(reps, ["n", "k1", "k2"], "left").select("doc_id", "n", rep.alias("rep")))
    copies = members.where("doc_id <> rep").select("doc_id").distinct()
    shared = stash(_thin(_cells(_of(docs.where("doc_id is not null"), copies, "left_anti"), k, t)))
    clear(spark, mark, members, shared)
    points = stash(_points(_of(docs, shared.select(F.col("rep").alias("doc_id")).distinct()), k))
    most = shared.where("rep <> leader").groupBy("rep", "leader").agg(F.count("*").alias("n")).groupBy("rep").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("leader"))
    x, y = points.alias("x"), points.alias("y")
    first = most.join(x, F.col("leader") == F.col("x.rep")).drop(F.col("x.rep")).join(y, most["rep"] == F.col("y.rep")).where(_bound("x", "y", t))
    links = stash(_verify(stash(first.select(F.col("leader").alias("a"), most["rep"].alias("b"))), docs, k, t))
    parts = connected_components(links)
    sides = stash(shared.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp")))
    # cells with the same members are one cell; only those that still hold several classes matter
    who = [F.bit_xor(F.xxhash64("rep", F.lit(x))).alias(f"h{x}") for x in (1, 2)]
    open_cells = sides.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m"), F.min_by("comp", "rep").alias("main"), *who).where("x < y")
    open_cells = open_cells.groupBy("m", "h1", "h2").agg(F.min(F.struct("key", "main")).alias("k")).select("k.*")
    rest = sides.join(open_cells, "key").join(points, "rep")
    more = stash(_verify(stash(_box_join(rest, t)), docs, k, t))
    joined = connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    out = members.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    out = stash(out.select("doc_id", F.col("n").alias("n_shingles"), "rep", F.coalesce("component", "rep", "doc_id").alias("component_id")))
    clear(spark, mark, out)
    return out


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), k=4, threshold="0.85").select("doc_id", "n_shingles", "component_id")
