"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import clear, stash, stashes, table

#: Arcs of the ring; a fixed number, so tables of arcs have a proven bound.
ARCS = 1 << 14


def ring(spark: SparkSession, shards: int, virtual_nodes: int, arcs: int = ARCS) -> DataFrame:
    """(arc, hop, shard): the distinct shards that one meets going clockwise from an arc, nearest first."""
    ids = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    nodes = spark.range(virtual_nodes).select(ids, "id").select("shard", F.pmod(F.xxhash64("shard", "id"), F.lit(arcs)).alias("at"))
    near = (
        spark.range(arcs).select(F.col("id").alias("arc"), ids)
        .join(F.broadcast(nodes.groupBy("shard").agg(F.sort_array(F.collect_set("at")).alias("ats"))), "shard")
        .select("arc", "shard", F.coalesce(F.get(F.filter("ats", lambda x: x >= F.col("arc")), F.lit(0)) - F.col("arc"), F.get("ats", F.lit(0)) + arcs - F.col("arc")).alias("gap"))
    )
    return near.select("arc", (F.row_number().over(W.partitionBy("arc").orderBy("gap", "shard")) - 1).alias("hop"), "shard")


def place(parts: DataFrame, hops: DataFrame, capacity: list[int]) -> DataFrame:
    """(arc, part, load, shard) of every load.

    ``parts(arc, part, load)`` is a table of bounded size. In round k each unplaced load asks the k-th shard clockwise of its
    arc; a shard takes loads in ring order until its capacity, and the first one that does not fit stays there too (so a
    shard exceeds its capacity by less than one load); the rest goes on clockwise.
    """
    spark = parts.sparkSession
    cap = spark.sql("select * from values " + ", ".join(f"({k}, {c}L)" for k, c in enumerate(capacity)) + " as caps(shard, cap)")
    wait, placed = parts.withColumn("hop", F.lit(0)), None
    for _ in capacity:
        ask = wait.join(F.broadcast(hops), ["arc", "hop"]).join(F.broadcast(cap), "shard")
        before = F.sum("load").over(W.partitionBy("shard").orderBy("arc", "part")) - F.col("load")
        ask = stash(ask.withColumn("before", before))
        taken = ask.where("before < cap").drop("before")
        placed = taken if placed is None else placed.unionByName(taken)
        wait = ask.where("before >= cap").select("arc", "part", "load", (F.col("hop") + 1).alias("hop"))
        used = taken.groupBy("shard").agg(F.sum("load").alias("used"))
        cap = stash(cap.join(F.broadcast(used), "shard", "left").select("shard", (F.col("cap") - F.coalesce("used", F.lit(0))).alias("cap")))
        if wait.isEmpty():
            break
    return placed.select("arc", "part", "load", "shard")


def shard(docs: DataFrame, shards: int = 8, virtual_nodes: int = 64, slack: float = 0.002, parts: int = 256, block: int = 50_000) -> DataFrame:
    """Shard of every row of ``docs(doc_id, text)``, balanced by bytes: law ``bytes``.

    A text's hash is its place on a ring of ARCS arcs; virtual nodes of the shards lie on the same ring. A shard takes what
    lies before its virtual nodes until it holds (1 + slack) times the mean size; the rest continues clockwise. Loads are
    compared per arc and, for arcs that weigh more than a small part of a shard (a text with very many copies), per part of
    an arc, rows being dealt to parts by hash, so one text that is a third of all rows spreads over shards. Equal texts
    share an arc and hence a shard unless their arc is cut so. Everything that is decided on arcs or parts is a table of
    fixed size. Null texts have size 1, null ids and repeated rows are placed like any other row; an empty table gives no
    rows; further columns are ignored. slot counts a shard's rows from 0 without gaps.
    """
    spark, text, mark = docs.sparkSession, F.col("text"), stashes()
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(ARCS)).alias("arc"), F.xxhash64("doc_id", text, F.lit(1)).alias("h"),
    )
    rows = stash(rows.select("doc_id", "size", "text_crc32", "arc", F.pmod("h", F.lit(parts)).cast("int").alias("part"), F.shiftrightunsigned("h", 20).alias("block")))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    # a shard's rows are counted in as many blocks as there are, so none grows with the input
    rows = rows.withColumn("block", F.pmod("block", F.lit(max(512, n // (shards * block)))))
    limit = -(-int(total * (1 + slack)) // shards) + 1
    heavy = limit // 50
    # arcs are cut into parts only where they are heavy: at most 50 arcs a shard
    arcs = stash(rows.groupBy("arc").agg(F.sum("size").alias("load")))
    cut = arcs.where(F.col("load") > heavy).select("arc", F.lit(True).alias("cut"))
    rows = rows.join(F.broadcast(cut), "arc", "left").withColumn("part", F.when(F.col("cut"), F.col("part")).otherwise(-1)).drop("cut")
    loads = stash(rows.groupBy("arc", "part").agg(F.sum("size").alias("load"), F.count("*").alias("n")))
    where = stash(place(loads.select("arc", "part", "load"), stash(ring(spark, shards, virtual_nodes)), [limit] * shards))
    rows = rows.join(F.broadcast(where.select("arc", "part", "shard")), ["arc", "part"])
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    first = counts.select("shard", "block", (F.sum("n").over(W.partitionBy("shard").orderBy("block")) - F.col("n")).alias("first"))
    slot = F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")) - 1
    out = stash(rows.withColumn("slot", slot).join(first, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("slot")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    ))
    clear(spark, mark, out)
    return out


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=8)
