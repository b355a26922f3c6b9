"""Analysis by content: what has been analysed once is kept in a table and only joined to later."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import text as T
from opinara.operators import screening

from .analyze import within_rows


def content_key(df: DataFrame) -> DataFrame:
    """Adds content: a hash of all that an analysis of the row alone depends on, its stripped text and product name."""
    text, name = T.strip(F.coalesce("raw_text", F.lit(""))), F.coalesce("product_name", F.lit(""))
    return df.withColumn("content", F.sha2(F.concat(F.length(text).cast("string"), F.lit(":"), text, name), 256))


def stored_runs(spark: SparkSession, store: str, version: str) -> list[str]:
    """Folders of the runs that were written to their end, oldest first."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/version={version}")
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(top):
        return []
    made = [x.getPath() for x in files.listStatus(top)]
    return sorted(p.toString() for p in made if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def analyze_incremental(df: DataFrame, store: str, version: str = "1", **options) -> DataFrame:
    """The result of ``analyze_batch(df, **options)``, with all steps within the row taken from ``store`` where it has them.

    Contents that the store lacks are found by an anti join on their hash, made distinct by a partial aggregate, analysed
    once and written as a further run; a run that failed leaves no mark of success and is not read. Then all rows, copies
    too, take their content's results by a join, in which a very frequent content is split by the adaptive skew join, and
    are screened with the duplicates of this batch. ``version`` names lexicons and options: a store never mixes them. One
    run at a time may write to a store.
    """
    spark = df.sparkSession
    rows = content_key(df.withColumn("product_name", F.coalesce("product_name", F.lit(""))))
    runs = stored_runs(spark, store, version)
    texts = rows.select("content", "raw_text", "product_name")
    if runs:
        texts = texts.join(spark.read.parquet(*runs).select("content"), "content", "left_anti")
    new = texts.groupBy("content").agg(F.first("raw_text").alias("raw_text"), F.first("product_name").alias("product_name"))
    if not runs or not texts.isEmpty():
        run = f"{store}/version={version}/run-{len(runs):06d}-{uuid.uuid4().hex}"
        within_rows(new.withColumn("raw_text", T.strip(F.coalesce("raw_text", F.lit("")))), **options).drop("raw_text", "product_name").write.parquet(run)
        runs = stored_runs(spark, store, version)
    marked = screening.mark_duplicates(rows.withColumn("raw_text", T.strip(F.coalesce("raw_text", F.lit("")))))
    return screening.screen(marked.join(spark.read.parquet(*runs), "content")).drop("hits", "content")
