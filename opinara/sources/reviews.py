"""Reading and writing of review tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, strict: bool = False, breaks: bool = True) -> DataFrame:
    """A CSV table of strings with header, quotes doubled, a byte order mark allowed.

    ``breaks``: cells in quotes may hold line breaks, so a file is read by one task; without them large files are split. Empty cells are empty strings; with ``strict`` they, and the usual marks of missing values, are null.
    """
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", breaks).csv(path)
    if not strict:
        return df.na.fill("")
    missing = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "<NA>", "#N/A"]
    return df.select(*(F.when(~F.col(f"`{c}`").isin(*missing), F.col(f"`{c}`")).alias(c) for c in df.columns))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder, spark.checkpoint.dir; only a session on one machine may go without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="opinara-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what was written under a path of ``scratch``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV files with header that read_csv reads back, in UTF-8; with ``mark`` every file begins with a byte order mark, as
    spreadsheets want it.

    The mark is the first character of each header. The first column's name must not need quotes then.
    """
    if mark:
        first = df.columns[0]
        if re.search(r'[",\n\r]|^\s|\s$', first):
            raise ValueError(f"with a byte order mark the first column cannot be named {first!r}")
        df = df.toDF("\ufeff" + first, *df.columns[1:])
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(word, rank) of a text of words, most frequent first; of a word that comes twice the last rank counts.

    Ranks come from the place in the file: files of vocabularies are read whole, as one row each.
    """
    text = spark.read.text(path, wholetext=True)
    words = F.filter(F.split("value", r"(?U)\s+"), lambda w: w != "")
    return text.select(F.posexplode(words).alias("rank", "word")).groupBy("word").agg(F.max("rank").alias("rank")).orderBy("rank")


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """One word per line, in order."""
    vocab.select("word").coalesce(1).write.mode("overwrite").text(path)


def numbered(df: DataFrame, order: str, prefix: str = "TH") -> DataFrame:
    """Adds review_id: prefix and four digits, in an order. Meant for small literal tables."""
    return df.withColumn("review_id", F.format_string(f"{prefix}%04d", F.row_number().over(W.orderBy(order))))
