"""Helpers shared by the corpus operators: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words in these operators.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where none is set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="opinara-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Of each thread, the paths of its stashes in the order in which they were made: calls in other threads are not touched.
_own = threading.local()


def _made() -> list[str]:
    if not hasattr(_own, "paths"):
        _own.paths = []
    return _own.paths


def _written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """The tables that one call writes in the shared folder: ``with Scratch(spark) as scratch``.

    Lineage ends at a written table, and any executor can read it again. When the call ends, its tables are deleted but for
    those handed on to the reader of its result; when it fails, all of them are. Other calls, in other threads too, have their own.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame) -> DataFrame:
        out = _written(df)
        self.paths.append(out._stash_path)
        return out

    def hand_on(self, df: DataFrame) -> DataFrame:
        self.paths.remove(df._stash_path)
        return df

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            _delete(self.spark, path)
        self.paths = []


def stash(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, any executor can reread it.

    Operators delete their stashes when the last reader is written; one that returns a stash leaves it to its caller.
    """
    out = _written(df)
    _made().append(out._stash_path)
    return out


def stashes() -> int:
    """A mark for ``clear``, of this thread."""
    return len(_made())


def clear(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Delete the stashes that this thread has made since a mark, but for some."""
    made, stay = _made(), {df._stash_path for df in kept}
    gone = [path for path in made[since:] if path not in stay]
    made[since:] = [path for path in made[since:] if path in stay]
    for path in gone:
        _delete(spark, path)


def words(text):
    """Column: the words of a text, split at ASCII white space; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
