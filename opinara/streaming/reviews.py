"""The analysis on streams: all steps within the row run unchanged; duplicates are found within a watermark."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from opinara.functions import text as T
from opinara.operators import screening
from opinara.plans.analyze import within_rows


#: The state store that marks of duplicates need, as they have a time to live.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def analyze_stream(reviews: DataFrame, dictionary: set[str] | None = None, remember: timedelta | None = None) -> DataFrame:
    """Result columns of a stream ``reviews(review_id, raw_text, product_name)``.

    Without ``remember`` no other row is looked at and none is a duplicate; with it, rows are marked as by ``mark_duplicates``.
    """
    out = reviews.withColumn("raw_text", T.strip(F.coalesce("raw_text", F.lit("")))).withColumn("fingerprint", T.fingerprint(F.col("raw_text")))
    out = out.withColumn("duplicate_of", F.lit(None).cast("string")) if remember is None else mark_duplicates(out, remember)
    return screening.screen(within_rows(out, dictionary=dictionary)).drop("hits")


class _FirstSeen(StatefulProcessor):
    """Per fingerprint the key of the first row, for some time."""

    def __init__(self, order: str, key: str, milliseconds: int) -> None:
        self.order, self.key, self.milliseconds = order, key, milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "id string", ttlDurationMs=self.milliseconds)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.first.get()[0] if self.first.exists() else None
        if known is None:
            # rows of one trigger have no order of their own: the first by the order column counts
            frame = pd.concat(list(rows), ignore_index=True)
            at = frame.sort_values([self.order, self.key]).index[0]
            known = frame[self.key][at]
            self.first.update((known,))
            yield frame.assign(duplicate_of=[None if k == at else known for k in range(len(frame))])
        else:
            for frame in rows:
                yield frame.assign(duplicate_of=known)


def mark_duplicates(reviews: DataFrame, remember: timedelta, order: str = "pos", key: str = "review_id") -> DataFrame:
    """Adds duplicate_of to a stream with fingerprints: the key of the first row with the same one, null for that row.

    A first row is forgotten ``remember`` after it was seen (by the clock), so state is bounded; a later copy is a first row
    again. Keys are strings. A trigger's rows of a fingerprint not yet known are looked at together: bound them by the size of
    a trigger (maxFilesPerTrigger). Uses the session's state store, set here to one that can forget. As time alone changes its
    state, such a query does not end by itself, whatever its trigger: stop it when its progress shows all input.
    """
    reviews.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    schema = StructType([*reviews.schema.fields, StructField("duplicate_of", StringType())])
    processor = _FirstSeen(order, key, int(remember.total_seconds() * 1000))
    return reviews.groupBy("fingerprint").transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")


def first_reviews(reviews: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each fingerprint within a delay; later copies are dropped, and state is bounded by the watermark."""
    marked = reviews.withColumn("fingerprint", T.fingerprint(T.strip(F.coalesce("raw_text", F.lit("")))))
    return marked.withWatermark(time, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def aspect_windows(results: DataFrame, time: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Mentions of aspects by window of time and polarity."""
    said = results.select(time, F.explode("aspect_sentiment").alias("aspect", "polarity")).withWatermark(time, delay)
    return said.groupBy(F.window(time, window), "aspect", "polarity").agg(F.count("*").alias("n"))


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Parquet files, exactly once, of all input available now."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
