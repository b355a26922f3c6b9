"""Work that rests on some columns alone, done once for equal values: distinct values by a partial aggregate, results joined back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions import text as T


def key_of(*columns: Column) -> Column:
    """SHA-2 of strings, each with its length before it; null is not the empty string."""
    parts = (F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in columns)
    return F.unhex(F.sha2(F.concat(*parts), 256))


def on_distinct(df: DataFrame, values: dict[str, Column], step: Callable[[DataFrame], DataFrame], **sums: Column) -> DataFrame:
    """df with the columns that ``step`` adds to the table of distinct ``values``, strings by name; what step returns under the
    names of values is left out, and what df has under other names of its results is replaced.

    ``sums`` are aggregates of the rows of each value, for step to use. Step keeps one row for each row that it gets. Nothing is
    gathered by value: rows that hold a frequent one are split, where they take its results, by the adaptive skew join.
    """
    rows = df.withColumn("_content", T.once(key_of(*values.values())))
    # sorting and dealing compare the hash first: texts begin alike more often
    named = rows.withColumns({f"_v_{n}": v for n, v in values.items()}).groupBy("_content", *(f"_v_{n}" for n in values))
    found = named.agg(*(a.alias(n) for n, a in sums.items())) if sums else named.agg(F.lit(1).alias("_one")).drop("_one")
    found = step(found.withColumnsRenamed({f"_v_{n}": n for n in values})).drop(*values)
    return rows.drop(*(set(found.columns) - {"_content"})).join(found, "_content").drop("_content")
