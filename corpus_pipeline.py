"""Corpus pipeline: toxicity, near duplicates, benchmark leaks, personal data and packing, one stage after the other.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``run`` writes each result as
Parquet in the shared folder and reads it back for the next stage. All stages but the last return the columns of documents.
Extra columns of docs, whatever their names, pass through the filters untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import decontam, jaccard, packing, pii, toxicity
from opinara.llm.common import clear, stash, stashes, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the rejection level; null and empty texts stay unless words speak against them.

    The classifier is fitted on the labelled rows of docs outside the held-out fold.
    """
    labels = toxicity.seen_labels(table(spark, sf_dir, "labels"))
    score = toxicity.scorer(spark, toxicity.train(docs.select("doc_id", "text"), labels))
    return docs.where(score("text") < toxicity.REJECT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each class of texts linked by similar sets of five-word shingles (0.8 or more).

    Texts without words and rows with a null doc_id are linked with nothing and stay; of rows with the same doc_id all stay
    or go.
    """
    found = jaccard.classes(docs.select("doc_id", "text"), k=5, threshold="0.8")
    gone = stash(found.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item's question and answer are found; null and empty texts stay."""
    found = decontam.finders(decontam.items_of(table(spark, sf_dir, "benchmark")))
    return docs.where(F.size(decontam.leaks(F.col("text"), found)) == 0)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in texts replaced by its kind; n_chars, where present, is the new length."""
    clean = pii.redact(docs, "text")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences without padding, each a piece of one document whose length is a power of two."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: The classifier and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents.

    Without labels of both classes nothing is toxic, without benchmark items nothing is a leak; without documents there are
    no rows. What the stages have written is deleted but for the input of the last one, which the result reads.
    """
    docs, mark = table(spark, sf_dir, "documents"), stashes()
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
        clear(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
