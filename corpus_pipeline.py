"""The training-data pipeline over ``documents``: toxicity, near duplicates, repeated passages, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; every stage's
result is written as Parquet to the shared folder and read again as the next
one's input.  All but the last return the columns of ``documents``.

1. toxicity: documents with a score of at least the threshold go.
2. near_duplicates: of each component of similar rows the one with the smallest id
   stays, of several with that id the one with the smallest text hash, of equal rows
   one; rows with a null id, and rows without words, stay.
3. repeated_passages: words under a window that an earlier document has are cut.
   A text without a repeat is left as it is; a cut text is the kept words with
   one space between them, and a text that is repeated as a whole becomes empty.
4. personal_data: spans are replaced by the name of their kind.
5. packing: pieces of the texts with their place in training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm import packing, pii, substring_dedup, toxicity
from tabsmith.llm.catalog import table
from tabsmith.llm.jaccard_join import one_of_each
from tabsmith.llm.shared import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

ORACLE_SQL = None


def _with_text(df: DataFrame, text) -> DataFrame:
    """The columns of documents with another text and its length."""
    own = [F.col(f"row.{c}") for c in COLUMNS if c not in ("text", "n_chars")]
    out = df.select(*own, text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(substring_dedup.remove_repeats(docs.select(*COLUMNS), keep_whole=True), F.col("kept"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = pii.train(docs)
    return _with_text(pii.find(docs, model, carry=[c for c in COLUMNS if c != "text"], redact=True), F.col("redacted"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; the last stage's rows.

    What a stage stores for itself is deleted once its result is written, and the
    results of all stages but the one that packing reads once that is written.
    """
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as last:
        for _, stage in STAGES[:-1]:
            with scratch(spark) as hand_on:
                docs = hand_on(stage(spark, docs, sf_dir))
        docs = last(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
