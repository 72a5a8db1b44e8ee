"""From raw documents to packed training sequences: each stage is one operator, and works on all that its predecessor kept.

All stages take an empty table (and give one), nulls in any column, repeated rows and extra columns
under any name; all but the last return the columns of ``docs``. What each makes of a null, an empty
or a repeated text is said where the stage is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import mixing, near_dedup, packing, pii, toxicity
from lumenfold.llm.common import materialize, read_table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go.

    A null text, or one without words, stays, and so does a row without an id; rows that repeat a
    text share its fate. Without labels nothing is rejected.
    """
    labels, categories = toxicity.label_categories(read_table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, toxicity.train(docs, labels, categories))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    Rows that repeat id and text become one, rows that repeat an id under another text are documents
    of their own. A text without words (null, empty) and a row without an id stay.
    """
    return near_dedup.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text.

    A null text stays null, a null n_chars too. Repeated texts are masked alike.
    """
    return pii.redact(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A document without words (null, empty) stays once; a null source is a source. Rows that repeat
    id, source and size share their copies evenly.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences.

    A null or empty text is one piece of one id. Repeated rows are packed each for itself.
    """
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_to_targets),
    ("packing", pack_sequences),
]

#: Trained models and hash-based samples aren't expressible in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
