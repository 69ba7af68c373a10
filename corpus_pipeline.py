"""A corpus from raw documents: toxic ones go, one of each group of near copies
stays, those with benchmark passages go, personal data is replaced, and what is
left is encoded.

Every stage takes rows as they come. Rows without an id stay, each by itself. Null and
empty texts are no one's copies, hold no items and nothing private, and have no tokens;
the toxicity model scores them as texts without words. Texts of any length are taken
whole. Rows that repeat an id are one document from the near-duplicate stage on. Columns
that documents does not have are left out. An empty table stays empty; without labels
of both kinds no text is toxic unless all labels are, and without items none goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontaminate, minhash, pieces, pseudonyms, toxicity
from waymark.llm.common import table, written

#: The columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Key of the pseudonyms.
KEY = "waymark"
#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a model fitted on docs and labels calls toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest id."""
    return minhash.one_of_each(docs).select(COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold an item of benchmark."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def anonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With pseudonyms in the text; n_chars is that of the new text, a null text keeps its own."""
    out = pseudonyms.pseudonymise(docs, KEY)
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.withColumn("n_chars", n_chars).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return pieces.encode_pieces(docs, pieces.default_model())


STAGES = [
    ("toxicity", clean),
    ("minhash", distinct),
    ("decontamination", uncontaminated),
    ("pii", anonymous),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
