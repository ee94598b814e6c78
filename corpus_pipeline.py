"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns documents again; the last returns the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseline.llm import line_crf, near_dedup, packing, pii_surrogates, suffix_match
from verseline.llm.queries import pii_key, table, tokenizer_path
from verseline.llm.tables import held, materialize, sweep

QUALITY = 0.3
#: SQL cannot express the classifier, the surrogates or the packing
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the line classifier accepts; it learns from the labels of the raw documents.

    Without labels, or with those of one class, all texts score their rate.  Null
    and empty texts score as all bad; rows that repeat are judged alike; ids play
    no part.  An empty table stays empty.
    """
    raw = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = line_crf.train(raw, table(spark, sf_dir, "labels").where(~line_crf.held_out()))
    return line_crf.keep_good(docs, model, QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id.

    Rows without an id or without words stay.  Of rows that repeat an id each text
    counts for itself, those beyond the first after all other documents; of rows
    that repeat id and text one stays.  An empty table stays empty.
    """
    return near_dedup.drop_near_duplicates(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth is benchmark text.

    Null and empty texts stay, as do all rows if the benchmark is empty; rows that
    repeat are judged alike.  An empty table stays empty.
    """
    return suffix_match.decontaminate(docs, table(spark, sf_dir, "benchmark"), size=13)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by surrogates; n_chars follows the text where it changed.

    Null texts stay null; equal texts are changed alike.  An empty table stays empty.
    """
    out = pii_surrogates.replace_entities(docs, pii_key(spark))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size("pii_kinds") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 4096 tokens.

    A null or empty text is one piece of the end token; rows that repeat an id are
    packed each; null ids stay null.  An empty table gives no pieces.
    """
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path(), capacity=4096, end_id=1)


STAGES = [("quality", quality), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("pii", personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of the documents that all stages kept.

    Each stage's rows are written to the shared folder and read again; what the
    stage wrote on its way, and its predecessor's rows, go then.
    """
    docs = table(spark, sf_dir, "documents")
    first = held()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
            sweep(first, held() - 1)
    return docs
