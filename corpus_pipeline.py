"""A corpus pipeline: quality, repeated lines, near duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm.common import cut, read
from lumenspan.llm.line_dedup import drop_repeated_lines
from lumenspan.llm.mixing import mix_sources
from lumenspan.llm.ngram_join import ngram_components
from lumenspan.llm.packing import pack_documents
from lumenspan.llm.quality import fit_quality
from lumenspan.llm.queries import word_tokenizer
from lumenspan.session import ship

KEEP_FROM = 0.3  # least quality score that stays


def _key(docs: DataFrame):
    """With the id, what tells a document: rows that repeat both are one document to every stage, and stay or go together."""
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score below KEEP_FROM). A null text is scored as an empty one; rows that
    repeat are scored alike; without labels all score 0.5 and stay. Columns stay as they are."""
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    return docs.filter(model.column()(F.col("text")) >= KEEP_FROM)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of passages; a document that was nothing else goes. n_chars follows the text."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = drop_repeated_lines(docs, carry=others).filter("n_removed = 0 or trim(text) <> ''")
    column = {"doc_id": F.col("doc_id"), "text": F.col("text"), **{c: F.col(f"carried.`{c}`") for c in others}}
    if "n_chars" in column:
        column["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(column["n_chars"])
    return found.select(*[column[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts: the one with the least id (of several, the least text hash)."""
    stays = ngram_components(docs).filter("stays").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["__id"]) & (_key(docs) == stays["__key"]), "left_semi")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once, or repeated. Those without words (null, empty or
    white texts) have nothing that a mix could take, and go."""
    mixed = mix_sources(docs, F.array("source")).filter("taken > 0")
    uses = mixed.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), (F.col("taken") / F.col("size")).cast("int").alias("__uses")).dropDuplicates(["__id", "__key"])
    joined = docs.join(uses, docs["doc_id"].eqNullSafe(uses["__id"]) & (_key(docs) == uses["__key"]))
    return joined.withColumn("__use", F.explode(F.sequence(F.lit(1), F.col("__uses")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, each with its sequence and place. A null or empty text is the end mark alone; rows that repeat
    are packed each."""
    return pack_documents(docs, word_tokenizer())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("ngram_jaccard_join", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the classifier, the flow or the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next."""
    ship(spark)
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
