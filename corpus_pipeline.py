"""A corpus pipeline of four stages; each works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confero.llm import language, neardup, packing, quality
from confero.llm.common import Scratch, table, text_or_empty

#: A text whose main language has a smaller share is a jumble of languages.
LEAST_SHARE = 0.35


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language: null, empty, without letters, or without a main language.

    Repeated rows are judged each, texts of any length as a whole; rows without a doc_id stay, but nothing is learned
    from them; an empty table gives no rows; all columns of the input come through, whatever their names."""
    names = docs.columns
    rest = [c for c in names if c not in ("doc_id", "text")]
    known = language.identify(docs, more=["text", *rest]).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return known.select("doc_id", *(F.col(f"own_{c}").alias(c) for c in ["text", *rest])).select(*names)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the positive-unlabelled classifier rejects: scores under one half.

    Null texts are empty ones, and are scored; without positive labels every text stays.  Repeated rows are judged
    each, texts of any length as a whole; an empty table gives no rows; all columns come through."""
    names = docs.columns
    rest = [c for c in names if c != "doc_id"]
    good = quality.score_quality(docs, table(spark, sf_dir, "labels"), more=rest).where("predicted = 1")
    return good.select("doc_id", *(F.col(f"own_{c}").alias(c) for c in rest)).select(*names)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five words, 0.8): the smallest doc_id's, and of several texts under
    that id one.  Null, empty and wordless texts are in no group and stay; of rows with the same doc_id and text one
    stays.  Rows without a doc_id go; an empty table gives no rows; all columns come through."""
    kept = neardup.near_duplicates(docs).where("kept").groupBy("group_id").agg(F.min("doc_id").alias("kept_id"), F.min("text_hash").alias("kept_hash"))
    own = docs.withColumn("own hash", F.xxhash64(text_or_empty()))
    held = own.join(kept, (own["doc_id"].cast("long") == kept["kept_id"]) & (own["own hash"] == kept["kept_hash"]), "left_semi")
    return held.dropDuplicates(["doc_id", "own hash"]).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: a row for each piece of a document.  Null texts are empty ones,
    which are one token; repeated rows are packed as often as they occur; an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [("language ID", language_stage), ("quality classifier", quality_stage), ("MinHash near-dedup", neardup_stage), ("best-fit packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage-{i}")
    return docs


#: Learned models, MinHash and BPE are not SQL; tests hold every stage against a plain version.
ORACLE_SQL = None
