"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common, decontamination, language_id, line_dedup, near_dedup, packing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return language_id.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that come earlier; documents of which nothing else was left go."""
    counts = common.spare(docs, "n_lines", "n_dropped")
    out = line_dedup.dedup_lines(docs, counts=tuple(counts))
    changed, emptied = F.col(counts[1]) > 0, ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    n_chars = F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(~(changed & emptied)).withColumn("n_chars", n_chars).select(*[f"`{c}`" for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Of a near copy line dedup leaves the few lines that were changed, and these resemble nothing.  So
    documents are linked by the texts that they have now or by those that they had in ``documents``;
    sets are those of operator 9's contract, of four words."""
    return near_dedup.keep_one(docs, shingle=4, also=common.read_table(spark, sf_dir, "documents"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontamination.remove_documents(docs, common.read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the pieces of all documents in sequences of 4096 tokens.  The workers have run
    the other stages, so they keep fewer encoded words."""
    return packing.pack_documents(docs, cache=100_000)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near), ("decontamination", benchmark), ("packing", pack)]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written as Parquet and read as the next
    one's input.

    Null texts have no language and go in the first stage, as do empty ones.  Rows with a null doc_id
    are documents of their own that no near-duplicate stage links; rows that repeat a doc_id stay or go
    together there, and each by its own text in all other stages.  An empty table gives an empty one,
    and further columns are passed on up to the last stage.  All scratch tables but the last
    stage's are deleted.
    """
    docs, before = common.read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        made: list[str] = []
        with common.scratch_scope(spark, made):
            docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}", made)
        for path in before:
            common.drop_path(spark, path)
        before = made
    return docs
