"""Operator 7: token counts by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokenizing import json_encoder, piece_counter, tokenizer_path


def count_tokens(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs(doc_id, text)``.

    Null texts count as empty (0 bytes, 0 tokens).  Rows are independent: repeated rows give
    repeated results, a null doc_id stays null, and columns of other names take no part.  Pre-tokens proven to be one token are counted directly; only the rest
    is merged (see :class:`~.tokenizing.PieceCounter`).  There is no shuffle.
    """
    common.small_batches(docs.sparkSession)
    path = tokenizer_path(tokenizer)
    model = path.endswith(".model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counter(path).count if model else lambda t, e=json_encoder(path): len(e.encode(t)) // 4
        for batch in batches:
            n = pa.array([count(t) for t in batch["text"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], n], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    counted = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.read_table(spark, sf_dir, "documents"))
