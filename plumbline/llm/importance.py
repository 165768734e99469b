"""Operator 12: importance resampling towards a target distribution.

1. Features of a text are its runs of 1 to ``order`` consecutive words, hashed into ``buckets`` by CRC-32.  Words and
   hashes come from the texts' Arrow buffers at once (:mod:`bytewords`): a lookup table classifies the bytes, words
   begin and end where neighbouring classes differ, and the CRCs of all features advance together, one byte at a time.
2. Features of the documents and of the target texts are counted by bucket.  Each task adds up its own counts, so a table
   of ``buckets`` sums is all that is shuffled and all that reaches the driver, whatever the input's size.
3. A bucket's gain is the log ratio of its two smoothed shares in thousandths, rounded down, and a document's weight
   the sum of the gains of its features.
4. Documents are drawn without replacement by Gumbel top-k: each gets noise from a hash of its id, and the
   highest sums are drawn.  Places come from a sort by ranges, not from one window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bytewords import LETTERS_DIGITS, Words, closed, crc32, slices, words

ORDER, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024


def feature_buckets(w: Words, order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of all runs of n words, for each n from 1 to ``order``; a run is hashed with one space between words."""
    for n in range(1, order + 1):
        last = len(w.row) - n + 1
        if last <= 0:
            return
        whole = np.flatnonzero(w.row[:last] == w.row[n - 1 :])
        yield w.row[whole], (crc32(w.data, w.start[whole], w.end[whole + n - 1]) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the features of ``docs(text)``, one row for each bucket that occurs."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for _, bucket in feature_buckets(words(part["text"], LETTERS_DIGITS), order, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    found = docs.select(closed(F.col("text")).alias("text")).mapInArrow(run, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: floor(1000 ln of its share in ``target`` over its share in ``docs``), shares smoothed
    by one in each bucket.  Two tables of at most ``buckets`` sums reach the driver."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, table in ((s, docs), (t, target)):
        for r in bucket_counts(table, order, buckets).collect():
            counts[r["bucket"]] = r["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``weight`` in place of ``text``, one row for each row; other columns
    are kept."""
    common.small_batches(docs.sparkSession)
    bc = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket
    rest = [f for f in docs.schema.fields if f.name != "text"]
    names = common.spare(docs.drop("text"), "n_words", "n_features", "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = bc.value
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part["text"], LETTERS_DIGITS)
                n, weight = np.zeros(w.rows, np.int64), np.zeros(w.rows, np.int64)
                for row, bucket in feature_buckets(w, order, len(gain)):
                    runs = np.bincount(row, minlength=w.rows)
                    upto = np.r_[0, np.cumsum(gain[bucket])]
                    to = np.cumsum(runs)
                    n, weight = n + runs, weight + upto[to] - upto[to - runs]
                kept = [part[f.name] for f in rest]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(w.counts(), pa.int64()), pa.array(n), pa.array(weight)], [f.name for f in rest] + names)

    schema = docs.select(*[f"`{f.name}`" for f in rest]).schema
    for name in names:
        schema = schema.add(name, "long")
    return docs.select(*[f"`{f.name}`" for f in rest], closed(F.col("text")).alias("text")).mapInArrow(run, schema)


def gumbel_score(weight: Column, doc_id: Column, seed: int = SEED) -> Column:
    """``weight`` plus Gumbel noise in thousandths, from a hash of the id; null without an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, rid, n_words, n_features, weight, score, rank), one row for each row of ``docs(doc_id, text)``.

    Of the N rows with an id and at least ``min_words`` words the floor(``percent`` * N / 100) with the highest scores
    are drawn and have their place as ``rank``; ties go to the smaller id (then to ``rid``, a hash of the text).  Rows that
    repeat an id share its noise.  Null and empty texts have no words; rows without an id have no score and are never
    drawn.  Without target texts all gains are those of an even target.  Other columns take no part.
    """
    key = docs.select(common.row_key().alias("k"), "text").select("k.doc_id", "k.rid", "text")
    weighed = weigh(key, gains(docs, target, order, buckets), order)
    scored = common.materialize(weighed.withColumn("score", gumbel_score(F.col("weight"), F.col("doc_id"), seed)), "scored")
    able = F.col("score").isNotNull() & (F.col("n_words") >= min_words)
    placed, total = common.numbered(scored.where(able), F.desc("score"), "doc_id", "rid")
    rank = F.when(F.col("place") <= percent * total // 100, F.col("place"))
    return placed.withColumn("rank", rank).drop("place").unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def draw_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`resample` draws, with all their columns.  Rows equal in id and text are drawn
    together with the first of them."""
    drawn = resample(docs, target, **options).where("rank IS NOT NULL").select("doc_id", "rid").distinct()
    drawn = common.materialize(drawn.select(F.struct("doc_id", "rid").alias("key")), "drawn")
    (name,) = common.spare(docs, "key")
    return docs.withColumn(name, common.row_key()).join(common.broadcast_if_small(drawn.withColumnRenamed("key", name)), name, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS f FROM benchmark),
o AS (SELECT doc_id, unnest(w) AS f FROM d),
-- the CRC-32 of each distinct word, bit by bit
table_ AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS t FROM range(256) x(i)),
ts AS (SELECT list(t ORDER BY i) AS t FROM table_),
v AS (SELECT f, encode(f) AS x FROM (SELECT f FROM o UNION SELECT f FROM b)),
h AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(x)), lambda i: ('0x' || hex(x[i + 1:i + 1]))::BIGINT)), lambda s, y: xor(ts.t[(xor(s, y) & 255) + 1], s // 256)), 4294967295) % 10000 AS bucket FROM v, ts),
s AS (SELECT bucket, count(*) AS n FROM o JOIN h USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN h USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s)::DOUBLE + 10000) / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0)::DOUBLE + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM o JOIN h USING (f) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT doc_id, len(d.w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
p AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM r WHERE n_features >= 20)
SELECT r.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END::BIGINT AS rank FROM r LEFT JOIN p USING (doc_id)
"""
