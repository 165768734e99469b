"""Operator 3: language identification by Bayesian evidence fusion.

For each document four pieces of evidence are multiplied:

* the text: likelihood of its letters under a character n-gram model of each language and of
  a *background* that holds every n-gram alike, tempered as neighbouring n-grams repeat
  each other's evidence, and growing with every word;
* the declared language (of the markup or of the table), by how often each language is declared
  so where the text is clear, counted over all documents;
* the host, by a prior smoothed towards the prior of its address suffix, and that towards the
  prior of the corpus; all three are counts by grouped aggregation over all documents.

A document is rejected (language ``und``) if it has no letters, or if no language reaches
``min_posterior`` or the background is likelier than all languages.  Where no row declares a
language there is no model: every language is ``und``, and nothing is rejected (``accepted`` is null).

A language has a model if more than ``LANGUAGE_SHARE`` of all rows that declare one declare it, and ``LANGUAGE_ROWS`` or more, so
at most 1 / ``LANGUAGE_SHARE`` languages have one, whatever strings are declared.  A document that declares any other is
never rejected for its text: it has the language that the model accepts, else ``und`` with ``accepted`` null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Documents of each declared language that its n-gram model is counted on, about: by a hash.
TRAIN_ROWS = 20_000
#: Share of the rows with a declaration, and rows, that a language needs for a model.
LANGUAGE_SHARE, LANGUAGE_ROWS = 1e-3, 3
#: Buckets of hashed n-grams.
BUCKETS = 1 << 14
#: Pseudo-counts: of an n-gram bucket, of the suffix in a host, of the corpus in a suffix.
SMOOTH, HOST_WEIGHT, SUFFIX_WEIGHT = 0.5, 20.0, 50.0
#: Share of a word's log-likelihood that counts as evidence.
TEMPER = 0.5
#: Characters worked on at once.
_CHARS = 1 << 20


@lru_cache(maxsize=1)
def _alphabetic() -> np.ndarray:
    """Whether each character is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str) -> tuple[np.ndarray, int]:
    """(counts of the n-grams by bucket, words) of a whole text.

    For each letter, lower-cased: itself, with the character before it, and with those on both
    sides; anything but a letter is a blank.
    """
    counts, words, text = np.zeros(BUCKETS, np.int64), 0, text.lower()
    for at in range(0, len(text), _CHARS):
        # one character more on either side; a word across the cut counts once
        x = np.frombuffer(text[max(0, at - 1) : at + _CHARS + 1].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _alphabetic()[x]
        c = np.zeros(len(x) + 2, np.uint64)
        c[1:-1] = np.where(letter, x, 0)
        i = np.flatnonzero(letter) + 1
        i = i[(i > (at > 0)) & (i <= min(_CHARS, len(text) - at) + (at > 0))]
        a, b, d = c[i - 1], c[i], c[i + 1]
        two = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
        three = two + d * np.uint64(0x165667B19E3779F9) + np.uint64(1)
        h = np.concatenate([b * np.uint64(0xD6E8FEB86659FD93), two, three])
        h = ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 14)
        counts += np.bincount(h.astype(np.int64), minlength=BUCKETS)
        words += int((a == 0).sum())
    return counts, words


@dataclass(frozen=True)
class TextModel:
    """``table`` has for each bucket the log-probability under each language, then under the
    background."""

    languages: tuple[str, ...]
    table: np.ndarray

    def score(self, text: str) -> tuple[np.ndarray, int]:
        """(tempered log-likelihoods, words) of a text."""
        counts, n = ngram_counts(text)
        mean = counts @ self.table / max(1, counts.sum())
        return mean * TEMPER * n, n


def train_text_model(docs: DataFrame, rows: int = TRAIN_ROWS) -> TextModel:
    """Count n-grams of ``docs(id, text, declared)`` for every language that is declared often enough, on all its
    documents or about ``rows`` of them.  What reaches the driver is bounded by buckets times
    languages, of which there are at most 1 / ``LANGUAGE_SHARE``."""
    spark = docs.sparkSession
    common.small_batches(spark)
    known = docs.where("declared IS NOT NULL AND declared <> '' AND text IS NOT NULL").select("id", "declared", "text")
    declared = common.materialize(known.groupBy("declared").agg(F.count("*").alias("n")), "declared")
    least = max(LANGUAGE_ROWS, int(LANGUAGE_SHARE * (declared.agg(F.sum("n")).first()[0] or 0)) + 1)
    sizes = sorted(tuple(r) for r in declared.where(F.col("n") >= least).collect())
    names = tuple(name for name, _ in sizes)
    of = spark.createDataFrame([(name, i, n) for i, (name, n) in enumerate(sizes)], "declared string, language int, size long")
    # a hash in [0, 1) under the share asked for; a language of at most that many rows is whole
    chance = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = known.join(F.broadcast(of), "declared").where(chance * F.col("size") < rows).select("language", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch["language"], batch["text"]):
                total.setdefault(name, np.zeros(BUCKETS, np.int64))
                total[name] += ngram_counts(text)[0]
        for name, row in total.items():
            at = np.flatnonzero(row)
            yield pd.DataFrame({"language": name, "bucket": at, "n": row[at]})
        common.release_memory()

    got = sample.mapInPandas(run, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((BUCKETS, len(names) + 1), SMOOTH)
    np.add.at(table, (got["bucket"].to_numpy(np.int64), got["language"].to_numpy(np.int64)), got["n"].to_numpy(np.float64))
    return TextModel(names, np.log(table / table.sum(axis=0)))


def text_evidence(docs: DataFrame, model: TextModel) -> DataFrame:
    """``docs`` with ``text`` replaced by ``loglik array<double>`` and ``n_words long``."""
    keep = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["loglik array<double>", "n_words long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.score(t or "") for t in batch["text"].to_pylist()]
            new = [pa.array([x for x, _ in got], pa.list_(pa.float64())), pa.array([n for _, n in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch[f.name] for f in keep] + new, [f.name for f in keep] + ["loglik", "n_words"])
        common.release_memory()

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, model: TextModel, min_posterior: float = 0.5) -> DataFrame:
    """(id, language, posterior, n_words, accepted) of each row of
    ``docs(id, text, declared, host, suffix)``.

    Null and empty declarations, hosts and suffixes are no evidence.  Rows are independent:
    repeated and null ids give a result each, and an id of any type is passed on as it is.
    Columns of other names take no part.
    """
    names, k = model.languages, len(model.languages)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select("id", "text", blank("declared").alias("declared"), blank("host").alias("host"), blank("suffix").alias("suffix"))
    e = common.materialize(text_evidence(rows, model), "evidence")
    if not k:
        return e.select("id", F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), "n_words", F.lit(None).cast("boolean").alias("accepted"))
    # the language of the text alone, where it has words and isn't background
    best = F.array_position("loglik", F.array_max("loglik")).cast("int") - 1
    clear = e.where("n_words > 0").withColumn("best", best).where(F.col("best") < k)
    tally = lambda *by: clear.groupBy(*by, "best").agg(F.count("*").cast("double").alias("n"))

    corpus = np.ones(k)
    for r in tally().collect():
        corpus[r.best] += r.n
    corpus /= corpus.sum()
    # how each language is declared: what is never met has one value for each language, the rest is sparse
    spark, said, sums = e.sparkSession, {name: {} for name in names}, np.full(k, 0.5 * k)
    modelled = spark.createDataFrame([(name,) for name in names], "declared string")
    for r in tally("declared").join(F.broadcast(modelled), "declared").collect():
        said[r.declared][r.best] = r.n
        sums[r.best] += r.n
    unsaid = F.array(*[F.lit(float(x)) for x in np.log(0.5 / sums)])
    rows = [(name, {i: float(np.log((n + 0.5) / sums[i])) for i, n in met.items()}) for name, met in said.items()]
    e = e.join(F.broadcast(spark.createDataFrame(rows, "declared string, say map<int, double>")), "declared", "left")

    for c in ("suffix", "host"):
        seen = common.materialize(tally(c).where(F.col(c) != ""), c)
        rows = seen.groupBy(c).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias(f"{c}_n"), F.sum("n").alias(f"{c}_all"))
        e = e.join(F.broadcast(rows) if common.size_in_bytes(seen) <= common.BROADCAST_BYTES else rows.hint("merge"), c, "left")
    prior = F.array(*[F.lit(float(p)) for p in corpus])
    or_0 = lambda c: F.coalesce(c, F.lit(0.0))

    def log(i: Column) -> Column:
        by_suffix = (or_0(F.try_element_at("suffix_n", i)) + SUFFIX_WEIGHT * F.get(prior, i)) / (or_0(F.col("suffix_all")) + SUFFIX_WEIGHT)
        by_host = (or_0(F.try_element_at("host_n", i)) + HOST_WEIGHT * by_suffix) / (or_0(F.col("host_all")) + HOST_WEIGHT)
        say = F.when(F.col("say").isNotNull(), F.coalesce(F.try_element_at("say", i), F.get(unsaid, i))).otherwise(0.0)
        return F.get("loglik", i) + F.log(by_host) + say

    # background: as likely as one document in a thousand, and blind to declarations
    logs = F.concat(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), log), F.array(F.get("loglik", F.lit(k)) + F.lit(float(np.log(1e-3)))))
    foreign = (F.col("declared") != "") & F.col("say").isNull()
    e = e.select("id", "n_words", foreign.alias("foreign"), logs.alias("logs"))
    e = e.withColumn("top", F.array_max("logs"))
    mass = F.aggregate(F.transform("logs", lambda v: F.exp(v - F.col("top"))), F.lit(0.0), lambda s, v: s + v)
    e = e.select("id", "n_words", "foreign", (F.array_position("logs", F.col("top")).cast("int") - 1).alias("at"), F.round(1 / mass, 6).alias("posterior"))
    accepted = (F.col("n_words") > 0) & (F.col("at") < k) & (F.col("posterior") >= min_posterior)
    language = F.when(accepted, F.element_at(F.array(*[F.lit(x) for x in names]), F.least(F.col("at") + 1, F.lit(k)))).otherwise("und")
    unsure = F.when(~(F.col("foreign") & (F.col("n_words") > 0)) | accepted, accepted)
    return e.select("id", language.alias("language"), "posterior", "n_words", unsure.alias("accepted"))


def from_documents(docs: DataFrame) -> DataFrame:
    """The evidence of ``documents``: ``lang`` is the declaration, ``source`` the host; they have
    no address, so no suffix."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit("").alias("suffix"))


def from_pages(pages: DataFrame) -> DataFrame:
    """The evidence of raw web pages: markup language, host and address suffix."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;", " ")
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    return pages.select(F.col("page_id").cast("long").alias("id"), text.alias("text"), declared.alias("declared"), host.alias("host"), F.regexp_extract(host, r"(\.[a-z]+)$", 1).alias("suffix"))


def keep_identified(docs: DataFrame, min_posterior: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language is rejected.  Where nothing is declared there is no
    model, and every row stays."""
    parts = ("text", "lang", "source")
    e = from_documents(docs).withColumn("id", common.row_key("id", "text", "declared", "host"))
    model = train_text_model(e)
    if not model.languages:
        return docs
    bad = identify(e, model, min_posterior).where("not accepted").select(F.col("id").alias("key"))
    return common.without_rows(docs, common.materialize(bad, "rejected"), *parts)


def _report(e: DataFrame, key: str) -> DataFrame:
    return identify(e, train_text_model(e)).withColumnRenamed("id", key)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(from_documents(common.read_table(spark, sf_dir, "documents")), "doc_id")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(from_pages(common.read_table(spark, sf_dir, "pages")), "page_id")
