"""Operator 5: a quality classifier learned from positives and unlabelled text.

A linear model over form features is trained by minimising the non-negative unbiased risk

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

with the logistic loss: ``R_P`` over trusted positives, ``R_U`` over a sample of the corpus,
labelled or not.  Labels of poor quality are never looked at.  The class prior is estimated
from the data: for the scores of a first model, it is the least ratio, over all thresholds, of
the share of unlabelled to the share of positive documents below it, with room for chance
(poor documents can only add to the unlabelled share, so the ratio is lowest where there are
none).  Scoring reads every whole text.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Most rows that a model is trained on, of positives and of unlabelled documents each.
SAMPLE_ROWS = 20_000
SHAPES = 256
_FORM = 13
_KEPT = 500_000
#: Characters worked on at once.
_CHARS = 1 << 20

_shapes: dict[str, int] = {}


@lru_cache(maxsize=1)
def _upper() -> np.ndarray:
    """Whether each character is a capital."""
    return np.fromiter((chr(c).isupper() for c in range(0x110000)), bool, 0x110000)


def _capitals(text: str) -> int:
    """Capitals of any script in a whole text."""
    parts = (text[at : at + _CHARS].encode("utf-32-le", "surrogatepass") for at in range(0, len(text), _CHARS))
    return sum(int(np.count_nonzero(_upper()[np.frombuffer(x, "<u4")])) for x in parts)


def _shape(word: str) -> int:
    """Bucket of the form of a word: its runs of capitals, small letters, digits and marks."""
    form = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return zlib.crc32(re.sub(r"(.)\1+", r"\1", form, flags=re.S).encode("utf-8", "surrogatepass")) % SHAPES


def features(text: str) -> np.ndarray:
    """Features of a whole text; all zero for one without words."""
    out = np.zeros(_FORM + SHAPES, np.float32)
    words = text.split()
    if not words:
        return out
    if len(_shapes) > _KEPT:
        _shapes.clear()
    counts = Counter(words)
    for w in counts:
        if w not in _shapes:
            _shapes[w] = _shape(w)
    n = len(words)
    np.add.at(out, np.fromiter((_shapes[w] for w in counts), np.int64, len(counts)) + _FORM, np.fromiter(counts.values(), np.float32, len(counts)))
    out[_FORM:] = np.sqrt(out[_FORM:] / n)
    lines = [x for x in text.split("\n") if x.strip()]
    chars = sum(map(len, words))
    upper = _capitals(text)
    letters = len(re.findall(r"[^\W\d_]", text))
    digits = len(re.findall(r"\d", text))
    out[:_FORM] = (
        np.log1p(n) / 10,
        chars / n / 10,
        len(counts) / n,
        max(counts.values()) / n,
        np.log1p(len(lines)) / 5,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))) / 5,
        sum(v for w, v in counts.items() if len(w) <= 3) / n,
        upper / max(1, chars),
        letters / max(1, chars),
        digits / max(1, chars),
        max(map(len, lines)) / max(1, len(text)),
        sum(map(operator.eq, words, words[1:])) / n,
    )
    return out


def feature_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` replaced by ``x``, the features of the text (null: empty) as 32-bit
    floats."""
    common.small_batches(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["x binary"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [features(t or "").tobytes() for t in batch["text"]]
            yield batch.drop(columns="text").assign(x=x)

    return docs.mapInPandas(run, schema)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 400, rate: float = 0.03, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam over all rows."""
    d = p.shape[1]
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    back = lambda x, r: np.r_[r.astype(np.float32) @ x, r.sum()] / len(x)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        f = w.astype(np.float32)
        zp, zu = (p @ f[:-1] + f[-1]).astype(np.float64), (u @ f[:-1] + f[-1]).astype(np.float64)
        # logistic loss as a positive: log(1 + exp(-z)); as a negative: log(1 + exp(z))
        good = -prior * back(p, sigmoid(-zp))
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        bad = back(u, sigmoid(zu)) - prior * back(p, sigmoid(zp))
        # below zero the negative part has been over-fitted: step back along it alone
        g = good + bad if rest >= 0 else -bad
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores of rows not trained on.  The share
    of unlabelled rows in the upper part of the scores, against that of positives."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.95, 96)))
    fp = np.array([(positive >= c).mean() for c in cuts])
    fu = np.array([(unlabelled >= c).mean() for c in cuts])
    room = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = int(np.argmin((fu + room) / fp))
    return float(np.clip(fu[best] / fp[best], 0.05, 0.99))


def train(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Model from feature rows of positives and unlabelled documents; with no rows of either it
    scores everything at the prior of one half."""
    d = _FORM + SHAPES
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 0.5)
    mean, scale = unlabelled.mean(axis=0, dtype=np.float64), np.maximum(unlabelled.std(axis=0, dtype=np.float64), 0.02)
    p, u = (((x - mean.astype(np.float32)) / scale.astype(np.float32)) for x in (positive, unlabelled))
    # prior: a first model on one half, its scores on the other
    a, b = np.arange(len(p)) % 2 == 0, np.arange(len(u)) % 2 == 0
    w, c = _fit(p[a], u[b], 0.5, steps=150)
    prior = estimate_prior(p[~a] @ w + c, u[~b] @ w + c) if (~a).any() and (~b).any() else 0.5
    w, c = _fit(p, u, prior)
    return Model(mean, scale, w, c, prior)


def fold(c: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(c.cast("string").cast("binary")) % 5


def train_on(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``rows`` positives (``quality`` 1) and ``rows`` documents of any kind:
    those least by a hash of their id.  Only features reach the driver, for that many rows.  Rows without
    a doc_id are not learned from; rows that repeat id and text count once."""
    good = labels.where("quality = 1").select("doc_id").distinct()
    pick = lambda d: d.orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(rows)
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("h"))
    ids = docs.select("doc_id", "h").distinct()
    chosen = pick(ids.join(good, "doc_id", "left_semi")).withColumn("positive", F.lit(True)).union(pick(ids).withColumn("positive", F.lit(False)))
    # at most 2 * rows keys, each of one text: a proven bound
    sample = docs.join(F.broadcast(common.materialize(chosen, "sample")), ["doc_id", "h"]).groupBy("doc_id", "h", "positive").agg(F.first("text").alias("text"))
    got = feature_rows(sample).toPandas().sort_values(["doc_id", "h", "positive"])
    positive = got["positive"].to_numpy(bool)
    rows_of = lambda mask: np.frombuffer(b"".join(got["x"][mask]), np.float32).reshape(-1, _FORM + SHAPES)
    return train(rows_of(positive), rows_of(~positive))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``text`` replaced by ``score``.  Null and empty texts get that of no words.  Each row
    is scored for itself; null and repeated ids and other columns are passed on, but a column ``score``
    of ``docs`` gives way."""
    common.small_batches(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name not in ("text", "score")]
    docs = docs.select(*[f"`{f.name}`" for f in keep], "text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t or "") for t in batch["text"].to_pylist()], np.float64).reshape(batch.num_rows, _FORM + SHAPES)
            yield pa.RecordBatch.from_arrays([batch[f.name] for f in keep] + [pa.array(model.score(x))], [f.name for f in keep] + ["score"])

    return docs.mapInArrow(run, schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = common.read_table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    learn = fold(F.col("doc_id")) != 0
    model = train_on(docs.where(learn), labels.where(learn))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
