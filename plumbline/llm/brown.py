"""Operator 13: scores of a class-based bigram model (Brown et al. 1992) with classes by exchange.

1. Tokens of the training texts are counted: words, and one end for each text, which is also what stands before its
   first word.
2. *Units* are the end, each word with more than ``SHARE`` of all tokens (and ``MIN_COUNT`` occurrences), and ``FORMS`` forms
   of all other words, known or not, by their last bytes.  So there are at most 1 / ``SHARE`` words among them.
3. Pairs of neighbouring units of all training texts are counted; this table is as large as the corpus makes it.
4. Exchange: each unit goes to the class that raises the likelihood of the class bigrams most.  A round works out, for
   each unit of a part of them, the exact change that a move to each class would make with all others staying where
   they are, from the unit's own counts by class.  Units of a part move at once; a round that lowers the likelihood is taken
   back, and fewer move at once from then on.
5. The model: P(word | before) = P(class | class before) * P(unit | class), and for words that aren't units themselves
   * P(word | form).  Transitions are smoothed by Witten-Bell with the classes' shares, the others by adding a constant;
   each form keeps one more type for words never met, so the probabilities of all words add up to one.
6. Texts are scored in one pass; only the words that aren't units are looked up by a join.

The driver holds counts of classes (``CLASSES`` squared) and of units, nothing else of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import common
from .bytewords import WHITE, Words, as_array, as_bytes, closed, crc32, slices, words

CLASSES, FORMS, ROUNDS = 64, 256, 8
SHARE, MIN_COUNT = 1e-6, 3
#: Pairs, about, that a task adds up before it gives them on.
PAIRS = 2_000_000
#: Rows of neighbours, about, that a task turns into lists at once.
CONTEXT_ROWS = 500_000
#: What is added to each count of a word.
ADDED = 0.1
#: The end of a text among the words; no word holds it.
END = "\n"


def learned_from(doc_id: Column, folds: int = 10) -> Column:
    """Whether a row is for training: the CRC-32 of its id as text isn't divisible by ``folds``, or it has no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != 0, F.lit(True))


def forms(strings: pa.Array, n: int = FORMS) -> np.ndarray:
    """The form of each word, by its last three bytes."""
    data, start, end = as_bytes(strings)
    return (crc32(data, np.maximum(start, end - 3), end) % np.uint32(n)).astype(np.int64)


def _with_ends(w: Words, codes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all rows with their ends, and the row of each."""
    size = w.counts() + 1
    out, word = np.empty(size.sum(), np.int64), np.ones(size.sum(), bool)
    at = np.cumsum(size) - 1
    word[at] = False
    out[word], out[at] = codes, end
    return out, np.repeat(np.arange(w.rows), size)


def token_counts(texts: DataFrame, n_forms: int = FORMS) -> DataFrame:
    """(word, form, n) of the tokens of closed ``texts(text)``, ends among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                coded = as_array(words(part["text"], WHITE), kind=pa.string()).dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(forms(coded.dictionary, n_forms), pa.int32()), pa.array(n, pa.int64())], ["word", "form", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([-1], pa.int32()), pa.array([len(part)], pa.int64())], ["word", "form", "n"])

    return texts.mapInArrow(run, "word string, form int, n long").groupBy("word", "form").agg(F.sum("n").alias("n"))


@dataclass
class Units:
    """Unit 0 is the end, then the words of ``listed``, the commonest first, then the forms.  ``n`` counts each; ``types`` has how
    many known words each form stands for.  ``total`` tokens and ``known`` distinct ones were counted."""

    listed: pa.Array
    n: np.ndarray
    types: np.ndarray
    total: int
    known: int

    def of(self, strings: pa.Array) -> np.ndarray:
        """The unit of each word."""
        place = pc.index_in(strings, value_set=self.listed).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        first = 1 + len(self.listed)
        place[new] = first - 1 + forms(strings.take(pa.array(new)), len(self.types))
        return place + 1

    @property
    def first_form(self) -> int:
        return 1 + len(self.listed)


def choose_units(counts: DataFrame, share: float = SHARE, min_count: int = MIN_COUNT, n_forms: int = FORMS) -> tuple[Units, DataFrame]:
    """The units of ``counts(word, form, n)``, and (word, n) of the words that are none."""
    all_ = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = (F.col("n") > share * all_[0]) & (F.col("n") >= min_count)
    words_ = counts.where(F.col("word") != END)
    # at most 1 / share rows, whose words are together at most that many times as long as the corpus' mean word
    table = words_.where(frequent).select("word", "n").orderBy(F.desc("n"), "word").toArrow()
    rest = words_.where(~frequent)
    n, types = np.zeros(n_forms, np.int64), np.zeros(n_forms, np.int64)
    for r in rest.groupBy("form").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        n[r["form"]], types[r["form"]] = r["n"], r["types"]
    ends = counts.where(F.col("word") == END).first()
    listed = table["word"].combine_chunks() if len(table) else pa.array([], pa.string())
    return Units(listed, np.r_[ends["n"] if ends else 0, table["n"].to_numpy(), n].astype(np.int64), types, all_[0], all_[1]), rest.select("word", "n")


def unit_pairs(texts: DataFrame, units: Units) -> DataFrame:
    """(a, b, n): how often unit ``b`` follows unit ``a`` in closed ``texts(text)``."""
    bc = texts.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = bc.value
        several = np.int64(len(units.n))
        held: list[np.ndarray] = []

        def added() -> pa.RecordBatch:
            ids, met = pd.factorize(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(met // several, pa.int32()), pa.array(met % several, pa.int32()), pa.array(np.bincount(ids, minlength=len(met)), pa.int64())], ["a", "b", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part["text"], WHITE)
                coded = as_array(w, kind=pa.string()).dictionary_encode()
                token, _ = _with_ends(w, units.of(coded.dictionary)[coded.indices.to_numpy()], 0)
                held.append(np.r_[0, token[:-1]] * several + token)
                if sum(map(len, held)) >= PAIRS:
                    yield added()
                    held = []
        if held:
            yield added()
        common.release_memory()

    return texts.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(pairs: np.ndarray) -> float:
    """The part of the log likelihood of class bigrams that depends on the classes."""
    return float(_phi(pairs).sum() - _phi(pairs.sum(axis=0)).sum() - _phi(pairs.sum(axis=1)).sum())


def move_gains(pairs: np.ndarray, a: int, after: np.ndarray, before: np.ndarray, self_: float) -> np.ndarray:
    """What moving one unit from class ``a`` to each class adds to :func:`likelihood`.  ``after`` and ``before`` count the classes
    behind and before the unit, ``self_`` how often it follows itself."""
    m, r, s = pairs.copy(), after.copy(), before.copy()
    m[a] -= r
    m[:, a] -= s
    m[a, a] += self_
    r[a] -= self_
    s[a] -= self_
    to, of = np.flatnonzero(r), np.flatnonzero(s)
    gain = (_phi(m[:, to] + r[to]) - _phi(m[:, to])).sum(axis=1) + (_phi(m[of] + s[of, None]) - _phi(m[of])).sum(axis=0)
    d = np.diagonal(m)
    # a class' own cell takes both sides at once
    gain += _phi(d + r + s + self_) + _phi(d) - _phi(d + r) - _phi(d + s)
    n = after.sum()
    for axis in (1, 0):
        margin = pairs.sum(axis=axis)
        margin[a] -= n
        gain -= _phi(margin + n) - _phi(margin)
    return gain - gain[a]


def contexts(pairs: DataFrame) -> DataFrame:
    """(unit, self, n_after, other, n), one row for each unit of ``pairs(a, b, n)``: the units behind it, ``n_after`` of them, and then those
    before it, with how often each comes, and how often it follows itself.  A row has at most twice as many entries as there
    are units."""
    both = F.array(
        F.struct(F.col("a").alias("unit"), F.lit(0).alias("side"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("unit"), F.lit(1).alias("side"), F.col("a").alias("other")),
    )
    rows = pairs.select(F.explode(both).alias("x"), "n").select("x.*", "n").repartition("unit").sortWithinPartitions("unit", "side")

    def whole(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        unit, side, other, n = (t[c].to_numpy() for c in ("unit", "side", "other", "n"))
        starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        offsets = pa.array(np.r_[starts, len(unit)], pa.int32())
        total = lambda x: pa.array(np.add.reduceat(x, starts).astype(np.int64))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(other, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array(unit[starts], pa.int32()), total(np.where((side == 0) & (other == unit), n, 0)), total(side == 0), *lists], ["unit", "self", "n_after", "other", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            unit = batch["unit"].to_numpy()
            new = np.flatnonzero(np.r_[bool(held) and unit[0] != held[-1]["unit"][-1].as_py(), unit[1:] != unit[:-1]])
            if sum(map(len, held)) >= CONTEXT_ROWS and len(new):
                cut = int(new[-1])
                yield whole([*held, batch.slice(0, cut)])
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield whole(held)
        common.release_memory()

    return rows.mapInArrow(run, "unit int, self long, n_after long, other array<int>, n array<long>")


def class_vectors(batch: pa.RecordBatch, classes: np.ndarray, k: int) -> np.ndarray:
    """For each unit of a batch of :func:`contexts` its neighbours by class: ``k`` counts behind it, then ``k`` before it."""
    other, n = (batch[c].flatten().to_numpy() for c in ("other", "n"))
    size, after = batch["other"].value_lengths().to_numpy(), batch["n_after"].to_numpy()
    row = np.repeat(np.arange(len(batch)), size)
    before = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) >= after[row]
    return np.bincount((row * 2 + before) * k + classes[other], weights=n, minlength=2 * k * len(batch)).reshape(len(batch), 2 * k)


def class_pairs(context: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """How often each class follows each; every task adds up its own, and at most ``k`` squared rows are collected."""
    bc = context.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, total = bc.value, np.zeros((k, k))
        for batch in batches:
            np.add.at(total, classes[batch["unit"].to_numpy()], class_vectors(batch, classes, k)[:, :k])
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b].astype(np.int64))], ["a", "b", "n"])

    table = np.zeros((k, k), np.int64)
    for r in context.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        table[r["a"], r["b"]] = r["n"]
    return table


def better_classes(context: DataFrame, pairs: np.ndarray, classes: np.ndarray) -> pd.DataFrame:
    """(unit, class) of the units of ``context`` that have a better class than their own, with all others where they are."""
    bc = context.sparkSession.sparkContext.broadcast((pairs.astype(float), classes))
    k = len(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, classes = bc.value
        for batch in batches:
            x, self_, out = class_vectors(batch, classes, k), batch["self"].to_numpy(), []
            for i, unit in enumerate(batch["unit"].to_pylist()):
                gain = move_gains(pairs, int(classes[unit]), x[i, :k], x[i, k:], float(self_[i]))
                best = int(np.argmax(gain))
                if gain[best] > 1e-6:
                    out.append((unit, best))
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int32()), pa.array([c for _, c in out], pa.int32())], ["unit", "class"])

    return context.mapInArrow(run, "unit int, class int").toPandas()


def exchange(context: DataFrame, n: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The class of each unit, the counts of class pairs, and the likelihood of each round that was kept, from a written table of
    :func:`contexts`.

    At first the most frequent units have a class each, but for the last class, which has all others.
    """
    now = np.full(len(n), classes - 1, np.int64)
    first = np.argsort(-n, kind="stable")[: classes - 1]
    now[first] = np.arange(len(first))
    kept, history, parts, still = None, [], 2, 0
    for turn in range(rounds + 1):
        table = class_pairs(context, now, classes)
        value = likelihood(table.astype(float))
        if kept is None or value > kept[0]:
            still = still + 1 if kept is not None and value - kept[0] < 1e-4 * abs(value) else 0
            kept = (value, now, table)
            history.append(value)
            if still == parts:  # every part has had its turn and gained little
                break
        else:
            parts *= 2
        if turn == rounds:
            break
        _, now, table = kept
        mine = context.where(F.pmod(F.xxhash64("unit"), F.lit(parts)) == turn % parts)
        moved = better_classes(mine, table, now)
        now = now.copy()
        now[moved["unit"].to_numpy()] = moved["class"].to_numpy()
    return kept[1], kept[2], history


@dataclass
class Model:
    """``transition[i, j]`` is log10 P(class j | class i), ``emission`` log10 P(unit | its class), and ``spread`` what each form
    divides the counts of its words by.  ``rest`` has the counts of the words that are no units."""

    units: Units
    classes: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    spread: np.ndarray
    rest: DataFrame
    history: list[float]


def smoothed(units: Units, classes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions, emissions and spreads of a model; see the module's text."""
    k = len(table)
    after, n = table.sum(axis=1), np.bincount(classes, weights=units.n, minlength=k)
    share = (n + 0.5) / (n.sum() + 0.5 * k)
    met = np.maximum(1, (table > 0).sum(axis=1))
    transition = np.log10((table + met[:, None] * share) / (after + met)[:, None])
    members = np.bincount(classes, minlength=k)
    emission = np.log10((units.n + ADDED) / (n + ADDED * members)[classes])
    spread = np.log10(units.n[units.first_form :] + ADDED * (units.types + 1))
    return transition, emission, spread


def train(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS, share: float = SHARE, min_count: int = MIN_COUNT, n_forms: int = FORMS) -> Model:
    """The model of all of ``docs(text)``.  Without any text every class is as likely as any other."""
    common.small_batches(docs.sparkSession)
    texts = docs.select(closed(F.col("text")).alias("text"))
    counts = common.materialize(token_counts(texts, n_forms), "tokens")
    units, rest = choose_units(counts, share, min_count, n_forms)
    made: list[str] = []
    pairs = common.materialize(unit_pairs(texts, units), "pairs", made)
    with common.wide_batches(docs.sparkSession):
        context = common.materialize(contexts(pairs), "context", made)
    common.drop_path(docs.sparkSession, made[0])
    of, table, history = exchange(context, units.n, classes, rounds)
    common.drop_path(docs.sparkSession, made[1])
    return Model(units, of, *smoothed(units, of, table), common.materialize(rest, "rest"), history)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` in place of ``text``, one row for
    each row; other columns are kept.

    ``score`` is the log10 probability of the text by the model, and ``base_score`` that by counts of single tokens.
    Null and empty texts are an end alone.  Perplexity is 10 ** (-score / n_tokens).
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    u = model.units
    base = u.total + ADDED * (u.known + 1)
    bc = spark.sparkContext.broadcast((u, model.classes, model.transition, model.emission, model.spread))
    rest = [f for f in docs.schema.fields if f.name != "text"]
    names = common.spare(docs.drop("text"), "n_tokens", "n_known", "base_score", "score", "rest", "row", "more_known", "more", "train_tokens")
    n_tokens, n_known, base_score, score_, words_, row, more_known, more, train_tokens = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, classes, transition, emission, spread = bc.value
        first = units.first_form
        single = np.log10((units.n + ADDED) / base)
        # of words that are no units only the count is missing, which the join adds
        single[first:] = -np.log10(base)
        own = emission.copy()
        own[first:] -= spread
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part["text"], WHITE)
                coded = as_array(w, kind=pa.string()).dictionary_encode()
                of = units.of(coded.dictionary)[coded.indices.to_numpy()]
                token, at = _with_ends(w, of, 0)
                c = classes[token]
                s = transition[np.r_[classes[0], c[:-1]], c] + own[token]
                known = (token < first) & (units.n[token] > 0)
                add = lambda x: np.bincount(at, weights=x, minlength=w.rows)  # noqa: B023, E731
                odd = np.flatnonzero(of >= first)
                offsets = np.r_[0, np.cumsum(np.bincount(w.row[odd], minlength=w.rows))]
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), coded.dictionary.take(coded.indices.take(pa.array(odd))))
                columns = [pa.array(w.counts() + 1, pa.int64()), pa.array(add(known).astype(np.int64)), pa.array(add(single[token])), pa.array(add(s)), listed]
                yield pa.RecordBatch.from_arrays([*[part[f.name] for f in rest], *columns], [f.name for f in rest] + names[:5])

    schema = docs.select(*[f"`{f.name}`" for f in rest]).schema
    for name, kind in zip(names[:5], ("long", "long", "double", "double", ArrayType(StringType())), strict=True):
        schema = schema.add(name, kind)
    texts = docs.select(*[f"`{f.name}`" for f in rest], closed(F.col("text")).alias("text"))
    scored = common.materialize(texts.mapInArrow(run, schema).withColumn(row, F.monotonically_increasing_id()), "scored")
    looked = scored.select(row, F.explode(words_).alias("word")).join(model.rest, "word", "left")
    found = looked.groupBy(row).agg(F.count("n").alias(more_known), F.sum(F.log10(F.coalesce("n", F.lit(0)) + ADDED)).alias(more))
    out = scored.join(found, row, "left")
    plus = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return out.select(*[f"`{f.name}`" for f in rest], n_tokens, plus(n_known, more_known), F.lit(u.total).cast("long").alias(train_tokens), plus(base_score, more), plus(score_, more))


def op13_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(learned_from(F.col("doc_id"))))
    scored = score(docs.select("doc_id", (~learned_from(F.col("doc_id"))).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
