"""Operator 11: collocations by pivot partitioning, as in MG-FSM.

1. Words are counted by language.  Those with fewer than ``min_count`` occurrences can be in no frequent phrase.
2. Each occurrence of a frequent word is the *pivot* of one fragment of its piece: the up to ``longest`` - 1 words on either
   side, up to the first word that is infrequent, rarer than the pivot, or (on the left) the same word.  Of every occurrence of a
   phrase the leftmost of its rarest words is one pivot, and only that fragment holds it on both sides: so each
   occurrence is counted once.  Equal fragments of a task are added up before they are shuffled.
3. Fragments meet by pivot.  Within a pivot its phrases are counted from the pivot outwards, and a phrase is tried only where both
   phrases that it extends are frequent.  Only frequent phrases that the pivot owns leave the task.
4. Phrases are scored at each of their cuts, and those that a longer phrase explains are dropped.

The words of a language that are common in it have short fragments of which few differ.  A pivot with more than ``SPLIT``
occurrences is dealt to several tasks by the words beside it; their counts are added up afterwards.

Workers get the words' order as a table, of at most ``LISTED`` words and ``LISTED_BYTES`` bytes.  If more words are frequent, the
table holds the most frequent ones; all others count as rarer than those and are ordered by a hash.  Pivots
are then less rare, but the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bytewords import Words, as_array, as_bytes, byte_classes, closed, crc32, slices, words

MIN_COUNT, LONGEST, TOP, COVER = 30, 4, 2000, 80
LISTED, LISTED_BYTES = 1_000_000, 32 << 20
#: Occurrences of a pivot, about, that one task gets.
SPLIT = 1_000_000
#: Fragments of whole pivots that are mined together.
CHUNK = 100_000

#: Pieces end at marks and line ends; words within them are divided by spaces and tabs.
PIECES = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")
_BLANK = np.iinfo(np.int64).max


def _distinct(w: Words, langs: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """A code for each word, and the words and languages that the codes stand for."""
    coded, lang = as_array(w, kind=pa.string()).dictionary_encode(), langs.dictionary_encode()
    n = max(1, len(lang.dictionary))
    codes, met = pd.factorize(coded.indices.to_numpy().astype(np.int64) * n + lang.indices.to_numpy()[w.row])
    return codes, coded.dictionary.take(pa.array(met // n)), lang.dictionary.take(pa.array(met % n))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of ``docs(lang, text)``, whose texts are closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                codes, word, lang = _distinct(words(part["text"], PIECES), part["lang"])
                yield pa.RecordBatch.from_arrays([lang, word, pa.array(np.bincount(codes, minlength=len(word)))], ["lang", "word", "n"])
        common.release_memory()

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _listed(frequent: DataFrame, most: int, most_bytes: int) -> tuple[pa.Table, int]:
    """The most frequent of ``frequent(lang, word, n)``, the commonest first, within both bounds; and a count that no other
    reaches (0: there are no others)."""
    doublings = F.length(F.bin("n")) - 1
    size = F.octet_length("word") + F.octet_length("lang") + 32
    by = sorted((tuple(r) for r in frequent.groupBy(doublings.alias("d")).agg(F.count("*"), F.sum(size)).collect()), reverse=True)
    least, rows, used = 64, 0, 0
    for d, n, b in by:
        if rows + n > most or used + b > most_bytes:
            break
        least, rows, used = d, rows + n, used + b
    table = frequent.where(doublings >= least).orderBy(F.desc("n"), "lang", "word").toArrow()
    return table, 0 if rows == sum(n for _, n, _ in by) else 1 << least


def fragments(docs: DataFrame, table: pa.Table, others: int, longest: int, split: int) -> DataFrame:
    """(k, salt, lang, fragment, at, n, part): fragments by pivot ``k``, with the pivot's place ``at`` and how often they came;
    ``part`` if the pivot is dealt to several tasks.  A space stands behind each word."""
    keys = pc.binary_join_element_wise(table["word"].combine_chunks(), table["lang"].combine_chunks(), " ") if len(table) else pa.array([], pa.string())
    bc = docs.sparkSession.sparkContext.broadcast((keys, table["n"].to_numpy()))  # bounded by _listed
    side = longest - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = bc.value
        shares = -(-counts // split)
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part["text"], PIECES)
                if not len(w.row):
                    continue
                codes, word, lang = _distinct(w, part["lang"])
                found = pc.index_in(pc.binary_join_element_wise(word, lang, " "), value_set=keys)
                order = found.fill_null(-1).to_numpy().astype(np.int64)
                share = shares[order] if len(shares) else np.zeros(len(order), np.int64)
                new = np.flatnonzero(order < 0)
                if others:
                    each = as_bytes(word.take(pa.array(new)))
                    order[new] = len(counts) + crc32(*each).astype(np.int64)
                    share[new] = -(-others // split)
                else:
                    order[new] = _BLANK
                rank, s, n = order[codes], share[codes], len(codes)
                left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for j in range(1, min(side, n - 1) + 1):
                    same = w.piece[j:] == w.piece[:-j]
                    left[j:] += (left[j:] == j - 1) & same & (rank[:-j] < rank[j:])
                    right[:-j] += (right[:-j] == j - 1) & same & (rank[j:] <= rank[:-j])
                at = np.flatnonzero((rank < _BLANK) & (left + right > 0))
                left, right = left[at], right[at]
                text = as_array(w, w.start[at - left], w.end[at + right] + 1, pa.string()).dictionary_encode()
                row = w.row[at]
                tongue = part["lang"].dictionary_encode()
                several, which = np.int64(max(1, len(tongue.dictionary))), tongue.indices.to_numpy()[row].astype(np.int64)
                ids, met = pd.factorize((text.indices.to_numpy().astype(np.int64) * longest + left) * several + which)
                count = np.bincount(ids, minlength=len(met))
                first = np.empty(len(met), np.int64)
                first[ids[::-1]] = np.arange(len(ids))[::-1]
                text_of = text.dictionary.take(pa.array(met // several // longest))
                pivot, parts = at[first], s[at[first]]
                salt = crc32(*as_bytes(text_of)).astype(np.int64) % np.maximum(1, parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rank[pivot]), pa.array(salt), tongue.dictionary.take(pa.array(met % several)), text_of, pa.array(left[first], pa.int32()), pa.array(count, pa.int64()), pa.array(parts > 1)],
                    ["k", "salt", "lang", "fragment", "at", "n", "part"],
                )
        common.release_memory()

    return docs.mapInArrow(run, "k long, salt long, lang string, fragment string, at int, n long, part boolean")


def mine_chunk(rows: pa.Table, min_count: int, longest: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, words, n, part): the phrases that the pivots of ``rows`` own, all fragments of a pivot being there;
    the frequent ones, and of pivots that were dealt to several tasks all."""
    rows = rows.combine_chunks()
    text, lang = rows["fragment"].combine_chunks(), rows["lang"].combine_chunks().dictionary_encode()
    w, at, n = words(text, PIECES), rows["at"].to_numpy().astype(np.int64), rows["n"].to_numpy()
    part = rows["part"].to_numpy()
    need = np.where(part, 1, min_count)
    size = w.counts()
    p = np.cumsum(size) - size + at
    right = size - 1 - at
    coded = as_array(w).dictionary_encode()
    code, several = coded.indices.to_numpy().astype(np.int64), np.int64(len(coded.dictionary))
    tongue = lang.indices.to_numpy().astype(np.int64)
    # ids[a, b]: of each fragment its phrase of a words before the pivot and b behind it, -1 if infrequent
    ids = {(0, 0): pd.factorize(code[p] * len(lang.dictionary) + tongue)[0]}
    for m in range(2, longest + 1):
        for a in range(m):
            b = m - 1 - a
            near = ids[a, b - 1] if b else ids[a - 1, 0]
            open_ = (near >= 0) & (at >= a) & (right >= b)
            if a and b:
                open_ &= ids[a - 1, b] >= 0
            at_ = np.flatnonzero(open_)
            which, met = pd.factorize(near[at_] * several + code[p[at_] + b if b else p[at_] - a])
            count = np.bincount(which, weights=n[at_], minlength=len(met)).astype(np.int64)
            first = np.empty(len(met), np.int64)
            first[which[::-1]] = at_[::-1]
            ok = count >= need[first]
            out = np.full(len(at), -1, np.int64)
            out[at_[ok[which]]] = which[ok[which]]
            ids[a, b] = out
            of = first[ok]
            if len(of):
                phrases = as_array(w, w.start[p[of] - a], w.end[p[of] + b], pa.string())
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(tongue[of])), phrases, pa.array(np.full(len(of), m, np.int32)), pa.array(count[ok]), pa.array(part[of])], ["lang", "phrase", "words", "n", "part"])


def mine(dealt: DataFrame, min_count: int, longest: int, chunk: int = CHUNK) -> DataFrame:
    """:func:`mine_chunk` over fragments that are dealt and sorted by pivot and salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in batches:
            if not len(batch):
                continue
            k, salt = batch["k"].to_numpy(), batch["salt"].to_numpy()
            if rows >= chunk:
                new = np.r_[(k[0], salt[0]) != last, (k[1:] != k[:-1]) | (salt[1:] != salt[:-1])]
                if new.any():
                    cut = int(np.flatnonzero(new)[-1])
                    yield from mine_chunk(pa.Table.from_batches([*held, batch.slice(0, cut)]), min_count, longest)
                    held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows, last = rows + len(batch), (k[-1], salt[-1])
        if held:
            yield from mine_chunk(pa.Table.from_batches(held), min_count, longest)
        common.release_memory()

    return dealt.repartition("k", "salt").sortWithinPartitions("k", "salt").mapInArrow(run, "lang string, phrase string, words int, n long, part boolean")


def _with_counts(rows: DataFrame, known: DataFrame, part: str, name: str) -> DataFrame:
    """``rows`` with ``name``: how often the phrase ``part`` of the row's language comes, by ``known(lang, phrase, n)``.  A word
    that begins very many phrases is joined by broadcast."""
    key = F.struct("lang", F.col(part).alias("phrase")).alias("key")
    used = rows.groupBy(key).agg(F.count("*").alias("n"))
    keyed = used.join(known.select(F.struct("lang", "phrase").alias("key"), F.col("n").alias(name)), "key")
    keyed = common.materialize(keyed, "parts")
    return common.join_by_hot_key(rows.withColumn("key", key), keyed, "key").drop("key", "n")


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, listed: int = LISTED, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of 1 to ``longest`` words with ``min_count`` or more occurrences, and (lang, n):
    all words of each language."""
    common.small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), closed(F.col("text")).alias("text"))
    counts = common.materialize(word_counts(texts), "words")
    frequent = common.materialize(counts.where(F.col("n") >= min_count), "frequent")
    table, others = _listed(frequent, listed, LISTED_BYTES)
    mined = common.materialize(mine(fragments(texts, table, others, longest, split), min_count, longest), "mined")
    dealt = mined.where("part").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    single = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "n")
    phrases = single.unionByName(mined.where("not part").drop("part")).unionByName(dealt)
    return common.materialize(phrases, "phrases"), counts.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int | None = TOP, cover: int = COVER, listed: int = LISTED, split: int = SPLIT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of ``docs(lang, text)``: the first ``top`` (None: all) collocations of each
    language by score, count (descending) and phrase.

    Texts are cut into pieces at marks and line ends; a candidate is a phrase of 2 to ``longest`` words of one piece with ``a``
    >= ``min_count`` occurrences.  Its score is the least of floor(2000000 * a / (l + r)) over its cuts, l and r being the
    counts of both parts and ties going to the shortest first part.  A candidate is dropped if it lies in a longer
    one with at least ``cover`` percent of its count.  ``n`` counts all words of the language.  A null language is
    ``und``, null and empty texts have no words, repeated rows count each time, and other columns take no part.
    """
    phrases, totals = frequent_phrases(docs, min_count, longest, listed, split)
    parts = F.split("phrase", " ", -1)
    join = lambda start, n: F.array_join(F.slice(parts, start, n), " ")
    several = phrases.where("words > 1").withColumnRenamed("n", "a")
    cuts = several.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("head"), join(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    cuts, known = common.materialize(cuts, "cuts"), phrases.select("lang", "phrase", "n")
    cuts = _with_counts(_with_counts(cuts, known, "head", "l"), known, "tail", "r")
    exact = F.expr("CAST(a AS decimal(20,0)) * 2000000 DIV (CAST(l AS decimal(20,0)) + r)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact.cast("long").alias("score"), "k", "l", "r")).alias("cut"))

    def inner(words: Column) -> Column:
        of = lambda n: F.transform(F.sequence(F.lit(1), words - n + 1), lambda i: join(i, n))
        return F.flatten(F.transform(F.sequence(F.lit(2), words - 1), of))

    within = several.where("words > 2").select("lang", F.explode(inner(F.col("words"))).alias("phrase"), "a")
    longer = within.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = best.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("most") * 100 < F.col("a") * cover, F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:  # each task keeps its own first rows before any are gathered
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(common.broadcast_if_small(common.materialize(totals, "totals")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.read_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM w, generate_series(1, 4) t(m) WHERE len(w) >= m)),
f AS (SELECT lang, phrase, m, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, m, n AS a, string_split(phrase, ' ') AS x FROM f WHERE m > 1),
k AS (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, u.n AS l, v.n AS r, ((2000000::HUGEINT * k.a) // (u.n + v.n))::BIGINT AS score FROM k
  JOIN f u ON u.lang = k.lang AND u.phrase = array_to_string(x[:k], ' ') JOIN f v ON v.lang = k.lang AND v.phrase = array_to_string(x[k + 1:], ' ')),
b AS (SELECT lang, phrase, a, min({'score': score, 'k': k, 'l': l, 'r': r}) AS c FROM s GROUP BY ALL),
i AS (SELECT lang, array_to_string(x[i:i + q - 1], ' ') AS phrase, a FROM (SELECT *, unnest(generate_series(1, m - q + 1)) AS i FROM c, generate_series(2, 3) y(q) WHERE q < m)),
o AS (SELECT lang, phrase, max(a) AS most FROM i GROUP BY ALL),
r AS (SELECT b.lang, b.phrase, a, c.l AS l, c.r AS r, c.score AS score, row_number() OVER (PARTITION BY b.lang ORDER BY c.score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN o USING (lang, phrase) WHERE coalesce(100 * most < 80 * a, TRUE))
SELECT r.lang, rank, phrase, a, l, r, t.n, score FROM r JOIN t ON t.lang = r.lang WHERE rank <= 2000
"""
