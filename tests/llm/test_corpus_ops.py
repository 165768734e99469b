"""Operators on counts of a corpus (11 to 13) against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import brown, bytewords, collocations, common, importance

DOCS = "doc_id long, text string, lang string, source string, n_words long, weight double, rank string, k long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd_rows(seed, n=120):
    """Texts of few words that repeat, with odd characters, nulls, repeated rows, clashing columns, and a word that most hold."""
    rng = random.Random(seed)
    words = ["The", "cat", "sat", "on", "é", "Été", "a", "b", "x" * 300, "naïve", "日本", "don't", "\x00", "q_r", "3.5", "\x7f", "😀"]
    marks = [" ", " ", " ", "  ", "\t", "\n", ". ", ",", "!?", "\r\n", "\x0b", "\x0c"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words[: rng.choice([4, 8, 17])]) + rng.choice(marks) for _ in range(rng.choice([0, 1, 5, 30, 60])))
        rows.append((i // 2 if i % 7 == 0 else i, text, rng.choice(["en", "de", None, "und", "e n"]), "s", 1, 0.5, "r", 3))
    rows += [(None, "the cat sat", "en", None, None, None, None, None), (5, None, None, None, None, None, None, None), (6, "", "en", None, None, None, None, None), (7, " \n ", "en", None, None, None, None, None)]
    rows += [(1000 + i, "Common line of the cat sat on a b. the the the the", "en", "s", 1, 0.5, "r", 3) for i in range(60)] + [rows[3]] * 3
    return rows


def test_words_of_buffers():
    texts = ["Ab c\n", "", "\n", "é ÉX\t\ty", " \n", "z" * 700 + " q1 ", "a-b"]
    closed = [t + "\n" for t in texts]
    for classes, pattern in ((bytewords.WHITE, r"[^\x20\x09-\x0D]+"), (bytewords.LETTERS_DIGITS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (collocations.PIECES, r"[^\x20\x09.,;:!?\x0A-\x0D]+")):
        for shift in (0, 2):
            w = bytewords.words(pa.array(closed)[shift:], classes)
            got = [(r, w.data[s:e].tobytes().decode()) for r, s, e in zip(w.row.tolist(), w.start.tolist(), w.end.tolist(), strict=True)]
            assert got == [(r, x) for r, t in enumerate(texts[shift:]) for x in re.findall(pattern, lower(t))]
            assert bytewords.as_array(w, kind=pa.string()).to_pylist() == [x for _, x in got]
            assert bytewords.crc32(w.data, w.start, w.end).tolist() == [zlib.crc32(x.encode()) for _, x in got]
    batch = pa.RecordBatch.from_arrays([pa.array(closed)], ["text"])
    assert [x for p in bytewords.slices(batch, "text", 5) for x in p["text"].to_pylist()] == closed
    assert len(bytewords.words(pa.array([], pa.string()), bytewords.WHITE).row) == 0


def brute_collocations(rows, min_count, longest, top, cover):
    f, total = collections.Counter(), collections.Counter()
    for r in rows:
        lang = r[2] or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(r[1])):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    cand = {k: n for k, n in f.items() if len(k[1]) > 1 and n >= min_count}
    inside = collections.Counter()
    for (lang, p), n in cand.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i : i + m]] = max(inside[lang, p[i : i + m]], n)
    out = []
    for (lang, p), a in cand.items():
        if 100 * inside[lang, p] >= cover * a:
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, total[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    place = collections.Counter()
    ranked = []
    for x in out:
        place[x[0]] += 1
        if top is None or place[x[0]] <= top:
            ranked.append((x[0], place[x[0]], *x[1:]))
    return sorted(ranked)


@pytest.mark.parametrize("listed, split, hot, longest, top, min_count", [(1_000_000, 1_000_000, False, 4, 25, 6), (4, 1_000_000, False, 5, None, 9), (1_000_000, 20, True, 5, None, 6), (0, 7, True, 4, 25, 9), (9, 7, False, 4, None, 6)])
def test_collocations(spark, monkeypatch, listed, split, hot, longest, top, min_count):
    """All frequent words in the workers' table, few or none; pivots dealt to several tasks; parts joined by broadcast."""
    if hot:
        monkeypatch.setattr(common, "HOT_ROWS", 1)
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    rows = odd_rows(3)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = collocations.collocations(docs, min_count, longest, top, listed=listed, split=split)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, min_count, longest, top, 80)


def test_collocations_mine_in_chunks(spark):
    rows = odd_rows(5)
    docs = spark.createDataFrame(rows, DOCS).select(F.coalesce("lang", F.lit("und")).alias("lang"), bytewords.closed(F.col("text")).alias("text"))
    frequent = collocations.word_counts(docs).where("n >= 6")
    table, others = collocations._listed(frequent, 1000, 1 << 20)
    assert others == 0 and table["n"].to_pylist() == sorted(table["n"].to_pylist(), reverse=True)
    dealt = collocations.fragments(docs, table, 0, 4, 1 << 40)
    assert sorted(map(tuple, collocations.mine(dealt, 6, 4, chunk=1).collect())) == sorted(map(tuple, collocations.mine(dealt, 6, 4).collect()))


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, None, None, None, None)], DOCS)).count() == 0


def brute_resample(rows, target, percent, min_words, order, buckets):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def features(text):
        w = re.findall(pattern, lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(w) - n + 1)]

    s, t = collections.Counter(), collections.Counter()
    for counts, table in ((s, [r[1] for r in rows]), (t, target)):
        for text in table:
            counts.update(features(text)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out = []
    for r in rows:
        n, f = features(r[1])
        weight = sum(gain[b] for b in f)
        h = None if r[0] is None else int(hashlib.sha256(f"2024:{r[0]}".encode()).hexdigest()[:8], 16)
        score = None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((r[0], n, len(f), weight, score))
    able = [x for x in out if x[1] >= min_words and x[4] is not None]
    able.sort(key=lambda x: (-x[4], x[0]))
    return out, able[: percent * len(able) // 100]


@pytest.mark.parametrize("order, buckets", [(1, 10_000), (3, 97)])
def test_resampling(spark, order, buckets):
    rows, target = odd_rows(9), ["The cat sat on the mat", None, "", "été 日本 日本"]
    want, drawn = brute_resample(rows, target, 10, 5, order, buckets)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(spark.createDataFrame(rows, DOCS).repartition(3), bench, 10, 5, order, buckets).collect()
    key = lambda x: str(x)
    assert sorted([(r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got], key=key) == sorted(want, key=key)
    places = sorted((r["rank"], r.score, r.doc_id) for r in got if r["rank"] is not None)
    assert places == [(i + 1, x[4], x[0]) for i, x in enumerate(drawn)]


def test_resampling_draws_what_resembles_the_target(spark):
    rng = random.Random(1)
    mix = lambda a, b: " ".join(rng.choice(a if rng.random() < 0.7 else b) for _ in range(60))
    a, b = [f"a{i}" for i in range(50)], [f"b{i}" for i in range(50)]
    rows = [(i, mix(a, b) if i % 10 == 0 else mix(b, a), "k") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    target = spark.createDataFrame([(mix(a, b),) for _ in range(30)], "text string")
    drawn = importance.draw_documents(docs, target)
    ids = {r.doc_id for r in drawn.collect()}
    # the noise may let a few others in
    assert drawn.columns == docs.columns and len(ids) == 40 and len(ids & set(range(0, 400, 10))) >= 37


def test_resampling_of_nothing(spark):
    none, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string")
    assert importance.resample(none, bench).count() == 0 and importance.draw_documents(none, bench).columns == none.columns
    assert [(r.n_features, r["rank"]) for r in importance.resample(spark.createDataFrame([(1, "one two", None, None, None, None, None, None)], DOCS), bench).collect()] == [(2, None)]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text)) + [brown.END]


def brute_score(model, counts, text):
    """Log10 probability of a text, word by word, from the model's tables."""
    u, total, before = model.units, 0.0, 0
    listed = {w: i + 1 for i, w in enumerate(u.listed.to_pylist())} | {brown.END: 0}
    for t in tokens(text):
        unit = listed.get(t)
        if unit is None:
            form = zlib.crc32(t.encode()[-3:]) % len(u.types)
            unit = u.first_form + form
            total += math.log10((counts[t] + 0.1) / (u.n[unit] + 0.1 * (u.types[form] + 1)))
        total += model.emission[unit] + model.transition[model.classes[before], model.classes[unit]]
        before = unit
    return total


@pytest.mark.parametrize("min_count, share, hot", [(3, 1e-6, False), (1, 0.02, True), (10**9, 1e-6, False)])
def test_brown_scores(spark, monkeypatch, min_count, share, hot):
    """Most words are units, some, or none."""
    if hot:
        monkeypatch.setattr(common, "HOT_ROWS", 1)
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    rows = odd_rows(11)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    model = brown.train(docs.where(brown.learned_from(F.col("doc_id"))), classes=6, rounds=3, share=share, min_count=min_count, n_forms=8)
    counts = collections.Counter(t for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 10 for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    assert (model.units.total, model.units.known) == (n, v) and model.history == sorted(model.history)
    got = brown.score(docs.select("doc_id", "text", "weight", F.lit("x").alias("score"), F.lit(1).alias("row")), model)
    assert got.columns == ["doc_id", "weight", "score", "row", "n_tokens", "n_known", "train_tokens", "base_score", "_score"]
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r._score) for r in got.collect())
    want = sorted((str(r[0]), len(tokens(r[1])), sum(counts[t] > 0 for t in tokens(r[1])), n, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(r[1])), brute_score(model, counts, r[1])) for r in rows)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert np.allclose([x[4:] for x in got], [x[4:] for x in want], rtol=1e-9)
    # behind every class the probabilities of all words, and of one unknown word a form, add up to one
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    assert np.allclose(np.bincount(model.classes, weights=10**model.emission, minlength=6), [1 if (model.classes == c).any() else 0 for c in range(6)])
    u = model.units
    for form in range(8):
        inside = [c for w, c in counts.items() if w != brown.END and w not in set(u.listed.to_pylist()) and zlib.crc32(w.encode()[-3:]) % 8 == form]
        assert math.isclose(sum(c + 0.1 for c in inside) + 0.1, 10 ** model.spread[form])


def test_exchange_gains_are_exact():
    rng = np.random.default_rng(2)
    of = rng.integers(0, 7, 40)

    def table(of):
        out = np.zeros((7, 7))
        np.add.at(out, (of[:, None], of[None]), pairs)
        return out

    walk = rng.integers(0, 40, 5000)
    walk[-1] = walk[0]
    pairs = np.zeros((40, 40))
    np.add.at(pairs, (walk[:-1], walk[1:]), 1)
    for unit in range(40):
        after, before = np.bincount(of, weights=pairs[unit], minlength=7), np.bincount(of, weights=pairs[:, unit], minlength=7)
        gain = brown.move_gains(table(of), int(of[unit]), after, before, pairs[unit, unit])
        for k in range(7):
            moved = of.copy()
            moved[unit] = k
            assert math.isclose(gain[k], brown.likelihood(table(moved)) - brown.likelihood(table(of)), abs_tol=1e-6)


def test_exchange_finds_classes(spark):
    """Words of two kinds that take turns, and texts of two languages: classes tell the languages apart, and held-out texts gain."""
    rng = random.Random(6)

    def text(tongue):
        return " ".join(f"{tongue}{'ab'[i % 2]}{rng.randrange(12)}" for i in range(40))

    rows = [(i, text("xy"[i % 2])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = brown.train(docs.where(brown.learned_from(F.col("doc_id"))), classes=8, rounds=6)
    kind = collections.defaultdict(set)
    for word, c in zip(model.units.listed.to_pylist(), model.classes[1:], strict=False):
        kind[int(c)].add(word[0])
    assert all(len(k) == 1 for k in kind.values()) and len(model.history) > 1
    held = brown.score(docs.where(~brown.learned_from(F.col("doc_id"))), model).collect()
    assert held and all(r.score > 0.9 * r.base_score for r in held)


def test_brown_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    model = brown.train(none, classes=4)
    assert brown.score(none, model).count() == 0
    got = brown.score(spark.createDataFrame([(1, "a b", None), (2, None, None)], "doc_id long, text string, row string"), model).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in sorted(got)] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert all(np.isfinite(r.score) for r in got)
