"""Training-data operators against brute force, round trips and held-out accuracy."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, components, decontamination, language_id, line_dedup, near_dedup, packing, quality, records, token_counts, tokenizing, topk

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, root long"
#: Null, empty, blank and very long texts, ties and repeated rows; columns with clashing names.
ODD = [(1, None, None, None, None, 0.5, 1), (2, "", "en", "", 0, 0.5, 1), (3, " \n\t ", "en", "a", 3, None, None), (4, "the same words here. " * 40_000, "en", "a", 1, 0.1, 2), (5, "one two three four five six", "en", "b", 1, 0.1, 2), (6, "one two three four five six", "fr", "b", 1, 0.1, 2), (6, "one two three four five six", "fr", "b", 1, 0.1, 2)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_encoders_equal_the_libraries():
    j, p = tokenizing.json_encoder(tokenizing.tokenizer_path("word_bpe_49k.json")), tokenizing.piece_counter(tokenizing.tokenizer_path("piece_bpe_32k.model"))
    assert j.cuts and j.ends is not None and p.independent
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "The,", "ing***", "'s", "don't", "é", "é", "́", "▁", "ΑΣ", "23", "<|endoftext|>", "</s>", "\x1c", "\x85", "日本", "😀", "\x00", "İ", "ﬁ", "x" * 80]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert j.encode(t) == j._library(t)
        assert p.count(t) == len(p.sp.encode(t))


def test_chat_events(spark):
    log = [
        (1, 0, "message", None, "user", "hi"), (1, 1, "message", None, "assistant", "he"), (1, 2, "delta", 1, None, "llo"), (1, 3, "message", None, "user", "more"),
        (1, 4, "regenerate", 1, None, "new"), (1, 5, "delta", 1, None, " <text> \\l"), (1, 6, "edit", 0, None, "HI\n"), (1, 7, "message", None, "user", "bye"),
        (2, 0, "message", None, "user", None), (2, 1, "message", None, None, ""), (2, 2, "delete", 1, None, None), (3, 0, "message", None, "a\nb<|turn|>", "x<|end|>\n<|turn|>y\\\\l"),
        (4, 0, "message", None, "user", "same"), (4, 0, "message", None, "user", "same"),
    ]
    log = spark.createDataFrame(log, "conv_id long, seq long, op string, target long, role string, text string")
    out = chat.render(chat.reconstruct(log))
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(out).collect()}
    assert back == {1: [("user", "HI\n"), ("assistant", "new <text> \\l"), ("user", "bye")], 2: [("user", "")], 3: [("a\nb<|turn|>", "x<|end|>\n<|turn|>y\\\\l")], 4: [("user", "same")] * 2}
    for r in out.collect():
        turns = back[r.conv_id]
        for s, (role, text) in zip(r.loss_spans, turns, strict=True):
            got = r.formatted[s.start : s.start + s.length]
            assert got == (text.replace("\\", "\\\\").replace("<", "\\l") if role == "assistant" else "")
    assert chat.render(chat.reconstruct(log.limit(0))).count() == 0


def test_records_round_trip(spark, docs, odd, none, tmp_path):
    for k, d in enumerate((docs, odd, none)):
        folder = f"file://{tmp_path}/{k}"
        files = records.write_records(d, folder, "word_bpe_49k.json")
        got = sorted(tuple(r) for r in records.read_records(spark, folder, files).collect())
        library = tokenizing.json_encoder(tokenizing.tokenizer_path("word_bpe_49k.json"))._library
        want, start = [], 0
        for r in sorted(d.collect(), key=lambda r: (r.doc_id, r.text or "")):
            ids = library(r.text or "") + (2).to_bytes(4, "little")
            want.append((r.doc_id, start, len(ids) // 4, zlib.crc32(ids)))
            start += len(ids) // 4
        assert got == sorted(want)
        for _, name, n, _ in files:
            order = list(range(n))[::-1]
            assert [i for i, _ in records.read_at(folder, name, order)] == [i for i, _ in records.read_file(folder, name)][::-1]
    part = next((tmp_path / "0").glob("*.rec"))
    data = bytearray(part.read_bytes())
    data[40] ^= 1
    part.write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        list(records.read_file(f"file://{tmp_path}/0", part.stem))


def test_packing(spark, docs, odd, none):
    """Pieces are the library's ids; places are gapless and, from one packer, those of a plain best fit."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizing.tokenizer_path("word_bpe_49k.json"))
    for d in (docs, odd, none):
        got = packing.pack_documents(d).toPandas()
        want = []
        for r in d.collect():
            ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
            want += [(r.doc_id, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
        assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
        free: dict[int, int] = {}
        for r in got.itertuples():  # rows come in the order in which they were packed
            fits = [f for f in free.values() if f >= r.length]
            assert free.get(r.sequence_id, 4096) == min(fits, default=4096) and r.offset == 4096 - free.get(r.sequence_id, 4096)
            free[r.sequence_id] = free.get(r.sequence_id, 4096) - r.length
        assert got.sequence_id.nunique() <= 1.05 * got.length.sum() / 4096 + 1


def test_packing_by_several_packers(spark):
    rng = random.Random(2)
    rows = [(i, 0, rng.choice([rng.randint(1, 100), rng.randint(1, 4096)])) for i in range(3000)]
    lengths = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    got = packing.pack(lengths, open_bins=64, pieces_a_packer=500).toPandas()
    assert sorted(zip(got.doc_id, got.length)) == sorted((i, n) for i, _, n in rows)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= 1.1 * got.length.sum() / 4096 + 6


def test_best_fit_closes_the_fullest():
    b = packing.BestFit(10, open_bins=2)
    assert [b.place(n) for n in (6, 7, 4, 8, 3, 2)] == [(0, 0), (1, 0), (0, 6), (2, 0), (1, 7), (2, 8)]
    b = packing.BestFit(10, open_bins=2)
    assert [b.place(n) for n in (6, 7, 8, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6)]


def test_token_counts(docs, odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizing.tokenizer_path("piece_bpe_32k.model"))
    for d in (docs, odd, none):
        want = sorted((r.doc_id, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in d.collect())
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(d).collect()) == want


def brute_lines(rows, least=1, near_least=20):
    places = collections.defaultdict(list)
    for d, t in rows:
        for i, x in enumerate([] if t is None else t.split("\n")):
            if len(x.strip(" \t\r\x0b\x0c")) >= least:
                places[x.strip(" \t\r\x0b\x0c")].append((d, i))
    first, gone = {x: min(p) for x, p in places.items()}, set()
    variants = {x: {x, *(x[:i] + x[i + 1 :] for i in range(len(x)))} for x in places}

    def near(a, b):
        if min(len(a), len(b)) < near_least:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return min(a, b, key=len) in variants[max(a, b, key=len)] and abs(len(a) - len(b)) == 1

    for x, p in places.items():
        gone |= {q for q in p if q != first[x]}
        if any(first[y] < first[x] and near(x, y) for y in places):
            gone |= set(p)
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def test_line_dedup(spark, odd, none):
    rng = random.Random(3)
    base = ["".join(rng.choice("abc") for _ in range(rng.randint(20, 24))) for _ in range(6)]

    def changed(x):
        x = list(x)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(x))
            x[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        return "".join(x)

    rows = [(i, "\n".join(changed(rng.choice(base)) for _ in range(rng.randint(0, 6)))) for i in range(120)] + [(900, None), (901, ""), (902, "short\nshort\n\n \nshirt"), (903, "short")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows) and got[902] == "short\n\n \nshirt"
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"] and out.count() == odd.count()
    assert line_dedup.dedup_lines(none).count() == 0


def brute_near(rows, size, percent):
    sets, parent = {}, {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
        parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_dedup(spark, docs, odd, none, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choices(words, k=90) for _ in range(2)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for i in range(80):  # a group of near copies on both sides of the threshold, in blocks
        x = list(base[i % 2])
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(len(x))] = rng.choice(words)
        rows.append((10_000 + i, " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(rows, 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, 4).collect()} == want
    limit = near_dedup.sketch_limit(near_dedup.BANDS, near_dedup.ROWS, near_dedup.SKETCH_BITS, 0.8)
    reps = near_dedup.signatures(df, 4).where("n_shingles > 0").select("doc_id", "keys", "sketch", "n_shingles")
    groups = near_dedup.candidate_groups(reps, limit, block=16)
    groups = groups.join(reps.select(F.col("doc_id").alias("node"), "n_shingles"), "node")
    found = {r.node: r.root for r in near_dedup.links(df, groups, 4, 80, block=16).collect()}
    assert all(found.get(d, d) == root for d, (n, root) in want.items() if n)
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, True), 6: (5, False)} and near_dedup.near_duplicates(odd).count() == len(ODD)
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.keep_one(none).columns == none.columns


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 7), (5, 3), (3, 5)], "a long, b long")
    got = {r.node: r.root for r in components.components(e).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 5: 3}


def test_decontamination(spark, odd, none):
    item = " ".join(f"q{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item), (2, "Short item"), (3, None), (4, "..."), (5, item)], "item_id long, text string")
    rows = [(1, "x " * 50 + item + " y" * 50), (2, "x, " + ", ".join(f"Q{i}" for i in range(5, 18)) + "!"), (3, " ".join(f"q{i}" for i in range(12))), (4, "a SHORT-item b"), (5, None), (6, ""), (7, "z " * 1000 + "short item")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontamination.contamination(df, bench).collect()}
    assert got == {1: (130, 30, ["1", "5"], True), 2: (14, 13, ["1", "5"], True), 3: (12, 0, [], False), 4: (4, 2, ["2"], True), 5: (0, 0, [], False), 6: (0, 0, [], False), 7: (1002, 2, ["2"], False)}
    assert {r.doc_id for r in decontamination.remove_documents(df, bench).collect()} == {3, 5, 6, 7}
    cut = {r.doc_id: r.text for r in decontamination.remove_spans(df, bench).collect()}
    assert cut[2] == "x, " and cut[4] == "a b" and cut[3] == rows[2][1] and cut[5] is None
    assert decontamination.contamination(odd, bench).count() == len(ODD)
    assert decontamination.contamination(none, bench).count() == 0 and decontamination.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_topk(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(300)] + [(300, None), (301, [1.0] * 7 + [None]), (302, [float("nan")] * 8), (303, [1.0, 2.0]), (None, [1.0] * 8), (305, [0.5] * 8), (306, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = {i: np.floor(256 * np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = {(q, r + 1, i, s) for q in x if q % 50 == 0 for r, (s, i) in enumerate(sorted(((int(x[q] @ x[c]), c) for c in x if c != q and len(x[c]) == len(x[q])), key=lambda z: (-z[0], z[1]))[:5])}
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()} == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_quality_held_out(spark, odd, none):
    got = quality.op5_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got.merge(truth, on="doc_id")
    both = both[both.held_out]
    assert (both.predicted == both.quality).mean() > 0.95 and 0.5 < both.quality.mean() < 0.9
    good, bad = both.score[both.quality == 1].to_numpy(), both.score[both.quality == 0].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.99
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    model = quality.train(np.zeros((0, 5)), np.zeros((0, 5)))
    few = quality.score(odd.select("doc_id", "text"), model)
    assert few.where("score BETWEEN 0 AND 1").count() == len(ODD) and quality.score(none.select("doc_id", "text"), model).count() == 0


def test_quality_of_any_script_and_length():
    """Capitals count alike in short and long texts, and words have their whole form."""
    for word in ("Жук ", "Łoś ", "Œuf ", "Été ", "Cat ", "𐐀𐐨𐐨 "):
        for n in (10, 499, 500, 501, 300_000):
            assert quality.features(word * n)[8] == np.float32(1 / 3)
    assert quality._shape("字" * 64 + "7") != quality._shape("字" * 64)


def test_language(spark, docs, odd, none):
    e = language_id.from_documents(docs).withColumn("declared", F.when(F.col("id") % 5 > 0, F.col("declared")))
    found = language_id.identify(e, language_id.train_text_model(e)).toPandas().merge(docs.select("doc_id", "lang").toPandas(), left_on="id", right_on="doc_id")
    held = found[found.id % 5 == 0]
    assert len(held) > 30 and (held.language == held.lang).all() and (found.language == found.lang).mean() > 0.97
    kept = language_id.keep_identified(docs.unionByName(odd.select(*docs.columns)))
    assert kept.where(F.col("doc_id") > 6).count() == docs.where(F.col("doc_id") > 6).count()
    assert language_id.keep_identified(none).count() == 0
    whole = language_id.ngram_counts("Le ouèque. x!" * 9)
    assert whole[1] == 27 - 8 + 8 and whole[0].sum() == 3 * 9 * 9


def test_language_of_many_and_of_few(spark):
    """More languages than 64, each of its own letters, and one too rare for a sample of all rows."""
    rng = np.random.default_rng(5)
    letters = {f"l{i:02}": [chr(0x4E00 + 40 * i + j) for j in range(40)] for i in range(70)}
    write = lambda name: " ".join("".join(rng.choice(letters[name], 5)) for _ in range(60))
    rows = [(70 * j + i, write(name), name if j else None, "h", "") for j in range(6) for i, name in enumerate(letters)]
    e = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")
    found = {r.id: r for r in language_id.identify(e, language_id.train_text_model(e)).collect()}
    assert all(found[i].accepted and found[i].language == f"l{i % 70:02}" for i, *_ in rows)

    rows = [(i, write("l00"), "l00", "h", "") for i in range(400)] + [(400 + i, write("l01"), "l01", "h", "") for i in range(3)]
    e = spark.createDataFrame(rows, e.schema)
    found = {r.id: r for r in language_id.identify(e, language_id.train_text_model(e, rows=20)).collect()}
    assert all(r.accepted and r.language == ("l00" if i < 400 else "l01") for i, r in found.items())


def brute_contaminated(docs, bench):
    """doc_ids of which a twentieth or more of the words are in windows of 13 words."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = {tuple(w[i : i + min(13, len(w))]) for w in map(words, bench) if w for i in range(len(w) - min(13, len(w)) + 1)}
    out = set()
    for d, t in docs:
        w = words(t)
        hit = {p for n in {len(g) for g in grams} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams for p in range(i, i + n)}
        if hit and 20 * len(hit) >= len(w):
            out.add(d)
    return out


def test_pipeline(spark):
    """Each stage against brute force on what it is given, and near-duplicates against the whole texts."""
    import corpus_pipeline

    source = docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.materialize(stage(spark, docs, SF), name)
        kept[name] = docs
    rows = lambda d: [(r.doc_id, r.text) for r in d.collect()]
    assert kept["near_dedup"].columns == kept["decontamination"].columns == source.columns
    # words by a plain definition of a language: the documents that stay are those with letters
    assert {d for d, _ in rows(kept["language_id"])} >= {d for d, t in rows(source) if t and sum(map(str.isalpha, t)) > 0.6 * len(t)}
    assert set(rows(kept["language_id"])) <= set(rows(source))
    lines, given = dict(rows(kept["line_dedup"])), dict(rows(kept["language_id"]))
    want = brute_lines(list(given.items()))
    assert lines == {d: t for d, t in want.items() if t is None or t.strip() or not given[d].strip()}
    whole = {d: t for d, t in rows(source) if d in lines}
    near = brute_near_of_several([(d, t) for d, t in lines.items()] + list(whole.items()), 4, 80)
    assert {d for d, _ in rows(kept["near_dedup"])} == {d for d, root in near.items() if root == d}
    # of the duplicates by whole texts that come so far, none is left beside the document it repeats
    assert not {d for d, (_, root) in brute_near(list(whole.items()), 4, 80).items() if root != d} & {d for d, _ in rows(kept["near_dedup"])}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    given = rows(kept["near_dedup"])
    assert {d for d, _ in rows(kept["decontamination"])} == {d for d, _ in given} - brute_contaminated(given, bench)
    packed, encoder = docs.toPandas(), tokenizing.json_encoder(tokenizing.tokenizer_path("word_bpe_49k.json"))
    assert packed.groupby("doc_id").length.sum().to_dict() == {d: len(encoder._library(t or "")) // 4 + 1 for d, t in rows(kept["decontamination"])}
    again = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(again.itertuples(index=False, name=None)) == sorted(packed.itertuples(index=False, name=None))


def brute_near_of_several(rows, size, percent):
    """Roots of doc_ids that may have several texts."""
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((d, {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()))
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    return {d: find(d) for d in parent}
