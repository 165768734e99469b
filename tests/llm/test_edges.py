"""Training-data operators: null and repeated ids, clashing columns, hot keys, and both ways of each join."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, common, components, decontamination, language_id, line_dedup, near_dedup, packing, quality, token_counts, topk

BIG = 9007199254740993  # no 64-bit float is that number
ROWS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def nulls(spark):
    rows = [(None, "one two three four five six", "en", "a", 1), (BIG, "one two three four five six", "en", "a", 1), (BIG + 1, "zz yy xx ww vv", None, None, None), (7, "zz yy xx ww vv uu", "en", "b", 1), (7, "qq rr ss tt uu", "en", "b", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, ROWS)


@pytest.fixture(params=["broadcast", "shuffle"])
def way(request, monkeypatch):
    """Each test runs with tables broadcast, and with all of them shuffled and hot keys everywhere."""
    if request.param == "shuffle":
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(common, "HOT_ROWS", 1)
    return request.param


def test_ids_survive_null_neighbours(spark, nulls):
    want = sorted([BIG, BIG + 1, 7, 7, None, None], key=str)
    ids = lambda d: sorted((r.doc_id for r in d.collect()), key=str)
    assert ids(token_counts.count_tokens(nulls)) == want
    assert ids(packing.pack_documents(nulls)) == want
    model = quality.train(np.zeros((0, 5)), np.zeros((0, 5)))
    assert ids(quality.score(nulls, model)) == want
    assert ids(near_dedup.near_duplicates(nulls)) == want
    e = language_id.from_documents(nulls)
    assert sorted((r.id for r in language_id.identify(e, language_id.train_text_model(e)).collect()), key=str) == want
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(nulls).collect()), key=str)
    assert got == sorted([(None, None, True), (None, None, True), (BIG, BIG, True), (BIG + 1, BIG + 1, True), (7, 7, True), (7, 7, True)], key=str)


def test_repeated_ids_are_near_by_any_text(spark, way):
    words = lambda a: " ".join(f"{a}{i}" for i in range(30))
    rows = [(1, words("a")), (5, words("a") + " x"), (5, words("b")), (3, words("b")), (9, words("c")), (9, words("c")), (8, words("c"))]
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (5, 1), (3, 1), (9, 8), (8, 8)}


def test_near_dedup_takes_further_texts(spark):
    words = " ".join(f"a{i}" for i in range(30))
    docs = spark.createDataFrame([(1, words, "k"), (2, "left over", "k"), (3, "other", "k"), (None, words, "k")], "doc_id long, text string, key string")
    also = spark.createDataFrame([(2, words + " end"), (3, "other"), (4, words)], "doc_id long, text string")
    kept = near_dedup.keep_one(docs, also=also)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, None}


def test_further_texts_alone_are_written(spark, way, monkeypatch):
    """Texts that documents have anyway are neither written again nor shuffled to find out which are further ones."""
    words = lambda a, n=30: " ".join(f"{a}{i}" for i in range(n))
    docs = [(1, words("a")), (2, "left over"), (3, words("c")), (4, None), (5, words("e")), (5, "e"), (None, words("a"))]
    also = [(1, words("a")), (2, words("a") + " end"), (2, words("a") + " end"), (3, words("c")), (4, words("c") + " end"), (5, "e"), (5, words("f")), (6, words("f")), (None, words("g")), (3, None)]
    docs, also = (spark.createDataFrame(rows, "doc_id long, text string") for rows in (docs, also))
    tables, write = {}, common.materialize

    def kept(df, name, *made):
        out = write(df, name, *made)
        tables.setdefault(name, (df, out))
        return out

    monkeypatch.setattr(common, "materialize", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted((r.doc_id for r in near_dedup.keep_one(docs, also=also).collect()), key=str)
        plan = tables["texts"][0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted([1, 3, 5, 5, None], key=str)
    assert sorted(map(tuple, tables["texts"][1].collect()), key=str) == sorted([(2, words("a") + " end"), (2, words("a") + " end"), (3, None), (4, words("c") + " end"), (5, words("f"))], key=str)
    # one join has texts: none is shuffled where ids are few, else they are shuffled once
    assert plan.count("SortMergeJoin") == (way == "shuffle") and plan.count("BroadcastHashJoin") == (way == "broadcast")


def test_components_with_hot_nodes(spark, way):
    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 400)] + [(10_000 + i, 5000) for i in range(400)] + [(rng.randrange(600, 900), rng.randrange(600, 900)) for _ in range(150)] + [(399, 10_001)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        u, v = find(a), find(b)
        parent[max(u, v)] = min(u, v)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent if n in got} and all(find(n) == n for n in parent if n not in got)


def test_groups_larger_than_a_block(spark, way):
    """Near copies, a chain whose ends don't resemble each other, and two groups that share a key."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=120)
    rows = []
    for i in range(70):
        x = list(base)
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(len(x))] = rng.choice(words)
        rows.append((i, " ".join(x)))
    x = rng.choices(words, k=120)
    for i in range(100, 160):  # each link replaces a few words more
        x = list(x)
        at = (i - 100) * 2 % 110
        x[at : at + 3] = rng.choices(words, k=3)
        rows.append((i, " ".join(x)))
    from test_llm import brute_near

    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(rows, 4, 80)
    sizes = spark.createDataFrame([(d, 0 if d < 100 else 1, n) for d, (n, _) in want.items()], "node long, root long, n_shingles long")
    for block, weight in ((8, 1 << 40), (1000, 600), (1000, 1 << 40)):
        found = {r.node: r.root for r in near_dedup.links(df, sizes, 4, 80, block=block, weight=weight).collect()}
        assert {d: found.get(d, d) for d in want} == {d: root for d, (_, root) in want.items()}


def test_line_dedup_both_ways(spark, nulls, way):
    line = "a line that is long enough to be near"
    rows = [(1, line + "\n{\nx"), (2, line[:-1] + "\n{\ny"), (None, line + "\nz"), (3, None), (2, "z"), (5, "long " * 20_000 + "\nx")]
    rows = [(d, t, "rid", "gone", "marks", 7, "key") for d, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid string, gone string, marks string, n_lines long, key string")
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(docs)
    out = line_dedup.dedup_lines(docs, counts=("before", "cut"))
    assert out.columns == [*docs.columns, "before", "cut"]
    got = sorted(((r.doc_id, r.text, r.before, r.cut) for r in out.collect()), key=str)
    # the row without an id comes first
    assert got == sorted([(1, "{\nx", 3, 1), (2, "y", 3, 2), (None, line + "\nz", 2, 0), (3, None, 0, 0), (2, "", 1, 1), (5, "long " * 20_000, 2, 1)], key=str)
    assert all(r.rid == "rid" and r.gone == "gone" and r.marks == "marks" and r.n_lines == 7 and r.key == "key" for r in out.collect())


def test_decontamination_both_ways(spark, way):
    item = " ".join(f"q{i}" for i in range(30))
    bench = spark.createDataFrame([(i, item) for i in range(40)] + [(None, "only the nameless item has this text"), (None, None)], "item_id long, text string")
    rows = [(1, item), (1, "a clean row of the same id " * 9), (None, "x " + item), (None, "nothing"), (4, "y only the nameless item has this text"), (5, item), (5, item)]
    rows = [(d, t, "spans", "marks", "key") for d, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, marks string, key string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination.contamination(docs, bench).collect()), key=str)
    assert got == sorted([(1, 30, 30, 40, True), (1, 63, 0, 0, False), (None, 31, 30, 40, True), (None, 1, 0, 0, False), (4, 8, 7, 0, True), (5, 30, 30, 40, True), (5, 30, 30, 40, True)], key=str)
    left = decontamination.remove_documents(docs, bench)
    assert left.columns == docs.columns and sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == [(1, rows[1][1]), (None, "nothing")]
    cut = decontamination.remove_spans(docs, bench)
    assert cut.columns == docs.columns and sorted(((r.doc_id, r.text, r.spans, r.marks) for r in cut.collect()), key=str) == sorted([(d, t.replace(item, "").replace("only the nameless item has this text", ""), s, m) for d, t, s, m, _ in rows], key=str)


def test_decontamination_of_long_texts_is_linear(spark, way):
    item = " ".join(f"q{i}" for i in range(13))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    took = []
    for n in (2_000, 40_000, 160_000):
        docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)) + " " + item)], "doc_id long, text string")
        began = time.time()
        assert [(r.n_words, r.n_hit) for r in decontamination.contamination(docs, bench).collect()] == [(n + 13, 13)]
        took.append(time.time() - began)
    assert took[2] < 6 * took[1] + 2


def test_language_without_declarations_keeps_all(spark):
    docs = spark.createDataFrame([(i, "some words of a text", None, None, 1) for i in range(9)] + [(9, None, None, None, 1)], ROWS)
    assert language_id.keep_identified(docs).count() == 10
    e = language_id.from_documents(docs)
    assert {(r.language, r.accepted) for r in language_id.identify(e, language_id.train_text_model(e)).collect()} == {("und", None)}


def test_language_of_letters_beyond_the_first_plane(spark):
    assert language_id.ngram_counts("𐐨𐐩𐐪 𐐫𐐬")[1] == 2
    rng = np.random.default_rng(1)
    write = lambda a: " ".join("".join(rng.choice([chr(a + j) for j in range(20)], 5)) for _ in range(40))
    rows = [(i, write(0x10428 if i % 2 else 0x61), ("new" if i % 2 else "old") if i > 9 else None, "s", 1) for i in range(60)]
    rows += [(3, None, "old", "s", 1), (4, "123 456", "old", "s", 1)]
    docs = spark.createDataFrame(rows, ROWS)
    assert sorted(r.text for r in language_id.keep_identified(docs).collect()) == sorted(t for _, t, *_ in rows[:60])


def test_language_of_pages_by_host_and_suffix(spark):
    """Pages without words of either language go by their host, and new hosts by their suffix."""
    words = {"de": "und der die das nicht ist ein zu", "fr": "le les des est une dans pour qui"}
    page = lambda lang, text: f"<html{' lang=' + lang if lang else ''}><head><style>p {{}}</style></head><body><p>{text}</p></body></html>"
    rng = random.Random(1)
    text = lambda lang: " ".join(rng.choice(words[lang].split()) for _ in range(30))
    rows = [(i, f"http://h{i % 5}.{lang}/p{i}", page(lang, text(lang))) for i, lang in enumerate(["de", "fr"] * 150)]
    rows += [(900, "http://h0.de/x", page("", "w")), (901, "http://new.fr/x", page("", "w")), (902, "http://new.de/x", page("", "w")), (903, "http://h1.fr/x", page("", text("de"))), (904, None, None), (None, "http://h1.fr/x", page("fr", text("fr")))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    e = language_id.from_pages(pages)
    got = {r.id: r for r in language_id.identify(e, language_id.train_text_model(e)).collect()}
    assert [got[i].language for i in range(300)] == ["de", "fr"] * 150
    # the weight of evidence: little text goes with the host and its suffix, much text against them
    assert [got[i].language for i in (900, 901, 902, 903, 904, None)] == ["de", "fr", "de", "de", "und", "fr"]


def test_risk_and_prior_against_known_ones():
    """The share of positives that was mixed in, and the decisions of the true distributions."""
    rng = np.random.default_rng(3)
    draw = lambda n, at: rng.normal(at, 1, (n, 4))
    for prior in (0.3, 0.6, 0.85):
        n = int(4000 * prior)
        unlabelled = np.concatenate([draw(n, 1.2), draw(4000 - n, -1.2)])
        scores = lambda x: x.sum(axis=1)
        assert abs(quality.estimate_prior(scores(draw(3000, 1.2)), scores(unlabelled)) - prior) < 0.05
        p, u = (x.astype(np.float32) for x in (draw(3000, 1.2), unlabelled))
        w, b = quality._fit(p, u, prior)
        right = np.r_[np.ones(n), np.zeros(4000 - n)].astype(bool)
        best = ((unlabelled.sum(axis=1) * 2.4 + np.log(prior / (1 - prior)) > 0) == right).mean()
        assert ((unlabelled @ w + b > 0) == right).mean() > best - 0.01


def test_quality_passes_columns_on(spark, nulls):
    model = quality.train(np.zeros((0, 5)), np.zeros((0, 5)))
    out = quality.score(nulls.withColumn("score", F.lit("mine")).withColumn("x", F.lit(1)), model)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "x", "score"]


def test_topk_of_any_number_of_lengths_and_far_outliers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=i % 1200 // 2).tolist()) for i in range(2400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = {i: np.floor(256 * np.array(v)) for i, v in rows}
    want = {(q, c, int(x[q] @ x[c])) for q in x if q % 50 == 0 for c in x if c != q and len(x[c]) == len(x[q])}
    got = {(r.query_id, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == want
    # tight clusters beside a vector of a million times their length
    centres = rng.normal(size=(20, 16))
    v = np.concatenate([centres[rng.integers(0, 20, 1500)] + 0.01 * rng.normal(size=(1500, 16)), 1e6 * centres[:1]])
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(v)], "vec_id long, embedding array<double>")
    q = np.floor(256 * v)
    s = q @ q.T
    want = {(i, r + 1, int(c), int(s[i, c])) for i in range(0, len(q), 50) for r, c in enumerate(sorted((c for c in range(len(q)) if c != i), key=lambda c: (-s[i, c], c))[:5])}
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()} == want


def test_topk_eliminates():
    """The share of scores that are worked out, on the given vectors."""
    import pandas as pd

    e = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    x, ids = np.floor(256 * np.stack(e.embedding).astype(np.float64)), e.vec_id.to_numpy()
    basis, asks, seen = topk.choose_pivots(x[: topk.SAMPLE], topk.PIVOTS), ids % 50 == 0, Counter()
    topk.search_block(ids, x, topk.place(x, basis), ids[asks], x[asks], topk.place(x[asks], basis), np.full(asks.sum(), -np.inf), 5, seen)
    assert seen["pairs"] == asks.sum() * (len(ids) - 1) and seen["scores"] < 0.3 * seen["pairs"]


def test_chat_mask_is_what_is_read(spark):
    """Losses come from the mask: moved by one, they change.  Null keys, long texts, further columns."""
    long_text = "<ab\\" * 50_000
    log = [(1, 0, "message", None, "user", "hi", "x"), (1, 1, "message", None, "assistant", long_text, "x"), (None, 0, "message", None, "user", "a", "x"), (None, 1, "message", None, "assistant", "b", "x"), (None, 2, "message", None, "user", "c", "x"), (None, 3, "regenerate", 1, None, "d", "x"), (2, None, "message", None, "assistant", "late", "x"), (2, 5, "message", None, "user", "z", "x")]
    log = spark.createDataFrame(log, "conv_id long, seq long, op string, target long, role string, text string, turns string")
    out = chat.render(chat.reconstruct(log))
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert back[1].losses == [None, long_text] and back[None].losses == [None, "d"] and [t.text for t in back[None].turns] == ["a", "d"]
    assert [t.text for t in back[2].turns] == ["late", "z"] and back[2].losses == ["late", None]
    moved = out.withColumn("loss_spans", F.transform("loss_spans", lambda m: F.struct((m["start"] + 1).alias("start"), m["length"].alias("length"))))
    assert {r.conv_id: r.losses for r in chat.read_back(moved).collect()}[None] == [None, "\\"]
    many = spark.createDataFrame([(1, i, "message", None, "assistant" if i % 2 else "user", f"t{i}") for i in range(3000)], "conv_id long, seq long, op string, target long, role string, text string")
    assert chat.read_back(chat.render(chat.reconstruct(many))).first().losses == [f"t{i}" if i % 2 else None for i in range(3000)]


def test_scratch_is_deleted(spark, tmp_path):
    keep: list[str] = []
    with common.scratch_scope(spark, keep):
        a = common.materialize(spark.range(3), "a", keep)
        gone: list[str] = []
        common.materialize(spark.range(3), "b", gone)
    assert a.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(gone[0])


def test_junk_declarations(spark):
    """Thousands of strings that are declared once or twice get no model, and reject nothing; odd rows have a stated result."""
    rng = random.Random(3)
    letters = {"aa": "abcdefgh", "bb": "nopqrstu"}
    write = lambda name: " ".join("".join(rng.choice(letters[name]) for _ in range(5)) for _ in range(30))
    rows = [(i, write("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb", "h", i) for i in range(200)]
    rows += [(1000 + i, write("aa"), f"junk{i}", "h", i) for i in range(5000)] + [(6000 + i, "日本 語", f"odd{i}", "h", i) for i in range(200)]
    rows += [(9001, None, "junk1", "h", 0), (9002, "", None, None, None), (9003, " 12 \n", "aa", "h", 0), (None, write("bb"), None, None, None), (9004, "abc " * 50_000, "", "h", 0), (9004, "abc " * 50_000, "", "h", 0)]
    docs = spark.createDataFrame(rows, ROWS)
    e = language_id.from_documents(docs)
    model = language_id.train_text_model(e)
    assert model.languages == ("aa", "bb")
    got = {(r.id, r.language, r.accepted) for r in language_id.identify(e, model).collect()}
    assert {(i, "aa" if i % 2 else "bb", True) for i in range(200)} <= got and {(1000 + i, "aa", True) for i in range(5000)} <= got
    assert len(got) == len(rows) - 1 and all(a is not False for i, _, a in got if i is None or i < 9000)
    assert {x for x in got if x[0] is None or x[0] > 9000} == {(9001, "und", False), (9002, "und", False), (9003, "und", False), (None, "bb", True), (9004, "aa", True)}
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3 and kept.where("doc_id IN (9001, 9002, 9003)").count() == 0


def test_line_in_most_documents(spark, way):
    """One menu line that most documents have, and a near one: all but the first go, broadcast or shuffled with hot keys."""
    menu = "Home | About us | Contact | Imprint"
    rng = random.Random(2)
    own = ["".join(rng.choices("abcdefgh", k=40)) for _ in range(300)]
    rows = [(i, f"{menu}\n{own[i]}\n}}") for i in range(300)] + [(300 + i, menu + "s") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {0: rows[0][1]} | {i: own[i] for i in range(1, 300)} | {300 + i: "" for i in range(40)}


def test_window_in_most_documents(spark):
    """A benchmark passage that most documents hold, in the shuffled way too."""
    words = [f"w{i}" for i in range(20)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "short one"), (None, " ".join(words[::-1]))], "item_id long, text string")
    rows = [(i, f"start{i} " + " ".join(words[:15]) + f" end{i}") for i in range(400)] + [(400, "nothing here"), (401, None), (402, " ".join(words[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for most in (None, -1):
        got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontamination.contamination(docs, bench, max_broadcast=most).collect()}
        assert all(got[i] == (15, 1, True) for i in range(400)) and got[400] == (0, 0, False) and got[401] == (0, 0, False) and got[402] == (20, 0, True)


def test_records_of_one_id(spark, tmp_path):
    """Rows that repeat one id are cut between files, in the order of id and text."""
    from plumbline.llm import records

    rows = [(7, f"{chr(97 + i % 26)} text {i}") for i in range(200)] + [(3, "x"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    files = records.write_records(docs, f"file://{tmp_path}/r", "word_bpe_49k.json", partitions=4)
    assert len(files) > 1 and max(f[2] for f in files) < 150
    back = sorted(records.read_records(spark, f"file://{tmp_path}/r", files).collect(), key=lambda r: r.start)
    from plumbline.llm import tokenizing

    encode = tokenizing.json_encoder(tokenizing.tokenizer_path("word_bpe_49k.json")).encode
    want = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    assert [(r.doc_id, r.n_tokens) for r in back] == [(d, len(encode(t or "")) // 4 + 1) for d, t in want]
