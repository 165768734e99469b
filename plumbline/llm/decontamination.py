"""Operator 10: benchmark decontamination (DataFrame functions only).

A window is ``n`` consecutive words of a benchmark item, or all of a shorter item.  The set
of windows comes from the benchmark alone; its bytes are counted, and it is broadcast only up to
``max_broadcast`` of them (joined by shuffle beyond).

Scanning every window of a 100 TB corpus would hash each word ``n`` times.  Instead the scan
probes shorter grams at every s-th word: an occurrence of a window of L words covers a gram
of g = L + 1 - s words that starts at a multiple of s, for any s.  With s = (L + 1) // 2 about
2 / L of all positions are probed against the hashes of all g-grams of the items, and no
occurrence can be missed.  Only documents with such a hit are read again; there every
position is hashed, and where a hash is met the words themselves are compared.

No row of a position carries the words of its document, so the cost is linear in the length of a
text.  Which items hold a window is a table of its own, joined once for each document and window, so
a window that many items share costs no more than what it adds to the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(c: Column) -> Column:
    """Lower-cased words (A-Z only) of a text; none for null."""
    return F.array_remove(F.split(common.ascii_lower(F.coalesce(c, F.lit(""))), WORD_BREAK), "")


def _hashes(w: Column, starts: Column, n: int) -> Column:
    """Hashes of the n-grams of ``w`` at ``starts``."""
    return F.transform(starts, lambda i: F.xxhash64(F.lit(n), F.slice(w, i + 1, n)))


def _steps(w: Column, n: int, by: int) -> Column:
    """Starts of the n-grams of ``w`` at multiples of ``by``."""
    return F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n, F.lit(by))).otherwise(F.array().cast("array<int>"))


def _spots(w: Column, n: int) -> Column:
    """Start, size and hash of every n-gram of ``w``."""
    return F.transform(_steps(w, n, 1), lambda i: F.struct(i.alias("at"), F.lit(n).alias("size"), F.xxhash64(F.lit(n), F.slice(w, i + 1, n)).alias("hash")))


def windows(bench: DataFrame, n: int = 13) -> tuple[DataFrame, DataFrame]:
    """((wid, size, window, hash), (wid, item)): each distinct window of ``bench(item_id, text)``, and the
    items that hold it, as strings.  Items without words have no window; windows of items without an
    id have no item."""
    b = bench.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    starts = F.sequence(F.lit(0), F.size("w") - size)
    b = b.withColumn("size", size).select("item", "size", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.col("size")))).alias("window"))
    w = b.select("size", "window").distinct().select(F.monotonically_increasing_id().alias("wid"), "size", "window", F.xxhash64("size", "window").alias("hash"))
    w = common.materialize(w, "windows")
    held = b.where("item IS NOT NULL").join(w, ["size", "window"]).select("wid", "item").distinct()
    return w, common.materialize(held, "holders")


def _suspects(text: DataFrame, w: DataFrame, sizes: list[int], max_broadcast: int | None) -> DataFrame:
    """(key, n_words, copies, suspect) of each distinct row of ``text(key, w)``."""
    probes = [(s, s + 1 - (s + 1) // 2, (s + 1) // 2) for s in sizes]
    gram = lambda g: F.explode(_hashes(F.col("window"), F.sequence(F.lit(0), F.col("size") - g), g))
    seeds = reduce(DataFrame.union, [w.where(F.col("size") == s).select(gram(g).alias("gram")) for s, g, _ in probes])
    seeds = common.materialize(seeds.distinct().withColumn("seen", F.lit(True)), "seeds")
    grams = F.concat(*[_hashes(F.col("w"), _steps(F.col("w"), g, by), g) for _, g, by in probes])
    probed = text.select("key", F.size("w").alias("n_words"), F.posexplode_outer(grams).alias("nth", "gram"))
    # rows of a document stand together in its task, so the partial aggregate leaves one of each
    first = (F.coalesce("nth", F.lit(0)) == 0).cast("long")
    counts = probed.join(common.broadcast_if_small(seeds, max_broadcast), "gram", "left").groupBy("key")
    return counts.agg(F.max("n_words").cast("long").alias("n_words"), F.sum(first).alias("copies"), F.max(F.coalesce("seen", F.lit(False))).alias("suspect"))


def find_hits(docs: DataFrame, bench: DataFrame, n: int = 13, max_broadcast: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(counts, hits, holders)`` for ``docs(doc_id, text)``.

    ``counts`` has ``(key, n_words, copies, suspect)`` for every document; ``hits`` has
    ``(key, at, size, wid)`` for every verified occurrence of a window, and ``holders`` ``(wid, item)`` the
    items of each window.  ``key`` is the document's :func:`common.row_key`: rows that share a ``doc_id`` are
    documents of their own unless their texts are equal too; of those there are ``copies``.
    """
    w, holders = windows(bench, n)
    spread = F.sum(F.octet_length(F.array_join("window", "")) + 24 * F.col("size") + 48)
    stats = w.agg(F.collect_set("size").alias("sizes"), spread.alias("bytes")).first()
    sizes = sorted(stats["sizes"])
    text = docs.select(common.row_key().alias("key"), words(F.col("text")).alias("w"))
    if not sizes:  # no benchmark: nothing is suspect
        counts = text.groupBy("key").agg(F.max(F.size("w")).cast("long").alias("n_words"), F.count("*").alias("copies"), F.lit(False).alias("suspect"))
        return counts, docs.sparkSession.createDataFrame([], "key struct<doc_id: bigint, rid: bigint>, at int, size int, wid long"), holders
    limit = common.BROADCAST_BYTES if max_broadcast is None else max_broadcast
    small = stats["bytes"] <= limit
    counts = common.materialize(_suspects(text, w, sizes, max_broadcast), "counts")

    def again(keys: DataFrame) -> DataFrame:
        return text.join(common.broadcast_if_small(keys, max_broadcast), "key", "left_semi")

    spots = again(counts.where("suspect").select("key")).select("key", F.explode(F.concat(*[_spots(F.col("w"), s) for s in sizes])).alias("p")).select("key", "p.*")
    spots = spots.select("key", "at", F.struct("hash", "size").alias("gram"))
    known = w.groupBy(F.struct("hash", "size").alias("gram")).agg(F.collect_list("wid").alias("wids"))
    met = spots.join(F.broadcast(known), "gram") if small else common.join_counted(spots, known, "gram")
    met = common.materialize(met.select("key", "at", "gram.size", F.explode("wids").alias("wid")).distinct(), "met")
    # the words of a hit; a document has as many hits as words times sizes at most
    of = met.groupBy("key").agg(F.collect_list(F.struct("at", "size", "wid")).alias("hits"))
    cut = F.transform("hits", lambda h: F.struct(h["at"].alias("at"), h["size"].alias("size"), h["wid"].alias("wid"), F.slice("w", h["at"] + 1, h["size"]).alias("gram")))
    found = again(common.materialize(met.select("key").distinct(), "hit-keys")).join(of, "key").select("key", F.explode(cut).alias("h")).select("key", "h.*")
    grams = w.select("wid", "window")
    hits = (found.join(F.broadcast(grams), "wid") if small else common.join_counted(found, grams, "wid")).where(F.col("gram") == F.col("window"))
    return counts, hits.select("key", "at", "size", "wid").distinct(), holders


def covered(hits: DataFrame) -> DataFrame:
    """(key, n_hit): words inside any hit, each once."""
    w = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    longest = hits.groupBy("key", "at").agg(F.max(F.col("at") + F.col("size")).alias("end"))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("at"), F.coalesce(F.max("end").over(w), F.lit(0))))
    return longest.withColumn("fresh", fresh).groupBy("key").agg(F.sum("fresh").cast("long").alias("n_hit"))


def _judged(docs: DataFrame, bench: DataFrame, n: int, percent: int, max_broadcast: int | None) -> DataFrame:
    counts, hits, holders = find_hits(docs, bench, n, max_broadcast)
    hits = common.materialize(hits, "hits")
    pairs = hits.select("key", "wid").distinct()
    items = holders.groupBy("wid").agg(F.collect_set("item").alias("item"))
    small = common.size_in_bytes(holders) <= (common.BROADCAST_BYTES if max_broadcast is None else max_broadcast)
    pairs = (pairs.join(F.broadcast(items), "wid") if small else common.join_counted(pairs, items, "wid")).select("key", F.explode_outer("item").alias("item"))
    items = pairs.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = covered(hits).join(items, "key", "left")
    none = F.array().cast("array<string>")
    joined = counts.join(found, "key", "left").select("key", "copies", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))
    return joined.select(
        "key", "copies", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)).alias("contaminated"),
    )


def contamination(docs: DataFrame, bench: DataFrame, n: int = 13, percent: int = 5, max_broadcast: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated), one row for each of ``docs(doc_id, text)``.

    A document is contaminated if at least ``percent`` percent of its words are hit.  A null
    or empty text has no words and is never contaminated.  Rows with a null or repeated doc_id are
    judged each by its own text.  A hit on an item without an id counts, but names no item.
    Columns of other names take no part.
    """
    found = _judged(docs, bench, n, percent, max_broadcast)
    return found.select(F.col("key.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items", "items", "contaminated", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def remove_documents(docs: DataFrame, bench: DataFrame, n: int = 13, percent: int = 5) -> DataFrame:
    """``docs`` without contaminated rows; see :func:`contamination`."""
    bad = _judged(docs, bench, n, percent, None).where("contaminated").select("key")
    return common.without_rows(docs, common.materialize(bad, "contaminated"))


def remove_spans(docs: DataFrame, bench: DataFrame, n: int = 13) -> DataFrame:
    """``docs`` with every hit word, and what stands between it and the next word, cut out of
    ``text``; other texts, and all other columns, are left as they are."""
    _, hits, _ = find_hits(docs, bench, n)
    key, gone = common.spare(docs, "key", "gone")
    spans = hits.select("key", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("at")).groupBy("key").agg(F.array_sort(F.collect_set("at")).alias(gone))
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    tokens = F.regexp_extract_all("text", F.lit(f"({word})"), 0)
    lead = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    cut = docs.withColumn(key, common.row_key()).join(spans.withColumnRenamed("key", key), key, "left")
    rest = F.concat(lead, F.array_join(common.drop_positions(tokens, F.col(gone)), ""))
    return cut.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(rest)).select(*[f"`{c}`" for c in docs.columns])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = contamination(docs, common.read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP10_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bw),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, i, pos.n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM pos) pos JOIN win USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
