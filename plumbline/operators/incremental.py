"""Incremental maintenance: merges, closures, fingerprints, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import cut, rounds


def replace_merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``new``, then ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def common_paths(left: DataFrame, right: DataFrame, path: str = "path") -> DataFrame:
    """The paths that both sides have, each once."""
    return left.select(path).join(right.select(path), path, "left_semi").distinct()


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as an aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


@rounds
def closure(spark: SparkSession, edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node) reachable from ``start(node)`` over ``edges(src, dst)``, by rounds of a semi-join
    on the new nodes until none is new, however many that takes.  Each round is a written table."""
    edges = cut(edges.select("src", "dst").distinct())
    made: list[str] = []
    fresh = cut(start.select("node").distinct(), made)
    read = lambda: spark.read.schema(fresh.schema).parquet(*made)
    while True:
        step = edges.join(fresh, edges.src == fresh.node, "left_semi").select(F.col("dst").alias("node")).distinct()
        now = cut(step.join(read(), "node", "left_anti"), made)
        if now.isEmpty():
            return read()
        fresh = now
        if len(made) >= 32:
            old, made = made, []
            cut(spark.read.schema(fresh.schema).parquet(*old), made)


def bucketed_fingerprint(parts: DataFrame, by: str, part: str) -> DataFrame:
    """(by, fingerprint): SHA-256 over all hex digests ``part`` of each value of ``by``, in order.  Digests
    are first hashed by their first two digits, so that no list has more than a 256th of a group, as
    digests go, and then the hashes of these parts."""
    first = parts.groupBy(by, F.substring(part, 1, 2).alias("_two")).agg(fingerprint(F.collect_list(part)).alias("_fp"))
    return first.groupBy(by).agg(fingerprint(F.collect_list(F.concat("_two", "_fp"))).alias("fingerprint"))


def fingerprint(parts: Column) -> Column:
    """SHA-256 of a sorted list of strings, a line each."""
    return F.sha2(F.array_join(F.sort_array(parts), "\n").cast("binary"), 256)


def ancestors(path: Column) -> Column:
    """All prefixes of a path at its slashes, the longest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _dyadic(lo: Column, hi: Column, levels: int) -> Column:
    """The least set of blocks (level k, number b: the integers from b * 2**k on, 2**k of them) that together
    are the integers from ``lo`` to ``hi``: at most two a level."""

    def at(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        left, right = F.ceil(lo / size).cast("long"), F.floor((hi + 1) / size).cast("long")
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        first = F.when(odd(left) & (left < right), F.struct(k.alias("k"), left.alias("b")))
        last = F.when(odd(right) & (left + odd(left).cast("long") < right), F.struct(k.alias("k"), (right - 1).alias("b")))
        return F.array_compact(F.array(first, last))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


#: Rows of a key, points and ranges together, up to which one task walks them.
WALK_ROWS = 1_000_000


def innermost(points: DataFrame, ranges: DataFrame, key: str, point: str, lo: str, hi: str, nested: bool = False) -> DataFrame:
    """The innermost range of ``ranges`` that holds each point (integers): the one that starts last and
    ends first.  Points that repeat are kept, each with its range; those in none go.

    Points and ranges of a key are walked once in order: the last range to start is the innermost if it still holds the
    point, and if all that have started are over there is none.  With ``nested`` (ranges of a key are disjoint or
    nested, and none repeats) so is the first to end, if it has started.  Only points for which nothing of this is so, and keys of more than
    ``WALK_ROWS`` rows, are looked up by blocks.

    There a range is cut into blocks whose sizes are powers of two, and a place is in one block of each size,
    so the join on key and block meets just the ranges that hold a place; a key with many of both is
    spread over its blocks, and no others are paired.  Only sizes that some range has are looked up, and a place
    that many points share is looked up once.
    """
    rest = [c for c in ranges.columns if c != key]
    own = [c for c in points.columns if c not in (key, point)]
    out = [*points.columns, *[F.col(f"_r.{c}").alias(c) for c in rest]]
    inside, asked = ranges.where(F.col(lo) <= F.col(hi)), points.where(F.col(point).isNotNull() & F.col(key).isNotNull())
    rows = inside.select(key).unionAll(asked.select(key)).groupBy(key).agg(F.count("*").alias("_n"))
    large = cut(rows.where(F.col("_n") > WALK_ROWS).select(key))
    whole = not large.isEmpty()
    some = lambda df: df.join(F.broadcast(large), key, "left_anti") if whole else df

    at = F.floor(point).cast("long")
    carried = F.struct(F.lit(True).alias("_"), *own)
    kinds = points.select(F.col(point), carried.alias("_p")).schema
    starts = some(inside).select(
        key, F.lit(0).alias("_turn"), F.col(lo).cast("long").alias("_from"), F.col(hi).cast("long").alias("_to"), F.struct(*rest).alias("_r"), F.lit(None).cast(kinds[point].dataType).alias(point), F.lit(None).cast(kinds["_p"].dataType).alias("_p")
    )
    asks = some(asked).select(key, F.lit(1).alias("_turn"), at.alias("_from"), at.alias("_to"), F.lit(None).cast(ranges.select(F.struct(*rest).alias("_r")).schema["_r"].dataType).alias("_r"), point, carried.alias("_p"))
    run = (Window.unboundedPreceding, Window.currentRow)
    forth = Window.partitionBy(key).orderBy("_from", "_turn", F.desc("_to"), F.desc("_r")).rowsBetween(*run)
    back = Window.partitionBy(key).orderBy(F.desc("_to"), "_turn", "_from").rowsBetween(*run)
    before = lambda w: F.last("_r", ignorenulls=True).over(w)
    walk = starts.unionByName(asks).withColumns({"_last": before(forth), "_far": F.max(F.when(F.col("_turn") == 0, F.col("_to"))).over(forth)})
    near = F.when(F.col(f"_last.{hi}") >= F.col("_to"), F.col("_last"))
    if nested:
        walk = walk.withColumn("_first", before(back))
        near = near.when(F.col(f"_first.{lo}") <= F.col("_from"), F.col("_first"))
    walk = cut(walk.where("_turn = 1 AND _far >= _from").select(key, point, *[F.col(f"_p.{c}").alias(c) for c in own], near.alias("_r")))
    found, todo = walk.where("_r IS NOT NULL").select(*out), walk.where("_r IS NULL").select(*points.columns)
    if whole:
        todo = todo.unionByName(asked.join(F.broadcast(large), key, "left_semi"))
    if todo.isEmpty():
        return found
    return found.unionByName(_by_blocks(todo, inside.join(todo.select(key).distinct(), key, "left_semi"), key, point, lo, hi))


def _by_blocks(points: DataFrame, inside: DataFrame, key: str, point: str, lo: str, hi: str) -> DataFrame:
    """``innermost`` by the blocks of ranges alone, none of which is empty."""
    widest = inside.agg(F.max(F.col(hi) - F.col(lo) + 1)).first()[0] or 1
    levels = max(1, int(widest).bit_length())
    blocks = inside.select(*inside.columns, F.explode(_dyadic(F.col(lo), F.col(hi), levels)).alias("_block"))
    sizes = sorted(r[0] for r in blocks.select("_block.k").distinct().collect())  # at most 64
    at = F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col(point) / (1 << k)).cast("long").alias("b")) for k in sizes or [0]])
    spread = points.select(key, point).distinct().select(key, point, F.explode(at).alias("_block"))
    rest = [c for c in inside.columns if c != key]
    best = F.min(F.struct((-F.col(lo)).alias("_l"), F.col(hi).alias("_h"), *rest))
    found = spread.join(blocks, [key, "_block"]).groupBy(key, point).agg(best.alias("_r"))
    return points.join(found, [key, point]).select(*points.columns, *[F.col(f"_r.{c}").alias(c) for c in rest])


def resolve(calls: DataFrame, targets: DataFrame, scopes: list[list[str]], id: str, to: str) -> DataFrame:
    """``calls`` with the target of the first of ``scopes`` (lists of key columns) that has any
    candidate, as column ``to``; null if it has more than one or none has any.  Candidates are counted
    before the joins, so a key that many targets share stays one row."""
    out, found = calls, F.lit(None)
    for i, keys in enumerate(scopes):
        one = targets.groupBy(*keys).agg(F.min(id).alias(f"_lo{i}"), F.max(id).alias(f"_hi{i}"))
        out = out.join(one, keys, "left")
    for i in reversed(range(len(scopes))):
        unique = F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}"))
        found = F.when(F.col(f"_lo{i}").isNotNull(), unique).otherwise(found)
    return out.select(*calls.columns, found.alias(to))


def unusable_ranges(ranges: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """The values of ``key`` whose ranges cross, repeat or are empty, so that nothing can be looked up
    in them.

    Ends and starts are walked in order with a count of the open ranges.  A range that crosses none
    finds as many open behind it as before it, and of ranges that cross, the first to start finds
    more.  One window over the key, no pairs.
    """
    ends = F.array(F.struct(F.col(hi).alias("pos"), F.lit(0).alias("turn"), (-F.col(lo)).alias("tie"), F.lit(-1).alias("d")), F.struct(F.col(lo).alias("pos"), F.lit(1).alias("turn"), (-F.col(hi)).alias("tie"), F.lit(1).alias("d")))
    events = ranges.select(key, lo, hi, F.explode(ends).alias("e")).select(key, lo, hi, "e.*")
    w = Window.partitionBy(key).orderBy("pos", "turn", "tie").rowsBetween(Window.unboundedPreceding, 0)
    open_ = events.withColumn("open", F.sum("d").over(w))
    before, behind = F.max(F.when(F.col("d") == 1, F.col("open") - 1)), F.max(F.when(F.col("d") == -1, F.col("open")))
    wrong = open_.groupBy(key, lo, hi).agg(((F.count("*") != 2) | (before != behind) | (F.col(lo) >= F.col(hi))).alias("wrong"))
    return wrong.where("wrong").select(key).distinct()


def enclosing(points: DataFrame, ranges: DataFrame, key: str, point: str, lo: str, hi: str) -> DataFrame:
    """``innermost`` among the keys whose ranges are disjoint or nested; other points stay without one."""
    return innermost(points, ranges.join(unusable_ranges(ranges, key, lo, hi), key, "left_anti"), key, point, lo, hi, nested=True)


#: Routines of a path up to which they are one row, and findings up to which one task takes them.
FEW_ROUTINES, MANY_FINDINGS = 128, 1_000_000


def associate(found: DataFrame, routines: DataFrame) -> DataFrame:
    """``found(path, at, symbol, ...)`` with the ``routine`` of ``routines(path, routine, symbol, lo, hi)`` that each belongs to; null
    if there is none.

    A finding that names a symbol belongs to the innermost routine of that symbol that holds it, and to no other;
    one that names none (null or empty) to the innermost of all.  Where ranges of those looked up cross, repeat
    or are empty, nothing is associated.  Findings that repeat are all kept.

    The routines of a path are one row, and its findings meet it in one join, so either table is shuffled once.  Only paths of
    more than ``FEW_ROUTINES`` routines or ``MANY_FINDINGS`` findings, and those that are null, are looked up range by range.
    """
    count = lambda df, r: df.select("path", F.lit(r).alias("_r"))
    rows = count(routines, 1).unionByName(count(found, 0)).groupBy("path").agg(F.sum("_r").alias("_r"), F.count("*").alias("_n"))
    large = cut(rows.where((F.col("_r") > FEW_ROUTINES) | (F.col("_n") - F.col("_r") > MANY_FINDINGS) | F.col("path").isNull()).select("path"))
    if large.isEmpty():
        return _associate_by_path(found, routines)
    split = lambda df, how: df.join(large, df["path"].eqNullSafe(large["path"]), how)
    rest = _associate_by_range(split(found, "left_semi"), split(routines, "left_semi"))
    return _associate_by_path(split(found, "left_anti"), split(routines, "left_anti")).unionByName(rest)


def _associate_by_path(found: DataFrame, routines: DataFrame) -> DataFrame:
    """``associate`` for paths of few routines, in pairs within a row."""
    named = lambda c: F.coalesce(c, F.lit("")) != ""

    def wrong(r: Column, i: Column, same) -> Column:
        """Whether a range is empty, equals the one before, or another one has one end alone in it; a missing end comes before all
        others.  Only those that are the ``same`` count."""
        before = F.get("_rs", i - 1)
        equal = (i > 0) & before["lo"].eqNullSafe(r["lo"]) & before["hi"].eqNullSafe(r["hi"]) & same(before)
        starts = lambda q: (r["lo"] < q["lo"]) & (q["lo"] < r["hi"]) & (q["hi"].isNull() | (q["hi"] > r["hi"]))
        ends = lambda q: q["lo"].isNull() & (r["lo"] < q["hi"]) & (q["hi"] <= r["hi"])
        crossed = F.exists("_rs", lambda q: F.coalesce((starts(q) | ends(q)) & same(q), F.lit(False)))
        return F.coalesce(r["lo"] >= r["hi"], F.lit(False)) | F.coalesce(equal, F.lit(False)) | crossed

    # in the order of their fields; what is wrong among the ranges of its symbol is wrong among all
    by_path = routines.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "symbol", "routine"))).alias("_rs"))
    of_all = F.transform("_rs", lambda r, i: r.withField("all", wrong(r, i, lambda q: F.lit(True))))
    of_own = F.transform("_rs", lambda r, i: r.withField("own", r["all"] & wrong(r, i, lambda q: q["symbol"] == r["symbol"])))
    by_path = by_path.select("path", of_all.alias("_rs")).select("path", of_own.alias("_rs"))
    at = F.floor("at").cast("long")
    looked = F.when(named(F.col("symbol")), F.filter("_rs", lambda r: r["symbol"] == F.col("symbol"))).otherwise(F.col("_rs"))
    usable = ~F.exists("_looked", lambda r: F.when(named(F.col("symbol")), r["own"]).otherwise(r["all"]))
    holding = F.filter("_looked", lambda r: (r["lo"] <= at) & (at <= r["hi"]))
    inner = F.array_max(F.transform(holding, lambda r: F.struct(r["lo"].alias("lo"), (-r["hi"]).alias("hi"), r["routine"].alias("routine"))))
    met = found.join(by_path, "path", "left").select(*found.columns, looked.alias("_looked"))
    return met.select(*found.columns, F.when(usable, inner["routine"]).alias("routine"))


def _associate_by_range(found: DataFrame, routines: DataFrame) -> DataFrame:
    """``associate`` for paths of any size, by a join on path and symbol."""
    named = F.coalesce(F.col("symbol"), F.lit("")) != ""
    key = lambda symbol: F.struct("path", symbol.alias("symbol"))
    looked = F.when(named, F.col("symbol"))
    places = found.select(key(looked).alias("_key"), F.col("at").alias("_at")).distinct()
    own = routines.where(named).select(key(F.col("symbol")).alias("_key"), "lo", "hi", "routine")
    all_ = routines.select(key(F.lit(None).cast("string")).alias("_key"), "lo", "hi", "routine")
    # keys are compared as text, as a struct with a null meets no other
    text = lambda df: df.withColumn("_key", F.to_json("_key"))
    best = enclosing(text(places), text(own.unionByName(all_)), "_key", "_at", "lo", "hi").select("_key", "_at", "routine")
    keyed = text(found.select(*found.columns, key(looked).alias("_key")))
    return keyed.join(best, (keyed["_key"] == best["_key"]) & (keyed["at"] == best["_at"]), "left").select(*[keyed[c] for c in found.columns], "routine")


def link_methods(types: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, type, location, fn): routines of ``functions(path, location, fn)`` by the locations that
    ``types(path, type, locations)`` names; a location of two routines is an error."""
    once = functions.groupBy("path", "location").agg(F.min("fn").alias("fn"), F.count("*").alias("n"))
    sure = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two routines at "), "path", F.lit(":"), F.col("location").cast("string"))).cast("string")).otherwise(F.col("fn"))
    return types.select("path", "type", F.explode("locations").alias("location")).join(once, ["path", "location"]).select("path", "type", "location", sure.alias("fn"))


def join_path(base: Column, relative: Column) -> Column:
    """A relative path from a directory, without ``.`` and ``..``; what would leave the root is null."""
    parts = F.split(F.concat_ws("/", base, relative), "/")
    step = lambda acc, p: F.when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) == 0), F.array(F.lit(None).cast("string"))).when(p == "..", F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array_append(acc, p))
    out = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(~F.exists(out, lambda p: p.isNull()), F.array_join(out, "/"))
