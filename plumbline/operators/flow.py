"""Control flow of all routines at once: dominators, loops, and what is held at exits.

Graphs are one table of edges ``(routine, src, dst)`` with an entry for each routine.  A routine of at most ``BITS`` nodes and ``ROWS`` edges is
one row, its sets of nodes are words of bits, and no round is a shuffle.  All others go by rounds: every round is one join and one
aggregate over all routines that still change, written to a table; rounds are bounded by the depth of the deepest graph, not by the number
of routines.  A self-edge is a loop; edges that repeat count once; what an entry doesn't reach takes no part, nor do edges with nulls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut, rounds

#: Bits of a word of a bit set.
BITS = 62
#: Places that bear witness to one resource, at most, that are listed.
WITNESSES = 32
#: Edges, or events, of a routine that are one row.
ROWS = 4096


# -- routines of one row: a node is its place among the sorted nodes, a set of nodes is a word of bits


def _none() -> Column:
    return F.lit(0).cast("long")


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _has(word: Column, i: Column) -> Column:
    return word.bitwiseAND(_bit(i)) != 0


def _any(items: Column, word: Callable[[Column], Column]) -> Column:
    """The bits that some item has."""
    return F.aggregate(items, _none(), lambda m, x: m.bitwiseOR(word(x)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _settled(first: Column, step: Callable[[Column], Column], most: Column) -> Column:
    """What ``step`` makes of ``first`` when it changes no more, after ``most`` steps at the latest."""
    start = F.struct(first.alias("now"), F.lit(False).alias("done"))
    go = lambda s: _let(step(s["now"]), lambda x: F.struct(x.alias("now"), (x == s["now"]).alias("done")))
    return F.aggregate(F.sequence(F.lit(1), most), start, lambda s, _: F.when(s["done"], s).otherwise(go(s)), lambda s: s["now"])


def _listed(rows: DataFrame, name: str) -> DataFrame:
    """(routine, name, n): the rows of each routine as a list, which is empty if they are more than ``ROWS``."""
    others = F.struct(*[c for c in rows.columns if c != "routine"])
    counted = rows.select("routine", others.alias("x"), F.count("*").over(Window.partitionBy("routine")).alias("n"))
    return counted.groupBy("routine").agg(F.collect_list(F.when(F.col("n") <= ROWS, F.col("x"))).alias(name), F.max("n").alias("n"))


def _graphs(edges: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(routine, nodes, before, leaf, dom) of all routines of one row, and the routines of all others, if there are any: for
    each node the places of those before it, whether it has no edges, and the word of its dominators, below zero if it isn't reached."""
    e = edges.where("routine IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL").select("routine", "src", "dst")
    e = e.unionByName(entries.where("entry IS NOT NULL").select("routine", F.lit(None).cast(e.schema["src"].dataType).alias("src"), F.col("entry").alias("dst")))
    g = _listed(e, "e").where(F.exists("e", lambda x: x["src"].isNull()) | (F.col("n") > ROWS))
    g = g.withColumn("e", F.array_distinct("e"))
    nodes = F.array_sort(F.array_distinct(F.concat(F.transform("e", lambda x: x["dst"]), F.array_compact(F.transform("e", lambda x: x["src"])))))
    g = g.select("routine", "e", nodes.alias("nodes"), F.col("n"))

    def of(nodes: Column) -> Column:
        before = F.transform(nodes, lambda x: F.transform(F.filter("e", lambda d: (d["dst"] == x) & d["src"].isNotNull()), lambda d: (F.array_position(nodes, d["src"]) - 1).cast("int")))
        entry = F.transform(nodes, lambda x: F.exists("e", lambda d: (d["dst"] == x) & d["src"].isNull()))
        leaf = F.transform(nodes, lambda x: ~F.exists("e", lambda d: F.coalesce(d["src"] == x, F.lit(False))))
        return F.struct(nodes.alias("nodes"), before.alias("before"), entry.alias("entry"), leaf.alias("leaf"))

    def ruled(x: Column) -> Column:
        # all bits until an entry is known to lead here; the entry has no dominators but itself, whatever leads back to it
        every = F.lit(-1).cast("long")
        first = F.transform(x["entry"], lambda is_entry, i: F.when(is_entry, _bit(i)).otherwise(every))
        kept = lambda dom, i: F.aggregate(F.get(x["before"], i), every, lambda m, p: m.bitwiseAND(F.get(dom, p)))
        step = lambda dom: F.transform(dom, lambda d, i: F.when(F.get(x["entry"], i), d).otherwise(kept(dom, i).bitwiseOR(_bit(i))))
        return F.struct(x["nodes"].alias("nodes"), x["before"].alias("before"), x["leaf"].alias("leaf"), _settled(first, step, F.size(x["nodes"])).alias("dom"))

    small = (F.col("n") <= ROWS) & (F.size("nodes") <= BITS)
    g = cut(g.select("routine", F.when(small, _let(F.col("nodes"), lambda n: _let(of(n), ruled))).alias("g")))
    rest = g.where("g IS NULL").select("routine")
    return g.where("g IS NOT NULL").select("routine", "g.*"), None if rest.isEmpty() else rest


def _places(nodes: Column) -> Column:
    return F.sequence(F.lit(0), F.size(nodes) - 1)


def _reached(then: Callable[[Column], Column]) -> Column:
    """A row for each reached node, of what ``then`` says of its place."""
    return F.explode(F.transform(F.filter(_places(F.col("nodes")), lambda i: F.get("dom", i) >= 0), then)).alias("x")


def _of(rest: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The rows of some routines, written."""
    return [cut(t.join(rest, "routine", "left_semi")) for t in tables]


@rounds
def dominators(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(routine, node, dom) of ``edges(routine, src, dst)`` and ``entries(routine, entry)``: every node that lies on all ways from
    the entry to ``node``, which is one of them."""
    g, rest = _graphs(edges, entries)
    doms = lambda i: F.transform(F.filter(_places(F.col("nodes")), lambda j: _has(F.get("dom", i), j)), lambda j: F.get("nodes", j))
    out = g.select("routine", _reached(lambda i: F.struct(F.get("nodes", i).alias("node"), doms(i).alias("dom"))))
    out = out.select("routine", "x.node", F.explode("x.dom").alias("dom"))
    return out if rest is None else out.unionByName(_dominators(*_of(rest, edges, entries)))


@rounds
def dominator_tree(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """``immediate(dominators(edges, entries))``, without a row for each dominator where a routine is one row."""
    g, rest = _graphs(edges, entries)
    n = lambda i: F.bit_count(F.get("dom", i))
    # dominators of a node are a chain
    near = lambda i: F.get(F.filter(_places(F.col("nodes")), lambda j: _has(F.get("dom", i), j) & (n(j) == n(i) - 1)), 0)
    out = g.select("routine", _reached(lambda i: F.struct(F.get("nodes", i).alias("node"), F.get("nodes", near(i)).alias("idom"), (n(i) - 1).cast("long").alias("depth"))))
    out = out.select("routine", "x.*")
    return out if rest is None else out.unionByName(immediate(_dominators(*_of(rest, edges, entries))))


@rounds
def loop_nesting(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """``nesting`` of the ``loops`` of all routines."""
    g, rest = _graphs(edges, entries)

    def body(before: Column, h: Column, ends: Column) -> Column:
        step = lambda b: F.aggregate(before, F.struct(b.alias("m"), F.lit(0).alias("i")), lambda s, w: F.struct(F.when((s["i"] != h) & _has(b, s["i"]), s["m"].bitwiseOR(w)).otherwise(s["m"]).alias("m"), (s["i"] + 1).alias("i")), lambda s: s["m"])
        return _settled(_bit(h).bitwiseOR(_any(ends, _bit)), step, F.size(before))

    back = lambda h: F.filter(F.get("before", h), lambda s: (F.get("dom", s) >= 0) & _has(F.get("dom", s), h))
    words = F.transform("before", lambda b: _any(b, lambda p: F.when(F.get("dom", p) >= 0, _bit(p)).otherwise(_none())))
    headers = F.filter(_places(F.col("nodes")), lambda h: F.size(back(h)) > 0)
    found = _let(words, lambda w: F.transform(headers, lambda h: F.struct(F.get("nodes", h).alias("header"), body(w, h, back(h)).alias("body"))))
    mine = lambda found, i: F.filter(found, lambda x: _has(x["body"], i))
    near = lambda held: F.array_min(F.transform(held, lambda x: F.struct(F.bit_count(x["body"]).alias("size"), x["header"].alias("header"))))["header"]
    node = lambda i, held: F.struct(F.get("nodes", i).alias("node"), F.size(held).cast("long").alias("loops"), near(held).alias("header"))
    reached = lambda found: F.transform(F.filter(_places(F.col("nodes")), lambda i: F.get("dom", i) >= 0), lambda i: _let(mine(found, i), lambda held: node(i, held)))
    out = g.select("routine", F.explode(_let(found, reached)).alias("x")).select("routine", "x.*")
    if rest is None:
        return out
    few = _of(rest, edges, entries)
    dom = _dominators(*few)
    return out.unionByName(nesting(dom, loops(few[0], dom)))


# -- routines of any size, by rounds


def _tree(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(routine, node, dom): the nodes on one shortest way from the entry to each reachable node, itself included."""
    spark, paths = edges.sparkSession, []
    fresh = entries.select("routine", F.col("entry").alias("node"), F.col("entry").alias("dom")).distinct()
    schema = fresh.schema
    fresh = cut(fresh, paths)
    while True:
        known = spark.read.schema(schema).parquet(*paths)
        reached = known.select("routine", "node").distinct()
        step = fresh.select("routine", F.col("node").alias("src")).distinct().join(edges, ["routine", "src"])
        first = step.groupBy("routine", "dst").agg(F.min("src").alias("src"))
        first = cut(first.join(reached.withColumnRenamed("node", "dst"), ["routine", "dst"], "left_anti"))
        if first.isEmpty():
            break
        way = first.join(fresh.withColumnRenamed("node", "src"), ["routine", "src"]).select("routine", F.col("dst").alias("node"), "dom")
        fresh = cut(way.unionByName(first.select("routine", F.col("dst").alias("node"), F.col("dst").alias("dom"))), paths)
    return known


@rounds
def _dominators(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """``dominators`` by rounds.

    The nodes of a shortest way are a first guess that holds all dominators; a node keeps of it what is kept by all
    nodes before it, until nothing more goes.
    """
    edges = cut(edges.select("routine", "src", "dst").distinct())
    dom = _tree(edges, entries)
    inside = dom.select("routine", F.col("node").alias("src")).distinct()
    own = entries.select("routine", F.col("entry").alias("dst"))
    # the entry has no dominators but itself, whatever leads back to it
    live = cut(edges.join(inside, ["routine", "src"]).join(own, ["routine", "dst"], "left_anti"))
    degree = live.groupBy("routine", F.col("dst").alias("node")).agg(F.count("*").alias("n_before"))
    open_, results = dom, []
    while True:
        before = live.join(open_.withColumnRenamed("node", "src"), ["routine", "src"]).groupBy("routine", F.col("dst").alias("node"), "dom").agg(F.count("*").alias("n"))
        kept = before.join(degree, ["routine", "node"]).where("n = n_before").select("routine", "node", "dom")
        nodes = open_.select("routine", "node").distinct()
        now = cut(kept.where("node <> dom").unionByName(nodes.select("routine", "node", F.col("node").alias("dom"))))
        # routines in which nothing went are done
        size = lambda d, c: d.groupBy("routine").agg(F.count("*").alias(c))
        moving = cut(size(open_, "a").join(size(now, "b"), "routine").where("a <> b").select("routine"))
        settled = cut(now.join(moving, "routine", "left_anti"), results)
        if moving.isEmpty():
            break
        open_ = cut(now.join(moving, "routine", "left_semi"))
    return edges.sparkSession.read.schema(settled.schema).parquet(*results)


def immediate(dom: DataFrame) -> DataFrame:
    """(routine, node, idom, depth) of ``dominators``: the closest other dominator, null for the entry, and how many
    there are above."""
    depth = dom.groupBy("routine", "node").agg((F.count("*") - 1).alias("depth"))
    above = dom.where("node <> dom").join(depth.select("routine", F.col("node").alias("dom"), F.col("depth").alias("above")), ["routine", "dom"])
    near = above.groupBy("routine", "node").agg(F.max_by("dom", "above").alias("idom"))
    return depth.join(near, ["routine", "node"], "left").select("routine", "node", "idom", "depth")


@rounds
def loops(edges: DataFrame, dom: DataFrame) -> DataFrame:
    """(routine, header, node): the natural loop of each header, which dominates the start of an edge that leads back to it."""
    spark, paths = edges.sparkSession, []
    edges = cut(edges.select("routine", "src", "dst").distinct())
    inside = dom.select("routine", F.col("node").alias("src")).distinct()
    edges = cut(edges.join(inside, ["routine", "src"]))
    back = edges.join(dom.select("routine", F.col("node").alias("src"), F.col("dom").alias("dst")), ["routine", "src", "dst"])
    body = F.explode(F.array_distinct(F.array("dst", "src")))
    fresh = cut(back.select("routine", F.col("dst").alias("header"), body.alias("node")).distinct(), paths)
    schema = fresh.schema
    while not fresh.isEmpty():
        known = spark.read.schema(schema).parquet(*paths)
        step = fresh.where("node <> header").withColumnRenamed("node", "dst").join(edges, ["routine", "dst"])
        fresh = cut(step.select("routine", "header", F.col("src").alias("node")).distinct().join(known, ["routine", "header", "node"], "left_anti"), paths)
    return spark.read.schema(schema).parquet(*paths)


def nesting(dom: DataFrame, loop: DataFrame) -> DataFrame:
    """(routine, node, loops, header) of every reachable node: how many loops it is in, and the header of the innermost, which is
    that of the smallest loop (then the first header)."""
    size = loop.groupBy("routine", "header").agg(F.count("*").alias("size"))
    held = loop.join(size, ["routine", "header"]).groupBy("routine", "node").agg(F.count("*").alias("loops"), F.min(F.struct("size", "header")).alias("near"))
    out = dom.select("routine", "node").distinct().join(held, ["routine", "node"], "left")
    return out.select("routine", "node", F.coalesce("loops", F.lit(0)).alias("loops"), F.col("near.header").alias("header"))


@rounds
def held_at_exits(edges: DataFrame, entries: DataFrame, events: DataFrame) -> DataFrame:
    """(routine, resource, acquired, exits, held, exits_held, released): for each resource of ``events(routine, node, pos, resource, kind)``
    that is acquired at a reachable node, whether some way leads from an acquisition to an exit without a release.

    ``kind`` is ``acquire`` or ``release``; events of a node happen in the order of ``pos``, and the last one of a resource decides what
    the node leaves.  An exit is a node without edges.  ``exits_held`` has the first ``WITNESSES`` exits at which the resource may
    still be held, ``held`` counts all of them, and ``released`` is true if there is none and some exit is reached at all.
    Resources are bits of words by their rank in the routine, and nodes pass words on until nothing is added.  A routine of one row has at
    most ``BITS`` resources too.
    """
    g, rest = _graphs(edges, entries)
    last = events.where("resource IS NOT NULL").groupBy("routine", "node", "resource").agg(F.max_by("kind", "pos").alias("kind"), F.count_if(F.col("kind") == "acquire").alias("n"))
    j = g.join(_listed(last, "v"), "routine")
    at = lambda node: (F.array_position("nodes", node) - 1).cast("int")
    seen = F.filter("v", lambda x: F.coalesce(F.get("dom", at(x["node"])) >= 0, F.lit(False)))
    j = j.withColumn("many", F.col("n") > ROWS)

    def of(v: Column, names: Column) -> Column:
        rank = lambda x: (F.array_position(names, x["resource"]) - 1).cast("int")
        ones = lambda kind: F.transform("nodes", lambda node: _any(F.filter(v, lambda x: (x["node"] == node) & (x["kind"] == kind) & F.array_contains(names, x["resource"])), lambda x: _bit(rank(x))))
        passed = lambda now, i: _any(F.get("before", i), lambda p: F.get(now, p))
        step = lambda gen, kill: lambda now: F.transform(gen, lambda w, i: w.bitwiseOR(passed(now, i).bitwiseAND(F.bitwise_not(F.get(kill, i)))))
        exits = F.filter(_places(F.col("nodes")), lambda i: F.get("leaf", i) & (F.get("dom", i) >= 0))
        held = lambda left, exits, r: F.transform(F.filter(exits, lambda i: _has(F.get(left, i), r)), lambda i: F.get("nodes", i))
        acquired = lambda name: F.aggregate(F.filter(v, lambda x: x["resource"] == name), _none(), lambda m, x: m + x["n"])
        row = lambda left, exits: lambda name, r: F.struct(name.alias("resource"), acquired(name).alias("acquired"), F.size(exits).cast("long").alias("exits"), held(left, exits, r).alias("all"))
        left = _let(ones("acquire"), lambda gen: _let(ones("release"), lambda kill: _settled(gen, step(gen, kill), F.size("nodes"))))
        return _let(left, lambda left: _let(exits, lambda exits: F.transform(names, row(left, exits))))

    names = lambda v: F.array_sort(F.array_distinct(F.transform(F.filter(v, lambda x: x["n"] > 0), lambda x: x["resource"])))
    found = _let(seen, lambda v: _let(names(v), lambda names: F.when(~F.col("many") & (F.size(names) <= BITS), of(v, names))))
    found = cut(j.select("routine", found.alias("found")))
    out = found.select("routine", F.explode("found").alias("x")).select("routine", "x.*")
    n = F.size("all").cast("long")
    out = out.select("routine", "resource", "acquired", "exits", n.alias("held"), F.slice("all", 1, WITNESSES).alias("exits_held"), ((n == 0) & (F.col("exits") > 0)).alias("released"))
    more = found.where("found IS NULL").select("routine")
    more = more if rest is None else more.unionByName(rest)
    return out if more.isEmpty() else out.unionByName(_held_at_exits(*_of(more, edges, entries, events)))


@rounds
def _held_at_exits(edges: DataFrame, entries: DataFrame, events: DataFrame) -> DataFrame:
    """``held_at_exits`` by rounds."""
    spark, paths = edges.sparkSession, []
    edges = cut(edges.select("routine", "src", "dst").distinct())
    nodes = _reach(edges, entries)
    last = events.groupBy("routine", "node", "resource").agg(F.max_by("kind", "pos").alias("kind"))
    last = last.join(nodes, ["routine", "node"], "left_semi")
    taken = events.where("kind = 'acquire'").join(nodes, ["routine", "node"], "left_semi")
    ranks = taken.groupBy("routine", "resource").agg(F.count("*").alias("acquired"))
    # the rank of a resource among those of its routine, from one sorted list of names a routine
    listed = ranks.groupBy("routine").agg(F.array_sort(F.collect_list("resource")).alias("all"))
    place = cut(listed.select("routine", F.posexplode("all").alias("rank", "resource")).join(ranks, ["routine", "resource"]))
    word, bit = F.floor(F.col("rank") / BITS).cast("int"), F.expr(f"shiftleft(1L, CAST(rank % {BITS} AS INT))")
    ones = lambda kind: F.bit_or(F.when(F.col("kind") == kind, F.col("bit")).otherwise(F.lit(0).cast("long")))
    effect = cut(last.join(place.select("routine", "resource", word.alias("word"), bit.alias("bit")), ["routine", "resource"]).groupBy("routine", "node", "word").agg(ones("acquire").alias("gen"), ones("release").alias("kill")))
    # what a node leaves, as far as it is new
    fresh = cut(effect.where("gen <> 0").select("routine", "node", "word", F.col("gen").alias("bits")), paths)
    schema = fresh.schema
    while not fresh.isEmpty():
        known = spark.read.schema(schema).parquet(*paths).groupBy("routine", "node", "word").agg(F.bit_or("bits").alias("old"))
        into = fresh.withColumnRenamed("node", "src").join(edges, ["routine", "src"]).groupBy("routine", F.col("dst").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        none = F.lit(0).cast("long")
        out = into.join(effect.select("routine", "node", "word", "kill"), ["routine", "node", "word"], "left").join(known, ["routine", "node", "word"], "left")
        left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("kill", none))).bitwiseAND(F.bitwise_not(F.coalesce("old", none)))
        fresh = cut(out.select("routine", "node", "word", left.alias("bits")).where("bits <> 0"), paths)
    exits = cut(nodes.join(edges.select("routine", F.col("src").alias("node")), ["routine", "node"], "left_anti"))
    state = spark.read.schema(schema).parquet(*paths).join(exits, ["routine", "node"], "left_semi").groupBy("routine", "node", "word").agg(F.bit_or("bits").alias("bits"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.expr("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    open_ = state.select("routine", "node", F.explode(F.transform(bits, lambda i: (F.col("word") * BITS + i).cast("int"))).alias("rank"))
    # exits of one routine
    found = open_.groupBy("routine", "rank").agg(F.count("*").alias("held"), F.slice(F.array_sort(F.collect_set("node")), 1, WITNESSES).alias("exits_held"))
    n = exits.groupBy("routine").agg(F.count("*").alias("exits"))
    out = place.join(found, ["routine", "rank"], "left").join(n, "routine", "left")
    out = out.select(
        "routine", "resource", "acquired", F.coalesce("exits", F.lit(0)).alias("exits"), F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("exits_held", F.array().cast(found.schema["exits_held"].dataType)).alias("exits_held"),
        (F.col("held").isNull() & F.col("exits").isNotNull()).alias("released"),
    )
    return out


def _reach(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(routine, node) of the nodes that an entry leads to."""
    spark, paths = edges.sparkSession, []
    fresh = cut(entries.select("routine", F.col("entry").alias("node")).distinct(), paths)
    schema = fresh.schema
    while not fresh.isEmpty():
        known = spark.read.schema(schema).parquet(*paths)
        step = fresh.withColumnRenamed("node", "src").join(edges, ["routine", "src"]).select("routine", F.col("dst").alias("node")).distinct()
        fresh = cut(step.join(known, ["routine", "node"], "left_anti"), paths)
    return spark.read.schema(schema).parquet(*paths)
