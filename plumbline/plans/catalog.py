"""Queries of the engine over the driver's tables, and their SQL.

Orders stand for files, their lines for routines, return flag and line status for
components and axes, events for the change log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..operators import depth, metrics, shape, store
from ..operators import incremental as inc
from ..operators import scoring as sc
from ..streaming import changes, ranks

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _signals(lines: DataFrame) -> DataFrame:
    """Two signals of each routine: quantity and discount."""
    cyclomatic = F.round(sev.continuous_log(F.col("l_quantity"), 1, 10) * 5, 6)
    cognitive = F.round(sev.continuous_log(100 * F.col("l_discount"), 0, 15) * 10, 6)
    both = F.explode(F.array(F.struct(F.lit("cognitive").alias("component"), cognitive.alias("value")), F.struct(F.lit("cyclomatic").alias("component"), cyclomatic.alias("value"))))
    return lines.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("grp"), both.alias("s"), F.col("l_linestatus").alias("axis")).select("path", "grp", F.col("grp").alias("subject"), "axis", "s.*")


_SIGNALS = """sig AS (
  SELECT l_orderkey AS path, l_linenumber AS grp, l_linestatus AS axis, 'cyclomatic' AS component, round(5 * log2(1 + greatest(0.0, l_quantity - 1) / 9), 6) AS value FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_linestatus, 'cognitive', round(10 * log2(1 + greatest(0.0, 100 * l_discount) / 15), 6) FROM lineitem),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, grp ORDER BY value DESC, component) AS nth FROM sig WHERE value <> 0) WHERE nth = 1)"""


@query(f"""WITH {_SIGNALS}, s AS (SELECT path, round(sum(value), 6) AS score FROM win GROUP BY path)
SELECT path, score, row_number() OVER (ORDER BY score DESC, path)::INTEGER AS rank FROM s ORDER BY score DESC, path LIMIT 20""")
def score_rank(spark, sf_dir):
    best = sc.grouped_max(_signals(_t(spark, sf_dir, "lineitem")))
    return sc.top_ranked(best.groupBy("path").agg(F.round(F.sum("contribution"), 6).alias("score")), "score", "path", n=20)


_SEV = {"s_binary": "CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END", "s_count": "v", "s_log_count": "log2(1 + v)", "s_linear": "CASE WHEN v >= 20 THEN v / 20 ELSE 0.0 END", "s_log_ratio": "CASE WHEN v >= 20 THEN 1 + log2(v / 20) ELSE 0.0 END", "s_continuous": "log2(1 + greatest(0.0, v - 1) / 9)"}


@query("SELECT l_returnflag, " + ", ".join(f"round({f}({e}), 4)::DOUBLE AS {f}_{n}" for n, e in _SEV.items() for f in ("min", "max", "avg")) + " FROM (SELECT l_returnflag, l_quantity AS v FROM lineitem) GROUP BY l_returnflag")
def severity_all(spark, sf_dir):
    v = sev.checked(F.col("l_quantity"), "quantity")
    cols = {"s_binary": sev.binary(v), "s_count": sev.count(v), "s_log_count": sev.log_count(v), "s_linear": sev.linear_over_threshold(v, 20), "s_log_ratio": sev.log_ratio(v, 20), "s_continuous": sev.continuous_log(v, 1, 10)}
    lines = _t(spark, sf_dir, "lineitem").select("l_returnflag", *[c.alias(n) for n, c in cols.items()])
    return lines.groupBy("l_returnflag").agg(*[F.round(f(n), 4).alias(f"{k}_{n}") for n in cols for k, f in (("min", F.min), ("max", F.max), ("avg", F.avg))])


@query("""WITH s AS (SELECT l_suppkey, sum(l_quantity) AS wmc, count(DISTINCT l_partkey) AS atfd, round(avg(l_discount) * 500, 6) AS tcc FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, round(CASE WHEN wmc >= 47 AND atfd > 5 AND tcc < 100.0/3 THEN 30 + 8 * (1 + log2(atfd / 5.0)) + 8 * (1 + log2((100.0::DOUBLE/3) / least(greatest(tcc, 1.0), 100.0::DOUBLE/3))) ELSE 0 END, 6)::DOUBLE AS severity FROM s""")
def god_severity(spark, sf_dir):
    s = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("wmc"), F.countDistinct("l_partkey").alias("atfd"), F.round(F.avg("l_discount") * 500, 6).alias("tcc"))
    return s.select("l_suppkey", F.round(sev.god_class(F.col("wmc"), F.col("atfd"), F.col("tcc")), 6).alias("severity"))


@query(f"""WITH {_SIGNALS}, n AS (SELECT path, grp, count(*) - 1 AS losers FROM sig WHERE value <> 0 GROUP BY path, grp)
SELECT path, count(*) FILTER (component = 'cognitive')::BIGINT AS cognitive_wins, count(*) FILTER (component = 'cyclomatic')::BIGINT AS cyclomatic_wins, sum(losers)::BIGINT AS overlapped, round(sum(value), 6) AS charged
FROM win JOIN n USING (path, grp) GROUP BY path""")
def grouped_max(spark, sf_dir):
    best = sc.grouped_max(_signals(_t(spark, sf_dir, "lineitem")))
    wins = lambda c: F.sum((F.col("component") == c).cast("long")).alias(f"{c}_wins")
    return best.groupBy("path").agg(wins("cognitive"), wins("cyclomatic"), F.sum(F.size("signals") - 1).cast("long").alias("overlapped"), F.round(F.sum("contribution"), 6).alias("charged"))


@query(f"""WITH {_SIGNALS}, c AS (SELECT path, sum(value) AS charged FROM win GROUP BY path)
SELECT o_orderkey AS owner, round(greatest(0.0, CASE WHEN o_totalprice >= 1000 THEN 10 * (1 + log2(o_totalprice / 1000)) ELSE 0.0 END - coalesce(charged, 0)), 6) AS residual
FROM orders LEFT JOIN c ON path = o_orderkey""")
def type_residual(spark, sf_dir):
    charges = sc.grouped_max(_signals(_t(spark, sf_dir, "lineitem"))).select(F.col("path").alias("owner"), "contribution")
    types = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("owner"), (sev.log_ratio(F.col("o_totalprice"), 1000) * 10).alias("severity"))
    return sc.residual(types, charges).select("owner", F.round("residual", 6).alias("residual"))


@query("""SELECT l_orderkey AS path, round(sum(CASE l_returnflag WHEN 'A' THEN l_quantity * 2 WHEN 'N' THEN 0 ELSE l_quantity END), 4)::DOUBLE AS score FROM lineitem GROUP BY l_orderkey""")
def policy_reweight(spark, sf_dir):
    q = F.col("l_quantity")
    under = F.when(F.col("l_returnflag") == "A", sc.reweight(q, 5, 10)).when(F.col("l_returnflag") == "N", sc.reweight(q, 5, 0)).otherwise(sc.reweight(q, 5, None))
    return _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.round(F.sum(under), 4).alias("score"))


@query("""SELECT d.doc_id, l.doc_id IS NOT NULL AS complete, l.doc_id IS NOT NULL AND coalesce(n_chars, 0) / 100.0 <= 20 AS passed FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def coverage_gate(spark, sf_dir):
    covered = _t(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("covered", F.lit(True))
    d = _t(spark, sf_dir, "documents").select("doc_id", "n_chars").join(covered, "doc_id", "left")
    complete = F.coalesce("covered", F.lit(False))
    return d.select("doc_id", complete.alias("complete"), sc.gate(F.coalesce("n_chars", F.lit(0)) / 100, complete, 20).alias("passed"))


@query("SELECT least(20, floor(greatest(0, o_totalprice / 4000) / 5))::INTEGER AS bin, count(*)::BIGINT AS files FROM orders GROUP BY 1")
def histogram(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy(sc.bucket(F.col("o_totalprice") / 4000).alias("bin")).agg(F.count("*").alias("files"))


@query("SELECT least(20, floor(greatest(0, v) / 5))::INTEGER AS bin, count(*)::BIGINT AS files FROM (SELECT user_id, max_by(value, event_id) AS v FROM events GROUP BY user_id) GROUP BY 1 HAVING count(*) > 0")
def histogram_delta(spark, sf_dir):
    """Histogram of each user's last value: that of the first half of the events, and what moved since."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "value")
    half = e.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    last = lambda d: inc.latest(d, ["user_id"], ["event_id"]).select(F.col("user_id").alias("path"), sc.bucket(F.col("value")).alias("bin"))
    old, new = last(e.where(F.col("event_id") <= half)), last(e)
    now = old.groupBy("bin").agg(F.count("*").alias("files")).unionByName(ranks.histogram_moves(old, new))
    return now.groupBy("bin").agg(F.sum("files").cast("long").alias("files")).where("files > 0")


@query("""WITH m AS (SELECT c_custkey, max(o_totalprice) AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT c_custkey, v AS metric, row_number() OVER (ORDER BY v DESC NULLS LAST, c_custkey) AS place FROM m""")
def view_sort_missing_last(spark, sf_dir):
    """Every customer with its place, those without a value last."""
    o = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("metric"))
    m = _t(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return sc.places(m, F.col("metric").desc_nulls_last(), F.col("c_custkey"))


@query("""SELECT regexp_extract(url, '\\.([a-z]+)(?:/|$)', 1) AS suffix, count(*)::BIGINT AS files, count(*) FILTER (url LIKE '%/en/%')::BIGINT AS english FROM pages WHERE NOT regexp_matches(url, '#top$') GROUP BY 1""")
def language_map(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").where(~F.col("url").rlike("#top$"))
    return p.groupBy(F.regexp_extract("url", r"\.([a-z]+)(?:/|$)", 1).alias("suffix")).agg(F.count("*").alias("files"), F.sum(F.col("url").contains("/en/").cast("long")).alias("english"))


@query("""WITH r AS (SELECT user_id, event_id AS lo, lead(event_id, 3) OVER (PARTITION BY user_id ORDER BY event_id) AS hi FROM events),
p AS (SELECT user_id, event_id, unnest(range(1 + event_id % 2)) AS copy FROM events WHERE event_type = 'click'),
j AS (SELECT p.*, lo, row_number() OVER (PARTITION BY p.user_id, event_id, copy ORDER BY lo DESC, hi) AS nth FROM p JOIN r ON p.user_id = r.user_id AND lo <= event_id AND event_id <= hi)
SELECT user_id, event_id, lo FROM j WHERE nth = 1""")
def nested_routine_join(spark, sf_dir):
    """The innermost range of each click; every other click comes twice."""
    e = _t(spark, sf_dir, "events")
    r = e.select("user_id", F.col("event_id").alias("lo"), F.lead("event_id", 3).over(Window.partitionBy("user_id").orderBy("event_id")).alias("hi"))
    clicks = e.where("event_type = 'click'").select("user_id", "event_id", F.explode(F.sequence(F.lit(0), F.col("event_id") % 2)).alias("copy")).drop("copy")
    return inc.innermost(clicks, r, "user_id", "event_id", "lo", "hi").select("user_id", "event_id", "lo")


@query("""WITH r AS (SELECT l_orderkey AS path, l_linenumber AS routine, 's' || l_suppkey % 3 AS symbol, 100 - 10 * l_linenumber AS lo, 100 + 10 * l_linenumber AS hi FROM lineitem),
f AS (SELECT l_orderkey AS path, (100 + l_partkey % 70)::BIGINT AS pos, CASE WHEN l_suppkey % 2 = 0 THEN 's' || l_partkey % 4 END AS symbol FROM lineitem),
b AS (SELECT path, symbol FROM r GROUP BY path, symbol, routine HAVING count(*) > 1), a AS (SELECT path FROM r GROUP BY path, routine HAVING count(*) > 1)
SELECT path, pos, symbol, CASE WHEN CASE WHEN symbol IS NULL THEN path NOT IN (SELECT path FROM a) ELSE (path, symbol) NOT IN (SELECT (path, symbol) FROM b) END
  THEN (SELECT min(routine) FROM r WHERE r.path = f.path AND (f.symbol IS NULL OR r.symbol = f.symbol) AND lo <= f.pos AND f.pos <= hi) END AS routine FROM f""")
def associated_routines(spark, sf_dir):
    """The routine that each finding belongs to: among those of its symbol if it names one, else of all."""
    li, n = _t(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    symbol = lambda c: F.concat(F.lit("s"), c.cast("string"))
    r = li.select(F.col("l_orderkey").alias("path"), n.alias("routine"), symbol(F.col("l_suppkey") % 3).alias("symbol"), (100 - 10 * n).alias("lo"), (100 + 10 * n).alias("hi"))
    f = li.select(F.col("l_orderkey").alias("path"), (100 + F.col("l_partkey") % 70).cast("long").alias("at"), F.when(F.col("l_suppkey") % 2 == 0, symbol(F.col("l_partkey") % 4)).alias("symbol"))
    return inc.associate(f, r).withColumnRenamed("at", "pos")


@query("""WITH m AS (SELECT DISTINCT l_orderkey, l_linenumber AS m, l_suppkey % 5 AS f FROM lineitem), n AS (SELECT l_orderkey, count(DISTINCT m) AS n FROM m GROUP BY 1),
p AS (SELECT a.l_orderkey, count(DISTINCT (a.m, b.m)) AS c FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.f = b.f AND a.m < b.m GROUP BY 1)
SELECT l_orderkey, CASE WHEN n < 2 THEN 0.0 ELSE round(coalesce(c, 0) / (n * (n - 1) / 2.0), 6) END::DOUBLE AS tcc FROM n LEFT JOIN p USING (l_orderkey)""")
def tcc_pairs(spark, sf_dir):
    m = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("type"), F.col("l_linenumber").alias("method")).agg(F.collect_set(F.col("l_suppkey") % 5).alias("fields"))
    return metrics.tcc(m).select(F.col("type").alias("l_orderkey"), F.round("tcc", 6).alias("tcc"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey)::BIGINT AS cbo FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) GROUP BY l_suppkey")
def cbo_distinct(spark, sf_dir):
    off = _t(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("type"))
    uses = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("type"), F.col("l_partkey").alias("foreign"))
    return metrics.coupling(uses, off).withColumnRenamed("type", "l_suppkey")


@query("SELECT o_orderkey, (count(l_orderkey) + coalesce(sum(l_quantity), 0))::DOUBLE AS wmc FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def wmc_sum(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("type"), (1 + F.col("l_quantity")).alias("cyclomatic"))
    types = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("type"), F.lit(0).alias("interface_methods"))
    return metrics.wmc(types, li).withColumnRenamed("type", "o_orderkey")


@query("""WITH a AS (SELECT l_suppkey, sum(greatest(1, l_linenumber)) AS f, count(*) + sum(greatest(1, l_linenumber % 3)) AS c, count(*) FILTER (l_returnflag = 'R') AS x FROM lineitem GROUP BY 1)
SELECT l_suppkey, floor(least(100.0, greatest(0.0, 0.8 * 100 * greatest(0.0, 1 - (f / c) / 1.05) + 0.2 * 100 * least(1.0, x / c))) + 0.5)::DOUBLE AS penalty FROM a""")
def shallowness_v3(spark, sf_dir):
    a = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.greatest(F.lit(1), "l_linenumber")).alias("f"), (F.count("*") + F.sum(F.greatest(F.lit(1), F.col("l_linenumber") % 3))).alias("c"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("x"))
    return a.select("l_suppkey", shape.shallowness(F.col("f"), F.col("c"), F.col("x"), F.lit(1.05)).alias("penalty"))


_RANKS = """d AS (SELECT user_id, date_trunc('day', ts)::DATE AS day, round(sum(value), 4) AS score FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, user_id) AS rank FROM d)"""


@query(f"""WITH {_RANKS} SELECT user_id, day, rank::INTEGER AS rank, (first_value(rank) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) - rank)::INTEGER AS movement,
sign(score - lag(score) OVER (PARTITION BY user_id ORDER BY day))::DOUBLE AS direction FROM r""")
def rank_movement(spark, sf_dir):
    d = _t(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("score"))
    r = sc.places_within(d, "day", F.desc("score"), F.col("user_id"))
    r = r.select(F.col("user_id").alias("path"), F.datediff("day", F.lit("1970-01-01")).alias("at"), F.col("place").cast("int").alias("rank"), "score")
    m = ranks.movements(r, 7)
    return m.select(F.col("path").alias("user_id"), F.date_add(F.lit("1970-01-01"), F.col("at")).alias("day"), "rank", "movement", "direction")


@query("""WITH f AS (SELECT user_id, min(event_id) AS seen, epoch(max(ts)) AS last_, count(*) > 2 AS moved FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY seen, user_id) AS rank, count(*) OVER () AS n, max(last_) OVER () - last_ AS age FROM f)
SELECT user_id, CASE WHEN age >= 86400 THEN NULL WHEN NOT moved THEN 'unmoved' WHEN rank <= greatest(1, (n * 10 + 99) // 100) THEN 'top10' WHEN rank <= greatest(1, (n * 50 + 99) // 100) THEN 'top50' ELSE 'rest' END AS marker FROM r""")
def new_file_marker(spark, sf_dir):
    """Users in the order of their first event; those of the last day are marked."""
    f = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("seen"), F.max("ts").alias("at"), (F.count("*") > 2).alias("moved"))
    whole = f.agg(F.count("*").alias("n"), F.max("at").alias("now")).first()
    age = F.lit(whole["now"]).cast("timestamp").cast("double") - F.col("at").cast("timestamp").cast("double")
    r = sc.places(f, F.col("seen"), F.col("user_id"))
    return r.select("user_id", sc.new_marker(F.col("place"), F.lit(whole["n"]), age, F.col("moved"), 86400).alias("marker"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS began, count(*)::BIGINT AS changes FROM s GROUP BY user_id, s""")
def debounce_sessions(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), "ts", F.col("event_id").alias("path"))
    return changes.bursts(e, "1 hour").select(F.col("unit").alias("user_id"), "began", F.size("paths").cast("long").alias("changes"))


@query("SELECT user_id, date_trunc('minute', ts) AS minute, bit_or(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 4 END)::INTEGER AS op, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def coalesce_changes(spark, sf_dir):
    """What happened to each user in a minute, as a set of bits."""
    op = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(4)
    c = changes.coalesce(_t(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts", op.alias("op")), "1 minute")
    return c.select(F.col("path").alias("user_id"), F.col("window.start").alias("minute"), "op", "n")


@query("SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 'new' ELSE 'old' END AS origin FROM orders")
def replace_merge(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    new = o.where("o_orderdate >= timestamp '1997-01-01'").select("o_orderkey", F.lit("new").alias("origin"))
    return inc.replace_merge(o.select("o_orderkey", F.lit("old").alias("origin")), new, "o_orderkey")


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def upsert_latest(spark, sf_dir):
    return inc.latest(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"])


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id AS src, event_id % (SELECT max(user_id) + 1 FROM events) AS dst FROM events), r AS (SELECT 3 AS node UNION SELECT dst FROM r JOIN e ON src = node) SELECT node::BIGINT AS node FROM r""")
def unit_closure(spark, sf_dir):
    """Over the edges of all events; there are as many units as users."""
    e = _t(spark, sf_dir, "events")
    units = e.agg(F.max("user_id") + 1).first()[0]
    e = e.select(F.col("user_id").alias("src"), (F.col("event_id") % F.lit(units)).alias("dst"))
    return inc.closure(spark, e, spark.createDataFrame([(3,)], "node long"))


@query("""WITH d AS (SELECT source, sha256(coalesce(text, '')) AS h FROM documents), p AS (SELECT source, h[1:2] AS two, sha256(string_agg(h, chr(10) ORDER BY h)) AS fp FROM d GROUP BY ALL)
SELECT source, sha256(string_agg(two || fp, chr(10) ORDER BY two || fp)) AS fingerprint FROM p GROUP BY source""")
def fingerprint(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    return inc.bucketed_fingerprint(d, "source", "h")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def misses(spark, sf_dir):
    planned = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), F.lit("").alias("language"), F.col("doc_id").alias("key"))
    stored = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("unit"), F.lit("").alias("language"), F.col("doc_id").alias("key"))
    return store.lookup(planned, stored).where("NOT hit").select(F.col("unit").alias("doc_id"))


@query("""WITH m AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+', 0) AS module FROM pages WHERE page_id % 2 = 0)
SELECT page_id, max_by(module, length(module)) AS owner FROM pages LEFT JOIN m ON url = module OR starts_with(url, module || '/') GROUP BY page_id""")
def nearest_ancestor(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    m = p.where("page_id % 2 = 0").select(F.regexp_extract("url", "^[a-z]+://[^/]+", 0).alias("module")).distinct()
    a = p.select("page_id", F.explode(inc.ancestors(F.col("url"))).alias("module")).join(m.withColumn("hit", F.lit(True)), "module", "left")
    return a.groupBy("page_id").agg(F.max_by("module", F.when(F.col("hit"), F.length("module"))).alias("owner"))


@query("""WITH b AS (SELECT l_suppkey, 8 * count(DISTINCT l_returnflag) + 4 * count(DISTINCT l_linestatus) + 2 * max(l_linenumber) + count(*) % 7 AS b8, count(DISTINCT l_linenumber) AS h FROM lineitem GROUP BY 1)
SELECT l_suppkey, b8::BIGINT AS b8, h::BIGINT AS h, ((200 * b8 + (b8 + 16 * h)) // (2 * (b8 + 16 * h)))::BIGINT AS shallow FROM b""")
def burden_b8(spark, sf_dir):
    zero = F.lit(0)
    b = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_returnflag").alias("O"), F.countDistinct("l_linestatus").alias("T"), F.max("l_linenumber").alias("A"), (F.count("*") % 7).alias("E"), F.countDistinct("l_linenumber").alias("h"))
    b = b.withColumn("b8", depth.burden(F.struct("O", "T", "A", "E", zero.alias("P"), zero.alias("S"), zero.alias("L"))))
    return b.select("l_suppkey", "b8", "h", depth.shallow(F.col("b8"), F.col("h")).alias("shallow"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, 2 * l_linenumber + l_suppkey % 5 + 8 * (l_partkey % 3) AS cost FROM lineitem)
SELECT l_orderkey, l_linenumber, cost FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY cost, l_linenumber) AS nth FROM c) WHERE nth = 1""")
def cheapest_route(spark, sf_dir):
    r = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("family"), F.col("l_linenumber").alias("route_id"), F.col("l_linenumber").alias("a"), (F.col("l_suppkey") % 5).alias("e"), (F.col("l_partkey") % 3).alias("p"), F.lit(0).alias("s"))
    return depth.cheapest_route(r).select(F.col("family").alias("l_orderkey"), F.col("route_id").alias("l_linenumber"), "cost")


@query("""WITH w AS (SELECT l_orderkey, l_returnflag, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS h FROM lineitem), o AS (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber, h FROM w)
SELECT l_orderkey, min(h)::BIGINT AS hidden FROM (SELECT l_orderkey, l_returnflag, sum(h) AS h FROM o GROUP BY ALL) GROUP BY l_orderkey""")
def min_hidden(spark, sf_dir):
    """Lines are obligations of three categories; those of one flag are an alternative."""
    category = F.when(F.col("l_linenumber") % 3 == 0, "U").when(F.col("l_linenumber") % 3 == 1, "V").otherwise("R")
    o = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_linenumber").cast("string").alias("id"), category.alias("category")).distinct()
    sets = o.groupBy("l_orderkey", "l_returnflag").agg(F.collect_set("id").alias("ids"), F.collect_set(F.struct("id", "category")).alias("of"))
    g = sets.groupBy("l_orderkey").agg(F.collect_list("ids").alias("alternatives"), F.map_from_entries(F.array_distinct(F.flatten(F.collect_list("of")))).alias("categories"))
    return g.select("l_orderkey", depth.hidden(F.col("alternatives"), F.col("categories")).cast("long").alias("hidden"))
