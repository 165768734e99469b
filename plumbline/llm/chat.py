"""Operator 1: chat formatting as event-sourced reconstruction (DataFrame functions only).

A log has rows ``(conv_id, seq, op, target, role, text)``.  ``op`` is

* ``message``: a new turn, whose position is its ``seq`` (rows that share one are turns of
  their own, in the order of role, then text);
* ``delta``: appends ``text`` to the turn at ``target``;
* ``edit``: replaces the text of that turn;
* ``regenerate``: replaces it too, and removes every turn after it that was there before;
* ``delete``: removes that turn; a later ``edit`` or ``regenerate`` brings it back.

Events whose turn was never started by a ``message`` start it (``role`` of the event, else
empty).  Null texts and roles count as empty.  Rows with a null ``conv_id`` are one conversation, and
events with a null place share one place, before all others.  Columns of other names take no part.

Template: each turn is ``<|turn|>``, role, newline, text, ``<|end|>``, newline.  Within role
and text a backslash becomes two and ``<`` becomes backslash-l (in roles a newline becomes
backslash-n), so that no text can hold a marker and unescaping gives back every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TURN, END = "<|turn|>", "<|end|>"
_TURNS = "array<struct<turn:bigint,nth:int,role:string,text:string>>"


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))
    return F.replace(c, F.lit("\n"), F.lit("\\n")) if role else c


def unescape(c: Column, role: bool = False) -> Column:
    """The inverse of :func:`escape`.  Escaped backslashes are set aside as ``<``, which no
    escaped text holds."""
    c = F.replace(c, F.lit("\\\\"), F.lit("<"))
    if role:
        c = F.replace(c, F.lit("\\n"), F.lit("\n"))
    # \l stands for "<": swap by way of a split, so that neither can meet the other
    parts = F.split(c, r"\\l")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("<"), F.lit("\\"))), "<")


def reconstruct(log: DataFrame) -> DataFrame:
    """(conv_id, turn, nth, role, text): the turns that are left after all events.

    Events are first folded by (conv_id, turn), so that a conversation with a large part of
    all rows is spread over many tasks.
    """
    e = log.select(
        "conv_id",
        F.col("seq").cast("long").alias("seq"),
        F.when(F.col("op") == "message", F.col("seq")).otherwise(F.coalesce("target", "seq")).cast("long").alias("turn"),
        F.coalesce("op", F.lit("message")).alias("op"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rank = F.when(F.col("op") == "message", 0).otherwise(1)
    folded = e.groupBy("conv_id", "turn").agg(
        F.sort_array(F.collect_list(F.struct("seq", rank.alias("rank"), "role", "text", "op"))).alias("events"),
        F.max(F.when(F.col("op") == "regenerate", F.col("seq"))).alias("regenerated"),
        F.min("seq").alias("born"),
    )
    messages = F.filter("events", lambda x: x["rank"] == 0)
    others = F.filter("events", lambda x: x["rank"] != 0)
    # the last of several messages at one place takes the events that follow
    last = F.coalesce(F.element_at(messages, -1), F.element_at(others, 1))
    state = F.struct(F.col("last.text").alias("text"), F.lit(True).alias("kept"))

    def step(s: Column, x: Column) -> Column:
        text = F.when(x["op"] == "delta", F.concat(s["text"], x["text"])).when(x["op"].isin("edit", "regenerate"), x["text"]).otherwise(s["text"])
        kept = F.when(x["op"] == "delete", F.lit(False)).when(x["op"].isin("edit", "regenerate"), F.lit(True)).otherwise(s["kept"])
        return F.struct(text.alias("text"), kept.alias("kept"))

    start = F.when(F.size("messages") > 0, state).otherwise(F.struct(F.lit("").alias("text"), F.lit(True).alias("kept")))
    final = F.aggregate("others", start, step)
    folded = folded.select("conv_id", "turn", "regenerated", "born", messages.alias("messages"), others.alias("others"), last.alias("last")).withColumn("final", final)
    earlier = F.slice("messages", 1, F.greatest(F.size("messages") - 1, F.lit(0)))
    mine = F.when(F.col("final.kept"), F.array(F.struct(F.col("last.role").alias("role"), F.col("final.text").alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    turns = F.concat(F.transform(earlier, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))), mine)
    folded = folded.select("conv_id", "turn", "regenerated", "born", turns.alias("turns"))
    # regenerations are rare: only they are set against the turns of their conversation
    regenerations = folded.where(F.col("regenerated").isNotNull()).select("conv_id", F.col("turn").alias("at"), F.col("regenerated").alias("when"))
    cut = (
        folded.select("conv_id", "turn", "born", F.lit(None).cast("long").alias("when"))
        .join(regenerations.select(F.col("conv_id").alias("which")).distinct(), F.col("conv_id").eqNullSafe(F.col("which")), "left_semi")
        .unionByName(regenerations.select("conv_id", F.col("at").alias("turn"), F.lit(None).cast("long").alias("born"), "when"))
        .withColumn("latest", F.max("when").over(Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)))
        .where(F.col("born").isNotNull() & (F.col("latest") > F.col("born")))
        .select(F.col("conv_id").alias("which"), F.col("turn").alias("gone"))
    )
    kept = folded.join(cut, F.col("conv_id").eqNullSafe(F.col("which")) & (F.col("turn") == F.col("gone")), "left_anti")
    return kept.select("conv_id", "turn", F.posexplode("turns").alias("nth", "t")).select("conv_id", "turn", "nth", "t.role", "t.text")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): one row a conversation.

    ``loss_spans`` has for each turn ``start`` (code points before it, from 0) and ``length``
    of the part of ``formatted`` that is trained on: the escaped text of an ``assistant``
    turn, else length 0.  A conversation all of whose turns were removed has no row.
    """
    head = F.concat(F.lit(TURN), escape(F.col("role"), role=True), F.lit("\n"))
    body = escape(F.col("text"))
    t = turns.select(
        "conv_id",
        F.struct(
            "turn", "nth", "role", "text",
            F.concat(head, body, F.lit(END + "\n")).alias("piece"),
            F.char_length(head).cast("long").alias("head"),
            F.when(F.col("role") == "assistant", F.char_length(body)).otherwise(0).cast("long").alias("loss"),
        ).alias("t"),
    )
    grouped = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda x: x["piece"]), "").alias("formatted"),
        _spans(F.col("ts")).alias("loss_spans"),
    )


def _spans(ts: Column) -> Column:
    """Starts are sums of the lengths before, made by blocks of about the square root of the
    number of turns, so that a very long conversation doesn't cost its square."""
    lengths = F.transform(ts, lambda x: F.char_length(x["piece"]).cast("long"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(ts))).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ts) - 1) / block).cast("int")), lambda b: F.struct(F.slice(ts, b * block + 1, block).alias("ts"), total(F.slice(lengths, F.lit(1), b * block)).alias("before")))
    inner = lambda b: F.transform(
        b["ts"],
        lambda x, i: F.struct(
            (b["before"] + total(F.transform(F.slice(b["ts"], F.lit(1), i), lambda y: F.char_length(y["piece"]).cast("long"))) + x["head"]).alias("start"),
            x["loss"].alias("length"),
        ),
    )
    return F.flatten(F.transform(blocks, inner))


def _under_mask(formatted: Column, mask: Column) -> Column:
    """The part of ``formatted`` at ``start`` and ``length`` of each entry of ``mask``, whose entries are in
    order.  It is cut to blocks first, as finding a place in a text costs what stands before it."""
    block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(mask))).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(mask) - 1) / block).cast("int")), lambda b: F.slice(mask, b * block + 1, block))
    last = lambda ms: F.element_at(ms, -1)
    cut = lambda ms: F.struct(ms.alias("ms"), ms[0]["start"].alias("at"), F.substr(formatted, ms[0]["start"].cast("int") + 1, (last(ms)["start"] + last(ms)["length"] - ms[0]["start"]).cast("int")).alias("text"))
    return F.flatten(F.transform(F.transform(blocks, cut), lambda c: F.transform(c["ms"], lambda m: F.substr(c["text"], (m["start"] - c["at"]).cast("int") + 1, m["length"].cast("int")))))


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, losses) parsed from ``formatted``: ``turns`` with role and text, ``losses``
    the unescaped text under each entry of the loss mask (null where its length is 0), found by the
    mask's start and length alone."""
    segments = F.slice(F.split("formatted", r"<\|turn\|>"), 2, 2**30)
    head = lambda s: F.substring_index(s, "\n", 1)
    body = lambda s: F.substr(s, F.char_length(head(s)) + 2, F.char_length(s) - F.char_length(head(s)) - 1 - len(END) - 1)
    return rendered.select(
        "conv_id",
        "formatted",
        F.transform(segments, lambda s: F.struct(unescape(head(s), role=True).alias("role"), unescape(body(s)).alias("text"))).alias("turns"),
        F.transform(_under_mask(F.col("formatted"), F.col("loss_spans")), lambda s: F.when(s != "", unescape(s))).alias("losses"),
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, seq long, role string, text string"))
    log = rows.withColumns({"op": F.lit("message"), "target": F.lit(None).cast("long")})
    back = read_back(render(reconstruct(log)))
    loss = F.array_join("losses", "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_SAID = "'\\### Assistant: </turn> ok'"
_ESC = "replace(replace({0}, '\\', '\\\\'), '<', '\\l')"
OP1_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_SAID} UNION ALL SELECT -7, 1, 'assistant', {_SAID})
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(length(replace({_ESC.format('role')}, chr(10), '\\n')) + length({_ESC.format('text')}) + 17)::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
