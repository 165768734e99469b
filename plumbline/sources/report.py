"""Report sinks: aligned text table, JSON, diagnostics and exit code.

``files`` are ranked rows

    rank, path, score, available, passed,
    components map<string, struct<contribution double, max double, subjects int>>,
    coverage map<string, string>, depth struct<state string, available boolean, value double>
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import display_number

FILES_SCHEMA = """rank int, path string, score double, available boolean, passed boolean,
components map<string, struct<contribution: double, max: double, subjects: int>>, coverage map<string, string>,
depth struct<state: string, available: boolean, value: double>"""
GAP = "  "


def _component(name: str) -> Column:
    return F.try_element_at("components", F.lit(name))


def _lost(name: str) -> Column:
    return F.coalesce(F.try_element_at("coverage", F.lit(name)).isin("failed", "unavailable"), F.lit(False))


def _cell(name: str, text: Column) -> Column:
    return F.when(_lost(name), "X").when(_component(name).isNull(), "-").otherwise(text)


def score_cell() -> Column:
    return F.when(F.col("available"), display_number(F.col("score"))).otherwise("X")


def max_count_cell(name: str) -> Column:
    """Largest value and number of subjects."""
    c = _component(name)
    return _cell(name, F.concat(display_number(F.greatest(F.lit(0.0), c["max"])), F.lit("/"), c["subjects"].cast("string")))


def total_max_cell(total: str, most: str) -> Column:
    """Largest value of types and of routines; one dash if there is neither."""
    side = lambda n: _cell(n, display_number(F.greatest(F.lit(0.0), _component(n)["max"])))
    return F.when(_component(total).isNull() & _component(most).isNull(), "-").otherwise(F.concat(side(total), F.lit("/"), side(most)))


def depth_cell() -> Column:
    d, there = F.col("depth"), F.coalesce(F.col("depth.available"), F.lit(False))
    lost = (F.coalesce(d["state"], F.lit("")) != "") | _lost("module_shallowness")
    return F.when(F.coalesce(d["state"] == "not_applicable", F.lit(False)), "N/A").when(there, display_number(d["value"])).when(lost, "X").otherwise("-")


def cells(compact: bool = False, gated: bool = False) -> dict[str, Column]:
    """Columns of the table by header."""
    if compact:
        return {"SCORE": score_cell(), "PATH": F.col("path")}
    god = _cell("god_class", display_number(_component("god_class")["contribution"]))
    out = {"PASS": F.when(F.col("passed"), "yes").otherwise("NO")} if gated else {}
    return out | {
        "RANK": F.col("rank").cast("string"),
        "SCORE": score_cell(),
        "COG MAX/#": max_count_cell("cognitive_complexity"),
        "NPATH MAX/#": max_count_cell("npath_complexity"),
        "CYCLO TOT/MAX": total_max_cell("cyclomatic_class_complexity", "cyclomatic_method_complexity"),
        "SHALLOW": depth_cell(),
        "GOD": god,
        "PATH": F.col("path"),
    }


def table(files: DataFrame, compact: bool = False, gated: bool = False) -> DataFrame:
    """(at, line): the lines of the text table, the header at 0.  Widths are one aggregate over the
    cells (a row that is broadcast); lines are made where their rows are."""
    columns = cells(compact, gated)
    names = [f"c{i}" for i in range(len(columns))]
    body = files.select(F.col("rank").alias("at"), *[c.alias(n) for n, c in zip(names, columns.values())])
    head = files.sparkSession.createDataFrame([(0, *columns)], "at int, " + ", ".join(f"{n} string" for n in names))
    # bytes, as paths are padded by their size in UTF-8
    widths = head.unionByName(body).agg(F.struct(*[F.max(F.octet_length(n)).alias(n) for n in names]).alias("w"))
    rows = head.unionByName(body).crossJoin(F.broadcast(widths))  # widths is one row
    pad = lambda n: F.repeat(F.lit(" "), F.greatest(F.lit(0), F.col(f"w.{n}") - F.char_length(n)))
    parts = [F.concat(pad(n), F.col(n)) for n in names[:-1]] + [F.col(names[-1])]
    return rows.select("at", F.rtrim(F.concat_ws(GAP, *parts)).alias("line"))


def diagnostics(rows: DataFrame) -> DataFrame:
    """``rows(severity, code, path, message)`` with a ``line`` for each error or warning that has a
    message; the path is put first unless the message starts with it."""
    path, message = F.coalesce("path", F.lit("")), F.col("message")
    place = F.when((path != "") & ~message.startswith(F.concat(path, F.lit(":"))), F.concat(path, F.lit(": "))).otherwise("")
    line = F.concat("severity", F.lit(" "), F.coalesce("code", F.lit("")), F.lit(": "), place, message)
    return rows.where(F.col("severity").isin("error", "warning") & (F.coalesce(message, F.lit("")) != "")).withColumn("line", line)


def write_json(files: DataFrame, path: str) -> None:
    """One JSON object a file, in rank order, in as many parts as there are partitions."""
    files.orderBy("rank").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def limited(files: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """The first ``n`` ranks (0: all), which keep their rank, and whether any were left out."""
    if not n:
        return files, False
    return files.where(F.col("rank") <= n), not files.where(F.col("rank") > n).isEmpty()


def exit_code(files: DataFrame | None, gated: bool = False) -> int:
    """2 if the analysis failed (no ``files``), 3 if a threshold is set and not all pass, else 0."""
    if files is None:
        return 2
    return 3 if gated and not files.where("NOT coalesce(passed, false)").isEmpty() else 0
