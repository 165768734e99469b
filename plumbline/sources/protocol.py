"""Record streams of analyzers: one JSON object a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """type string, protocol_version int, invocation_id string, unit_id string, component_id string, definition_version string,
path string, language string, scope string, value variant, subject struct<name:string,symbol:string,routine:string,line:int,column:int,end_line:int,end_column:int>,
attributes variant, provenance variant, state string, reason string, severity string, code string, message string, status string"""


def number(value: Column) -> Column:
    """A JSON number, a numeric string, or ``{"$integer": "..."}``; null if none of them."""
    text = F.coalesce(F.try_variant_get(value, "$['$integer']", "string"), F.try_variant_get(value, "$", "string"))
    return text.try_cast("double")


def read(spark: SparkSession, path: str, invocation: str | None = None, version: int = 1) -> dict[str, DataFrame]:
    """Tables of a record file by type.  The file must have exactly one terminal record, as its
    last line, and only records of this version and invocation; anything else is an error."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at")).where("trim(value) <> ''")
    records = lines.select("at", F.from_json("value", SCHEMA, {"mode": "FAILFAST"}).alias("r")).select("at", "r.*")
    wrong = F.col("protocol_version").isNull() | (F.col("protocol_version") != version)
    if invocation is not None:
        wrong |= F.col("invocation_id").isNull() | (F.col("invocation_id") != invocation)
    ends = F.col("type") == "terminal"
    c = records.agg(F.sum(ends.cast("int")).alias("ends"), F.max(F.when(ends, F.col("at"))).alias("end"), F.max("at").alias("last"), F.sum(wrong.cast("int")).alias("wrong")).first()
    if c["ends"] != 1 or c["end"] != c["last"]:
        raise ValueError("a record stream ends with its one terminal record")
    if c["wrong"]:
        raise ValueError(f"{c['wrong']} records of another version or invocation")
    measurement = records.where("type = 'measurement'").withColumn("number", number(F.col("value")))
    return {
        "measurement": measurement.select("unit_id", "component_id", "definition_version", "path", "language", "scope", "number", "subject", "attributes", "provenance"),
        "coverage": records.where("type = 'coverage'").select("unit_id", "component_id", "definition_version", "path", "state", "reason"),
        "diagnostic": records.where("type = 'diagnostic'").select("unit_id", "path", "severity", "code", "message"),
    }
