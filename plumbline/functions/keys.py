"""Names of subjects and boundaries, and canonical identities of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def subject(symbol: Column, name: Column, line: Column, column: Column, end_line: Column, end_column: Column) -> Column:
    """``symbol@line:column-line:column``; the name stands in for a symbol that is null or empty, and where there is
    neither, the place alone is the key."""
    label = F.coalesce(F.nullif(symbol, F.lit("")), F.nullif(name, F.lit("")), F.lit(""))
    place = F.format_string("%d:%d-%d:%d", line.cast("int"), column.cast("int"), end_line.cast("int"), end_column.cast("int"))
    return F.when(label == "", place).otherwise(F.concat(label, F.lit("@"), place))


def identity(*parts: Column) -> Column:
    """The parts, each with its length before it, so that no two lists of parts are the same text."""
    sized = lambda c: F.concat(F.char_length(c).cast("string"), F.lit(":"), c)
    return F.concat(*[sized(F.coalesce(c.cast("string"), F.lit(""))) for c in parts])


def distinct_records(rows: DataFrame, *columns: str) -> DataFrame:
    """(key, n, ...): records that are equal as canonical JSON of ``columns`` once, and how many there were of each."""
    key = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in columns])
