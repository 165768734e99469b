"""Method sets of types through embedding: what a type has of its own, and what embedded types promote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, rounds


#: Candidates of a round that are sent to all tasks, at most (two keys each); more are shuffled with all that is known.
FEW_ROWS = 1_000_000


@rounds
def method_sets(types: DataFrame, members: DataFrame, embeds: DataFrame) -> DataFrame:
    """(type, name, origin, depth): the methods of each of ``types(type)``, with the type they come from.

    ``members(type, name, kind)`` are methods and fields (``kind`` is ``method`` or ``field``), each once a type.  Of a name the one at the least depth
    counts; a field hides methods that lie deeper, and two of one depth cancel each other and hide what lies
    deeper, as does one that is reached in two ways.  Null types and names take no part.

    What a type embeds it gets from the types directly below, name by name: what is first met below them at depth d is met at d + 1, and
    goes up no further where the name is known.  So a name costs one row for each type that has it and each link above, not one for
    each type below which it lies.
    """
    spark, paths = types.sparkSession, []
    links = cut(embeds.select(F.col("embedded").alias("type"), F.col("type").alias("above")).where("type IS NOT NULL AND above IS NOT NULL"))
    own = members.where("type IS NOT NULL AND name IS NOT NULL").select("type", "name", "kind").distinct()
    # no origin: a field, or what is cancelled
    one = F.when((F.count("*") == 1) & (F.min("kind") == "method"), F.min("type"))
    fresh, depth = cut(own.groupBy("type", "name").agg(one.alias("origin")).withColumn("depth", F.lit(0)), paths), 0
    schema = fresh.schema
    while n := fresh.count():
        depth += 1
        up = fresh.select("type", "name", "origin").join(links, "type").groupBy(F.col("above").alias("type"), "name").agg(F.when(F.count("*") == 1, F.min("origin")).alias("origin"))
        known = spark.read.schema(schema).parquet(*paths).select("type", "name")
        if n <= FEW_ROWS:
            up = cut(up)
            if up.count() <= FEW_ROWS:  # then what is known stays where it is
                known = F.broadcast(known.join(F.broadcast(up.select("type", "name")), ["type", "name"], "left_semi"))
        fresh = cut(up.join(known, ["type", "name"], "left_anti").select("type", "name", "origin", F.lit(depth).alias("depth")), paths)
    wanted = types.select("type").where("type IS NOT NULL").distinct()
    found = spark.read.schema(schema).parquet(*paths).where("origin IS NOT NULL")
    return found.join(wanted, "type", "left_semi").select("type", "name", "origin", "depth")


def surfaces(sets: DataFrame, methods: DataFrame) -> DataFrame:
    """(owner, path, operation, value) for ``depth.projected``: a type's surface is its whole method set, and it falls on the files
    that implement any of it; ``methods(type, name, path, value)`` says where each method stands and what it counts."""
    where = methods.select(F.col("type").alias("origin"), "name", "path", "value")
    return sets.join(where, ["origin", "name"]).select(F.col("type").alias("owner"), "path", F.col("name").alias("operation"), "value")
