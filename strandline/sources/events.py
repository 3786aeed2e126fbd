"""Event sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical(events: DataFrame) -> DataFrame:
    """event_id, event_type, time_ms, user_id (the scope), parent, value_c (hundredths), k.

    Order everywhere is (time_ms, event_id), which no window over all rows is needed for.
    """
    return events.select(
        "event_id",
        "event_type",
        F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("time_ms"),
        "user_id",
        (F.col("user_id") % 10).alias("parent"),
        F.round(F.col("value") * 100).cast("long").alias("value_c"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"),
    )


def normalised(events: DataFrame) -> DataFrame:
    """A field's first value counts; lists of numbers are sorted, distinct, and their 64 lowest kept.

    fields: array<struct<name,value>>, int_lists: map<string, array<bigint>>.
    """
    first = F.aggregate(
        "fields",
        F.create_map().cast("map<string,bigint>"),
        lambda m, f: F.when(F.map_contains_key(m, f["name"]), m).otherwise(F.map_concat(m, F.create_map(f["name"], f["value"]))),
    )
    lists = F.transform_values("int_lists", lambda k, v: F.slice(F.array_sort(F.array_distinct(v)), 1, 64))
    return events.withColumn("fields", first).withColumn("int_lists", lists)


def routed(events: DataFrame, routes: Column) -> DataFrame:
    """One copy of an event for each scope in routes (array of scopes), each scope once, null scopes not at all."""
    return events.withColumn("scope", F.explode(F.array_distinct(F.filter(routes, lambda s: s.isNotNull()))))


def hex_bytes(text: Column) -> Column:
    """Bytes of hexadecimal text; blanks, _ and 0x do not count; null where the digits are odd in number or none."""
    bare = F.regexp_replace(text, r"\s|_|0[xX]", "")
    return F.when((F.length(bare) % 2 == 0) & bare.rlike("^[0-9a-fA-F]*$"), F.unhex(bare))
