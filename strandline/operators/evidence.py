"""From inferences to causes, problems and reports, as plans over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_in_window(infers: DataFrame, keys: list[str], window: int, order: list[str]) -> DataFrame:
    """The first inference of each key in each tumbling window of event time; later ones have no effect."""
    w = Window.partitionBy(*keys, "_window").orderBy(*order)
    rows = infers.withColumn("_window", F.floor(F.col("time_ms") / window))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_window")


def in_order(rows: DataFrame, keys: list[str], order: list[str], read: str, fold: Callable, name: str, kind: T.DataType) -> DataFrame:
    """rows with a column that depends on the rows before it of the same keys, in one sorted pass.

    fold(first, values, carried) gets for a run of rows whether each is the first of its keys, the values of the column
    read, and what it returned for the run before; it returns the new column and what it carries on.  Rows stream by, so a
    task holds a batch, however many rows a key has; a key is the work of one task.
    """
    marked = rows.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            first = batch.column("_first").to_numpy(zero_copy_only=False)
            made, carried = fold(first, batch.column(read).to_numpy(zero_copy_only=False), carried)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made)], [*batch.schema.names[:-1], name])

    return marked.mapInArrow(run, T.StructType([*rows.schema, T.StructField(name, kind)]))


def clamped_sums(rows: DataFrame, keys: list[str], order: list[str], weight: str) -> DataFrame:
    """rows with `confidence`, the sum of weights up to each row, held in 0..100 after every step."""

    def fold(first: np.ndarray, weights: np.ndarray, x: int | None) -> tuple[np.ndarray, int]:
        out = np.empty(len(first), dtype=np.int32)
        for i, (new, w) in enumerate(zip(first.tolist(), weights.tolist())):
            x = w if new else x + w
            x = 0 if x < 0 else 100 if x > 100 else x
            out[i] = x
        return out, x

    return in_order(rows, keys, order, weight, fold, "confidence", T.IntegerType())


def causes(infers: DataFrame, keys: list[str], order: list[str], weight: str = "weight", mixed: bool = True) -> DataFrame:
    """keys, confidence, first_ms (of the first inference).  mixed: whether weights below 0 occur, which need the order."""
    first = F.min_by("time_ms", F.struct(*order))
    if not mixed:
        return infers.groupBy(*keys).agg(F.least(F.lit(100), F.sum(weight)).cast("int").alias("confidence"), first.alias("first_ms"))
    runs = clamped_sums(infers, keys, order, weight)
    return runs.groupBy(*keys).agg(F.max_by("confidence", F.struct(*order)).alias("confidence"), first.alias("first_ms"))


def band(confidence: Column) -> Column:
    """Candidate from 10, Probable from 40, Confirmed from 80."""
    return F.when(confidence >= 80, "Confirmed").when(confidence >= 40, "Probable").when(confidence >= 10, "Candidate")


def cooled(problems: DataFrame, keys: list[str], cooldown: int, time: str = "time_ms", order: str = "event_id") -> DataFrame:
    """Problems more than cooldown after the last one kept of the same keys; the work is one step for each that is kept."""

    def fold(first: np.ndarray, times: np.ndarray, last: int | None) -> tuple[np.ndarray, int | None]:
        keep = np.zeros(len(first), dtype=bool)
        starts = np.flatnonzero(first)
        for i, j in zip([0, *starts], [*starts, len(first)]):
            if i < j and first[i]:
                last = None
            while i < j:
                i = i if last is None else i + int(np.searchsorted(times[i:j], last + cooldown, side="right"))
                if i < j:
                    keep[i], last = True, int(times[i])
                    i += 1
        return keep, last

    return in_order(problems, keys, [time, order], time, fold, "_kept", T.BooleanType()).where("_kept").drop("_kept")


def rolled_up(found: DataFrame, scope: str, target: str, keys: list[str]) -> DataFrame:
    """The parent's confidence: the largest among other scopes that name it as the target."""
    return found.where(F.col(scope) != F.col(target)).groupBy(F.col(target).alias(scope), *keys).agg(F.max("confidence").alias("confidence"), F.count("*").alias("children"))


def ambiguous(found: DataFrame, pairs: list[tuple[str, str]], keys: list[str], margin: int = 15) -> DataFrame:
    """Pairs of exclusive causes of the same keys that are both probable and less than margin apart."""
    spark = found.sparkSession
    table = spark.createDataFrame(pairs or [("", "")], "cause_a string, cause_b string").where("cause_a <> ''")
    a = found.select(*keys, F.col("cause").alias("cause_a"), F.col("confidence").alias("confidence_a"))
    b = found.select(*keys, F.col("cause").alias("cause_b"), F.col("confidence").alias("confidence_b"))
    both = a.join(F.broadcast(table), "cause_a").join(b, [*keys, "cause_b"])
    probable = F.col("confidence_a").between(40, 79) & F.col("confidence_b").between(40, 79)
    return both.where(probable & (F.abs(F.col("confidence_a") - F.col("confidence_b")) < margin))


def edges(infers: DataFrame, bound: list[str], node: Column) -> DataFrame:
    """One edge from each bound event to the cause, Supports or Contradicts by the weight's sign."""
    sources = F.filter(F.array(*[F.col(b) for b in bound]), lambda x: x.isNotNull())
    kind = F.when(F.col("weight") >= 0, "Supports").otherwise("Contradicts")
    return infers.select(F.explode(sources).alias("src"), node.alias("dst"), kind.alias("kind"))
