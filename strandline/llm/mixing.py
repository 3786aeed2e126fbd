"""Mixing sources to target weights by temperature.

Token shares p of the sources are raised to an exponent a and normalised, w = p**a / sum(p**a).  The exponent is
found by bisection so that the weights have a target entropy, or so that no source is repeated more than a limit.
Weights become token budgets, and each source's budget is spent over block permutations: a source's documents lie
in blocks of about block_rows, every epoch runs through all blocks in a new order, and the budget ends the run.
A document is taken once for every epoch in which its first token lies within the budget.

With no budget given, the smallest one is used with which every source is read at least once in full, so no
document is lost and small sources are repeated.

Only the distinct source sizes and how many sources have each go to the driver (sizes that differ sum to no more
than the corpus, so there are at most sqrt(2 * tokens) of them); weights are computed on the executors.  Running
sums go over blocks of a source and over documents of a block, never over all documents of a source.

Defined cases: tokens are words of [^\\x20\\x09-\\x0D]+ and one end token, so an empty or null text has one; a null
source is the source "", an empty table gives an empty result; repeated rows are rows of their own, also where ids are null or
repeat; a very long text is one document, taken whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain_names, slices, written

STEPS = 60


@dataclass(frozen=True)
class Temperature:
    exponent: float
    budget: float
    total: int
    norm: float

    def weight(self, tokens: Column) -> Column:
        return F.pow(tokens / F.lit(float(self.total)), F.lit(self.exponent)) / F.lit(self.norm)


def measured(docs: DataFrame, text_col: str, **others: Column) -> DataFrame:
    """The columns others, _n (words and one end token of the text) and _mark (a hash of the text), without the text."""
    names = list(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = [t or b"" for t in part.column("_text").to_pylist()]
                n = pa.array([len(t.split()) + 1 for t in texts], pa.int64())
                mark = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), n, pa.array(mark)], [*names, "_n", "_mark"])

    rows = docs.select(*(c.alias(n) for n, c in others.items()), F.col(text_col).cast("binary").alias("_text"))
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("_n", T.LongType()), T.StructField("_mark", T.LongType())])
    return rows.mapInArrow(run, schema)


def find_temperature(sizes: list[tuple[int, int]], entropy: float | None = None, repeats: float | None = None, budget: float | None = None) -> Temperature:
    """sizes: (tokens of a source, number of such sources).

    entropy: wanted share of the greatest possible entropy, 0 to 1.  repeats: the most epochs of any source.
    Exponents lie between 0 (all sources alike) and 1 (as they are), or 8 where an entropy below the natural one is
    wanted; a target out of reach gives the nearest end.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("give an entropy or a repetition limit")
    n = np.array([s for s, _ in sizes], dtype=float)
    k = np.array([c for _, c in sizes], dtype=float)
    total = float((n * k).sum())
    if not total:
        return Temperature(1.0, 0.0, 1, 1.0)

    def weights(a: float) -> np.ndarray:
        w = (n / total) ** a
        return w / (w * k).sum()

    def spent(a: float) -> float:
        return budget if budget is not None else float((n / weights(a)).max())

    def over(a: float) -> bool:
        """Whether the exponent must be larger."""
        w = weights(a)
        if entropy is not None:
            most = np.log(k.sum())
            return bool(-(k * w * np.log(w)).sum() > entropy * most)
        return bool((w * spent(a) / n).max() > repeats)

    low, high = 0.0, 1.0 if repeats is not None else 8.0
    if over(low):
        for _ in range(STEPS):
            middle = (low + high) / 2
            low, high = (middle, high) if over(middle) else (low, middle)
    else:
        high = low
    w = (n / total) ** high
    return Temperature(high, spent(high), int(total), float((w * k).sum()))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    entropy: float | None = None,
    repeats: float | None = None,
    budget: float | None = None,
    block_rows: int = 1000,
    seed: int = 0,
) -> DataFrame:
    """One row for every taking of a document: id_col, source, epoch, block, n_tokens, position, weight, exponent.

    position is the share of its source's budget that was spent before it, 0 to 1; sorting by it interleaves the
    sources at their weights.
    """
    sizes = written(measured(docs, text_col, _id=F.col(id_col), _source=_source(source_col)), "sizes")
    taken, found = _takings(sizes, entropy, repeats, budget, block_rows, seed)
    return taken.select(
        F.col("_id").alias(id_col),
        F.col("_source").alias("source"),
        "epoch",
        F.col("_block").alias("block"),
        F.col("_n").alias("n_tokens"),
        (F.col("_at") / F.col("_budget")).alias("position"),
        F.col("_weight").alias("weight"),
        F.lit(found.exponent).alias("exponent"),
    )


def _source(source_col: str) -> Column:
    return F.coalesce(F.col(source_col).cast("string"), F.lit(""))


def _takings(rows: DataFrame, entropy: float | None, repeats: float | None, budget: float | None, block_rows: int = 1000, seed: int = 0) -> tuple[DataFrame, Temperature]:
    """rows: _id, _source, _n, _mark.  _id, _source, _n, _mark, _nth (among equal rows), _block, epoch, _at, _budget, _weight of every taking."""
    sources = rows.groupBy("_source").agg(F.sum("_n").alias("_tokens"), F.count("*").alias("_rows"))
    sources = written(sources, "sources")
    found = find_temperature([(r[0], r[1]) for r in sources.groupBy("_tokens").count().orderBy("_tokens").toLocalIterator()], entropy, repeats, budget)
    plan = sources.select(
        "_source",
        "_tokens",
        F.ceil(F.col("_rows") / block_rows).cast("long").alias("_blocks"),
        found.weight(F.col("_tokens")).alias("_weight"),
    ).withColumn("_budget", F.greatest(F.floor(F.col("_weight") * found.budget + 1e-6), F.lit(0)).cast("long"))

    # A document's block follows from its id and text; a source's blocks hold about block_rows documents each.
    dealt = rows.join(plan.select("_source", "_blocks"), "_source").withColumn("_block", F.pmod(F.xxhash64("_id", "_mark", F.lit(seed)), F.col("_blocks")))
    inside = Window.partitionBy("_source", "_block").orderBy(F.xxhash64("_id", "_mark", F.lit(seed + 1)), "_id", "_mark")
    dealt = dealt.withColumn("_before", F.coalesce(F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    dealt = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("_source", "_block", "_id", "_mark").orderBy("_before")))

    blocks = dealt.groupBy("_source", "_block").agg(F.sum("_n").alias("_sum")).join(plan, "_source")
    epochs = F.sequence(F.lit(0), F.greatest(F.expr("(_budget + _tokens - 1) div _tokens") - 1, F.lit(0)).cast("int"))
    blocks = blocks.where("_budget > 0").withColumn("epoch", F.explode(epochs))
    order = Window.partitionBy("_source", "epoch").orderBy(F.xxhash64("_source", "_block", "epoch", F.lit(seed + 2)), "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_start", F.coalesce(F.sum("_sum").over(order), F.lit(0)) + F.col("epoch") * F.col("_tokens"))

    taken = dealt.select("_id", "_source", "_n", "_mark", "_nth", "_block", "_before").join(blocks.select("_source", "_block", "epoch", "_start", "_budget", "_weight"), ["_source", "_block"])
    return taken.withColumn("_at", F.col("_start") + F.col("_before")).where("_at < _budget"), found


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float | None = None, repeats: float | None = None, budget: float | None = None) -> DataFrame:
    """docs in the mixture: every row as often as mix_sources takes it, all columns as they were.

    A row is known by id, source and text; rows that agree in all three are taken one by one like any others.
    """
    names, docs, (id_col, text_col, source_col) = plain_names(docs, id_col, text_col, source_col)
    sizes = written(measured(docs, text_col, _id=F.col(id_col), _source=_source(source_col)), "sizes")
    taken, _ = _takings(sizes, entropy, repeats, budget)
    times = taken.groupBy("_id", "_source", "_mark", "_nth").agg(F.count("*").alias("_times"))
    ids = sizes.groupBy("_id").agg(F.count("*").alias("_rows"))
    rows = docs
    same = docs[id_col].eqNullSafe(times["_id"])
    if ids.where("_rows > 1").limit(1).count():
        # An id alone does not name a row here.
        rows = marked(docs, text_col).withColumn("_from", _source(source_col))
        rows = rows.withColumn("_own", F.row_number().over(Window.partitionBy(id_col, "_from", "_text_mark").orderBy("_text_mark")))
        same = rows[id_col].eqNullSafe(times["_id"]) & (rows["_from"] == times["_source"]) & (rows["_text_mark"] == times["_mark"]) & (rows["_own"] == times["_nth"])
    found = rows.join(times, same).withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return found.select(*[rows[c] for c in docs.columns]).toDF(*names)


def marked(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with _text_mark, the hash that measured() gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                mark = np.array([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) for t in part.column(text_col).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(mark)], [*part.schema.names, "_text_mark"])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("_text_mark", T.LongType())]))
