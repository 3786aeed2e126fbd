"""Exact dedup: a tree of merges over sorted digest runs.

Every row gets a digest and belongs to one of fan_in**k runs.  A run is sorted by digest and lies in slices of equal ranges
of digests, so that the last one is as spread as the first.  In each of k rounds the slices of fan_in neighbouring runs
come together (an exchange by slice and run, and by nothing else), are merged in the order of the digests, and the merged
order is aggregated as it streams by: of equal digests one row goes on, with the identifier that stays and the
number of rows seen.  A digest is SHA-256 of the text, and a merge is verified by the text's length in bytes and a
second, independent hash.  The verdicts then go back down the same tree, so that no join, up or down, meets
more than fan_in rows of one digest on a level, however many copies a text has.  Only digests travel, no texts.

Everything here is DataFrame operations.  The identifier is aggregated as a struct, which Spark aggregates over sorted rows
and never by hash.

Defined cases: a very long text is hashed whole; a null text counts as empty; an empty table gives an empty result; a null id never stays unless
all ids of its group are null; of rows that repeat one id and one text, one is kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, plain_names, written

#: Ids with digests up to this number are broadcast (48 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
KEY = ["_sha", "_bytes", "_check"]
RUN = ["_slice", "_run"]


def digest_runs(docs: DataFrame, id_col: str, text_col: str, runs: int, slices: int) -> DataFrame:
    """Ids and digests with their runs; a row's run follows from its id and text, so a recomputed task deals it alike."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.sha2(text, 256).alias("_hex"), F.octet_length(text).cast("long").alias("_bytes"), F.xxhash64(text, F.lit("check")).alias("_check"))
    lead = F.conv(F.substring("_hex", 1, 6), 16, 10).cast("long")
    return written(
        rows.select(
            F.shiftright(lead * slices, 24).cast("int").alias("_slice"),
            F.pmod(F.xxhash64("_id", "_check"), F.lit(runs)).cast("int").alias("_run"),
            F.unhex("_hex").alias("_sha"), "_bytes", "_check", "_id",
        ),
        "runs",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    keep: "largest" or "smallest", the identifier that stays of equal texts.
    """
    stays = {"largest": F.max, "smallest": lambda c: F.min(F.when(c["_x"].isNotNull(), c))}[keep]
    n = partitions(docs.sparkSession)
    rounds = 1
    while fan_in**rounds < n:
        rounds += 1
    base = digest_runs(docs, id_col, text_col, fan_in**rounds, 4 * n)

    def merged(rows: DataFrame, kept: str, size: Column) -> DataFrame:
        found = rows.groupBy(*RUN, *KEY).agg(stays(F.struct(F.col(kept).alias("_x"))).alias("_s"), size.alias("_size"))
        return found.select(*RUN, *KEY, F.col("_s")["_x"].alias("_keep"), "_size")

    up = F.expr(f"_run div {fan_in}").cast("int")
    levels = [merged(base, "_id", F.count("*"))]
    for level in range(rounds):
        levels[level] = written(levels[level], f"level{level}")
        together = levels[level].withColumn("_run", up).repartition(n, *RUN).sortWithinPartitions(*RUN, *KEY)
        levels.append(merged(together, "_keep", F.sum("_size")))

    verdict = written(levels[-1], "verdict")
    for level in reversed(range(rounds)):
        below = levels[level].select(*RUN, *KEY, up.alias("_up"))
        verdict = below.join(verdict.withColumnRenamed("_run", "_up"), ["_slice", "_up", *KEY]).drop("_up")
        verdict = written(verdict, f"down{level}")

    once = F.row_number().over(Window.partitionBy(*RUN, *KEY, "_id").orderBy("_id")) == 1
    return base.join(verdict, [*RUN, *KEY]).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_keep")) & once).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """docs with the rows that exact_dedup keeps, all columns as they were; of rows of one id and text one stays."""
    names, docs, (id_col, text_col) = plain_names(docs, id_col, text_col)
    sha = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    found = exact_dedup(docs, id_col, text_col, keep).where(~F.col("kept"))
    # An id alone does not name a row: another text can have it, and so can a copy that stays.
    again = F.col(id_col).eqNullSafe(F.col("keep_id")).alias("_again")
    gone = written(found.select(F.col(id_col).alias("_gone"), F.unhex("text_sha256").alias("_gone_sha"), again).distinct(), "gone")
    repeats = gone.where("_again").limit(1).count() > 0
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    rows = docs.withColumn("_text_sha", sha)
    same = rows[id_col].eqNullSafe(gone["_gone"]) & (rows["_text_sha"] == gone["_gone_sha"])
    left = rows.join(gone, same, "left_anti")
    if repeats:
        left = left.unionByName(rows.join(gone.where("_again"), same, "left_semi").dropDuplicates([id_col, "_text_sha"]))
    return left.drop("_text_sha").toDF(*names)
