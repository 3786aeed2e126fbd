"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, all others as
users with a name, and a mask over what the assistant says.  Speakers are the roles other than "system"; system
turns stay system turns in every rendering.

A dialogue has one rendering for each speaker, which comes in chunks of chunk_turns turns, one row per conversation,
speaker and chunk: the texts of the chunks on end are the whole rendering, and masks count from the start of the dialogue.
So a conversation of any length is spread over rows of bounded size.  Turns are numbered in two steps, inside
partitions of a range of turns and by the sizes of those before, and so are offsets: no task holds or orders a whole
conversation.  All of that is done without the texts, which are moved twice: to their number, and to their chunk.
Speakers are gathered over the whole conversation: a chunk in which the speaker is silent is rendered too, without a
mask.

Everything here is DataFrame operations.

Defined cases: a null text is empty, a null role is "unknown", a null turn counts as 0; turns with equal numbers are
ordered by role and by the MD5 of the text; repeated rows are turns of their own; markers inside texts and names are broken
up; a conversation of system turns alone has no row; a null conversation is one; a very long text is one turn, whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

START, END = "<|im_start|>", "<|im_end|>"


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def before(rows: DataFrame, keys: list[str], at: str, size: str, name: str, block: int = 1024) -> DataFrame:
    """rows with the sum of size over those of equal keys and lower at (which is a number from 0 on), in blocks of at.  Keys are not null."""
    rows = rows.withColumn("_block", F.floor(F.col(at) / block))
    sofar = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, "_block").agg(F.sum(size).alias("_sum"))
    blocks = blocks.withColumn("_start", F.coalesce(F.sum("_sum").over(sofar(keys, "_block")), F.lit(0))).drop("_sum")
    rows = rows.withColumn("_inside", F.coalesce(F.sum(size).over(sofar([*keys, "_block"], at)), F.lit(0)))
    return rows.join(blocks, [*keys, "_block"]).withColumn(name, F.col("_start") + F.col("_inside")).drop("_block", "_inside", "_start")


def numbered(rows: DataFrame) -> DataFrame:
    """rows (_key, turn, role, _text, _row and others) with pos, their place in the conversation _key from 0 on."""
    order = ["turn", "role", "_text", "_row"]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), "_key", *order)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()), "places")
    dealt = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("_key", "_part").orderBy(*order)) - 1)
    parts = dealt.groupBy("_key", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_sofar", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return dealt.join(parts, ["_key", "_part"]).withColumn("pos", (F.col("_sofar") + F.col("_nth")).cast("long")).drop("_part", "_nth", "_sofar")


def _named(role: Column) -> Column:
    return F.when(role == "system", role).otherwise(F.concat(F.lit("user name="), role))


def rotate(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_turns: int = 256) -> DataFrame:
    """id_col, speaker, chunk, n_turns, n_loss_turns, text, start (of the chunk in the rendering), mask (start and end, end excluded).

    Places are code points from the start of the rendering.
    """
    rows = turns.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")).alias("_key"),
        F.coalesce(F.col(turn_col), F.lit(0)).cast("long").alias("turn"),
        _plain(F.coalesce(F.col(role_col), F.lit("unknown"))).alias("role"),
        _plain(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
    )
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "turns")
    # How long a turn is where another speaks, and how much longer where its own speaker is the assistant.
    others = F.length(F.lit(START)) + F.length(_named(F.col("role"))) + F.length("text") + F.length(F.lit(END)) + 2
    places = numbered(rows.select("_key", "turn", "role", F.md5("text").alias("_text"), "_row", others.cast("long").alias("_size")))
    places = written(places.select("_key", "role", "_row", "pos", F.floor(F.col("pos") / chunk_turns).cast("long").alias("chunk"), "_size"), "numbers")

    spoken = places.where(F.col("role") != "system")
    own = spoken.groupBy("_key", F.col("role").alias("speaker"), "chunk").agg((F.count("*") * (F.length(F.lit("assistant")) - F.length(_named(F.col("speaker"))))).alias("_more"))
    sizes = places.groupBy("_key", "chunk").agg(F.sum("_size").alias("_size")).join(own.select("_key", "speaker").distinct(), "_key")
    sizes = sizes.join(own, ["_key", "speaker", "chunk"], "left").withColumn("_size", F.col("_size") + F.coalesce("_more", F.lit(0)))
    starts = before(sizes.drop("_more"), ["_key", "speaker"], "chunk", "_size", "start").drop("_size")

    chunks = rows.drop("_key", "turn", "role").join(places.select("_key", "role", "_row", "pos", "chunk"), "_row")
    chunks = chunks.groupBy("_key", "chunk").agg(F.first("_id").alias("_id"), F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    both = chunks.join(starts, ["_key", "chunk"])

    def part(t: Column) -> Column:
        who = F.when(t["role"] == F.col("speaker"), F.lit("assistant")).otherwise(_named(t["role"]))
        return F.struct(F.concat(F.lit(START), who, F.lit("\n")).alias("head"), F.concat(t["text"], F.lit(END)).alias("said"), (t["role"] == F.col("speaker")).alias("loss"))

    both = both.withColumn("_parts", F.transform("turns", part))
    span = "struct<start:bigint,end:bigint>"
    at = F.aggregate(
        "_parts",
        F.struct(F.col("start").cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("mask")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["said"]) + 1).alias("at"),
            F.when(
                p["loss"],
                F.concat(
                    acc["mask"],
                    F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), (acc["at"] + F.length(p["head"]) + F.length(p["said"])).alias("end"))),
                ),
            )
            .otherwise(acc["mask"])
            .alias("mask"),
        ),
    )
    return both.select(
        F.col("_id").alias(id_col),
        "speaker",
        "chunk",
        F.size("_parts").cast("long").alias("n_turns"),
        F.size(F.filter("_parts", lambda p: p["loss"])).cast("long").alias("n_loss_turns"),
        F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["said"], F.lit("\n"))), "").alias("text"),
        F.col("start").cast("long").alias("start"),
        at["mask"].alias("mask"),
    )
