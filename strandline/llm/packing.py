"""Best-fit packing with several permitted sequence lengths.

Pieces of documents go, longest first, into the open bin with the least room that still holds them.  Where none
does, a bin is opened: of all permitted lengths that hold the piece, the one whose cost per expected token is
least, given what is still to come that would fit beside it.  At the end every bin shrinks to the smallest
permitted length that holds its contents.  The cost of a sequence of c tokens is fixed + c + c * c / quadratic.

Documents longer than the largest length are cut into pieces of that length; nothing is dropped.  Only ids and
lengths travel.  Pieces are dealt by hash into shards of about shard_rows, each packed alone, so memory is bounded
and shards grow in number with the corpus.

Defined cases: a null or empty text is a document of one (end) token; an empty table gives an empty result;
repeated rows are packed each; ties are broken by id, null last, then by a hash of the text; a very long text is as many pieces as
it needs; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .mixing import measured

LENGTHS = (512, 1024, 2048, 4096, 8192)


def sequence_cost(c: int, fixed: float = 32.0, quadratic: float = 8192.0) -> float:
    return fixed + c + c * c / quadratic


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int]]:
    """The bin of each size (sizes descending, none above the largest length), and each bin's final length."""
    lengths = tuple(sorted(lengths))
    left = np.bincount(sizes, weights=sizes, minlength=lengths[-1] + 1) if sizes else np.zeros(lengths[-1] + 1)
    rooms: list[tuple[int, int]] = []
    bins, used = [], []
    for size in sizes:
        left[size] -= size
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, which = rooms.pop(at)
        else:
            room = min(
                (c for c in lengths if c >= size),
                key=lambda c: (sequence_cost(c) / (size + min(c - size, left[: c - size + 1].sum())), c),
            )
            which = len(used)
            used.append(0)
        used[which] += size
        bins.append(which)
        if room > size:
            insort(rooms, (room - size, which))
    return bins, [lengths[bisect_left(lengths, u)] for u in used]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, shard_rows: int = 4096) -> DataFrame:
    """One row per bin: shard, bin, capacity, used, n_pieces, doc_ids, starts and sizes (of the pieces, in tokens)."""
    top = max(lengths)
    rows = measured(docs, text_col, _id=F.col(id_col))
    pieces = rows.withColumn("_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(top).cast("long"))))
    pieces = written(pieces.select("_id", "_mark", "_start", F.least(F.col("_n") - F.col("_start"), F.lit(top)).cast("int").alias("_size")), "pieces")
    shards = max(1, -(-pieces.count() // shard_rows))
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64("_id", "_mark", "_start"), F.lit(shards)).cast("int"))
    kind = docs.schema[id_col].dataType.simpleString()
    order = [("_size", "descending"), ("_id", "ascending"), ("_mark", "ascending"), ("_start", "ascending")]

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.compute.sort_indices(rows, sort_keys=order)).combine_chunks()
        sizes = rows.column("_size").to_numpy()
        bins, capacities = best_fit(sizes.tolist(), lengths)
        bins = np.array(bins, dtype=np.int64)
        by_bin = np.argsort(bins, kind="stable")
        rows, sizes = rows.take(pa.array(by_bin)).combine_chunks(), sizes[by_bin]
        ends = np.searchsorted(bins[by_bin], np.arange(len(capacities) + 1))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(rows.column(c).chunks)) for c in ("_id", "_start", "_size")]
        numbers = [np.repeat(rows.column("_shard")[0].as_py(), len(capacities)), np.arange(len(capacities)), capacities, np.add.reduceat(sizes, ends[:-1]), np.diff(ends)]
        return pa.Table.from_arrays([*(pa.array(x, pa.int32()) for x in numbers), *lists], ["shard", "bin", "capacity", "used", "n_pieces", "doc_ids", "starts", "sizes"])

    return dealt.groupBy("_shard").applyInArrow(fill, f"shard int, bin int, capacity int, used int, n_pieces int, doc_ids array<{kind}>, starts array<bigint>, sizes array<int>")
