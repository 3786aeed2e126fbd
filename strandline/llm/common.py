"""Shared pieces of the corpus operators: tables in the shared folder, text keys, pass-through batches."""

from __future__ import annotations

import itertools
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The bytes of [\x20\x09-\x0D]; bytes.split() without arguments splits at the same six.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_serial = itertools.count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset and Spark runs in this one process, a temporary folder is set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{next(_serial)}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", codec).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_at = path
    return made


def forget(made: DataFrame) -> None:
    """Remove a written table that nothing reads any more."""
    spark, path = made.sparkSession, made._written_at
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain_names(docs: DataFrame, *cols: str) -> tuple[list[str], DataFrame, list[str]]:
    """The columns of docs, docs with plain ones in their place, and the plain ones of cols.  Nothing else is named like them."""
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    return names, docs.toDF(*plain), [plain[names.index(c)] for c in cols]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, mod modulus, is remainder; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def words(text: str | bytes | None) -> list[bytes]:
    """ASCII-lower-cased words of [^\\x20\\x09-\\x0D]+; none for a null text."""
    data = text or b""
    return (data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data).lower().split()


def digests(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes as two int64 columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<i8").reshape(-1, 2)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """The batch in slices of about limit bytes of text, so that a run of long texts is not turned into objects at once."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def most_frequent(counts: DataFrame, n_col: str, at_most: int, key_col: str) -> DataFrame:
    """Rows of the largest counts, at most at_most of them: whole steps of a sixteenth of a power of two as long as they fit.

    Of the first step that does not fit, as much goes with them as does by a hash of the key, in 4096 parts.  Only the number of rows
    on each of the (about a thousand) steps, and on each part, goes to the driver; no task sorts or gathers the rows.
    """
    counts = counts.where(F.col(n_col) > 0)
    step = F.floor(F.log2(F.col(n_col).cast("double")) * 16).cast("int")
    part = F.pmod(F.xxhash64(key_col), F.lit(4096)).cast("int")

    def fitting(sizes: list[tuple[int, int]], room: int) -> tuple[int | None, int | None, int]:
        """The last value that fits, the first that does not, and the room then."""
        last = None
        for value, n in sizes:
            if n > room:
                return last, value, room
            last, room = value, room - n
        return last, None, room

    tally = lambda rows, by: [(r[0], r[1]) for r in rows.groupBy(by.alias("s")).count().collect()]
    whole, split, room = fitting(sorted(tally(counts, step), reverse=True), at_most)
    chosen = F.lit(False) if whole is None else step >= whole
    if split is not None and room:
        last, _, _ = fitting(sorted(tally(counts.where(step == split), part)), room)
        if last is not None:
            chosen = chosen | ((step == split) & (part <= last))
    return counts.where(chosen)


def bloom(ids: DataFrame, id_col: str, most_bits: int = 1 << 27):
    """A test on an id column that holds for every id of ids, and for about one in a hundred others.

    The filter is gathered as 64-bit words, has ten bits an id and never more than most_bits (16 MB); above about
    13 million ids it lets more through, and never less.  A caller joins what passes exactly.
    """
    spark, hashes = ids.sparkSession, 4
    bits = min(most_bits, max(64, 1 << (10 * ids.count()).bit_length()))
    place = lambda c, i: F.pmod(F.xxhash64(c.cast("string"), F.lit(i)), F.lit(bits))
    at = ids.select(F.explode(F.array(*(place(F.col(id_col), i) for i in range(hashes)))).alias("p"))
    got = at.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toArrow()
    table = np.zeros(bits // 64, dtype=np.int64)
    table[got.column("w").to_numpy()] = got.column("b").to_numpy()
    held = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def has(p0: pd.Series, p1: pd.Series, p2: pd.Series, p3: pd.Series) -> pd.Series:
        found = np.ones(len(p0), dtype=bool)
        for p in (x.to_numpy() for x in (p0, p1, p2, p3)):
            found &= (held.value[p // 64] >> (p % 64)) & 1 == 1
        return pd.Series(found)

    return lambda c: has(*(place(c, i) for i in range(hashes)))


def without(docs: DataFrame, id_col: str, gone: DataFrame, gone_col: str) -> DataFrame:
    """docs without the ids of gone.  Only rows that a filter of those ids lets through are joined; other texts stay where they are."""
    maybe = bloom(gone, gone_col)
    rest = docs.where(maybe(docs[id_col])).join(gone, docs[id_col].eqNullSafe(gone[gone_col]), "left_anti")
    return docs.where(~maybe(docs[id_col])).unionByName(rest)
