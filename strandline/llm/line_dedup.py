"""Incremental line dedup: sharded cuckoo filters over exact reference counts.

The index holds, for every line key, the exact number of documents with that key (the reference-count table),
and for every shard a cuckoo filter of the keys that at least `threshold` documents share.  Documents can be
inserted and deleted; counts go up and down, keys cross the threshold either way and enter or leave their
filter, so deleting what was inserted gives back the earlier state.  Each state is a pair of tables in the
shared folder; older states stay readable.

Filters judge lines in one of two places, with one result.  While filters are within `broadcast_limit` bytes they go to the
texts, and what a filter claims wrongly about a key of the corpus is listed exactly ("exceptions", found by probing
the whole reference-count table, and within the same limit).  Beyond it the keys go to the filters: a text's distinct keys are
dealt to the shards, each in `salts` parts by text, and meet the shard's filter there; only the keys it claims are
joined with the exact counts.

The number of shards follows the number of shared keys; where it changes, filters are made anew from the exact counts.

A line is text between \\n; its key has [\\x20\\x09-\\x0D] stripped at both ends and A-Z lower-cased; empty keys are
never dropped.  Defined cases: null and empty texts have one empty line; repeated rows count as documents each;
deleting what was not inserted is an error; an empty table gives an empty result; a very long text is split in memory of
some ten times its size; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, digests, partitions, slices, written

SLOTS, KICKS, FILTER_LOAD = 4, 500, 0.85
KEYS_PER_SHARD = 1 << 16


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Lines and their keys."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [x.strip(BLANKS).lower() for x in lines]


# --- cuckoo filter -----------------------------------------------------------------------------------------


def _fingerprint(h2: np.ndarray) -> np.ndarray:
    fp = (h2.view(np.uint64) >> np.uint64(48)).astype(np.uint64)
    return np.where(fp == 0, np.uint64(1), fp)


def _places(h1: np.ndarray, fp: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = (h1.view(np.uint64) >> np.uint64(16)) & mask
    return first, _other(first, fp, mask)


def _other(place: np.ndarray, fp: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return (place ^ (fp * np.uint64(0x5BD1E995))) & mask


class CuckooFilter:
    """Buckets of four 16-bit fingerprints.  put() is False when the filter is too full; take() removes one copy."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * FILTER_LOAD < keys + 1:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of all keys (rows of two int64), doubled until they fit."""
        room = len(keys)
        while True:
            made = cls.sized(room)
            if made.put_all(keys):
                return made
            room = 2 * len(made.slots) * SLOTS

    def _mask(self) -> np.uint64:
        return np.uint64(len(self.slots) - 1)

    def put_all(self, keys: np.ndarray) -> bool:
        keys = np.ascontiguousarray(keys, dtype=np.int64).reshape(-1, 2)
        fps = _fingerprint(np.ascontiguousarray(keys[:, 1]))
        first, second = _places(np.ascontiguousarray(keys[:, 0]), fps, self._mask())
        return all(self._put(int(f), int(a), int(b)) for f, a, b in zip(fps, first, second))

    def _put(self, fp: int, a: int, b: int) -> bool:
        for place in (a, b):
            free = np.flatnonzero(self.slots[place] == 0)
            if len(free):
                self.slots[place, free[0]] = fp
                return True
        place, mask = b, int(self._mask())
        for kick in range(KICKS):
            slot = (fp + kick) % SLOTS
            fp, self.slots[place, slot] = int(self.slots[place, slot]), fp
            place = (place ^ (fp * 0x5BD1E995)) & mask
            free = np.flatnonzero(self.slots[place] == 0)
            if len(free):
                self.slots[place, free[0]] = fp
                return True
        return False

    def take_all(self, keys: np.ndarray) -> None:
        keys = np.ascontiguousarray(keys, dtype=np.int64).reshape(-1, 2)
        fps = _fingerprint(np.ascontiguousarray(keys[:, 1]))
        first, second = _places(np.ascontiguousarray(keys[:, 0]), fps, self._mask())
        for fp, a, b in zip(fps, first, second):
            for place in (int(a), int(b)):
                there = np.flatnonzero(self.slots[place] == fp)
                if len(there):
                    self.slots[place, there[0]] = 0
                    break

    def has(self, keys: np.ndarray) -> np.ndarray:
        return Probe.of({0: self.slots}, 1).has(keys)


@dataclass
class Probe:
    """All shards' filters in one array, for probing many keys at once."""

    shards: int
    base: np.ndarray
    mask: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, filters: dict[int, np.ndarray], shards: int) -> Probe:
        empty = np.zeros((1, SLOTS), dtype=np.uint16)
        parts = [filters.get(s, empty) for s in range(shards)]
        sizes = np.array([len(x) for x in parts], dtype=np.uint64)
        base = np.concatenate([[np.uint64(0)], np.cumsum(sizes)[:-1]]).astype(np.uint64)
        return cls(shards, base, sizes - np.uint64(1), np.concatenate(parts))

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, dtype=bool)
        h1, fp = np.ascontiguousarray(keys[:, 0]), _fingerprint(np.ascontiguousarray(keys[:, 1]))
        shard = shard_of(h1, self.shards)
        first, second = _places(h1, fp, self.mask[shard])
        want = fp.astype(np.uint16)[:, None]
        at = self.base[shard]
        return (self.slots[(at + first).astype(np.int64)] == want).any(1) | (self.slots[(at + second).astype(np.int64)] == want).any(1)


def shards_for(shared: int) -> int:
    shards = 1
    while shards < 1 << 16 and shards * KEYS_PER_SHARD < shared:
        shards *= 2
    return shards


def packed(keys: np.ndarray) -> np.ndarray:
    """Digests as one value each, which can be sorted."""
    return np.ascontiguousarray(keys, dtype=np.int64).view("S16").ravel()


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    """The low 16 bits choose the shard, the bits above them the bucket; shards is a power of two up to 65536."""
    return (h1.view(np.uint64) & np.uint64(shards - 1)).astype(np.int64)


# --- reference counts --------------------------------------------------------------------------------------


def reference_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """h1, h2, refs: the number of documents that have each non-empty key, counted per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            h = np.frombuffer(b"".join(seen), dtype="<i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(list(seen.values()), pa.int64())], ["h1", "h2", "refs"])

        for batch in batches:
            for part in slices(batch, text_col):
                for text in part.column(text_col).to_pylist():
                    keys = set(line_keys(text)[1])
                    keys.discard(b"")
                    seen.update(map(xxhash.xxh3_128_digest, keys))
                if len(seen) > 400_000:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    counted = docs.select(text_col).mapInArrow(count, "h1 long, h2 long, refs long")
    return counted.groupBy("h1", "h2").agg(F.sum("refs").alias("refs"))


@dataclass
class LineIndex:
    """One state of the index: exact counts and the filters of the keys that threshold documents share."""

    spark: SparkSession
    threshold: int
    shards: int
    refs: DataFrame
    filters: DataFrame
    broadcast_limit: int = 64 << 20

    @classmethod
    def build(cls, docs: DataFrame, text_col: str = "text", threshold: int = 10, broadcast_limit: int = 64 << 20) -> LineIndex:
        return cls._of(docs.sparkSession, threshold, written(reference_counts(docs, text_col), "refs"), broadcast_limit)

    @classmethod
    def _of(cls, spark: SparkSession, threshold: int, refs: DataFrame, broadcast_limit: int) -> LineIndex:
        """The index of exact counts, with filters made from them."""
        made = cls(spark, threshold, shards_for(refs.where(F.col("refs") >= threshold).count()), refs, refs.limit(0), broadcast_limit)
        keys = made.repeated().select("h1", "h2", made._shard().alias("shard"))
        made.filters = written(keys.groupBy("shard").applyInPandas(_new_filter, "shard int, slots binary"), "filters")
        return made

    def _shard(self):
        return F.col("h1").bitwiseAND(self.shards - 1).cast("int")

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self._changed(reference_counts(docs, text_col))

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """The state without docs; an error if they were not inserted before."""
        return self._changed(reference_counts(docs, text_col).withColumn("refs", -F.col("refs")))

    def _changed(self, delta: DataFrame) -> LineIndex:
        both = self.refs.select("h1", "h2", "refs", F.col("refs").alias("was")).unionByName(delta.withColumn("was", F.lit(0).cast("long")))
        sums = written(both.groupBy("h1", "h2").agg(F.sum("refs").alias("refs"), F.sum("was").alias("was")), "sums")
        if sums.where("refs < 0").limit(1).count():
            raise ValueError("a line is to be deleted more often than it was inserted")
        refs = written(sums.where("refs > 0").select("h1", "h2", "refs"), "refs")
        if shards_for(refs.where(F.col("refs") >= self.threshold).count()) != self.shards:
            return self._of(self.spark, self.threshold, refs, self.broadcast_limit)
        old, new = F.col("was") >= self.threshold, F.col("refs") >= self.threshold
        keys = sums.where(old | new).select("h1", "h2", old.alias("was"), new.alias("now"), self._shard().alias("shard"))
        filters = self.filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(_updated_filter, "shard int, slots binary")
        return LineIndex(self.spark, self.threshold, self.shards, refs, written(filters, "filters"), self.broadcast_limit)

    def repeated(self) -> DataFrame:
        return self.refs.where(F.col("refs") >= self.threshold).select("h1", "h2")

    def probe(self) -> tuple[Probe, np.ndarray] | None:
        """Filters and exceptions (digests in order), or None where they are over the limit."""
        size = self.filters.agg(F.sum(F.octet_length("slots"))).first()[0] or 0
        if size > self.broadcast_limit:
            return None
        found = {r["shard"]: np.frombuffer(r["slots"], dtype=np.uint16).reshape(-1, SLOTS) for r in self.filters.toLocalIterator()}
        probe = self.spark.sparkContext.broadcast(filters := Probe.of(found, self.shards))

        def claimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
                yield batch.filter(pa.array(probe.value.has(keys)))

        wrong = written(self.refs.where(F.col("refs") < self.threshold).select("h1", "h2").mapInArrow(claimed, "h1 long, h2 long"), "exceptions")
        if size + 16 * wrong.count() > self.broadcast_limit:
            return None
        wrong = wrong.toArrow()
        return filters, np.sort(packed(np.column_stack([wrong.column(0).to_numpy(), wrong.column(1).to_numpy()])))

    def drop_lines(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id_col, n_lines, n_dropped, kept_text for every row of docs, which must be among the inserted documents."""
        found = self.probe()
        if found is None:
            return self._drop_at_shards(docs, id_col, text_col)
        held = self.spark.sparkContext.broadcast(found)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probe, exceptions = held.value
            for batch in batches:
                for part in slices(batch, text_col):
                    split = [line_keys(x) for x in part.column(text_col).to_pylist()]
                    keys = digests([k for _, ks in split for k in ks])
                    drop = probe.has(keys) & np.array([bool(k) for _, ks in split for k in ks], dtype=bool)
                    if len(exceptions):
                        at = np.flatnonzero(drop)
                        claimed = packed(keys[at])
                        place = np.minimum(np.searchsorted(exceptions, claimed), len(exceptions) - 1)
                        drop[at[exceptions[place] == claimed]] = False
                    yield _kept(part.column(0), split, drop)

        kind = docs.schema[id_col].dataType.simpleString()
        return docs.select(id_col, text_col).mapInArrow(judge, f"`{id_col}` {kind}, n_lines long, n_dropped long, kept_text string")

    def _drop_at_shards(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """The same where the filters lie.  A shard's keys are dealt to salts parts by text, so that a common key is spread."""
        salts = max(16, partitions(self.spark) // self.shards)

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col):
                    texts = part.column(text_col).to_pylist()
                    keys = [sorted(set(line_keys(x)[1]) - {b""}) for x in texts]
                    own = np.repeat(digests([(x or "").encode("utf-8", "surrogatepass") for x in texts]), [len(k) for k in keys], axis=0)
                    h = digests([k for ks in keys for k in ks])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[:, 0], own[:, 1], h[:, 0], h[:, 1])], ["t1", "t2", "h1", "h2"])

        def claimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A part's filter comes before its keys; where a shard has no filter nothing is claimed."""
            at, here = None, None
            for batch in batches:
                shard, salt, slots = (batch.column(i) for i in (4, 5, 6))
                place = shard.to_numpy().astype(np.int64) * salts + salt.to_numpy()
                keep = np.zeros(len(place), dtype=bool)
                start = np.flatnonzero(np.diff(place, prepend=-1))
                for i, j in zip(start, [*start[1:], len(place)]):
                    if place[i] != at:
                        at, here = place[i], slots[int(i)].as_py()
                    if here is not None:
                        keys = np.column_stack([batch.column(k).to_numpy()[i:j] for k in (2, 3)])
                        keep[i:j] = CuckooFilter(np.frombuffer(here, dtype=np.uint16).reshape(-1, SLOTS)).has(keys)
                yield batch.select(range(4)).filter(pa.array(keep & slots.is_null().to_numpy(zero_copy_only=False)))

        pairs = docs.select(text_col).mapInArrow(explode, "t1 long, t2 long, h1 long, h2 long")
        pairs = pairs.withColumns({"shard": self._shard(), "salt": F.pmod("t1", F.lit(salts)).cast("int"), "slots": F.lit(None).cast("binary")})
        nothing = [F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "h1", "h2")]
        filters = self.filters.select(*nothing, "shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "slots")
        met = pairs.unionByName(filters).repartition(partitions(self.spark), "shard", "salt").sortWithinPartitions("shard", "salt", F.col("slots").isNull())
        met = met.mapInArrow(claimed, "t1 long, t2 long, h1 long, h2 long").withColumn("salt", F.pmod("t1", F.lit(salts)).cast("int"))
        shared = self.repeated().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hits = met.join(shared, ["h1", "h2", "salt"], "left_semi").groupBy("t1", "t2").agg(F.collect_set(F.struct("h1", "h2")).alias("hits"))

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = digests([(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own[:, 0]), pa.array(own[:, 1])], [*batch.schema.names, "t1", "t2"])

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col):
                    split = [line_keys(x) for x in part.column(text_col).to_pylist()]
                    hit = [{(x["h1"], x["h2"]) for x in row or ()} for row in part.column("hits").to_pylist()]
                    drop = np.array([bool(k) and tuple(digests([k])[0].tolist()) in own if own else False for (_, ks), own in zip(split, hit) for k in ks], dtype=bool)
                    yield _kept(part.column(0), split, drop)

        kind = docs.schema[id_col].dataType.simpleString()
        rows = docs.select(id_col, text_col).mapInArrow(keyed, f"`{id_col}` {kind}, `{text_col}` string, t1 long, t2 long")
        return rows.join(hits, ["t1", "t2"], "left").select(id_col, text_col, "hits").mapInArrow(judge, f"`{id_col}` {kind}, n_lines long, n_dropped long, kept_text string")


def _kept(ids: pa.Array, split: list[tuple[list[bytes], list[bytes]]], drop: np.ndarray) -> pa.RecordBatch:
    sizes = np.array([len(x) for x, _ in split], dtype=np.int64)
    ends = np.cumsum(sizes)
    texts, dropped = [], []
    for (lines, _), end, n in zip(split, ends.tolist(), sizes.tolist()):
        gone = drop[end - n : end]
        dropped.append(int(gone.sum()))
        texts.append(b"\n".join(x for x, out in zip(lines, gone) if not out) if dropped[-1] else b"\n".join(lines))
    return pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_lines", "n_dropped", "kept_text"])


def _new_filter(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
    made = CuckooFilter.of(keys[["h1", "h2"]].to_numpy())
    return pd.DataFrame({"shard": [int(key[0])], "slots": [made.slots.tobytes()]})


def _updated_filter(key: tuple, old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    """Entering keys are put, leaving ones taken out; a filter that is too full is made anew from the exact keys."""
    now = keys[keys["now"]][["h1", "h2"]].to_numpy()
    made = None
    if len(old):
        made = CuckooFilter(np.frombuffer(old["slots"].iloc[0], dtype=np.uint16).reshape(-1, SLOTS).copy())
        made.take_all(keys[keys["was"] & ~keys["now"]][["h1", "h2"]].to_numpy())
        if not made.put_all(keys[keys["now"] & ~keys["was"]][["h1", "h2"]].to_numpy()):
            made = None
    made = made or CuckooFilter.of(now)
    return pd.DataFrame({"shard": [int(key[0])], "slots": [made.slots.tobytes()]})


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 10, broadcast_limit: int = 64 << 20) -> DataFrame:
    """Build an index of docs and drop from each the lines whose key threshold documents share."""
    return LineIndex.build(docs, text_col, threshold, broadcast_limit).drop_lines(docs, id_col, text_col)
