"""Document fingerprints: SpotSigs.

Common words of the corpus are anchors.  A spot is an anchor with the chain of the `chain` content words that follow
it; the set of a document's spots, as 48-bit hashes, is its fingerprint (sorted, eight base64 characters a spot).
Likeness is the Jaccard similarity of two such sets.  near_classes finds documents alike, by set length and with a bound on
what is left to compare; fingerprint_edits gives likenesses of known pairs in full, so it searches and prunes nothing.

Words are runs between [\\x20\\x09-\\x0D] and ASCII punctuation, A-Z lower-cased.  Anchors are the `anchors` most
frequent words over all documents.

Defined cases: a text without a complete spot takes every word as an anchor; a text without words takes its
whole text as the one spot; null counts as empty, and the empty text has the empty fingerprint, which is like
another empty one (1) and unlike all others (0); ids are whole numbers, others an error; a very long text is read whole; repeated rows get a result each and are one another's next; the
order of documents is (id, hash of the text), null ids first; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, partitions, slices
from .shingle_join import Rule, jaccard_components

_MAP = bytes.maketrans((UPPER + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").encode(), (LOWER + " " * 32).encode())
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_MAP).split()


def common_words(docs: DataFrame, text_col: str = "text", anchors: int = 64) -> list[bytes]:
    """The most frequent words, ties by the word; counted over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for part in slices(batch, text_col):
                for text in part.column(text_col).to_pylist():
                    seen.update(plain_words(text))
                if len(seen) > 400_000:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    counted = docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r[0]) for r in counted.orderBy(F.desc("n"), "word").limit(anchors).collect()]


class Spotter:
    """Turns texts into sorted arrays of spots."""

    def __init__(self, anchors: list[bytes], chain: int = 2):
        self.anchors, self.chain, self.known = frozenset(anchors), chain, {}

    def _hashes(self, tokens: list[bytes]) -> np.ndarray:
        """Hashes of the words; the lowest bit tells anchors."""
        known = self.known
        if len(known) > 300_000:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = xxhash.xxh3_64_intdigest(t) & ~1 | (t in self.anchors)
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = plain_words(text)
        if not tokens:
            return np.array([xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 16], dtype=np.uint64) if text else np.zeros(0, dtype=np.uint64)
        h = self._hashes(tokens)
        anchor = (h & np.uint64(1)).astype(bool)
        at, content = np.flatnonzero(anchor), np.flatnonzero(~anchor)
        first = np.searchsorted(content, at)
        full = first + self.chain <= len(content)
        at, first = at[full], first[full]
        if len(at):
            spots = self._mixed(h[at], [h[content[first + i]] for i in range(self.chain)])
        else:
            tail = np.concatenate([h, np.zeros(self.chain, dtype=np.uint64)])
            spots = self._mixed(~h, [tail[i + 1 : i + 1 + len(h)] for i in range(self.chain)])
        return np.unique(spots)

    @staticmethod
    def _mixed(anchor: np.ndarray, chain: list[np.ndarray]) -> np.ndarray:
        x = anchor * _P[0]
        for word in chain:
            x = ((x ^ (x >> np.uint64(29))) + word) * _P[1]
        x = (x ^ (x >> np.uint64(32))) * _P[2]
        return (x ^ (x >> np.uint64(31))) >> np.uint64(16)


def encode(spots: np.ndarray) -> str:
    return base64.b64encode(spots.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode() if len(spots) else ""


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), dtype=np.uint8), raw], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def edited(text: str, following: str) -> str:
    """The last quarter of text gives way to as many first code points of the following text, or all of them."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts in slots of adjacent ids, in order within a slot; every slot ends with the first text of the next slot.

    Columns _slot, _guest, _id, _text.  Slots are cut at quantiles of the ids, four to a partition; only the cuts
    and each slot's first id go to the driver.  A text is shuffled once.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} is to be a whole number, as it gives the order of the documents")
    slots = 4 * partitions(docs.sparkSession)
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_key"))
    cuts = ids.agg(F.percentile_approx("_key", [i / slots for i in range(1, slots)], 20 * slots)).first()[0]
    cuts = np.array(sorted(set(cuts or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def slot_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="right").astype(np.int32))

    firsts = sorted((r[0], r[1]) for r in ids.groupBy(slot_of("_key").alias("s")).agg(F.min("_key")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def places(key: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, key.to_numpy(), side="right") * 2
        return pd.Series([[int(s)] if k not in before else [int(s), before[k] * 2 + 1] for s, k in zip(own, key)])

    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_place", F.explode(places("_key"))).withColumn("_slot", F.expr("_place div 2").cast("int")).withColumn("_guest", F.expr("_place % 2"))
    dealt = rows.repartition(partitions(docs.sparkSession), "_slot").sortWithinPartitions("_slot", "_guest", "_key", F.xxhash64("_text"))
    return dealt.select("_slot", "_guest", "_id", "_text")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: int = 64, chain: int = 2) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    words = common_words(docs, text_col, anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot, last = Spotter(words, chain), None
        for batch in batches:
            out: list[tuple] = []
            for part in slices(batch, "_text"):
                for slot, guest, doc, text in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if guest and (last is None or last[0] != slot):
                        continue
                    spots = spot(text)
                    if last is not None and last[0] == slot:
                        new = edited(last[2], text)
                        changed = spot(new)
                        out.append((
                            last[1], len(last[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), encode(last[3]), encode(changed),
                            likeness(last[3], changed), likeness(last[3], spots),
                        ))
                    last = None if guest else (slot, doc, text, spots)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out = []

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    dealt = with_next(docs, id_col, text_col).withColumn("_id", F.col("_id").cast("long"))
    got = dealt.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return got.withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class SpotRule(Rule):
    """Sets of spots in place of shingles."""

    anchors: tuple[bytes, ...] = ()
    chain: int = 2

    def maker(self):
        spot = Spotter(list(self.anchors), self.chain)
        return lambda text: spot(text) << np.uint64(15)


def near_classes(docs: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", anchors: int = 64, chain: int = 2) -> DataFrame:
    """id_col, n_spots, class_id for every row of docs: the smallest id that links of likeness num / den or more reach.

    Documents meet in lists of a spot that one of two alike sets must share, rarest spots first, in order of set length and
    parted where lengths are too far apart; sets are compared along a tree that drops what the bound on the rest rules
    out (see shingle_join, which does it for shingles).  No list is paired with itself, however long it is.
    """
    rule = SpotRule(chain + 1, num, den, tuple(common_words(docs, text_col, anchors)), chain)
    found = jaccard_components(docs, id_col, text_col, rule)
    return found.withColumnRenamed("n_shingles", "n_spots").withColumnRenamed("component_id", "class_id")
