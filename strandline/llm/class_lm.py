"""LM scoring by Brown class-based bigrams.

Exchange clustering assigns words to classes: a word moves to the class that raises the likelihood of the class bigrams
most.  The `head` most frequent words are exchanged one by one on the driver until no move helps.  Then all other
words of a list of the `listed` most frequent ones are exchanged at once, by the classes of their neighbours in all
training text, sweep after sweep until the likelihood gains less than `tolerance` a token.  Every further word of at least `least`
occurrences takes the best class beside its neighbours once, as those of the list stand then.  So every word of
`least` occurrences has a class, at any size; words below `least`, and the unknown one, form the class of rare words.
A text's probability is the product of smoothed class transitions and of the words' emission probabilities in their classes:

    P(w | c') = (n(c', c) + s * p(c)) / (n(c') + s) * e(w | c),   c the class of w

with e(w | c) = n(w) / n(c), and (n(w) + 1) / (n(rare) + V(rare) + 1) for rare words.  The end of a text is a class and
a token of its own; a text starts after an end.

Counts cover all training text.  The driver and the broadcasts hold what parameters bound: 21 bytes for each of at most `listed`
words, (head + 2)**2 pair counts, (classes + 2)**2 transitions.  Every text is read twice, to count and to code its words, and
is numbers from then on.  Words that are not listed meet their class and count in a join on the word, once for each
text, and the classes go back to the text; such a word is never frequent, so the join is not skewed.  Words are known by
63-bit hashes, and two words of one hash count as one; among a billion distinct words the chance of such a pair is 1 in 20.

Tokens are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end.  Defined cases: null and empty texts are an end alone;
repeated rows are scored (and, in training, counted) each; a null id is training text; without training text all
words are unknown; an empty table gives an empty result; a very long text is coded as a whole, in memory of some ten times
its size; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, held_out, most_frequent, partitions, slices, words, written

#: Codes of tokens: 0 for a word that is not listed, 1 for the end, then the listed words, most frequent first.
END, FIRST = 1, 2
#: The bit that marks the hash of a word that is not listed where codes are looked up.
FAR = 1 << 63
#: Most words of a block of neighbours, entries in a block on average, and tokens that are worked on at once.
SPAN, ENTRIES, STEP = 4096, 250_000, 1 << 20
#: Bits for twice a code: at most 16 million words can be listed.
BITS = 25


def hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)) >> np.uint64(1)


def word_counts(training: DataFrame, text_col: str) -> DataFrame:
    """h, n over all training text, as a table; counted per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(hashes(list(seen)).view(np.int64)), pa.array(list(seen.values()), pa.int64())], ["h", "n"])
        for batch in batches:
            for part in slices(batch, "_text"):
                for text in part.column("_text").to_pylist():
                    seen.update(words(text))
                if len(seen) > 250_000:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    return written(training.select(F.col(text_col).cast("binary").alias("_text")).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")


# --- exchange clustering -----------------------------------------------------------------------------------


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(pairs: np.ndarray, classes: int) -> np.ndarray:
    """Classes 0 .. classes - 1 of words 0 .. m - 1, most frequent first.

    pairs: (m + 1, m + 1) counts of adjacent words; m stands for everything else and keeps a class of its own.  A word
    moves where sum n(c, d) log n(c, d) - sum n(c) log n(c) - sum n(., d) log n(., d) gains most.
    """
    m = len(pairs) - 1
    k = min(classes, m)
    if k <= 0:
        return np.zeros(m, dtype=np.int64)
    rest = classes
    of = np.append(np.arange(m) % k, rest)
    pairs = pairs.astype(float)
    after = np.zeros((m + 1, classes + 1))  # of each word: by class of what follows
    before = np.zeros((m + 1, classes + 1))
    for c in np.unique(of):
        after[:, c] = pairs[:, of == c].sum(1)
        before[:, c] = pairs[of == c, :].sum(0)
    grid = np.zeros((classes + 1, classes + 1))
    np.add.at(grid, of, after)
    itself = pairs.diagonal()
    moved = 1
    while moved:
        moved = 0
        for w in range(m):
            a, out, into, own = of[w], after[w].copy(), before[w].copy(), itself[w]
            out[a] -= own
            into[a] -= own
            # grid without w
            grid[a] -= out
            grid[:, a] -= into
            grid[a, a] -= own
            # Sums with w as a neighbour, wherever it goes.
            rows, cols = grid.sum(1) + into, grid.sum(0) + out
            c = np.arange(k)
            gain = (_xlogx(grid[:k] + out) - _xlogx(grid[:k])).sum(1) + (_xlogx(grid[:, :k] + into[:, None]) - _xlogx(grid[:, :k])).sum(0)
            corner = grid[c, c]
            gain += _xlogx(corner + out[c] + into[c] + own) - _xlogx(corner + out[c]) - _xlogx(corner + into[c]) + _xlogx(corner)
            gain -= _xlogx(rows[:k] + out.sum() + own) - _xlogx(rows[:k]) + _xlogx(cols[:k] + into.sum() + own) - _xlogx(cols[:k])
            b = int(gain.argmax())
            b = a if gain[b] <= gain[a] + 1e-9 else b
            grid[b] += out
            grid[:, b] += into
            grid[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                after[:, a] -= pairs[:, w]
                after[:, b] += pairs[:, w]
                before[:, a] -= pairs[w]
                before[:, b] += pairs[w]
    return of[:m]


def place(left: np.ndarray, right: np.ndarray, grid: np.ndarray, classes: int) -> np.ndarray:
    """The best class of further words, from the classes before (left) and after (right) each: one exchange step.

    grid: counts of adjacent classes, smoothed here so that no cell is empty.
    """
    p = grid + 0.1
    apart = np.log(p) - np.log(p.sum(1, keepdims=True)) - np.log(p.sum(0, keepdims=True))
    gain = left @ apart[:, :classes] + right @ apart[:classes].T
    return gain.argmax(1)


# --- coded text --------------------------------------------------------------------------------------------


def _binary(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """Runs of data, of the given sizes, as binary values."""
    ends = np.append(0, np.cumsum(sizes) * data.itemsize)
    if ends[-1] >= 1 << 31:
        raise ValueError("a slice of texts is over 2 GB of codes")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the runs in a binary column, and all of them on end."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return np.diff(ends) // np.dtype(kind).itemsize, data.view(kind)


class Coder:
    """Codes of listed words, and hashes with the bit FAR of all others."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray):
        self.keys, self.codes, self.known = keys, codes, {}

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 300_000:
            known.clear()
        fresh = list(set(tokens).difference(known))
        if fresh:
            h = hashes(fresh)
            found = h | np.uint64(FAR)
            if len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                found = np.where(self.keys[at] == h, self.codes[at].astype(np.uint64), found)
            known.update(zip(fresh, found.tolist()))
        return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


@dataclass(frozen=True)
class Listed:
    """The most frequent words: sorted hashes with their codes, and counts by code (those of 0 and of the end are 0)."""

    keys: np.ndarray
    codes: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, h: np.ndarray, n: np.ndarray) -> Listed:
        h = h.astype(np.uint64)
        by_count = np.lexsort((h, -n))
        by_hash = np.argsort(h[by_count], kind="stable")
        return cls(h[by_count][by_hash], (by_hash + FIRST).astype(np.int32), np.concatenate([np.zeros(FIRST, dtype=np.int64), n[by_count]]))


def _coded(docs: DataFrame, id_col: str, text_col: str, train: Column, listed: Listed) -> DataFrame:
    """row, id, train, x (codes of the tokens, the end last), t (hashes of those that are not listed, in order) as a table."""
    held = docs.sparkSession.sparkContext.broadcast((listed.keys, listed.codes))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*held.value)
        for batch in batches:
            for part in slices(batch, "_text", 1 << 20):
                split = [words(text) for text in part.column("_text").to_pylist()]
                sizes = np.array([len(s) + 1 for s in split])
                ends = np.cumsum(sizes) - 1
                x = np.full(int(sizes.sum()), END, dtype=np.uint64)
                inner = np.ones(len(x), dtype=bool)
                inner[ends] = False
                x[inner] = coder([w for s in split for w in s])
                far = x >= np.uint64(FAR)
                t = (x[far] ^ np.uint64(FAR)).astype("<i8")
                each = np.add.reduceat(far.astype(np.int64), ends - sizes + 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _binary(sizes, np.where(far, 0, x).astype("<i4")), _binary(each, t)], ["id", "train", "x", "t"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), train.alias("_train"), F.col(text_col).cast("binary").alias("_text"))
    rows = rows.mapInArrow(code, f"id {kind}, train boolean, x binary, t binary")
    # The number is that of the row as it was written.
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "codes", "zstd")


def _steps(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of x with what stands before each of their elements; before the first is an end, which is the last of x."""
    for i in range(0, len(x), STEP):
        now = x[i : i + STEP]
        yield x[i - 1 : i - 1 + len(now)] if i else np.append(x[-1], now[:-1]), now


def _pair_counts(coded: DataFrame, column: str, kind, size: int, lookup: np.ndarray) -> np.ndarray:
    """size x size counts of what lookup gives for adjacent codes, over all training text."""
    held = coded.sparkSession.sparkContext.broadcast(lookup)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = held.value.astype(np.int64)
        sums = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for before, now in _steps(_flat(batch.column(0), kind)[1]):
                cell = lookup[before] * size + lookup[now]
                sums += np.bincount(cell, minlength=size * size)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["cell", "n"])

    cells = coded.where("train").select(column).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    held.unpersist()
    grid = np.zeros(size * size, dtype=np.int64)
    grid[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return grid.reshape(size, size)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their sums."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    return key[at], np.add.reduceat(n, at) if len(at) else n


def _neighbours(coded: DataFrame, first: int, blocks: int, span: int) -> DataFrame:
    """block, data for every block of words: the neighbours of the codes from first on, one row a block.

    A code's block is the code modulo blocks.  data: three rows of 32-bit numbers: place in the block, twice the neighbour's
    code (plus 1 where it comes after), count.
    """

    def rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        word = key >> BITS
        block = word // span
        at = np.flatnonzero(np.diff(block, prepend=-1))
        data = np.empty((3, len(key)), dtype="<u4")
        data[0], data[1], data[2] = word % span, key & ((1 << BITS) - 1), n
        return pa.RecordBatch.from_arrays([pa.array(block[at]), pa.array([data[:, i:j].tobytes() for i, j in zip(at, [*at[1:], len(key)])], pa.binary())], ["block", "data"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for before, now in _steps(_flat(batch.column(0), "<i4")[1]):
                before, now = before.astype(np.int64), now.astype(np.int64)
                # What follows the last of a piece is met as the one before the first of the next, which is an end or that code.
                for word, near, side in ((now, before, 0), (before, now, 1)):
                    here = np.flatnonzero(word >= first)
                    place = (word[here] % blocks) * span + word[here] // blocks
                    parts.append(place << BITS | near[here] << 1 | side)
                    size += len(here)
                if size > 2 * STEP:
                    yield rows(*np.unique(np.concatenate(parts), return_counts=True))
                    parts, size = [], 0
        if size:
            yield rows(*np.unique(np.concatenate(parts), return_counts=True))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []

        def whole() -> pa.RecordBatch:
            word, near, n = np.concatenate(parts, axis=1).astype(np.int64)
            return rows(*_summed((word + block * span) << BITS | near, n))

        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                if b != block:
                    if parts:
                        yield whole()
                    block, parts = b, []
                parts.append(np.frombuffer(data.as_buffer(), "<u4").reshape(3, -1))
        if parts:
            yield whole()

    dealt = coded.where("train").select("x").mapInArrow(gather, "block long, data binary").repartition(partitions(coded.sparkSession), "block")
    return written(dealt.sortWithinPartitions("block").mapInArrow(merge, "block long, data binary"), "neighbours")


def _sweep(near: DataFrame, blocks: int, span: int, kinds: np.ndarray, grid: np.ndarray, classes: int) -> np.ndarray:
    """One exchange step of all words of the blocks at once; other words keep what they have."""
    held = near.sparkSession.sparkContext.broadcast((kinds, grid))
    size = len(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, grid = held.value
        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                word, near, n = np.frombuffer(data.as_buffer(), "<u4").reshape(3, -1).astype(np.int64)
                cell = (word * 2 + (near & 1)) * size + kinds[near >> 1]
                sides = np.bincount(cell, weights=n, minlength=2 * span * size).reshape(span, 2, size)
                own = kinds[b::blocks].copy()
                at = np.unique(word)
                own[at] = place(sides[at, 0], sides[at, 1], grid, classes)
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([own.tobytes()], pa.binary())], ["block", "data"])

    found = kinds.copy()
    got = near.mapInArrow(run, "block long, data binary").toArrow()
    held.unpersist()
    for b, data in zip(got.column("block").to_pylist(), got.column("data").to_pylist()):
        found[b::blocks] = np.frombuffer(data, kinds.dtype)
    return found


def _further(coded: DataFrame, kinds: np.ndarray, grid: np.ndarray, classes: int, rare: int, least: int) -> DataFrame:
    """h, n, kind of all training words that are not listed, as a table; kind is rare for those below least."""
    held = coded.sparkSession.sparkContext.broadcast((kinds, grid))
    size = len(grid)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = held.value[0].astype(np.int64)
        for batch in batches:
            x, t = _flat(batch.column(0), "<i4")[1], _flat(batch.column(1), "<i8")[1]
            at = np.flatnonzero(x == 0)
            for i in range(0, len(at), STEP):
                here, h = at[i : i + STEP], t[i : i + STEP]
                near = np.where(here > 0, kinds[x[here - 1]], kinds[END]) * size + kinds[x[here + 1]]
                order = np.lexsort((near, h))
                h, near = h[order], near[order]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (near[1:] != near[:-1])))
                n = np.diff(np.append(new, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(near[new].astype(np.int32)), pa.array(n)], ["h", "near", "n"])

    def choose(h: np.ndarray, near: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        grid = held.value[1]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        total = np.add.reduceat(n, start)
        kind = np.full(len(start), rare, dtype=np.int32)
        word = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))
        several = np.flatnonzero(total >= least)
        for i in range(0, len(several), 4096):
            some = several[i : i + 4096]
            lo, hi = start[some[0]], start[some[-1] + 1] if some[-1] + 1 < len(start) else len(h)
            slot = np.full(some[-1] - some[0] + 1, -1)
            slot[some - some[0]] = np.arange(len(some))
            own, where = slot[word[lo:hi] - some[0]], near[lo:hi]
            use = own >= 0
            own, where, weight = own[use], where[use], n[lo:hi][use]
            left = np.bincount(own * size + where // size, weights=weight, minlength=len(some) * size).reshape(-1, size)
            right = np.bincount(own * size + where % size, weights=weight, minlength=len(some) * size).reshape(-1, size)
            kind[some] = place(left, right, grid, classes)
        return pa.RecordBatch.from_arrays([pa.array(h[start]), pa.array(total), pa.array(kind)], ["h", "n", "kind"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, dtype=np.int64)] * 3
        for batch in batches:
            rows = [np.concatenate([r, batch.column(i).to_numpy().astype(np.int64)]) for i, r in enumerate(rest)]
            end = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            if end:
                yield choose(*(c[:end] for c in rows))
            rest = [c[end:] for c in rows]
        if len(rest[0]):
            yield choose(*rest)

    met = coded.where("train and octet_length(t) > 0").select("x", "t").mapInArrow(gather, "h long, near int, n long")
    met = met.repartition(partitions(coded.sparkSession), "h").sortWithinPartitions("h")
    return written(met.mapInArrow(pick, "h long, n long, kind int"), "further")


# --- the model ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ClassModel:
    """classes + 2 classes: the last two are rare words and the end."""

    total: int  # training tokens
    distinct: int
    ends: int  # training texts
    listed: Listed
    kinds: np.ndarray  # class by code
    further: DataFrame  # h, n, kind of all other training words
    of_class: np.ndarray  # log10 of the emission's denominator
    rare: int
    jump: np.ndarray | None = None  # log10 of transitions

    @property
    def base(self) -> float:
        return math.log10(self.total + self.distinct + 1)


def _stream(size: int):
    return np.uint8 if size <= 256 else np.dtype("<u2")


def _filled(coded: DataFrame, model: ClassModel) -> DataFrame:
    """id, train, c (classes of the tokens), n_tokens, n_known, log_n (sum of log10(count + 1)), said (of log10 e(w | c)) as a table."""
    listed, kinds = model.listed, model.kinds
    n = listed.n.astype(float)
    n[END] = model.ends
    said = np.log10(np.maximum(n, 1)) - model.of_class[kinds]
    said[:FIRST] = 0
    held = coded.sparkSession.sparkContext.broadcast((kinds, said, np.log10(n + 1), model.of_class))
    rare, known_end, stream = model.rare, int(model.ends > 0), _stream(len(model.of_class))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, t = _flat(batch.column(1), "<i8")
            row = np.repeat(batch.column(0).to_numpy(), sizes)
            order = np.lexsort((t, row))
            row, t = row[order], t[order]
            new = np.append(True, (row[1:] != row[:-1]) | (t[1:] != t[:-1])) if len(t) else np.zeros(0, dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(row[new]), pa.array(t[new])], ["row", "h"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, said, log_n, of_class = held.value
        for batch in batches:
            (sizes, x), (_, t) = _flat(batch.column("x"), "<i4"), _flat(batch.column("t"), "<i8")
            found = batch.column("found").flatten().flatten()
            h, at = np.unique(found[0].to_numpy(zero_copy_only=False).astype(np.int64), return_index=True)
            count, kind = (found[i].to_numpy(zero_copy_only=False).astype(np.int64)[at] for i in (1, 2))
            far_n, far_kind = np.zeros(len(t)), np.full(len(t), rare)
            if len(h):
                at = np.minimum(np.searchsorted(h, t), len(h) - 1)
                met = h[at] == t
                far_n[met], far_kind[met] = count[at][met], kind[at][met]
            far_known = np.log10(far_n + 1)
            far_said = np.where(far_kind == rare, far_known, np.log10(np.maximum(far_n, 1))) - of_class[far_kind]
            c = np.empty(len(x), dtype=stream)
            tokens, starts = np.zeros(len(sizes) + 1, dtype=np.int64), np.append(0, np.cumsum(sizes))
            sums = np.zeros((3, len(sizes)))
            # Text by text in pieces, so that a batch needs no more than a few numbers a token at once.
            far_at = 0
            i = 0
            while i < len(sizes):
                j = max(i + 1, int(np.searchsorted(starts, starts[i] + STEP, side="right")) - 1)
                piece = x[starts[i] : starts[j]]
                far = np.flatnonzero(piece == 0)
                own = slice(far_at, far_at + len(far))
                far_at += len(far)
                part = kinds[piece]
                part[far] = far_kind[own]
                c[starts[i] : starts[j]] = part
                begin = starts[i:j] - starts[i]
                for k, (all_of, of_far) in enumerate(((log_n, far_known), (said, far_said))):
                    each = all_of[piece]
                    each[far] = of_far[own]
                    sums[k, i:j] = np.add.reduceat(each, begin)
                hit = (piece != 0).astype(np.int64)
                hit[piece == END] = known_end
                hit[far] = far_n[own] > 0
                sums[2, i:j] = np.add.reduceat(hit, begin)
                i = j
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("train"), _binary(sizes, c), pa.array(sizes), pa.array(sums[2].astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])],
                ["id", "train", "c", "n_tokens", "n_known", "log_n", "said"],
            )

    asked = coded.where("octet_length(t) > 0").select("row", "t").mapInArrow(ask, "row long, h long")
    answers = asked.join(model.further, "h").groupBy("row").agg(F.collect_list(F.struct("h", "n", "kind")).alias("found"))
    kind = coded.schema["id"].dataType.simpleString()
    both = coded.join(answers, "row", "left").select("id", "train", "x", "t", "found")
    return written(both.mapInArrow(fill, f"id {kind}, train boolean, c binary, n_tokens long, n_known long, log_n double, said double"), "classes", "zstd")


def _likelihood(jumps: np.ndarray) -> float:
    """What exchange() raises."""
    return float(_xlogx(jumps.astype(float)).sum() - _xlogx(jumps.sum(0).astype(float)).sum() - _xlogx(jumps.sum(1).astype(float)).sum())


def _learned(
    docs: DataFrame, train: Column, id_col: str, text_col: str, classes: int = 64, head: int = 1024, listed: int = 1 << 20, smoothing: float = 20.0, least: int = 2, tolerance: float = 1e-4,
) -> tuple[ClassModel, DataFrame]:
    """The model of the rows for which train holds, and the classes of the tokens of all rows."""
    counts = word_counts(docs.where(train), text_col)
    top = most_frequent(counts.where(F.col("n") >= least), "n", listed, "h").toArrow()
    words = Listed.of(top.column("h").to_numpy(), top.column("n").to_numpy())
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    forget(counts)
    coded = _coded(docs, id_col, text_col, train, words)
    ends = coded.where("train").count()
    total, distinct = int(total) + ends, int(distinct) + (ends > 0)
    rare, stop, size = classes, classes + 1, classes + 2
    reach, m = len(words.n), min(head, len(words.keys))

    # For the exchange, other words and the end are the last row; they keep their own class there.
    lookup = np.zeros(reach, dtype=np.int32)
    lookup[: FIRST + m] = np.arange(FIRST + m)
    grid = _pair_counts(coded, "x", "<i4", m + FIRST, lookup)
    order = np.append(np.arange(FIRST, m + FIRST), [0])
    pairs = grid[np.ix_(order, order)]
    pairs[-1] += grid[END, order]
    pairs[:, -1] += grid[order, END]
    kinds = np.full(reach, rare, dtype=_stream(size))
    kinds[END], kinds[FIRST : FIRST + m] = stop, exchange(pairs, classes)

    jumps = _pair_counts(coded, "x", "<i4", size, kinds)
    some = min(classes, max(1, m))
    if reach > FIRST + m:
        entries = 2 * int(words.n[FIRST + m :].sum())
        blocks = max(1, -(-reach // SPAN), min(reach, entries // ENTRIES))
        span = -(-reach // blocks)
        near = _neighbours(coded, FIRST + m, blocks, span)
        # Before the first sweep words outside the head have no class, so whatever it gives is taken.
        best = -math.inf
        while True:
            found = _sweep(near, blocks, span, kinds, jumps, some)
            after = _pair_counts(coded, "x", "<i4", size, found)
            reached = _likelihood(after)
            gain = reached - best
            if gain > 0:
                best, kinds, jumps = reached, found, after
            if gain <= tolerance * total:
                break
        forget(near)
    further = _further(coded, kinds, jumps, some, rare, least)

    of_class = np.zeros(size)
    np.add.at(of_class, kinds[FIRST:], words.n[FIRST:])
    for r in further.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        of_class[r["kind"]] += r["n"] + (r["words"] if r["kind"] == rare else 0)
    of_class[rare] += 1
    of_class[stop] = 1
    model = ClassModel(total, distinct, ends, words, kinds, further, np.log10(np.maximum(of_class, 1)), rare)
    filled = _filled(coded, model)
    forget(coded)
    jumps = _pair_counts(filled, "c", _stream(size), size, np.arange(size)).astype(float)
    share = (jumps.sum(0) + 1) / (jumps.sum() + size)
    jump = (jumps + smoothing * share) / (jumps.sum(1, keepdims=True) + smoothing)
    return replace(model, jump=np.log10(jump)), filled


def _scored(filled: DataFrame, model: ClassModel, id_col: str) -> DataFrame:
    held = filled.sparkSession.sparkContext.broadcast(model.jump)
    stream, stop = _stream(len(model.of_class)), model.rare + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, c = _flat(batch.column("c"), stream)
            starts = np.append(0, np.cumsum(sizes))
            score, i = np.zeros(len(sizes)), 0
            while i < len(sizes):
                j = max(i + 1, int(np.searchsorted(starts, starts[i] + STEP, side="right")) - 1)
                piece = c[starts[i] : starts[j]]
                score[i:j] = np.add.reduceat(held.value[np.append(stop, piece[:-1]), piece], starts[i:j] - starts[i])
                i = j
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(score + batch.column("said").to_numpy())], [*kept, "score"])

    kept = ["id", "n_tokens", "n_known", "log_n"]
    kind = filled.schema["id"].dataType.simpleString()
    got = filled.select(*kept, "said", "c").mapInArrow(run, f"id {kind}, n_tokens long, n_known long, log_n double, score double")
    return got.select(
        F.col("id").alias(id_col),
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("log_n") - F.col("n_tokens") * F.lit(model.base)).alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def fit_classes(training: DataFrame, text_col: str = "text", **how) -> ClassModel:
    """The model of all rows of training; how: classes, head, listed, smoothing, least, tolerance."""
    model, filled = _learned(training.select(F.lit(0).alias("_no"), F.col(text_col)), F.lit(True), "_no", text_col, **how)
    forget(filled)
    return model


def score_texts(docs: DataFrame, model: ClassModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row of docs."""
    return _scored(_filled(_coded(docs, id_col, text_col, F.lit(False), model.listed), model), model, id_col)


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2, **how) -> DataFrame:
    """Learn from the documents that are not held out, score all of them; adds held_out."""
    held = held_out(F.col(id_col), modulus, remainder)
    model, filled = _learned(docs, ~held, id_col, text_col, **how)
    return _scored(filled, model, id_col).withColumn("held_out", held)
