"""N-gram Jaccard join by a prefix tree.

A document's set is its distinct k-word shingles as 63-bit hashes.  Candidates follow one global order: shingles with a
small hash by the number of sets that have them, then those with a larger hash, then those that very many documents
share, by how many.  Two sets that are alike enough must share a shingle among the first n - ceil(t * n) + 1 of both,
and a shingle of one set alone links nothing; documents that share one, at compatible sizes, are joined into
candidate groups (chains within each shingle's list, so a list of m documents gives m - 1 edges and no pairs).
Groups are joined exactly: each set walks a compressed trie of the group's sets, most shared shingles first,
carrying the overlap of the path that sets have in common, and leaves a subtree when what is left of both
sides cannot reach the overlap needed by the smallest set below, or when all sets below are linked to it already.

Equal sets are one node, so copies cost nothing after the first pass.  A group above `group_limit` shingles is dealt
into blocks, each joined on its own; then representatives of what is linked are joined, and at last the sets outside the
group's largest component with all its blocks.  So memory stays bounded, no link is lost, and a group of near copies
costs as its size.

The order uses counts over all documents; the list of shared shingles that is broadcast holds at most `shared_limit`,
the most frequent ones; that bound changes only the order, never the result.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased.  Defined cases: with fewer words than k the whole sequence is the one
shingle; null or wordless texts have an empty set, are linked with nothing and are their own component; repeated rows
are copies of one another; null ids take part and are never the smallest unless alone; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom, most_frequent, partitions, plain_names, slices, without, words, written
from .components import components

TOP = np.uint64(1) << np.uint64(63)
#: Shingles below this can be among the first of a set; only they are counted for the order.
COUNTED = np.uint64(3 << 60)
LOCAL = 3
#: Kinds of rows on the way to the deciding shingles, in the order in which a set meets its own.
HEAD, LAST, COUNT = 0, 1, 2
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@dataclass(frozen=True)
class Rule:
    k: int = 3
    num: int = 90
    den: int = 100

    def maker(self) -> Callable[[str | None], np.ndarray]:
        """What turns a text into its set: ascending numbers, spread evenly below 2**63."""
        return Shingler(self.k)

    def lead(self, n: int) -> int:
        """How many first shingles of a set of n can decide."""
        return n + (-self.num * n) // self.den + 1

    def cut(self) -> np.uint64:
        """Below it lie about twice as many shingles of a set as decide."""
        return np.uint64(int((0.02 + 1.8 * (1 - self.num / self.den)) * (1 << 63)))

    def linked(self, shared: int, n: int, m: int) -> bool:
        return self.den * shared >= self.num * (n + m - shared)


class Shingler:
    def __init__(self, k: int):
        self.k, self.known = k, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """The distinct shingles, ascending by hash."""
        tokens = words(text)
        if not tokens:
            return np.zeros(0, dtype=np.uint64)
        if len(tokens) < self.k:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), seed=1)], dtype=np.uint64) >> np.uint64(1)
        known = self.known
        if len(known) > 300_000:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = xxhash.xxh3_64_intdigest(t)
        h = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        n = len(h) - self.k + 1
        x = h[:n] * _P[0]
        for i in range(1, self.k):
            x = ((x ^ (x >> np.uint64(29))) + h[i : i + n]) * _P[1]
        x = (x ^ (x >> np.uint64(32))) * _P[2]
        return np.unique((x ^ (x >> np.uint64(31))) >> np.uint64(1))


def digest(s: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype="<i8")
    return int(d[0]), int(d[1])


def ordered(s: np.ndarray, shared: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in the global order, as ascending keys: shared shingles become 2**63 + rank."""
    if not len(shared) or not len(s):
        return s
    at = np.minimum(np.searchsorted(shared, s), len(shared) - 1)
    common = shared[at] == s
    if not common.any():
        return s
    return np.concatenate([s[~common], np.sort(rank[at[common]] + TOP)])


# --- the trie ----------------------------------------------------------------------------------------------


class _Node:
    __slots__ = ("part", "above", "below", "low", "high", "ends", "sole")

    def __init__(self, part: np.ndarray, above: _Node | None, low: int, high: int, sole: int):
        self.part, self.above, self.below, self.low, self.high, self.ends, self.sole = part, above, {}, low, high, [], sole


class LinkTree:
    """Sets come one by one, by ascending size: begin(), then probe() with sets before it that can be alike, then insert()."""

    def __init__(self, rule: Rule):
        self.rule, self.root, self.parent, self.leaves = rule, _Node(np.zeros(0, dtype=np.uint64), None, 1 << 60, 0, -1), [], []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def begin(self) -> int:
        self.parent.append(len(self.parent))
        return len(self.parent) - 1

    def probe(self, path: np.ndarray, own: int, candidates: list[int]) -> None:
        """Link own with those candidates that are alike; the walk takes only the paths to them."""
        rule, n = self.rule, len(path)
        total = rule.num + rule.den
        marked: set[_Node] = set()
        for other in candidates:
            node = self.leaves[other]
            while node is not None and node not in marked:
                marked.add(node)
                node = node.above
        todo = [(self.root, 0, 0)]
        while todo:
            node, depth, shared = todo.pop()
            if node.high * rule.den < rule.num * n or node.low * rule.num > n * rule.den:
                continue
            if node.sole >= 0 and self.find(node.sole) == self.find(own):
                continue
            if len(node.part):
                at = np.searchsorted(path, node.part)
                shared += int(np.count_nonzero(path[np.minimum(at, n - 1)] == node.part))
                depth += len(node.part)
                used = int(np.searchsorted(path, node.part[-1], side="right"))
                if total * (shared + min(node.high - depth, n - used)) < rule.num * (n + node.low):
                    continue
            if node.ends and rule.linked(shared, n, depth):
                for other in node.ends:
                    self.parent[self.find(other)] = self.find(own)
            todo.extend((x, depth, shared) for x in node.below.values() if x in marked)

    def insert(self, path: np.ndarray, own: int) -> None:
        node, n, at = self.root, len(path), 0
        while True:
            node.low, node.high = min(node.low, n), max(node.high, n)
            if node is self.root and own == 0:
                node.sole = own
            elif node.sole >= 0 and self.find(node.sole) != self.find(own):
                node.sole = -1
            if at == n:
                break
            child = node.below.get(int(path[at]))
            if child is None:
                child = node.below[int(path[at])] = _Node(path[at:], node, n, n, own)
                node = child
                break
            m = min(len(child.part), n - at)
            differ = np.flatnonzero(child.part[:m] != path[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.part):
                upper = _Node(child.part[:same], node, child.low, child.high, child.sole)
                child.part, child.above = child.part[same:], upper
                upper.below[int(child.part[0])] = child
                node.below[int(path[at])] = child = upper
            node, at = child, at + same
        node.ends.append(own)
        self.leaves.append(node)


def link_sets(sets: list[np.ndarray], rule: Rule) -> list[int]:
    """For each set the index of the first set (by size, then as given) of its component.

    Within the group the deciding shingles are taken by the group's own counts, rarest first; a set's candidates are
    the sets before it that share one of them and are not linked with it yet.  The latest set of a list is tried
    first: in a group of near copies one link tells all others.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum([len(s) for s in sets])
    lists: dict[int, list[int]] = {}
    sole: dict[int, int] = {}  # a member of the list, as long as all are linked, else -1
    tree = LinkTree(rule)
    find = tree.find
    for pos, i in enumerate(order):
        s = sets[i]
        own = at[ends[i] - len(s) : ends[i]]
        lead = own[np.lexsort((own, count[own]))[: rule.lead(len(s))]]
        decide = lead[count[lead] > 1].tolist()
        own, path = tree.begin(), (~s)[::-1]  # ascending again, most shared shingles first
        met = [k for k in decide if k in lists]
        if met:
            tree.probe(path, own, [lists[met[0]][-1]])
        todo = set()
        for k in met:
            if sole[k] < 0 or find(sole[k]) != find(own):
                todo.update(other for other in lists[k] if find(other) != find(own))
        if todo:
            tree.probe(path, own, list(todo))
        tree.insert(path, own)
        for k in decide:
            lists.setdefault(k, []).append(pos)
            if sole.setdefault(k, pos) >= 0 and find(sole[k]) != find(own):
                sole[k] = -1
    first: dict[int, int] = {}
    out = [0] * len(sets)
    for pos, i in enumerate(order):
        out[i] = first.setdefault(find(pos), i)
    return out


# --- the join ----------------------------------------------------------------------------------------------


def _sets_and_counts(docs: DataFrame, id_col: str, text_col: str, rule: Rule) -> DataFrame:
    """kind 0: id, digest and size of every row; kind 1: a shingle (d1) and how often a task met it (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, size = rule.maker(), [], 0

        def counts() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            value, n = value[n >= LOCAL], n[n >= LOCAL]
            return batch_of(pa.nulls(len(value), ids), value.astype(np.int64), np.zeros(len(value), dtype=np.int64), n, 1)

        def batch_of(id_, d1, d2, n, kind) -> pa.RecordBatch:
            arrays = [pa.array(np.full(len(n), kind, dtype=np.int32)), id_, pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(n, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["kind", "id", "d1", "d2", "n"])

        ids = None
        for batch in batches:
            ids = batch.schema.field(0).type
            for part in slices(batch, text_col):
                sets = [shingles(x) for x in part.column(text_col).to_pylist()]
                marks = [digest(s) if len(s) else (0, 0) for s in sets]
                yield batch_of(part.column(0), [d for d, _ in marks], [d for _, d in marks], np.array([len(s) for s in sets], dtype=np.int64), 0)
                for s in sets:
                    held.append(s[: np.searchsorted(s, COUNTED)])
                    size += len(held[-1])
                if size > 3_000_000:
                    yield counts()
                    held, size = [], 0
        if size:
            yield counts()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"kind int, id {kind}, d1 long, d2 long, n long")


def _first_shingles(docs: DataFrame, text_col: str, rule: Rule, order) -> DataFrame:
    """shingle, node, n: the deciding shingles of every set, in lists of no shingle that only one set has.

    A set's shingles below rule.cut() are counted exactly: they go to their shingle, where those of one set are
    dropped, and the others back to their set with the count.  There, as the dropped ones come first in the order, what
    is left of the deciding places goes to the rarest others.  Shingles from the cut on are needed only by sets with
    fewer deciding ones below it, and come last.
    """
    cut = rule.cut()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, (shared, rank), met = rule.maker(), order.value, set()
        for batch in batches:
            for part in slices(batch, text_col):
                heads, keys, nodes, kinds, sizes = [], [], [], [], []
                for text in part.column(text_col).to_pylist():
                    s = shingles(text)
                    # A task gives a set that it has met before only once.
                    if not len(s) or (node := digest(s)[0]) in met:
                        continue
                    met.add(node)
                    s = ordered(s, shared, rank)
                    below, lead = int(np.searchsorted(s, cut)), rule.lead(len(s))
                    own = s[: max(below, lead)]
                    heads.append((node, len(s), below))
                    keys.append(own)
                    nodes.append(node)
                    sizes.append(len(s))
                    kinds.append(np.where(np.arange(len(own)) < below, COUNT, LAST))
                if len(met) > 500_000:
                    met.clear()
                if heads:
                    head = np.array(heads, dtype=np.int64)
                    each = [len(k) for k in keys]
                    yield listed(np.full(len(head), HEAD), head[:, 0], head[:, 0], head[:, 1], head[:, 2])
                    yield listed(np.concatenate(kinds), np.concatenate(keys).view(np.int64), np.repeat(np.array(nodes, dtype=np.int64), each), np.repeat(np.array(sizes), each), np.zeros(sum(each)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By kind, shingle, node: keeps what is counted of two sets or more, with the count; all other kinds pass."""
        for rows in runs(batches, 1):
            kind, shingle, node = rows[0], rows[1], rows[2]
            new = np.ones(len(kind), dtype=bool)
            new[1:] = (kind[1:] != kind[:-1]) | (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])
            rows = [c[new] for c in rows]
            start, size = bounds(rows[0], rows[1])
            several = np.repeat(size > 1, size)
            keep = (rows[0] != COUNT) | several
            rows[4] = np.where(rows[0] == COUNT, np.repeat(size, size), rows[4])
            yield listed(*(c[keep] for c in rows))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By node, kind, count, shingle: the deciding ones of each set."""
        for rows in runs(batches, 2):
            new = np.ones(len(rows[0]), dtype=bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in (rows[0], rows[1], rows[2])])
            kind, shingle, node, n, aux = (c[new] for c in rows)
            start, size = bounds(node)
            at = np.arange(len(kind)) - np.repeat(start, size)
            head = np.repeat(start, size)
            counted = np.add.reduceat((kind == COUNT).astype(np.int64), start) if len(start) else np.zeros(0, dtype=np.int64)
            last = np.add.reduceat((kind == LAST).astype(np.int64), start) if len(start) else np.zeros(0, dtype=np.int64)
            lead = n[start] + (-rule.num * n[start]) // rule.den + 1
            need = lead - (aux[start] - counted)
            keep = (kind == LAST) | ((kind == COUNT) & (at - 1 - np.repeat(last, size) < np.repeat(need, size)))
            yield pa.RecordBatch.from_arrays([pa.array(shingle[keep]), pa.array(node[keep]), pa.array(n[head][keep].astype(np.int32))], ["shingle", "node", "n"])

    names = ["kind", "shingle", "node", "n", "aux"]

    def listed(kind, shingle, node, n, aux) -> pa.RecordBatch:
        types = [np.int32, np.int64, np.int64, np.int32, np.int32]
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(t)) for c, t in zip((kind, shingle, node, n, aux), types)], names)

    def bounds(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each run of equal keys."""
        new = np.ones(len(keys[0]), dtype=bool)
        if len(new):
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        start = np.flatnonzero(new)
        return start, np.diff(np.append(start, len(new)))

    def runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[np.ndarray]]:
        """The rows in pieces that never part equal values of column by."""
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy().astype(np.int64) for i in range(5)]
            same = np.flatnonzero(rows[by] != rows[by][-1])
            end = int(same[-1]) + 1 if len(same) else 0
            if end or (held and held[-1][by][-1] != rows[by][0]):
                whole = [np.concatenate([*(h[i] for h in held), rows[i][:end]]) for i in range(5)]
                held = []
                if len(whole[0]):
                    yield whole
            held.append([c[end:] for c in rows])
        if held:
            yield [np.concatenate([h[i] for h in held]) for i in range(5)]

    kinds = "kind int, shingle long, node long, n int, aux int"
    at_shingle = docs.select(text_col).mapInArrow(emit, kinds).repartition(partitions(docs.sparkSession), "shingle").sortWithinPartitions("kind", "shingle", "node")
    at_node = at_shingle.mapInArrow(count, kinds).repartition(partitions(docs.sparkSession), "node").sortWithinPartitions("node", "kind", "aux", "shingle")
    return at_node.mapInArrow(choose, "shingle long, node long, n int")


def _chains(lists: DataFrame, rule: Rule) -> DataFrame:
    """Edges between the members of each shingle's list, split where sizes are too far apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # shingle, size and head of the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            shingle, node, n = (batch.column(i).to_numpy() for i in range(3))
            n = n.astype(np.int64)
            new = np.ones(len(n), dtype=bool)
            new[1:] = (shingle[1:] != shingle[:-1]) | (n[:-1] * rule.den < n[1:] * rule.num)
            if last is not None:
                new[0] = shingle[0] != last[0] or last[1] * rule.den < n[0] * rule.num
            at = np.maximum.accumulate(np.where(new, np.arange(len(n)), -1))
            head = np.where(at >= 0, node[np.maximum(at, 0)], 0 if last is None else last[2])
            last = (int(shingle[-1]), int(n[-1]), int(head[-1]))
            pairs = np.unique(np.column_stack([head, node])[head != node], axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    sorted_lists = lists.repartition(partitions(lists.sparkSession), "shingle").sortWithinPartitions("shingle", "n", "node")
    return sorted_lists.mapInArrow(run, "a long, b long").distinct()


def _linked(members: DataFrame, rule: Rule, order) -> DataFrame:
    """Edges (a, b) of digests between each set and the first of its component, for every group and pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, (shared, rank) = rule.maker(), order.value
        group, sets, marks, out = None, [], [], []

        def close() -> None:
            if len(sets) > 1:
                out.extend((marks[head], marks[i]) for i, head in enumerate(link_sets(sets, rule)) if head != i)

        for batch in batches:
            for part in slices(batch, "text"):
                for g, lo, hi, d1, d2, text in zip(*(part.column(i).to_pylist() for i in range(6))):
                    if (g, lo, hi) != group:
                        close()
                        group, sets, marks = (g, lo, hi), [], []
                    sets.append(ordered(shingles(text), shared, rank))
                    marks.append({"d1": d1, "d2": d2})
                if out:
                    yield rows(out)
                    out = []
        close()
        if out:
            yield rows(out)

    mark = pa.struct([("d1", pa.int64()), ("d2", pa.int64())])
    rows = lambda out: pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], mark), pa.array([b for _, b in out], mark)], ["a", "b"])
    dealt = members.select("root", "lo", "hi", "d1", "d2", "text").repartition(partitions(members.sparkSession), "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "d1", "d2")
    return dealt.mapInArrow(run, "a struct<d1: bigint, d2: bigint>, b struct<d1: bigint, d2: bigint>")


def _verdicts(docs: DataFrame, id_col: str, text_col: str, rule: Rule, group_limit: int = 4_000_000, shared_limit: int = 1 << 17) -> DataFrame:
    """id, d1, d2, n, component_id, head for every row of docs; head is the one set of the component that is its smallest id's."""
    spark = docs.sparkSession
    base = written(_sets_and_counts(docs, id_col, text_col, rule), "sets")
    sets = base.where("kind = 0").select("id", "d1", "d2", "n")
    many = written(base.where("kind = 1").groupBy("d1").agg(F.sum("n").alias("n")), "shared")
    many = np.array(sorted((r[1], r[0]) for r in most_frequent(many, "n", shared_limit, "d1").collect()), dtype=np.int64).reshape(-1, 2)
    by_value = np.argsort(many[:, 1])
    order = spark.sparkContext.broadcast((many[by_value, 1].astype(np.uint64), by_value.astype(np.uint64)))

    groups = components(_chains(_first_shingles(docs, text_col, rule, order), rule))
    # One document stands for each set.  Ids are nullable, so the choice is by the least struct.
    nodes = written(sets.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("id"), F.first("n").alias("n")), "nodes")
    found = written(nodes.join(groups.select(F.col("node").alias("d1"), "root"), "d1"), "groups")
    groups = found.groupBy("root").agg(F.sum("n").alias("_total"), F.count("*").alias("_sets"))
    groups = written(groups.where("_sets > 1").select("root", F.ceil(F.col("_total") / group_limit).cast("int").alias("blocks")), "blocks")
    own = F.pmod(F.xxhash64("d1", "d2"), F.col("blocks")).cast("int")
    found = written(found.join(groups, "root").withColumn("own", own).withColumnRenamed("id", "_id"), "members")
    texts = docs.select(F.col(id_col).alias("_did"), F.col(text_col).alias("text"))
    texts = texts.where(bloom(found, "_id")(F.col("_did")))
    repeated = id_col_repeats(sets)

    def joined(rows: DataFrame) -> DataFrame:
        """Links inside each (root, lo, hi)."""
        members = texts.join(rows.select("root", "lo", "hi", "d1", "d2", "_id"), F.col("_did").eqNullSafe(F.col("_id"))).drop("_id", "_did")
        return written(_linked(_own_texts(members, rule) if repeated else members, rule, order), "links")

    links = joined(found.withColumn("lo", F.col("own")).withColumn("hi", F.col("own")))
    large = found.where("blocks > 1")
    if large.limit(1).count():
        links = _across(large, links, joined, group_limit)
    links = components(links)

    mark = F.struct("d1", "d2")
    named = nodes.withColumn("mark", mark).join(links, F.col("mark") == F.col("node"), "left").withColumn("root", F.coalesce("root", "mark"))
    named = written(named.select("d1", "d2", "id", "root"), "named")
    first = F.min_by(mark, F.struct(F.col("id").isNull(), "id", "d1", "d2"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"), first.alias("head"))
    verdict = written(named.join(least, "root").select("d1", "d2", "component_id", "head"), "verdict")
    whole = sets.where("n > 0").join(verdict, ["d1", "d2"])
    empty = sets.where("n = 0").withColumn("component_id", F.col("id"))
    return whole.unionByName(empty, allowMissingColumns=True)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule(), group_limit: int = 4_000_000, shared_limit: int = 1 << 17) -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id that links reach) for every row of docs."""
    both = _verdicts(docs, id_col, text_col, rule, group_limit, shared_limit)
    return both.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _across(large: DataFrame, links: DataFrame, joined, group_limit: int) -> DataFrame:
    """Links between the blocks of large groups, beside those inside blocks (links).

    Representatives of what is linked inside blocks are joined first; in a group of near copies that leaves one
    component.  Then only sets outside the largest component of their group are still to be met, by all blocks of it.
    """
    mark = F.struct("d1", "d2")

    def placed(links: DataFrame) -> DataFrame:
        """large with comp, the component of each set as far as it is known."""
        known = components(links).select(F.col("node").alias("_node"), F.col("root").alias("_comp"))
        return written(large.join(known, F.struct("d1", "d2") == F.col("_node"), "left").withColumn("comp", F.coalesce("_comp", mark)).drop("_node", "_comp"), "placed")

    heads = placed(links).where(F.col("comp") == mark)
    heads = heads.withColumn("lo", F.lit(-1)).withColumn("hi", F.pmod(F.xxhash64("d2", "d1"), F.col("blocks")).cast("int"))
    # Only heads of several sets, as single ones are met below in any case.
    several = written(links.select(F.col("a.d1").alias("d1"), F.col("a.d2").alias("d2")).unionByName(links.select("b.d1", "b.d2")).distinct(), "several")
    heads = heads.join(several, ["d1", "d2"], "left_semi")
    weight = heads.groupBy("root").agg(F.sum("n").alias("_w"))
    heads = heads.join(weight, "root").withColumn("hi", F.when(F.col("_w") <= group_limit, F.lit(-1)).otherwise(F.col("hi"))).drop("_w")
    links = written(links.unionByName(joined(heads)), "links")

    now = placed(links)
    sizes = now.groupBy("root", "comp").agg(F.count("*").alias("_sets"))
    main = written(sizes.groupBy("root").agg(F.max_by("comp", F.struct("_sets", "comp")).alias("_main")), "main")
    outside = written(now.join(main, "root").where(F.col("comp") != F.col("_main")).drop("_main"), "outside")
    rest = written(outside.groupBy("root").agg(F.ceil(F.sum("n") / group_limit).cast("int").alias("_parts")), "rest")
    part = F.pmod(F.xxhash64("d1", "d2"), F.col("_parts")).cast("int")
    asked = outside.join(rest, "root").withColumn("lo", part).withColumn("hi", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    there = now.join(rest, "root").withColumn("hi", F.col("own")).withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    both = asked.select("root", "lo", "hi", "d1", "d2", "_id").unionByName(there.select("root", "lo", "hi", "d1", "d2", "_id")).distinct()
    return links.unionByName(joined(both))


def id_col_repeats(sets: DataFrame) -> bool:
    """Whether an id stands at more than one set, so that an id alone does not name a text."""
    return bool(sets.groupBy("id").agg(F.min(F.struct("d1", "d2")).alias("x"), F.max(F.struct("d1", "d2")).alias("y")).where("x <> y").limit(1).count())


def _own_texts(members: DataFrame, rule: Rule) -> DataFrame:
    """Only the rows whose text has the digest that they were joined for, one for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = rule.maker()
        for batch in batches:
            for part in slices(batch, "text"):
                own = [digest(shingles(t)) for t in part.column("text").to_pylist()]
                yield part.filter(pa.array([m == d for m, d in zip(own, zip(part.column("d1").to_pylist(), part.column("d2").to_pylist()))], pa.bool_()))

    return members.mapInArrow(run, members.schema).dropDuplicates(["root", "lo", "hi", "d1", "d2"])


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule(5, 80, 100)) -> DataFrame:
    """docs with one row of each component, of the smallest id; rows without words all stay."""
    names, docs, (id_col, text_col) = plain_names(docs, id_col, text_col)
    stays = (F.col("n") == 0) | (F.col("id").eqNullSafe(F.col("component_id")) & (F.struct("d1", "d2") == F.col("head")))
    found = written(_verdicts(docs, id_col, text_col, rule).select("id", "d1", "d2", "n", stays.alias("stays")), "verdicts")
    gone = written(found.where(~F.col("stays")).select(F.col("id").alias("_gone")).distinct(), "gone")
    several = written(found.groupBy("id").count().where("count > 1").select(F.col("id").alias("_several")), "several")
    if not several.limit(1).count():
        return without(docs, id_col, gone, "_gone").toDF(*names)
    # An id of several rows does not name a row: they are judged by id and set.
    left = without(without(docs, id_col, several, "_several"), id_col, gone, "_gone")
    rows = docs.where(bloom(several, "_several")(F.col(id_col)))
    rows = _with_digests(rows.join(several, rows[id_col].eqNullSafe(several["_several"]), "left_semi"), text_col, rule)
    kept = found.where("stays and n > 0").select(F.col("id").alias("_id_kept"), F.col("d1").alias("_k1"), F.col("d2").alias("_k2"))
    same = rows[id_col].eqNullSafe(kept["_id_kept"]) & (rows["_d1"] == kept["_k1"]) & (rows["_d2"] == kept["_k2"])
    one = rows.where("_n > 0").join(kept, same, "left_semi").dropDuplicates([id_col, "_d1", "_d2"])
    return left.unionByName(rows.where("_n = 0").unionByName(one).drop("_d1", "_d2", "_n")).toDF(*names)


def _with_digests(docs: DataFrame, text_col: str, rule: Rule) -> DataFrame:
    """docs with the digest (_d1, _d2) and size (_n) of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = rule.maker()
        for batch in batches:
            for part in slices(batch, text_col):
                sets = [shingles(t) for t in part.column(text_col).to_pylist()]
                marks = [digest(s) if len(s) else (0, 0) for s in sets]
                more = [[d for d, _ in marks], [d for _, d in marks], [len(s) for s in sets]]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.int64()) for x in more)], [*part.schema.names, "_d1", "_d2", "_n"])

    return docs.mapInArrow(run, docs.withColumns({c: F.lit(0).cast("long") for c in ("_d1", "_d2", "_n")}).schema)
