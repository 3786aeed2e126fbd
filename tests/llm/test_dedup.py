"""Exact, line and shingle dedup against brute force on small tables."""

import hashlib
import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from strandline.llm import exact_dedup, line_dedup, shingle_join

SCHEMA = "doc_id long, text string, source string, _id string, n int, kind int, root string, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", "x", 1, 2, "r", "y") for i, t in rows], SCHEMA)


def corpus(n=160, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "two words"), (6, "x" * 50_000)]
    made = []
    for i in range(7, n):
        kind = rng.random()
        if made and kind < 0.15:
            text = rng.choice(made)
        elif made and kind < 0.6:
            words = rng.choice(made).split(" ")
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            text = " ".join(words)
        else:
            text = " ".join(rng.choice(vocab) for _ in range(rng.choice([4, 30, 60, 150, 400])))
        if rng.random() < 0.3:
            text = text.replace(" w1", "\nw1") + "\nCommon line \n  shared PASSAGE\t"
        made.append(text)
        rows.append((i, text))
    return rows


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute_components(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and den * len(x & y) >= num * len(x | y):
            parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, len(x), least[find(a)]) for a, (i, x) in enumerate(sets))


@pytest.mark.parametrize("rule,limit,shared", [((3, 90, 100), 8_000_000, 1 << 17), ((5, 80, 100), 8_000_000, 1 << 17), ((3, 90, 100), 300, 1 << 17), ((3, 90, 100), 3000, 1 << 17), ((5, 80, 100), 100, 0), ((2, 50, 100), 8_000_000, 0)])
def test_components_equal_brute_force(spark, rule, limit, shared):
    rows = corpus()
    got = shingle_join.jaccard_components(table(spark, rows), rule=shingle_join.Rule(*rule), group_limit=limit, shared_limit=shared)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == brute_components(rows, *rule)


def test_components_on_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(map(tuple, shingle_join.jaccard_components(docs).collect()))
    assert got == brute_components(rows, 3, 90, 100)
    assert sum(c != i for i, _, c in got) > 20


def test_components_of_repeated_and_missing_ids(spark):
    long = " ".join(f"v{i}" for i in range(60))
    rows = [(7, long), (7, long), (7, "other text here"), (None, long), (None, None)]
    got = shingle_join.jaccard_components(table(spark, rows)).collect()
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1) for r in got) == [(-1, 0, -1), (-1, 58, 7), (7, 1, 7), (7, 58, 7), (7, 58, 7)]
    assert shingle_join.jaccard_components(table(spark, [])).count() == 0


def test_near_copies_leave_one_each(spark):
    rows = corpus()
    kept = [r["doc_id"] for r in shingle_join.drop_near_copies(table(spark, rows)).collect()]
    assert sorted(kept) == sorted({c for _, _, c in brute_components(rows, 5, 80, 100)})


def test_near_copies_of_repeated_and_missing_ids(spark):
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(60)) for c in "pqrs")
    rows = [(3, one), (None, one + " more"), (None, "a text of its own without id"), (None, None), (None, "")]
    rows += [(5, two), (7, two + " more"), (7, "another text that has id seven too"), (8, "once is enough for this text"), (8, "once is enough for this text")]
    rows += [(None, three), (None, three + " more"), (9, four), (9, four + " more"), (10, four)]
    left = shingle_join.drop_near_copies(table(spark, rows))
    assert left.columns == table(spark, []).columns
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    sure = [(3, one), (None, "a text of its own without id"), (None, None), (None, ""), (5, two), (7, "another text that has id seven too"), (8, "once is enough for this text")]
    assert len(got) == len(sure) + 2 and all(got.count(r) == 1 for r in sure)
    assert sum(r in got for r in [(None, three), (None, three + " more")]) == 1 and sum(r in got for r in [(9, four), (9, four + " more")]) == 1


def test_tree_links_as_pairs_do():
    rng = np.random.default_rng(5)
    for _ in range(30):
        base = [np.unique(rng.integers(0, 500, rng.integers(1, 60))).astype(np.uint64) for _ in range(5)]
        sets = []
        for _ in range(25):
            s = base[rng.integers(5)]
            sets.append(np.unique(np.append(s[rng.random(len(s)) > 0.05], rng.integers(0, 500, rng.integers(0, 3)).astype(np.uint64))))
        sets = [s for s in sets if len(s)]
        rule = shingle_join.Rule(1, 70, 100)
        got = shingle_join.link_sets(sets, rule)
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in itertools.combinations(range(len(sets)), 2):
            if rule.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])):
                parent[find(a)] = find(b)
        for a, b in itertools.combinations(range(len(sets)), 2):
            assert (got[a] == got[b]) == (find(a) == find(b))


def test_exact_copies(spark):
    rows = corpus() + [(900, None), (901, ""), (902, "Common"), (902, "Common"), (None, "Common")]
    for keep, pick in (("largest", max), ("smallest", min)):
        got = exact_dedup.exact_dedup(table(spark, rows), keep=keep, fan_in=2).collect()
        assert len(got) == len(rows)
        groups = defaultdict(list)
        for i, t in rows:
            groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
        kept = defaultdict(int)
        for r in got:
            ids = groups[r["text_sha256"]]
            assert r["group_size"] == len(ids)
            assert r["keep_id"] == pick(i for i in ids if i is not None)
            kept[r["text_sha256"]] += r["kept"]
        assert set(kept.values()) == {1}
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    left = exact_dedup.drop_copies(table(spark, corpus()))
    assert left.columns == table(spark, []).columns
    assert left.count() == len({t or "" for _, t in corpus()})


def test_drop_copies_of_repeated_and_missing_ids(spark):
    rows = [(902, "Common"), (902, "Common"), (None, "Common"), (None, "alone"), (7, "alone too"), (7, "twice"), (8, "twice"), (None, None), (9, "")]
    rows += [(None, "no id"), (None, "no id")]
    left = exact_dedup.drop_copies(table(spark, rows))
    assert left.columns == table(spark, []).columns
    got = sorted((str(r["doc_id"]), r["text"]) for r in left.collect())
    assert got == [("7", "alone too"), ("8", "twice"), ("9", ""), ("902", "Common"), ("None", "alone"), ("None", "no id")]


def brute_lines(rows, threshold):
    split = [((t or "").split("\n")) for _, t in rows]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    refs = defaultdict(int)
    for lines in split:
        for k in {key(x) for x in lines}:
            refs[k] += 1
    hot = {k for k, n in refs.items() if k and n >= threshold}
    return sorted((i, len(lines), sum(key(x) in hot for x in lines), "\n".join(x for x in lines if key(x) not in hot)) for (i, _), lines in zip(rows, split))


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_lines_equal_brute_force(spark, limit):
    rows = corpus()
    got = line_dedup.dedup_lines(table(spark, rows), threshold=5, broadcast_limit=limit)
    found = sorted(map(tuple, got.collect()))
    assert found == brute_lines(rows, 5)
    assert any(r[2] for r in found)


def test_line_index_is_reversible(spark):
    first, second = corpus(80, 1), corpus(80, 2)
    index = line_dedup.LineIndex.build(table(spark, first), threshold=6)
    grown = index.insert(table(spark, second))
    state = lambda x: sorted(map(tuple, x.refs.collect()))
    whole = line_dedup.LineIndex.build(table(spark, first + second), threshold=6)
    assert state(grown) == state(whole) and state(grown) != state(index)
    assert sorted(map(tuple, grown.drop_lines(table(spark, second)).collect())) == sorted(map(tuple, whole.drop_lines(table(spark, second)).collect()))
    back = grown.delete(table(spark, second))
    assert state(back) == state(index)
    assert sorted(map(tuple, back.drop_lines(table(spark, first)).collect())) == brute_lines(first, 6)
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_line_index_grows_and_refuses_what_it_has_not(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 8)
    rows = corpus(120)
    empty = line_dedup.LineIndex.build(table(spark, []), threshold=3)
    assert empty.shards == 1
    grown = empty.insert(table(spark, rows))
    assert grown.shards == line_dedup.LineIndex.build(table(spark, rows), threshold=3).shards > 1
    assert sorted(map(tuple, grown.drop_lines(table(spark, rows)).collect())) == brute_lines(rows, 3)
    at_shards = line_dedup.LineIndex._of(spark, 3, grown.refs, 0)
    assert sorted(map(tuple, at_shards.drop_lines(table(spark, rows)).collect())) == brute_lines(rows, 3)
    assert grown.delete(table(spark, rows)).shards == 1
    with pytest.raises(ValueError):
        empty.delete(table(spark, rows[:20]))
    with pytest.raises(ValueError):
        grown.delete(table(spark, [(1000, "never inserted")]))


def test_runs_are_merged_in_order(spark):
    """Every merge reads rows in the order of slice, run and digest, and aggregates them as they come."""
    plans = []
    take = exact_dedup.written
    try:
        exact_dedup.written = lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), take(df, name))[1]
        exact_dedup.exact_dedup(table(spark, corpus(30)), fan_in=2).collect()
    finally:
        exact_dedup.written = take
    merges = [p for n, p in plans if n.startswith("level") or n == "verdict"]
    assert len(merges) == 3 and all("SortAggregate" in p and "HashAggregate" not in p for p in merges)
    for p in merges[1:]:
        assert p.count("Exchange") == 1 and "hashpartitioning(_slice" in p and "_sha" not in p.split("hashpartitioning(")[1].split(")")[0]


def test_cuckoo_filter_has_all_and_forgets():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, (5000, 2))
    made = line_dedup.CuckooFilter.of(keys)
    assert made.has(keys).all()
    others = rng.integers(-(1 << 62), 1 << 62, (20_000, 2))
    assert made.has(others).mean() < 0.005
    made.take_all(keys[:2500])
    assert made.has(keys[2500:]).all()
    assert made.has(keys[:2500]).mean() < 0.01
