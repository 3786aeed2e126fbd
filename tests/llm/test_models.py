"""Quality, fingerprints and the class model against direct computations."""

import hashlib
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import class_lm, quality, spots
from strandline.llm.common import held_out
from test_dedup import corpus, table


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    held = held_out(F.col("doc_id"), 4, 2)
    got = quality.score_quality(docs, labels.where(~held))
    rows = got.join(labels.where(held), "doc_id").select("score", "predicted", "quality").toPandas()
    assert got.count() == docs.count()
    pos, neg = rows[rows.quality == 1].score.to_numpy(), rows[rows.quality == 0].score.to_numpy()
    auc = (pos[:, None] > neg[None, :]).mean() + (pos[:, None] == neg[None, :]).mean() / 2
    print("AUC", auc, "recall of 0", (neg < 0.7).mean(), "kept of 1", (pos >= 0.7).mean())
    assert auc > 0.97 and (neg < 0.7).mean() > 0.85 and (pos >= 0.7).mean() > 0.95
    assert ((rows.score >= 0.7) == (rows.predicted == 1)).all()


def test_quality_of_odd_tables(spark):
    docs = table(spark, corpus() + [(3, "again"), (None, "no id")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score_quality(docs, none).collect()
    assert len(got) == docs.count() and all(r["predicted"] == 1 and abs(r["score"] - 0.7) < 1e-9 for r in got)
    labels = spark.createDataFrame([(i, i % 2) for i in range(7, 60)] + [(None, 1), (8, None)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    assert quality.score_quality(table(spark, []), labels).count() == 0


def test_cut_does_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    first, scored = quality.fit_quality(docs, labels)
    second, _ = quality.fit_quality(docs.repartition(13, "n_chars"), labels.repartition(3))
    assert first.cut == second.cut and np.array_equal(first.ranker.weights, second.ranker.weights)
    # The cut, and the quantiles it is chosen from, by sorting all scores.
    raw = {r[0]: r[1] for r in scored.collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in raw}
    values = sorted(raw.values())
    grid = sorted({values[max(1, math.ceil(q * len(values) / 400)) - 1] for q in range(401)})
    good = lambda cut, of: sum(raw[i] >= cut for i, y in known.items() if y == of) / sum(y == of for y in known.values())
    gain = [good(c, 1) - good(c, 0) for c in grid]
    best = [c for c, g in zip(grid, gain) if g >= max(gain) - 1e-12]
    assert first.cut == best[len(best) // 2]


def test_fit_equals_gradient_descent():
    """The same pairs by plain gradient steps on the logistic loss."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, quality.FEATURES))
    y = (x[:, 0] + rng.normal(size=80) > 0).astype(int)
    made = quality.fit_pairs(x, y, pairs=300, ridge=5.0, seed=7)
    pick = np.random.default_rng(7)
    phi = made.expand(x)
    d = phi[pick.choice(np.flatnonzero(y == 1), 300)] - phi[pick.choice(np.flatnonzero(y == 0), 300)]
    w = np.zeros(phi.shape[1])
    for _ in range(20_000):
        w -= 0.002 * (5.0 * w - d.T @ (1 / (1 + np.exp(d @ w))))
    assert np.allclose(w, made.weights, atol=1e-3)


def test_pairs_order_documents():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality.FEATURES))
    y = (x[:, 2] - x[:, 5] > 0).astype(int)
    raw = quality.fit_pairs(x, y).raw(x)
    assert (raw[y == 1][:, None] > raw[y == 0][None, :]).mean() > 0.97


def test_score_does_not_depend_on_the_rows_around():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, quality.FEATURES))
    made = quality.fit_pairs(x, (x[:, 2] > 0).astype(int))
    whole = made.raw(x)
    for size in (1, 3, 64, 333):
        assert np.array_equal(np.concatenate([made.raw(x[i : i + size]) for i in range(0, len(x), size)]), whole)


def test_text_at_the_cut_is_kept_and_predicted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model, scored = quality.fit_quality(docs, labels)
    at_cut = [r[0] for r in scored.where(F.col("_raw") == model.cut).select("doc_id").collect()]
    assert at_cut
    kept = {r[0] for r in quality.keep_quality(docs.repartition(7), labels).select("doc_id").collect()}
    predicted = {r[0] for r in quality.score_quality(docs, labels).where("predicted = 1").select("doc_id").collect()}
    assert set(at_cut) <= kept and kept == predicted



def naive_spots(text, anchors, chain=2):
    """Spots as tuples of words."""
    tokens = re.sub(r"[!-/:-@\[-`{-~]", " ", (text or "")).translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    tokens = [w for w in re.split("[\x20\x09-\x0D]+", tokens) if w]
    if not tokens:
        return {("", text)} if text else set()
    found = set()
    for i, w in enumerate(tokens):
        content = [x for x in tokens[i + 1 :] if x not in anchors][:chain]
        if w in anchors and len(content) == chain:
            found.add((w, *content))
    return found or {tuple(tokens[i : i + chain + 1]) for i in range(len(tokens))}


def test_fingerprints_equal_naive_spots(spark):
    rows = [(i, t) for i, t in corpus(80)] + [(900, "..."), (901, "The, THE the; a"), (902, "w1 a"), (903, "w1 A!")]
    docs = table(spark, rows)
    anchors = {w.decode() for w in spots.common_words(docs)}
    got = {r["doc_id"]: r for r in spots.fingerprint_edits(docs).collect()}
    sets = {i: naive_spots(t, anchors) for i, t in rows}
    like = lambda x, y: len(x & y) / len(x | y) if x and y else float(not x and not y)
    ids = [i for i, _ in rows]
    for at, (i, text) in enumerate(rows):
        text, following = text or "", rows[(at + 1) % len(rows)][1] or ""
        changed = naive_spots(text[: len(text) - len(text) // 4] + following[: len(text) // 4], anchors)
        assert math.isclose(got[i]["near_edited"], like(sets[i], changed)) and math.isclose(got[i]["near_next"], like(sets[i], sets[ids[(at + 1) % len(ids)]]))
        assert len(got[i]["fingerprint"]) == 8 * len(sets[i])
    for i in ids:
        for j in ids:
            assert (got[i]["fingerprint"] == got[j]["fingerprint"]) == (sets[i] == sets[j])


def test_fingerprints_need_numbers(spark):
    with pytest.raises(ValueError):
        spots.fingerprint_edits(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("repeat", [False, True])
def test_fingerprints_of_edits(spark, repeat):
    rows = [(i, t) for i, t in corpus(60) if i != 9] + ([(20, "the same"), (20, "the same")] if repeat else [])
    docs = table(spark, rows)
    words = spots.common_words(docs)
    count = Counter(w for _, t in rows for w in spots.plain_words(t))
    assert words == [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:64]]
    got = {}
    for r in spots.fingerprint_edits(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    spot = spots.Spotter(words)
    ordered = sorted(rows, key=lambda r: r[0])
    for at, (i, text) in enumerate(ordered):
        if repeat and i == 20:
            continue
        text, following = text or "", ordered[(at + 1) % len(ordered)][1] or ""
        if repeat and ordered[(at + 1) % len(ordered)][0] == 20:
            continue
        changed = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        [r] = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = (set(spot(t).tolist()) for t in (text, changed, following))
        assert r["fingerprint"] == spots.encode(spot(text)) and set(spots.decode(r["edited_fingerprint"]).tolist()) == b
        like = lambda x, y: len(x & y) / len(x | y) if x and y else float(not x and not y)
        assert math.isclose(r["near_edited"], like(a, b)) and math.isclose(r["near_next"], like(a, c))
    assert spots.fingerprint_edits(table(spark, [])).count() == 0


def test_near_classes_equal_brute_force(spark):
    rows = corpus(120)
    docs = table(spark, rows)
    anchors = {w.decode() for w in spots.common_words(docs)}
    sets = {i: naive_spots(t, anchors) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and x and y and 10 * len(x & y) >= 6 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = sorted((i, len(s), find(i)) for i, s in sets.items())
    assert sorted(map(tuple, spots.near_classes(docs, 6, 10).collect())) == want and sum(i != c for i, _, c in want) > 20


def classes_of(model, found):
    """The class of each word, looked up by its hash alone."""
    h = [x >> 1 for x in map(xxhash.xxh3_64_intdigest, found)]
    kinds = {int(k): int(model.kinds[c]) for k, c in zip(model.listed.keys, model.listed.codes)} | {r["h"]: r["kind"] for r in model.further.collect()}
    return {w: kinds.get(x, model.rare) for w, x in zip(found, h)}


def coded_texts(rows, of, stop):
    return [[stop, *(of[w] for w in (t or "").encode().lower().split()), stop] for _, t in rows]


def brute_scores(rows, training, model):
    stop = model.rare + 1
    count = Counter(w for _, t in training for w in [*(t or "").encode().lower().split(), b" "])
    n, v = sum(count.values()), len(count)
    every = {w for _, t in [*rows, *training] for w in (t or "").encode().lower().split()}
    of = classes_of(model, list(every)) | {b" ": stop}
    rare = {w for w in count if of[w] == model.rare}
    jumps = np.zeros((stop + 1, stop + 1))
    for c in coded_texts(training, of, stop):
        np.add.at(jumps, (c[:-1], c[1:]), 1)
    share = (jumps.sum(0) + 1) / (jumps.sum() + stop + 1)
    own = Counter()
    for w, k in count.items():
        own[of[w]] += k
    out = []
    for i, t in rows:
        words = [*(t or "").encode().lower().split(), b" "]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)
        score, last = 0.0, stop
        for w in words:
            c = of[w]
            score += math.log10((jumps[last, c] + 20 * share[c]) / (jumps[last].sum() + 20))
            if c == model.rare:
                score += math.log10((count[w] + 1) / (sum(count[x] for x in rare) + len(rare) + 1))
            elif w != b" ":
                score += math.log10(count[w] / own[c])
            last = c
        out.append((i, len(words), sum(count[w] > 0 for w in words), n, base, score))
    return out


@pytest.mark.parametrize("head,listed", [(40, 150), (40, 0), (1024, 1 << 20)])
def test_class_model_equals_brute_force(spark, head, listed):
    rows = corpus(90) + [(300, "never seen before never"), (8, "w1 w2 w3"), (None, "w1 w1")]
    training = [r for r in rows if r[0] is None or r[0] % 7 != 2]
    model = class_lm.fit_classes(table(spark, training), classes=8, head=head, listed=listed)
    assert len(model.listed.keys) <= listed
    got = sorted(class_lm.score_texts(table(spark, rows), model).collect(), key=lambda r: (r["doc_id"] or 0, r["score"]))
    want = sorted(brute_scores(rows, training, model), key=lambda r: (r[0] or 0, r[5]))
    assert len(got) == len(want)
    for r, w in zip(got, want):
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert math.isclose(r["base_score"], w[4], rel_tol=1e-9) and math.isclose(r["score"], w[5], rel_tol=1e-9)


def brute_place(rows, of, stop, asked, classes):
    """The best class of each asked word beside its neighbours, by sums over all its occurrences."""
    texts = [[None, *(t or "").encode().lower().split(), None] for _, t in rows]
    of = of | {None: stop}
    n = [[0.1] * (stop + 1) for _ in range(stop + 1)]
    for t in texts:
        for a, b in zip(t, t[1:]):
            n[of[a]][of[b]] += 1
    row = [sum(x) for x in n]
    col = [sum(x[d] for x in n) for d in range(stop + 1)]
    tie = lambda c, d: math.log(n[c][d]) - math.log(row[c]) - math.log(col[d])
    gain = {w: [0.0] * classes for w in asked}
    for t in texts:
        for a, b, c in zip(t, t[1:], t[2:]):
            for k in range(classes) if b in gain else ():
                gain[b][k] += tie(of[a], k) + tie(k, of[c])
    return gain


def test_sweep_and_further_words_equal_brute_force(spark):
    rows = corpus(80)
    training = table(spark, rows)
    count = Counter(w for _, t in rows for w in (t or "").encode().lower().split())
    model = class_lm.fit_classes(training, classes=5, head=30, listed=200, tolerance=math.inf)
    names = list(count)
    of = classes_of(model, names)
    listed = dict(zip(model.listed.keys.tolist(), model.listed.codes.tolist()))
    code = {w: listed.get(xxhash.xxh3_64_intdigest(w) >> 1, 0) for w in names}
    heads = {w for w in names if 2 <= code[w] < 32}
    swept = {w for w in names if code[w] >= 32}
    further = {w for w in names if not code[w] and count[w] > 1}
    assert len(heads) == 30 and len(swept) > 100 and len(further) > 100
    assert min(count[w] for w in heads) >= max(count[w] for w in swept) and len(swept) <= 170
    first = {w: of[w] if w in heads else 5 for w in names}
    second = {w: 5 if w not in heads | swept else of[w] for w in names}
    for asked, known in ((swept, first), (further, second)):
        for w, gain in brute_place(rows, known, 6, asked, 5).items():
            assert gain[of[w]] >= max(gain) - 1e-6
    assert all(of[w] == 5 for w in names if count[w] == 1)


def test_sweeps_never_lower_the_likelihood(spark):
    rows = corpus(80)
    training = table(spark, rows)

    def reached(tolerance):
        model = class_lm.fit_classes(training, classes=5, head=30, tolerance=tolerance)
        of, n = classes_of(model, [w for _, t in rows for w in (t or "").encode().lower().split()]), Counter()
        for c in coded_texts(rows, of, 6):
            n.update(zip(c, c[1:]))
        sides = [Counter(), Counter()]
        for pair, k in n.items():
            for side, c in zip(sides, pair):
                side[c] += k
        return sum(k * math.log(k) for k in n.values()) - sum(k * math.log(k) for side in sides for k in side.values())

    assert reached(0.0) >= reached(1e-4) >= reached(math.inf)


def test_every_repeated_word_has_a_class(spark):
    rng = random.Random(6)
    many = [f"{'ab'[i % 2]}{i}" for i in range(14_000) for _ in range(2)]
    rng.shuffle(many)
    rows = [(i, " ".join(many[i::70]) + f" once{i} w1 w2") for i in range(70)]
    count = Counter(w for _, t in rows for w in t.encode().split())
    model = class_lm.fit_classes(table(spark, rows), classes=8, listed=600)
    kind = classes_of(model, list(count))
    assert len(model.listed.keys) == 602 or 500 < len(model.listed.keys) <= 600
    assert {w for w, c in kind.items() if c != model.rare} == {w for w, n in count.items() if n > 1}
    asked = rows[:20] + [(300, "unseen once3 a0 unseen")]
    got = sorted((r["doc_id"], r["score"]) for r in class_lm.score_texts(table(spark, asked), model).collect())
    want = sorted((r[0], r[5]) for r in brute_scores(asked, rows, model))
    assert all(g[0] == w[0] and math.isclose(g[1], w[1], rel_tol=1e-9) for g, w in zip(got, want)) and len(got) == len(want)


def test_sweeps_part_alternating_words(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"{'xy'[i % 2]}{min(int(rng.expovariate(0.05)), 299)}" for i in range(400))
    rows = [(i, text()) for i in range(60)]
    count = Counter(w for _, t in rows for w in t.encode().split())
    of = classes_of(class_lm.fit_classes(table(spark, rows), classes=2, head=40), [w for w, n in count.items() if n > 20])
    sides = {side: {c for w, c in of.items() if w[:1] == side} for side in (b"x", b"y")}
    assert len(of) > 80 and len(sides[b"x"]) == len(sides[b"y"]) == 1 and sides[b"x"] != sides[b"y"]


def test_emissions_and_transitions_sum_to_one(spark):
    rows = corpus(80)
    model = class_lm.fit_classes(table(spark, rows), classes=5, head=30, listed=100)
    assert np.allclose((10.0**model.jump).sum(1), 1)
    count = Counter(w for _, t in rows for w in (t or "").encode().lower().split())
    of, sums = classes_of(model, list(count)), Counter()
    for w, n in count.items():
        sums[of[w]] += (n + (of[w] == model.rare)) / 10.0 ** model.of_class[of[w]]
    sums[model.rare] += 1 / 10.0 ** model.of_class[model.rare]  # the unknown word
    assert all(math.isclose(x, 1) for x in sums.values()) and len(sums) == 6


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(3)
    for _ in range(5):
        pairs = rng.integers(0, 30, (13, 13)) * (rng.random((13, 13)) < 0.5)
        of = [*class_lm.exchange(pairs, 3), 3]

        def value(of):
            n = Counter()
            for i, j in np.ndindex(13, 13):
                n[of[i], of[j]] += int(pairs[i, j])
            rows, cols = Counter(), Counter()
            for (c, d), k in n.items():
                rows[c] += k
                cols[d] += k
            log = lambda counts: sum(k * math.log(k) for k in counts.values() if k)
            return log(n) - log(rows) - log(cols)

        assert all(value([*of[:w], c, *of[w + 1 :]]) <= value(of) + 1e-6 for w in range(12) for c in range(3))


def test_class_model_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = class_lm.score_corpus(docs)
    assert got.count() == docs.count()
    sums = got.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    print("held-out log10 per token", sums[0] / sums[2], "base", sums[1] / sums[2])
    assert sums[0] > sums[1] * 0.95


def test_class_model_without_training_text(spark):
    empty = table(spark, [])
    model = class_lm.fit_classes(empty)
    got = class_lm.score_texts(table(spark, [(1, "a b"), (2, None)]), model).collect()
    assert [(r["n_tokens"], r["n_known"], r["base_score"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [(3, 0, 0.0), (1, 0, 0.0)]
    assert all(math.isfinite(r["score"]) for r in got)
    assert class_lm.score_texts(empty, model).count() == 0


def test_exchange_finds_alternating_classes():
    rng = random.Random(4)
    text = [rng.choice(range(0, 10)) if i % 2 else rng.choice(range(10, 20)) for i in range(6000)]
    pairs = np.zeros((21, 21))
    np.add.at(pairs, (text[:-1], text[1:]), 1)
    of = class_lm.exchange(pairs, 2)
    assert len(set(of[:10])) == 1 and len(set(of[10:])) == 1 and of[0] != of[10]
