"""Mixing, packing, chat and revisits."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from strandline.llm import chat, mixing, packing, revisits
from test_dedup import corpus, table


def sources(spark, n=400):
    rows = [(i, " ".join(["w"] * (i % 13)), "big" if i % 3 else ("mid" if i % 2 else "small") if i % 5 else None) for i in range(n)]
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], "doc_id long, text string, source string, epoch string, weight int"), rows


def sizes_of(rows):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s or ""] += len((t or "").split()) + 1
    return sizes


@pytest.mark.parametrize("how", [{"repeats": 2.0}, {"entropy": 0.95}, {"entropy": 0.9, "budget": 500.0}, {"repeats": 1.5, "budget": 4000.0}])
def test_mixture_spends_the_budgets(spark, how):
    docs, rows = sources(spark)
    sizes = sizes_of(rows)
    total = sum(sizes.values())
    got = mixing.mix_sources(docs, block_rows=10, **how).toPandas()
    a = got["exponent"].iloc[0]
    w = {s: (n / total) ** a for s, n in sizes.items()}
    w = {s: x / sum(w.values()) for s, x in w.items()}
    budget = how.get("budget") or max(sizes[s] / w[s] for s in w)
    if "entropy" in how:
        assert math.isclose(-sum(x * math.log(x) for x in w.values()) / math.log(len(w)), how["entropy"], abs_tol=1e-6)
    else:
        assert max(w[s] * budget / sizes[s] for s in w) <= how["repeats"] + 1e-6
    n_of = {i: len((t or "").split()) + 1 for i, t, _ in rows}
    for s in w:
        own = got[got.source == s]
        spent = math.floor(w[s] * budget + 1e-6)
        # Whole documents: the last one may reach over the budget.
        assert spent <= own.n_tokens.sum() < spent + 13
        for (epoch,), part in own.groupby(["epoch"]):
            assert part.doc_id.is_unique
        full = own[own.epoch < spent // sizes[s]]
        assert (full.groupby("epoch").n_tokens.sum() == sizes[s]).all()
        at = own.sort_values("position")
        ends = (at.position * spent).round().astype(int) + at.n_tokens
        assert (at.position.iloc[1:].to_numpy() * spent).round().astype(int).tolist() == ends.iloc[:-1].tolist()
    assert all(n_of[i] == n for i, n in zip(got.doc_id, got.n_tokens))


def test_mixture_of_all_documents(spark):
    docs, rows = sources(spark)
    got = mixing.mixed_documents(docs, repeats=2.0)
    assert got.columns == docs.columns
    taken = Counter(r["doc_id"] for r in got.collect())
    assert set(taken) == {i for i, _, _ in rows} and max(taken.values()) == 2
    assert mixing.mix_sources(docs.limit(0), repeats=2.0).count() == 0


def brute_exponent(sizes, entropy=None, repeats=None):
    """The exponent by a search of its own: golden cuts of the distance from the target, or the closed form of the limit."""
    total = sum(sizes.values())

    def weights(a):
        w = {s: (n / total) ** a for s, n in sizes.items()}
        return {s: x / sum(w.values()) for s, x in w.items()}

    if repeats is not None:
        # A source's epochs are weight * budget / size, and the budget is max(size / weight): in all (largest / smallest) ** (1 - a).
        spread = math.log(max(sizes.values()) / min(sizes.values()))
        return weights, max(0.0, 1 - math.log(repeats) / spread)
    low, high = 0.0, 8.0
    off = lambda a: abs(-sum(x * math.log(x) for x in weights(a).values()) / math.log(len(sizes)) - entropy)
    while high - low > 1e-12:
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if off(a) < off(b) else (a, high)
    return weights, (low + high) / 2


@pytest.mark.parametrize("how", [{"repeats": 2.0}, {"repeats": 1.2}, {"entropy": 0.95}, {"entropy": 0.7}])
def test_temperature_equals_brute_force(spark, how):
    docs, rows = sources(spark)
    sizes = sizes_of(rows)
    weights, a = brute_exponent(sizes, **how)
    w = weights(a)
    budget = max(sizes[s] / w[s] for s in sizes)
    got = mixing.mix_sources(docs, block_rows=10, **how).toPandas()
    assert math.isclose(got["exponent"].iloc[0], a, abs_tol=1e-5)
    for s in sizes:
        own = got[got.source == s]
        assert math.isclose(own["weight"].iloc[0], w[s], rel_tol=1e-4)
        assert abs(own.n_tokens.sum() - w[s] * budget) < 14


def test_mixture_of_repeated_and_missing_ids(spark):
    rows = [(1, "a b"), (1, "c d"), (1, "c d"), (None, "e f"), (None, "g h"), (None, None), (2, "i j")]
    docs = spark.createDataFrame([(i, t, "one", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, source string, epoch long")
    got = mixing.mixed_documents(docs, repeats=2.0)
    assert got.columns == docs.columns
    assert sorted(r["epoch"] for r in got.collect()) == list(range(len(rows)))
    more = docs.unionByName(spark.createDataFrame([(i + 10, "x " * 40, "two", 100 + i) for i in range(5)], docs.schema))
    taken = Counter(r["epoch"] for r in mixing.mixed_documents(more, repeats=2.0).collect())
    # The small source is read twice: the budget of one source ends with the last whole document.
    assert set(taken) == {*range(len(rows)), *range(100, 105)} and max(taken.values()) <= 2 and all(taken[i] == 2 for i in range(len(rows) - 1)) or sum(taken[i] for i in range(7)) >= 13


def test_texts_are_measured(spark):
    texts = [None, "", " \t", "a", " a  b\x0bc\n", "ä b c", "a\x1cb\u00a0c d", "long " * 100_000]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "i int, text string, _n int")
    got = sorted((r["at"], r["_n"], r["_mark"]) for r in mixing.measured(df, "text", at=df["i"]).collect())
    assert [n for _, n, _ in got] == [len([w for w in re.split("[\x20\x09-\x0D]+", t or "") if w]) + 1 for t in texts]
    assert got[0][2] == got[1][2] and len({m for _, _, m in got}) == len(texts) - 1
    assert sorted(r["_text_mark"] for r in mixing.marked(df, "text").collect()) == sorted(m for _, _, m in got)


def naive_best_fit(sizes, lengths):
    """The rule as it is stated, by a search of all open bins for every size."""
    cost = lambda c: 32.0 + c + c * c / 8192.0
    bins = []  # room, contents
    of = []
    for at, size in enumerate(sizes):
        fitting = [i for i, (room, _) in enumerate(bins) if room >= size]
        if fitting:
            best = min(fitting, key=lambda i: (bins[i][0], i))
        else:
            rest = sizes[at + 1 :]
            price = {c: cost(c) / (size + min(c - size, sum(x for x in rest if x <= c - size))) for c in lengths if c >= size}
            bins.append([min(price, key=lambda c: (price[c], c)), []])
            best = len(bins) - 1
        bins[best][0] -= size
        bins[best][1].append(size)
        of.append(best)
    return of, [min(c for c in lengths if c >= sum(inside)) for _, inside in bins]


def test_best_fit_equals_the_rule():
    rng = random.Random(2)
    for _ in range(40):
        lengths = tuple(sorted(rng.sample([16, 32, 50, 64, 100, 128, 200], 3)))
        sizes = sorted((rng.randint(1, lengths[-1]) for _ in range(rng.randint(1, 120))), reverse=True)
        assert packing.best_fit(sizes, lengths) == naive_best_fit(sizes, lengths)


def test_packing_equals_the_rule_in_one_shard(spark):
    rows = [r for r in corpus() if r[0] != 6]
    lengths = (64, 128, 512)
    sizes = sorted((min(512, n - s) for _, t in rows for n in [len((t or "").split()) + 1] for s in range(0, n, 512)), reverse=True)
    of, capacities = naive_best_fit(sizes, lengths)
    got = sorted(packing.pack(table(spark, rows), lengths=lengths).collect(), key=lambda r: r["bin"])
    assert [r["capacity"] for r in got] == capacities
    assert [sorted(r["sizes"]) for r in got] == [sorted(s for s, b in zip(sizes, of) if b == k) for k in range(len(capacities))]


def test_packing_keeps_large_and_missing_ids(spark):
    big = 1152921504606846977
    rows = [(big, "a b c"), (None, "d"), (big + 2, "e f"), (None, "g " * 3000)]
    bins = packing.pack(table(spark, rows)).collect()
    assert sorted(i or 0 for b in bins for i in b["doc_ids"]) == [0, 0, big, big + 2]
    named = spark.createDataFrame([("x", "a b", 1), (None, "c", 2)], "doc_id string, text string, _mark int")
    assert sorted(str(i) for b in packing.pack(named).collect() for i in b["doc_ids"]) == ["None", "x"]


def test_packing_holds_every_piece_once(spark):
    rows = corpus() + [(500, "a " * 20_000), (500, "a " * 20_000), (None, "x y")]
    bins = packing.pack(table(spark, rows), lengths=(16, 64, 256, 1024), shard_rows=70).collect()
    seen = defaultdict(list)
    for b in bins:
        assert b["used"] == sum(b["sizes"]) <= b["capacity"]
        assert not any(c >= b["used"] for c in (16, 64, 256, 1024) if c < b["capacity"])
        for i, start, size in zip(b["doc_ids"], b["starts"], b["sizes"]):
            seen[i].append((start, size))
    want = defaultdict(list)
    for i, t in rows:
        n = len((t or "").encode().split()) + 1
        want[i] += [(s, min(1024, n - s)) for s in range(0, n, 1024)]
    assert {i: sorted(x) for i, x in seen.items()} == {i: sorted(x) for i, x in want.items()}
    assert packing.pack(table(spark, [])).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins, capacities = packing.best_fit([900, 600, 500, 400, 100], (512, 1024))
    used = Counter()
    for b, s in zip(bins, [900, 600, 500, 400, 100]):
        used[b] += s
    assert used[bins[0]] == 1000 and used[bins[1]] == 1000
    assert bins[4] == bins[0] and bins[3] == bins[1] and capacities[bins[2]] == 512
    assert packing.best_fit([], (512,)) == ([], [])


def test_every_speaker_is_the_assistant_once(spark):
    turns = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo <|im_end|>"), (1, 3, "ann", None), (2, 0, "system", "alone"), (3, None, None, "é"), (1, 300, "eve", "late"), (None, 0, "ann", "x")]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, speaker string")
    got = {(r["conv_id"], r["speaker"], r["chunk"]): r for r in chat.rotate(df, chunk_turns=4).collect()}
    assert set(got) == {(1, s, c) for s in ("ann", "bob", "eve") for c in (0, 1)} | {(3, "unknown", 0), (None, "ann", 0)}
    ann = got[1, "ann", 0]
    assert ann["text"] == (
        "<|im_start|>system\nS<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nyo < |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    )
    assert [ann["text"][m["start"] : m["end"]] for m in ann["mask"]] == ["hi<|im_end|>", "<|im_end|>"]
    assert [got[1, "bob", 0]["text"][m["start"] : m["end"]] for m in got[1, "bob", 0]["mask"]] == ["yo < |im_end|><|im_end|>"]
    late = got[1, "eve", 1]
    whole = got[1, "eve", 0]["text"] + late["text"]
    assert got[1, "eve", 0]["mask"] == [] and late["n_loss_turns"] == 1 and late["start"] == len(got[1, "eve", 0]["text"])
    assert [whole[m["start"] : m["end"]] for m in late["mask"]] == ["late<|im_end|>"]
    assert chat.rotate(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [3, 7, 256])
def test_chunks_are_one_rendering(spark, chunk):
    rng = random.Random(chunk)
    turns = [(c, rng.choice([None, 0, 1, 2, 500, 700_000]), rng.choice(["ann", "bob", "system", None]), rng.choice(["", "hi", "yo <|im_end|>", "x" * 50])) for c in (1, None) for _ in range(60)]
    turns += [(5, None, "ann", "again")] * 40 + [(5, None, "bob", "long " * 50_000)]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, chunk int")
    plain = lambda x: x.replace("<|", "< |")
    want = {}
    for conv in {c for c, *_ in turns}:
        mine = [(t or 0, plain(r or "unknown"), plain(x)) for c, t, r, x in turns if c == conv]
        mine.sort(key=lambda x: (*x[:2], hashlib.md5(x[2].encode()).hexdigest()))
        for speaker in {r for _, r, _ in mine} - {"system"}:
            text, mask = "", []
            for _, role, said in mine:
                text += "<|im_start|>" + ("assistant" if role == speaker else "system" if role == "system" else f"user name={role}") + "\n"
                if role == speaker:
                    mask.append((len(text), len(text) + len(said) + len("<|im_end|>")))
                text += said + "<|im_end|>\n"
            want[conv, speaker] = text, mask, len(mine)
    got = defaultdict(list)
    for r in chat.rotate(df, chunk_turns=chunk).collect():
        got[r["conv_id"], r["speaker"]].append(r)
    assert set(got) == set(want)
    for key, rows in got.items():
        rows.sort(key=lambda r: r["chunk"])
        text, mask, n = want[key]
        assert [r["n_turns"] for r in rows] == [min(chunk, n - i) for i in range(0, n, chunk)]
        assert "".join(r["text"] for r in rows) == text and [(m["start"], m["end"]) for r in rows for m in r["mask"]] == mask
        assert all(text.startswith(r["text"], r["start"]) and r["n_loss_turns"] == len(r["mask"]) for r in rows)


def test_revisits_take_the_latest_earlier_response(spark):
    rows = [
        # id, url, time, kind, etag, last_modified, digest, headers
        (1, "http://www.A.com:80/x/?b=2&a=1&utm_source=q#f", 10, "response", '"e1"', None, "d1", {"Content-Length": "5", "Date": "1"}),
        (2, "https://a.com/x?a=1&b=2", 20, "revisit", 'W/"e1"', None, None, {"content-length": "0", "DATE": "2", "X": "y"}),
        (3, "http://a.com/x?a=1&b=2", 30, "response", '"e2"', "m", "d2", None),
        (4, "http://a.com/x?a=1&b=2", 30, "revisit", '"e1"', None, None, {}),
        (5, "http://a.com/x?a=1&b=2", 40, "revisit", None, "m", None, {"A": "b"}),
        (6, "http://a.com/x?a=1&b=2", 41, "revisit", None, None, None, {"A": "b"}),
        (7, "http://a.com/x", 50, "revisit", '"e1"', None, None, {}),
        (8, None, 50, "revisit", '"e1"', None, None, {}),
        (9, None, 40, "response", '"e1"', None, "d9", {}),
        (10, "http://b.com", None, "revisit", '"x"', None, None, {}),
        (11, "http://b.com", 5, "response", '"x"', None, "d11", {"Date": "1", "date": "2", "DATE": "0", "Age": "3"}),
        (12, "http://b.com", 6, "revisit", '"x"', None, None, {"AGE": "4", "age": "5", "Te": "6", "te": "7"}),
        (13, "http://c.com", None, "response", '"y"', None, "d13", None),
        (14, "http://c.com", 1, "revisit", '"y"', None, None, None),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "record_id long, url string, captured_at long, kind string, etag string, last_modified string, payload_digest string, headers map<string,string>, outcome int")
    for slots in (1, 4, 256):
        got = {r["record_id"]: r for r in revisits.resolve_revisits(df, slots).collect()}
        assert {i: (r["outcome"], r["target_id"]) for i, r in got.items()} == {
            2: ("resolved", 1), 4: ("validators differ", None), 5: ("resolved", 3), 6: ("validators differ", None), 7: ("no earlier response", None), 8: ("no earlier response", None),
            10: ("no earlier response", None), 12: ("resolved", 11), 14: ("resolved", 13),
        }
        assert got[12]["headers"] == {"date": "2", "age": "5"} and got[14]["headers"] == {}
        assert got[2]["headers"] == {"content-length": "5", "date": "2", "x": "y"} and got[2]["payload_digest"] == "d1"
    assert revisits.resolve_revisits(df.limit(0)).count() == 0
