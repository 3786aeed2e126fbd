"""The registered queries on whole tables against SQL or brute force, and the pipeline stage by stage."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

import __spark_entry__
import corpus_pipeline
from strandline.llm import registry, spots
from test_dedup import brute_components

SF = "/root/testdata/sf0.001"
TABLES = "documents pages conversations labels".split()


@pytest.fixture(scope="module")
def rows():
    return sorted(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


def collect(spark, name):
    return registry.queries()[name](spark, SF).collect()


def test_all_are_registered():
    known = __spark_entry__.queries()
    assert {n.split("_")[0] for n in known if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in known


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = db.sql(registry.oracle_sql()[name]).df()
    assert sorted(want.columns) == cols
    text = lambda row: tuple("" if pd.isna(x) else str(int(x)) if isinstance(x, (int, float)) or hasattr(x, "item") else str(x) for x in row)
    assert sorted(text(r[c] for c in cols) for r in got.collect()) == sorted(map(text, want[cols].itertuples(index=False)))


def test_mixture_of_the_corpus(spark, rows):
    taken = Counter(r["doc_id"] for r in collect(spark, "op1_mix_sources"))
    assert set(taken) == {i for i, _ in rows} and max(taken.values()) <= 3


def test_packing_of_the_corpus(spark, rows):
    seen = defaultdict(int)
    for b in collect(spark, "op3_best_fit_packing"):
        assert sum(b["sizes"]) == b["used"] <= b["capacity"] <= 8192
        for i, n in zip(b["doc_ids"], b["sizes"]):
            seen[i] += n
    assert seen == {i: len(t.encode().split()) + 1 for i, t in rows}


def test_quality_of_the_corpus(spark, rows):
    got = collect(spark, "op4_quality_ranking")
    assert sorted(r["doc_id"] for r in got) == [i for i, _ in rows]
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)


def test_fingerprints_of_the_corpus(spark, rows):
    got = {r["doc_id"]: r for r in collect(spark, "op5_spotsigs")}
    count = Counter(w for _, t in rows for w in spots.plain_words(t))
    spot = spots.Spotter([w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:64]])
    assert len(got) == len(rows)
    for at, (i, text) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        changed = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (spots.encode(spot(text)), spots.encode(spot(changed)))
        assert math.isclose(r["near_next"], spots.likeness(spot(text), spot(following)))


def test_scores_of_the_corpus(spark, rows):
    split = {i: [*t.encode().lower().split(), b" "] for i, t in rows}
    held = {i for i in split if zlib.crc32(str(i).encode()) % 7 == 2}
    count = Counter(w for i, ws in split.items() if i not in held for w in ws)
    n, v = sum(count.values()), len(count)
    for r in collect(spark, "op6_class_lm"):
        ws = split[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] in held, len(ws), sum(w in count for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0


def test_components_of_the_corpus(spark, rows):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in collect(spark, "op10_shingle_join"))
    assert got == brute_components(rows, 3, 90, 100)


def test_pipeline_stage_by_stage(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = sorted(r["doc_id"] for r in docs.collect())
        if name == names[1]:
            last = {}
            for i, t in sorted(before.items()):
                last[t] = i
            assert kept[name] == sorted(last.values())
        if name == names[2]:
            assert kept[name] == sorted({c for _, _, c in brute_components(sorted(before.items()), 5, 80, 100)})
        if name == names[3]:
            assert set(kept[name]) == set(before) and max(Counter(kept[name]).values()) <= 2
    bins = corpus_pipeline.run(spark, SF).collect()
    texts = dict(rows)
    words = Counter()
    for b in bins:
        for i, n in zip(b["doc_ids"], b["sizes"]):
            words[i] += n
    assert words == {i: k * (len(texts[i].encode().split()) + 1) for i, k in Counter(kept[names[3]]).items()}
