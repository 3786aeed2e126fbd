"""Every operator and stage over tables of very long, empty, repeated and missing rows."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.llm import class_lm, exact_dedup, line_dedup, mixing, packing, quality, shingle_join, spots

LONG = " ".join(f"word{i % 5000} x{i}" for i in range(120_000))  # 1.7 MB
ROWS = [
    (1, LONG), (2, LONG + " end"), (3, "short text\nline"), (4, None), (5, ""), (6, "short text\nline"), (6, "short text\nline"), (7, " \t\n"), (None, "no id"), (None, None),
    (8, "x" * 1_000_000), (9, "\n" * 3000),
]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame([(i, t, "s" if n % 3 else None, "e", 1, 2, "t") for n, (i, t) in enumerate(ROWS)], "doc_id long, text string, source string, h string, n int, kind int, train string")
    return made.repartition(3)


def texts(rows):
    return Counter((r["doc_id"], hashlib.md5((r["text"] or "").encode()).hexdigest()) for r in rows)


def test_lines(docs):
    got = line_dedup.dedup_lines(docs, threshold=3).collect()
    assert len(got) == len(ROWS) and sorted(r["n_lines"] for r in got) == sorted(len((t or "").split("\n")) for _, t in ROWS)
    assert sum(r["n_dropped"] for r in got) == 6


def test_exact(docs):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(ROWS) and sum(r["kept"] for r in got) == len({t or "" for _, t in ROWS})
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and sorted(r["text"] or "" for r in left.collect()) == sorted({t or "" for _, t in ROWS})


def test_shingles(docs):
    got = Counter((r["doc_id"], r["component_id"]) for r in shingle_join.jaccard_components(docs).collect())
    assert got[1, 1] == got[2, 1] == 1 and got[6, 3] == 2 and sum(got.values()) == len(ROWS)
    left = texts(shingle_join.drop_near_copies(docs).collect())
    assert sum(left.values()) == len(ROWS) - 3 and not any(i in (2, 6) for i, _ in left)


def test_scores(docs):
    got = class_lm.score_corpus(docs).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len((t or "").split()) + 1 for _, t in ROWS) and all(r["score"] <= 0 and r["base_score"] <= 0 for r in got)
    labels = docs.sparkSession.createDataFrame([(1, 1), (3, 0), (8, 0)], "doc_id long, quality int")
    assert quality.score_quality(docs, labels).count() == len(ROWS)
    assert quality.keep_quality(docs, labels).columns == docs.columns


def test_spots(docs):
    got = spots.fingerprint_edits(docs).collect()
    assert sorted(r["n_chars"] for r in got) == sorted(len(t or "") for _, t in ROWS)


def test_stages_keep_columns_of_any_name(docs):
    odd = docs.withColumnsRenamed({"h": "_raw", "n": "_text_sha", "kind": "_taken", "train": "_d1"}).where("doc_id is null or doc_id > 2")
    labels = odd.sparkSession.createDataFrame([(3, 1), (6, 0)], "doc_id long, quality int")
    for stage in (lambda d: quality.keep_quality(d, labels), exact_dedup.drop_copies, shingle_join.drop_near_copies, lambda d: mixing.mixed_documents(d, repeats=2.0)):
        got = stage(odd)
        assert got.columns == odd.columns and {(r["_raw"], r["_text_sha"], r["_taken"], r["_d1"]) for r in got.collect()} == {("e", 1, 2, "t")}


def test_mixture_and_bins(docs):
    mixed = mixing.mixed_documents(docs, repeats=2.0)
    assert mixed.columns == docs.columns and set(texts(mixed.collect())) == set(texts(docs.collect()))
    bins = packing.pack(docs).collect()
    assert sum(b["used"] for b in bins) == sum(len((t or "").split()) + 1 for _, t in ROWS)
    taken = mixing.mix_sources(docs.withColumn("source", F.lit(None).cast("string")), repeats=3.0)
    assert taken.count() == len(ROWS)
