"""Quality classifier: Bradley-Terry ranking from preference pairs, cut at a quantile of the scores.

A document of label 1 is preferred to one of label 0.  The model is a linear score over features of the text alone,
fitted by the logistic loss on feature differences of pairs.  The cut is searched among the quantiles of the scores
of ALL documents: the one that best separates all labelled training rows (balanced accuracy; the middle one of
equals).  The score that is returned is logistic in the distance from the cut, and is 0.7 exactly there.

Raw scores are rounded down to multiples of 1/4096 between -64 and 64, so a table has at most 2**19 of them, and quantiles are
exact: they follow from the number of rows of each, and not from how the rows lie in files.

Bounds: the fit uses at most about `sample` labelled rows (chosen by a hash of the id) and `pairs` pairs; everything
else covers all rows.

Defined cases: null and empty texts have features of 0 and get a score; rows without a label are only scored; a label
that is null counts as none, of several labels of a document the least counts; without training labels of both kinds
nothing is rejected (every score is 0.7); repeated rows are scored each; a very long text is read whole; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain_names, slices, written

KNOTS = (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98)
FEATURES = 14
CUT = 0.7
#: Raw scores are whole numbers of 1/GRID, of size below SPAN.
GRID, SPAN = 4096, 64
_kinds = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"|", b"!?", b".,;:'\"()-", b"\n", b" \t\r\v\f"), 1):
    for _c in _chars:
        _kinds[_c] = _k
_kinds[128:] = 2  # bytes of letters beyond ASCII; what is left, 0, are symbols


def features(text: str | None) -> np.ndarray:
    """Shares and ratios that do not depend on a vocabulary."""
    data = (text or "").encode("utf-8", "surrogatepass")
    tokens = data.split()
    n = len(tokens)
    if not n:
        return np.zeros(FEATURES)
    kinds = np.bincount(_kinds, weights=np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256), minlength=9)
    seen = Counter(tokens)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return np.array([
        math.log1p(n),
        math.log1p(len(seen)) / math.log1p(n),
        sum(map(eq, tokens, tokens[1:])) / n,
        max(seen.values()) / n,
        len(set(zip(tokens, tokens[1:]))) / n,
        kinds[1] / (kinds[1] + kinds[2] + 1),
        kinds[3] / len(data),
        kinds[4] / n,
        kinds[5] / n,
        kinds[6] / n,
        kinds[0] / n,
        kinds[7] / n,
        (len(data) - kinds[7] - kinds[8]) / n / 10,
        1 - len(set(lines)) / max(1, len(lines)),
    ])


@dataclass(frozen=True)
class Ranker:
    """Piecewise linear in each feature, with knots at quantiles of the sample."""

    mean: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        hinges = np.maximum(0, z[:, None, :] - self.knots[None, :, :]).reshape(len(z), -1)
        return np.concatenate([z, hinges], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Summed row by row: a matrix product would round by the rows around, and a text at the cut could fall on either side."""
        raw = (self.expand(x) * self.weights).sum(axis=1) if len(x) else np.zeros(0)
        return np.floor(np.clip(raw, -SPAN, SPAN - 1 / GRID) * GRID) / GRID


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 40_000, ridge: float = 5.0, seed: int = 7) -> Ranker:
    """Newton steps on sum(log(1 + exp(-w.(phi(better) - phi(worse))))) + ridge/2 |w|^2."""
    x, y = np.asarray(x, dtype=float).reshape(-1, FEATURES), np.asarray(y)
    mean = x.mean(0) if len(x) else np.zeros(FEATURES)
    scale = np.where((s := x.std(0) if len(x) else np.zeros(FEATURES)) > 1e-9, s, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    knots = np.quantile(z, KNOTS, axis=0) if len(x) else np.zeros((len(KNOTS), FEATURES))
    made = Ranker(mean, scale, knots, np.zeros(FEATURES * (1 + len(KNOTS))))
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(better) or not len(worse):
        return made
    rng = np.random.default_rng(seed)
    phi = made.expand(x)
    d = phi[rng.choice(better, pairs)] - phi[rng.choice(worse, pairs)]
    w = made.weights
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        gradient = ridge * w - d.T @ p
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), gradient)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return Ranker(mean, scale, knots, w)


@dataclass(frozen=True)
class QualityModel:
    ranker: Ranker
    cut: float

    def score(self, raw: Column) -> Column:
        return F.lit(1.0) / (1 + F.exp(-(raw - F.lit(self.cut)) - F.lit(math.log(CUT / (1 - CUT)))))

    def keep(self, raw: Column) -> Column:
        return raw >= F.lit(self.cut)


def with_column(docs: DataFrame, kept: list[str], name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, kind)])


def feature_rows(docs: DataFrame, text_col: str, others: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                rows = pa.array([features(x).tolist() for x in part.column(text_col).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), rows], [*others, "_features"])

    return docs.select(*others, text_col).mapInArrow(run, with_column(docs, others, "_features", T.ArrayType(T.DoubleType())))


def raw_scores(docs: DataFrame, ranker: Ranker, text_col: str, others: list[str]) -> DataFrame:
    """The columns others and _raw."""
    held = docs.sparkSession.sparkContext.broadcast(ranker)
    passed = [text_col, *(c for c in others if c != text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                x = np.array([features(t) for t in part.column(text_col).to_pylist()]).reshape(-1, FEATURES)
                raw = held.value.raw(x)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(raw, pa.float64())], [*others, "_raw"])

    return docs.select(*passed).mapInArrow(run, with_column(docs, others, "_raw", T.DoubleType()))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000, quantiles: int = 400, kept: list[str] | None = None,
) -> tuple[QualityModel, DataFrame]:
    """The model, and the table of the kept columns (else id_col alone) and _raw of all documents.  labels: all rows to learn from."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = written(known.groupBy(F.col(id_col).alias("_lid")).agg(F.min(label_col).cast("int").alias("_label")), "labels")
    n = known.count()
    some = known if n <= sample else known.where(F.pmod(F.xxhash64("_lid"), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    learn = docs.select(id_col, text_col).join(F.broadcast(some), F.col(id_col) == F.col("_lid")).select("_label", text_col)
    got = feature_rows(learn, text_col, ["_label"]).collect()
    # Sorted, so that the fit does not depend on the order in which tasks end.
    got = sorted((r["_label"], tuple(r["_features"])) for r in got)
    ranker = fit_pairs(np.array([x for _, x in got]), np.array([y for y, _ in got]))
    scored = written(raw_scores(docs, ranker, text_col, kept or [id_col]), "scores")

    every = sorted((r[0], r[1]) for r in scored.groupBy("_raw").count().collect())
    if not every or not ranker.weights.any():
        return QualityModel(ranker, 0.0 if every else -math.inf), scored
    raw, upto = np.array([r for r, _ in every]), np.cumsum([n for _, n in every])
    ranks = np.ceil(np.linspace(0, 1, quantiles + 1) * upto[-1]).clip(1)
    grid = np.unique(raw[np.searchsorted(upto, ranks)])
    tally = np.zeros((len(grid) + 1, 2))
    for r in scored.join(known, F.col(id_col) == F.col("_lid")).groupBy("_raw", "_label").count().collect():
        tally[np.searchsorted(grid, r["_raw"], side="right"), 1 if r["_label"] == 1 else 0] += r["count"]
    above = tally[::-1].cumsum(0)[::-1]  # row k: labels of rows with at least grid[k - 1]
    gain = above[1:, 1] / max(1, above[0, 1]) - above[1:, 0] / max(1, above[0, 0])
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return QualityModel(ranker, float(grid[int(best[len(best) // 2])])), scored


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> DataFrame:
    """id_col, score, predicted for every row of docs."""
    model, scored = fit_quality(docs, labels, id_col, text_col, label_col, sample)
    cut = model.cut if math.isfinite(model.cut) else 0.0
    model = QualityModel(model.ranker, cut)
    return scored.select(id_col, model.score(F.col("_raw")).alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> DataFrame:
    """docs without the rows that are rejected; all columns as they were.  Texts are written once with their scores."""
    labels = labels.select(F.col(id_col).alias("_of"), F.col(label_col).alias("_label"))
    names, docs, (id_col, text_col) = plain_names(docs, id_col, text_col)
    model, scored = fit_quality(docs, labels.withColumnRenamed("_of", id_col), id_col, text_col, "_label", sample, kept=docs.columns)
    return scored.where(model.keep(F.col("_raw"))).drop("_raw").toDF(*names)
