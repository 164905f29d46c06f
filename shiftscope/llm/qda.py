"""Quality classifier: regularised quadratic discriminant analysis.

One native projection turns every whole text into a short vector of
transformed statistics: shares of symbols, capitals, repeated words and the
like, smoothed by a few words' worth of the usual share (so that short texts
lie near it) and taken as logarithms.  The moments of each class (weight,
sums, sums of products) are added up in the tasks over **all** labelled rows
of the training fold; from them the driver, which sees only ``d x d`` numbers,
makes one covariance a class, shrunk towards the pooled one (by the classes'
sizes) and towards a multiple of the identity (oracle approximating
shrinkage), and its Cholesky factor.  The factors are kept in the model: a
score is two triangular products, the difference of the two Mahalanobis log
densities with the classes' prior shares, as a probability.

Statistics are held within ``CLIP`` deviations of the mean, so that one odd
share can't outweigh all others.

Defined results: a NULL text is empty and gets a score like any other.  Labels
other than 0 and 1 (NULL too) are not learnt from; several labels of one
document weigh one each, as do repeated documents; a NULL doc_id has no label
and is not held out.  With one class only the score is that class, with none
0.5.  Empty tables give no rows.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut_lineage, text_of

CLIP = 6.0
POOL_ROWS = 20.0       # rows of the pooled covariance that join each class's own, per dimension
LEAST_SHRINK = 0.01
SMOOTH = 8.0           # words (or characters of so many words) of the usual share in every ratio
THRESHOLD = 0.3
SALTS = 16             # parts of the documents of one id

#: (statistic, counted, out of, usual share)
RATIOS: list[tuple[str, str, str, float]] = [
    ("symbols", "symbols", "chars", 0.002), ("capitals", "capitals", "chars", 0.03), ("shouts", "shouts", "words", 0.002),
    ("bare_words", "bare", "words", 0.005), ("repeats", "repeats", "words", 0.01), ("pairs", "pairs", "words", 0.01),
    ("same_lines", "same_lines", "lines", 0.01), ("stops", "stops", "words", 0.08), ("commas", "commas", "words", 0.06),
    ("digits", "digits", "chars", 0.005), ("others", "others", "chars", 0.02), ("line_share", "lines", "words", 0.05),
]
FEATURES = [name for name, *_ in RATIOS] + ["word_length", "longest"]


def features(docs: DataFrame, text: str = "text", out: str = "features", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and the array of transformed statistics of the whole text."""
    kept = [F.col(f"`{c}`") for c in (keep if keep is not None else [c for c in docs.columns if c != text])]
    t = text_of(F.col(f"`{text}`"))
    count = lambda pattern: F.regexp_count("__t", F.lit(pattern)).cast("double")
    s = docs.select(*kept, t.alias("__t")).select(
        *kept, "__t", F.array_remove(F.split("__t", rf"[{SPACE_CLASS}]+"), "").alias("__w"),
        F.filter(F.split("__t", "\n"), lambda x: F.length(F.trim(x)) > 0).alias("__l"))
    w, lines = F.col("__w"), F.col("__l")
    s = s.select(
        *kept, F.size(w).cast("double").alias("words"), F.size(lines).cast("double").alias("lines"),
        F.length(F.array_join(w, "")).cast("double").alias("chars"),
        F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)).cast("double").alias("longest"),
        F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("double").alias("repeats"),
        F.size(F.filter(w, lambda x, i: x == F.get(w, i - 2))).cast("double").alias("pairs"),
        F.size(F.filter(w, lambda x: ~x.rlike(r"[\p{L}\p{N}]"))).cast("double").alias("bare"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("double").alias("same_lines"),
        count(r"[#*$%&|<>{}\[\]=~^@\\_]").alias("symbols"), count(r"\p{Lu}").alias("capitals"), count("[!?]{2}").alias("shouts"),
        count(r"[.!?]").alias("stops"), count(r"[,;:]").alias("commas"), count(r"\p{Nd}").alias("digits"),
        count(r"[^\p{L}\p{N}\s\p{P}\p{S}]").alias("others"))
    width = {"words": SMOOTH, "lines": SMOOTH / 4, "chars": 5 * SMOOTH}
    share = [F.log((F.col(a) + F.lit(p * width[b])) / (F.col(b) + F.lit(width[b]))) for _, a, b, p in RATIOS]
    length = [F.log((F.col("chars") + 5 * SMOOTH) / (F.col("words") + SMOOTH)), F.log(F.greatest(F.col("longest"), F.lit(8.0)))]
    return s.select(*kept, F.array(*share, *length).alias(out))


@dataclass(frozen=True)
class Model:
    """Centre and spread of the statistics; per class a mean, the inverse of
    its Cholesky factor, and the constant of its log density."""
    centre: np.ndarray
    spread: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    share: float          # of label 1, weighted; the answer when there is one class or none

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -CLIP, CLIP)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not 0 < self.share < 1 or np.isnan(self.share):
            return np.full(len(x), 0.5 if np.isnan(self.share) else self.share)
        z = self.standard(x)
        density = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def moments(train: DataFrame, dim: int, centre: np.ndarray | None = None, spread: np.ndarray | None = None) -> np.ndarray:
    """Per class: weight, sums and sums of products of (1, x) (``train``:
    features, w0, w1), added up in the tasks and then by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, dim + 1, dim + 1))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            if centre is not None:
                x = np.clip((x - centre) / spread, -CLIP, CLIP)
            x = np.column_stack([np.ones(len(x)), x])
            for c in (0, 1):
                total[c] += (x * b.column(1 + c).to_numpy(zero_copy_only=False).astype(float)[:, None]).T @ x
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["cell", "v"])

    rows = train.select("features", "w0", "w1").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(2 * (dim + 1) ** 2)
    for r in rows:
        out[r["cell"]] = r["v"]
    return out.reshape(2, dim + 1, dim + 1)


def shrunk(cov: np.ndarray, n: float) -> np.ndarray:
    """Oracle approximating shrinkage of a covariance towards a multiple of the identity."""
    d = len(cov)
    mu = np.trace(cov) / d
    a, b = (cov ** 2).sum(), np.trace(cov) ** 2
    down = (n + 1 - 2 / d) * (a - b / d)
    rho = 1.0 if down <= 0 else min(1.0, ((1 - 2 / d) * a + b) / down)
    rho = max(rho, LEAST_SHRINK)
    return (1 - rho) * cov + (rho * mu + 1e-9) * np.eye(d)


def fit(train: DataFrame) -> Model:
    """The classes' moments (two passes: spread, then moments of the clipped
    statistics) and their factors."""
    dim = len(FEATURES)
    raw = moments(train, dim)
    weight = raw[:, 0, 0]
    n = weight.sum()
    share = weight[1] / n if n else float("nan")
    both = raw.sum(axis=0)
    centre = both[0, 1:] / n if n else np.zeros(dim)
    spread = np.sqrt(np.maximum(np.diag(both)[1:] / n - centre ** 2, 0)) if n else np.ones(dim)
    spread = np.where(spread > 1e-9, spread, 1.0)
    if not 0 < share < 1:
        zero = np.zeros((2, dim))
        return Model(centre, spread, zero, np.zeros((2, dim, dim)), np.zeros(2), share)
    m = moments(train, dim, centre, spread)
    means = m[:, 0, 1:] / weight[:, None]
    scatter = [m[c, 1:, 1:] - weight[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / n
    factors, constants = [], []
    for c in (0, 1):
        extra = POOL_ROWS * dim
        cov = (scatter[c] + extra * pooled) / (weight[c] + extra)
        lower = np.linalg.cholesky(shrunk(cov, weight[c] + extra))
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(weight[c] / n) - np.log(np.diag(lower)).sum())
    return Model(centre, spread, means, np.array(factors), np.array(constants), float(share))


def label_weights(labels: DataFrame, label: str = "quality") -> DataFrame:
    """One row a document: how often it is labelled 0 and 1."""
    return labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(
        F.count_if(F.col(label) == 0).alias("w0"), F.count_if(F.col(label) == 1).alias("w1"))


def training_rows(rows: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``features, w0, w1`` of labelled documents (salted: an id may repeat in many rows)."""
    salted = label_weights(labels, label).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("features"), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", salt).join(
        salted, (F.col("doc_id") == F.col("labelled")) & (F.col("salt") == F.col("part"))).select("features", "w0", "w1")


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``score`` in place of ``features``."""
    rest = [c for c in rows.columns if c != "features"]
    at, dim = rows.columns.index("features"), len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns) if i != at], pa.array(model.score(x))],
                                             names=[*rest, "score"])

    from pyspark.sql import types as T
    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in rest], T.StructField("score", T.DoubleType())]))


def held_out(folds: int = 5) -> Column:
    """Whether crc32(doc_id as text) leaves 0 (a NULL id: no)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def op11_qda(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels of the training fold, score every document."""
    rows = cut_lineage(features(docs.select("doc_id", held_out().alias("held_out"), "text"), "text"))
    train = cut_lineage(training_rows(rows.where(~F.col("held_out")), labels))
    scored = score(rows, fit(train))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
