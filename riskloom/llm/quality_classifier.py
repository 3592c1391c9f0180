"""Quality classifier: regularised quadratic discriminant.

Ten statistics of the whole text, transformed towards normality, are
standardised; each class gets a mean and a covariance, shrunk first towards
the pooled covariance and then towards a multiple of the identity.  A score
is the logistic of the difference of the two log densities (Mahalanobis
distance, log determinant, log prior); the inverted Cholesky factors are
computed once on the driver (ten by ten numbers) and enter the plan as
literals, so scoring is one pass over the texts in the JVM, with no shuffle.

Fitting uses at most ``FIT_ROWS`` labelled rows (a documented bound: those
with the smallest hash of the id), so the ids can be broadcast and only the
sample's texts are read twice; its sums and cross products are one aggregate.

Defined cases: null and empty texts have all statistics at zero and a score
like any other; labels other than 0 and 1, null ids and unknown ids are
ignored; a doc_id labelled both 0 and 1 counts as 0; a document repeated in
the table is scored row by row (and weighs twice in the fit); with fewer than
two rows of either class every score is the smoothed share of good labels;
empty table, empty result; labels, lang, source and doc_id never enter a
score; extra columns are carried by ``with_score`` untouched.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import chars_in, crc_of_id, free_name, text_of, words_of

FOLDS = 5
THRESHOLD = 0.3
FIT_ROWS = 50_000
TO_POOLED = 0.1
TO_IDENTITY = 0.05
FEATURES = ["log_words", "log_word_len", "symbol_share", "upper_share", "mark_share", "digit_share",
            "distinct_share", "dup_line_share", "log_line_words", "other_share"]


def _staged(docs: DataFrame, text: str) -> tuple[DataFrame, str, list[str]]:
    """``docs`` with a struct column of the transformed statistics."""
    names = [free_name(docs, f"_qc_{x}") for x in ("t", "w", "l", "c", "x")]
    t, w, ln, c, x = names
    staged = docs.withColumn(t, text_of(text))
    staged = staged.withColumn(w, words_of(F.col(t))).withColumn(
        ln, F.filter(F.split(t, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    staged = staged.withColumn(c, F.struct(
        F.size(w).cast("double").alias("words"), F.size(F.array_distinct(w)).cast("double").alias("distinct"),
        F.size(ln).cast("double").alias("lines"), F.size(F.array_distinct(ln)).cast("double").alias("lines_distinct"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("double").alias("chars"),
        chars_in(F.col(t), r"[^#*$%&|<>]").alias("symbols"), chars_in(F.col(t), r"[^\p{Lu}]").alias("upper"),
        chars_in(F.col(t), r"[^!?]").alias("marks"), chars_in(F.col(t), r"[^0-9]").alias("digits"),
        chars_in(F.col(t), r"[\p{L}\p{N}\x20\x09-\x0D]").alias("other")))

    def over(a: Column, b: str) -> Column:
        return a / F.greatest(F.col(c)[b], F.lit(1.0))

    s = F.col(c)
    values = [F.log1p(s["words"]), F.log1p(over(s["chars"], "words")), F.sqrt(over(s["symbols"], "chars")),
              F.sqrt(over(s["upper"], "chars")), F.sqrt(over(s["marks"], "chars")), F.sqrt(over(s["digits"], "chars")),
              over(s["distinct"], "words"), F.sqrt(over(s["lines"] - s["lines_distinct"], "lines")),
              F.log1p(over(s["words"], "lines")), F.sqrt(over(s["other"], "chars"))]
    staged = staged.withColumn(x, F.array(*[v.cast("double") for v in values]))
    return staged, x, names


@dataclass(frozen=True)
class Model:
    """Means, inverted Cholesky factors and log terms of the classes, over
    standardised features; ``constant`` is used instead when no fit exists."""
    center: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...] = ()
    inverse_factors: tuple[np.ndarray, ...] = ()
    offsets: tuple[float, ...] = ()
    constant: float | None = None

    def score(self, x: Column) -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        z = F.array(*[(F.get(x, F.lit(i)) - F.lit(float(m))) / F.lit(float(s))
                      for i, (m, s) in enumerate(zip(self.center, self.scale))])
        density = []
        for mean, inv, offset in zip(self.means, self.inverse_factors, self.offsets):
            shift = inv @ mean
            total = F.lit(offset)
            for i in range(len(mean)):
                row = F.lit(-float(shift[i]))
                for j in range(i + 1):
                    row = row + F.lit(float(inv[i, j])) * F.get(z, F.lit(j))
                total = total - F.lit(0.5) * row * row
            density.append(total)
        diff = F.least(F.greatest(density[1] - density[0], F.lit(-50.0)), F.lit(50.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-diff))


def from_sums(n: np.ndarray, s: np.ndarray, ss: np.ndarray, to_pooled: float = TO_POOLED,
              to_identity: float = TO_IDENTITY) -> Model:
    """Model from counts (2), sums (2, d) and cross products (2, d, d)."""
    d = s.shape[1]
    if min(n) < 2:
        return Model(np.zeros(d), np.ones(d), constant=float((n[1] + 1) / (n.sum() + 2)))
    center = s.sum(0) / n.sum()
    var = np.diag(ss.sum(0)) / n.sum() - center ** 2
    scale = np.sqrt(np.where(var > 1e-9, var, 1.0))
    means, covs = [], []
    for k in (0, 1):
        m = s[k] / n[k]
        covs.append((ss[k] / n[k] - np.outer(m, m)) / np.outer(scale, scale))
        means.append((m - center) / scale)
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    factors, offsets = [], []
    for k in (0, 1):
        c = (1 - to_pooled) * covs[k] + to_pooled * pooled
        c = (1 - to_identity) * c + to_identity * np.eye(d) * max(np.trace(c) / d, 1e-6)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        offsets.append(float(np.log(n[k] / n.sum()) - np.log(np.diag(low)).sum()))
    return Model(center, scale, tuple(means), tuple(factors), tuple(offsets))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on labelled rows outside the held-out fold."""
    known = (labels.where("quality in (0, 1) and doc_id is not null")
             .where(crc_of_id() % FOLDS != 0)
             .groupBy("doc_id").agg(F.min("quality").alias("_y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(known), "doc_id")
    staged, x, _ = _staged(rows, "text")
    d = len(FEATURES)
    at = [F.get(F.col(x), F.lit(i)) for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = staged.groupBy("_y").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(v) for v in at]).alias("s"),
        F.array(*[F.sum(at[i] * at[j]) for i, j in pairs]).alias("ss"))
    n, s, ss = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in sums.collect():                                  # two rows of sums
        k = int(r["_y"])
        n[k], s[k] = r["n"], r["s"]
        for (i, j), v in zip(pairs, r["ss"]):
            ss[k, i, j] = ss[k, j, i] = v
    return from_sums(n, s, ss)


def with_score(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    staged, x, names = _staged(docs, text)
    return staged.withColumn(score, model.score(F.col(x))).drop(*names)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select("doc_id", F.col(text).alias("text"))
    return with_score(rows, fit(docs, labels, text)).select(
        "doc_id", (crc_of_id() % FOLDS == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    score, row = free_name(docs, "_score"), free_name(docs, "_row")
    scored = with_score(docs, fit(docs, labels, text), text, score)
    # the row number keeps the filter above the projections: pushed down, it
    # would carry a copy of every statistic for each use in the score
    numbered = scored.withColumn(row, F.monotonically_increasing_id())
    return numbered.where((F.col(score) >= threshold) & (F.col(row) >= 0)).drop(score, row)
