"""Quality rules and the quality classifier."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import quality_classifier, quality_rules
from tests.conftest import SF_MID


def test_binomial_bound_is_exact(spark):
    cases = [(0, 50), (3, 400), (5, 5), (0, 0), (20, 1500), (75, 1500)]
    frame = spark.createDataFrame(cases, "k long, n long")
    p = 0.05
    got = [r[0] for r in frame.select(quality_rules.binomial_cdf(F.col("k"), F.col("n"), p)).collect()]
    for (k, n), g in zip(cases, got):
        exact = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
        assert g == (pytest.approx(exact, rel=1e-9) if k <= n * p else 1.0)
    big = spark.createDataFrame([(4_500, 100_000)], "k long, n long")
    value = big.select(quality_rules.binomial_cdf(F.col("k"), F.col("n"), p)).first()[0]
    assert 0 < value < 1e-10                     # no underflow


def test_cutoffs_limit_false_rejections(spark):
    """Good documents with a known share above each cutoff: the strictest
    cutoff whose exact test passes is chosen, per stratum."""
    n = 4000
    measured = spark.range(n).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"),
        *[F.when(F.col("id") < bad, F.lit(1.0)).otherwise(F.lit(0.0)).alias(r)
          for r, bad in (("symbol_ratio", 10), ("dup_line_ratio", 2000), ("upper_ratio", 0))])
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    grid = {r: (0.0, 0.5, 1.0) for r in ("symbol_ratio", "dup_line_ratio", "upper_ratio")}
    rows = {r.lang: r for r in quality_rules.learn_cutoffs(measured, labels, grid=grid).collect()}
    for lang in "ab":
        assert rows[lang].cut_symbol_ratio == 0.0 and rows[lang].cut_upper_ratio == 0.0
        assert rows[lang].cut_dup_line_ratio == 1.0
    few = quality_rules.learn_cutoffs(measured.limit(60), labels, grid=grid).collect()
    assert all(r.cut_symbol_ratio is None and r.cut_upper_ratio is None for r in few)


def test_rules_on_odd_rows(spark, odd_documents, no_documents, odd_labels):
    rows = quality_rules.apply_rules(odd_documents, odd_labels).collect()
    assert len(rows) == odd_documents.count()
    by = {r.doc_id: r for r in rows}
    assert by[3].n_words == 0 and by[3].base_failed and not by[4].kept
    assert by[6].n_words == 30_000 and by[6].n_repeat_words == 30_000
    assert by[1].kept and by[8].n_dup_lines == 1
    assert quality_rules.apply_rules(no_documents, odd_labels).count() == 0
    assert quality_rules.apply_rules(odd_documents, odd_labels.limit(0)).where("kept").count() == sum(
        not r.base_failed for r in rows)


def test_repeat_words_by_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcd"), rng.integers(0, 60))) for _ in range(80)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("x"))
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.signals(frame).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        grams = [tuple(w[j:j + 5]) for j in range(len(w) - 4)]
        covered = {j + d for j, g in enumerate(grams) if grams.count(g) > 1 for d in range(5)}
        assert got[i] == len(covered)


def test_score_is_the_log_density_difference(spark):
    rng = np.random.default_rng(1)
    d = len(quality_classifier.FEATURES)
    x = [rng.normal(0, 1, (300, d)) @ np.diag(rng.uniform(.5, 2, d)), rng.normal(.7, 1.5, (500, d))]
    n = np.array([300.0, 500.0])
    s = np.array([a.sum(0) for a in x])
    ss = np.array([a.T @ a for a in x])
    model = quality_classifier.from_sums(n, s, ss)
    points = rng.normal(0, 1, (20, d))
    frame = spark.createDataFrame([(p.tolist(),) for p in points], "x array<double>")
    got = [r[0] for r in frame.select(model.score(F.col("x"))).collect()]
    pooled = sum(a.shape[0] * np.cov(a.T, bias=True) for a in x) / n.sum()
    z = np.diag(1 / model.scale)
    logs = []
    for k, a in enumerate(x):
        c = .9 * np.cov(a.T, bias=True) + .1 * pooled
        c = z @ c @ z
        c = .95 * c + .05 * np.eye(d) * np.trace(c) / d
        diff = (points - a.mean(0)) @ z
        logs.append(np.log(n[k] / n.sum()) - .5 * np.linalg.slogdet(c)[1]
                    - .5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(c), diff))
    assert got == pytest.approx((1 / (1 + np.exp(logs[0] - logs[1]))).tolist(), rel=1e-6)


def test_held_out_accuracy(spark):
    """Ranks most held-out pairs of a good and a bad document rightly, and
    keeps the good ones."""
    from riskloom.llm.queries import QUERIES
    rows = QUERIES["op5_quality_classifier"](spark, SF_MID).join(
        spark.read.parquet(f"{SF_MID}/labels.parquet"), "doc_id").where("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    auc = np.mean([(g > b) + .5 * (g == b) for g in good for b in bad])
    assert auc > 0.9
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.9


def test_classifier_on_odd_rows(spark, odd_documents, no_documents, odd_labels):
    rows = quality_classifier.classify(odd_documents, odd_labels).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    twins = {r.score for r in rows if r.doc_id in (1, 2)}
    assert len(twins) == 1
    assert quality_classifier.classify(no_documents, odd_labels).count() == 0
    none = quality_classifier.classify(odd_documents, odd_labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    kept = quality_classifier.keep_good(odd_documents, odd_labels)
    assert kept.columns == odd_documents.columns
