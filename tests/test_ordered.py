"""Scalable ordered operators equal their plain single-window / NumPy /
pandas definitions, including with a hot value holding a third of rows."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import metrics, ordered
from riskloom.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    n = 3000
    p = np.round(rng.gamma(2.0, 1.0, n), 2)
    p[: n // 3] = 1.5                     # one value holds a third of the rows
    y = rng.poisson(0.2, n) * rng.gamma(2, 50, n)
    w = rng.uniform(0.3, 1.0, n)
    ids = rng.permutation(n) + 1
    pdf = pd.DataFrame({"IDpol": ids, "p": p, "y": y, "w": w})
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_prefix_equals_plain_window(skewed):
    pdf, df = skewed
    pre = ordered.exclusive_prefix(df, [("p", True), ("IDpol", False)], {"s": F.col("y")})
    w = Window.orderBy(F.col("p").desc(), "IDpol")
    plain = df.withColumn("rn0", F.row_number().over(w) - 1).withColumn(
        "s0", F.coalesce(F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    j = pre.join(plain.select("IDpol", "rn0", "s0"), "IDpol").toPandas()
    assert (j["_rn"] == j["rn0"]).all()
    assert np.allclose(j["s_before"], j["s0"], rtol=1e-12, atol=1e-9)


def _np_gini(y, p, w, ids):
    def area(key):
        order = np.lexsort((ids, -key))
        cw = np.cumsum(w[order]) / w.sum()
        cy = np.cumsum((y * w)[order]) / (y * w).sum()
        return np.trapezoid(cy, cw) - 0.5
    g, gp = area(p), area(y)
    return g, gp, g / gp


def test_gini_equals_numpy(skewed):
    pdf, df = skewed
    g = ordered.gini_parts(df, "y", "p", "w")
    ref = _np_gini(pdf.y.to_numpy(), pdf.p.to_numpy(), pdf.w.to_numpy(), pdf.IDpol.to_numpy())
    assert g["gini_raw"] == pytest.approx(ref[0], abs=1e-10)
    assert g["gini_perfect"] == pytest.approx(ref[1], abs=1e-10)
    assert g["gini"] == pytest.approx(ref[2], abs=1e-10)


@pytest.mark.parametrize("q", [2, 5, 10])
def test_rank_bins_equal_pandas_qcut(skewed, q):
    pdf, df = skewed
    got = ordered.rank_bins(df, "p", q).select("IDpol", "bin").toPandas()
    s = pdf.sort_values("IDpol").reset_index(drop=True)
    s["bin_ref"] = pd.qcut(s["p"].rank(method="first"), q=q, labels=False)
    m = s.merge(got, on="IDpol")
    assert (m["bin"] == m["bin_ref"]).all()


def test_auto_calibration_equals_pandas(skewed):
    pdf, df = skewed
    got = metrics.auto_calibration_error(df, "y", "p", "w", 10).first()[0]
    s = pdf.sort_values("IDpol").reset_index(drop=True)
    s["bin"] = pd.qcut(s["p"].rank(method="first"), q=10, labels=False)
    gmean = np.average(s.y, weights=s.w)
    err = 0.0
    for _, x in s.groupby("bin"):
        err += (x.w.sum() / s.w.sum()) * abs(np.average(x.y, weights=x.w) - np.average(x.p, weights=x.w)) / gmean
    assert got == pytest.approx(err, rel=1e-10)


def test_risk_percentile_brute_force(spark, skewed):
    pdf, df = skewed
    market = df.select(F.col("p").alias("premium"))
    qs = np.concatenate([pdf.p.to_numpy()[:40], [1.5, 0.0, 1e9, pdf.p.max()]])
    quotes = spark.createDataFrame(pd.DataFrame({"IDpol": np.arange(len(qs)), "premium": qs}))
    got = ordered.risk_percentile(quotes, market).toPandas().sort_values("IDpol")
    m = pdf.p.to_numpy()
    ref = [(m < v).mean() * 100 for v in qs]
    assert np.allclose(got["risk_percentile"].to_numpy(), ref, atol=1e-12)


def test_exact_quantiles_equal_numpy(skewed):
    pdf, df = skewed
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.995, "e": 1.0}
    got = {r.q_name: r.q_value for r in exact_quantiles(df, "y", probs).collect()}
    for k, q in probs.items():
        assert got[k] == pytest.approx(np.quantile(pdf.y, q), rel=1e-12, abs=1e-12)


def test_quantiles_with_null_keys_and_values(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", float("nan")), ("a", 2.0), ("a", None), ("b", None)]
    got = {r.g: r.q_value for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v",
                                                   {"m": 0.5}, keys=["g"]).collect()}
    assert got == {None: 2.0, "a": 2.0}


@pytest.fixture(scope="module")
def half(spark):
    """Half of the rows on one value, the rest distinct."""
    return spark.range(4000).select(F.col("id").alias("IDpol"), F.when(F.col("id") % 2 == 0, F.lit(500.0)).otherwise(
        F.col("id") / 3.0).alias("p"), (F.col("id") % 5).cast("double").alias("y"))


def test_hot_value_in_every_ordered_operator(spark, half):
    pdf = half.toPandas()
    bins = ordered.rank_bins(half, "p", 10).groupBy("bin").count().collect()
    assert len(bins) == 10 and all(r["count"] in (399, 400, 401) for r in bins)
    pct = {r.IDpol: r.risk_percentile for r in ordered.risk_percentile(
        half.select("IDpol", F.col("p").alias("premium")), half.select(F.col("p").alias("premium"))).collect()}
    assert pct[0] == pytest.approx((pdf.p < 500.0).mean() * 100) and len(pct) == 4000
    q = {r.q_name: r.q_value for r in exact_quantiles(half, "p", {"a": .25, "b": .5, "c": .9}).collect()}
    assert q == pytest.approx({n: np.quantile(pdf.p, x) for n, x in (("a", .25), ("b", .5), ("c", .9))})
    g = ordered.gini_parts(half, "y", "p")
    ref = _np_gini(pdf.y.to_numpy(), pdf.p.to_numpy(), np.ones(4000), pdf.IDpol.to_numpy())
    assert g["gini"] == pytest.approx(ref[2], abs=1e-9)


def test_dropped_cache_changes_nothing(spark, half):
    """The ranges are fixed before the result runs: clearing the cache between
    planning and running gives the same rows."""
    many = spark.range(60_000).select(F.col("id").alias("IDpol"), (F.col("id") * 7919 % 50_021 / 3).alias("premium"))
    market = many.select("premium")
    kept = {r.IDpol: r.risk_percentile for r in ordered.risk_percentile(many, market).collect()}
    lazy = ordered.risk_percentile(many, market)
    bins = ordered.rank_bins(many, "premium", 7)
    spark.catalog.clearCache()
    assert {r.IDpol: r.risk_percentile for r in lazy.collect()} == kept
    counts = sorted(r["count"] for r in bins.groupBy("bin").count().collect())
    assert sum(counts) == 60_000 and counts[-1] - counts[0] <= 1
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_grouped_exact_quantiles(skewed):
    pdf, df = skewed
    g = df.withColumn("g", (F.col("IDpol") % 3).cast("string"))
    got = exact_quantiles(g, "p", {"m": 0.5, "q9": 0.9}, keys=["g"]).collect()
    pdf = pdf.assign(g=(pdf.IDpol % 3).astype(str))
    for r in got:
        ref = np.quantile(pdf[pdf.g == r.g].p, 0.5 if r.q_name == "m" else 0.9)
        assert r.q_value == pytest.approx(ref, rel=1e-12)


def test_splits_are_grouped_and_stable(spark):
    df = spark.range(1, 5001).withColumnRenamed("id", "IDpol")
    tr, te = ordered.grouped_split(df)
    assert tr.count() + te.count() == 5000
    assert tr.join(te, "IDpol").count() == 0
    assert 0.17 < te.count() / 5000 < 0.23
    f = ordered.group_kfold(df, n_folds=5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in f) == [1000] * 5
    tr2, val = ordered.early_stopping_split(tr)
    assert 0.1 < val.count() / tr.count() < 0.2


def plain_packing(sizes, k):
    """Every group, largest first, to the lightest fold (the first of equal ones)."""
    load, out = [0] * k, []
    for s in sizes:
        j = min(range(k), key=lambda i: (load[i], i))
        load[j] += s
        out.append(j)
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_packing_lines_equal_one_by_one_packing(k):
    rng = np.random.default_rng(k)
    for _ in range(40):
        sizes = sorted(rng.choice([1, 1, 2, 3, 5, 8, 40, 300], rng.integers(1, 200)).tolist(), reverse=True)
        classes = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
        lines, got = ordered._packed(classes, k), []
        for size, first, number, folds in lines:
            assert first == len([g for g in got if g[0] == size])
            got += [(size, folds[i % len(folds)]) for i in range(number)]
        assert [f for _, f in got] == plain_packing(sizes, k)
        assert len(lines) <= (k + 1) * len(classes)


def test_folds_are_balanced_by_rows(spark):
    """Groups of several rows, one with a third of them, and rows without an id."""
    ids = [0] * 900 + [i for i in range(1, 200) for _ in range(i % 13)] + [None] * 50
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "IDpol long, row long")
    rows = ordered.group_kfold(df, n_folds=3).collect()
    assert sorted(r.row for r in rows) == list(range(len(ids)))
    folds = {}
    for r in rows:
        folds.setdefault(r.IDpol, set()).add(r.fold)
    assert all(len(f) == 1 for f in folds.values())
    total = [sum(r.fold == j for r in rows) for j in range(3)]
    sizes = sorted((ids.count(i) for i in set(ids)), reverse=True)
    want = [0] * 3
    for s, j in zip(sizes, plain_packing(sizes, 3)):
        want[j] += s
    assert total == want and max(total) - min(total) <= 900


def test_gini_by_group_equals_single_runs(spark):
    rng = np.random.default_rng(8)
    n = 600
    pdf = pd.DataFrame({"IDpol": range(n), "g": rng.integers(0, 4, n), "h": rng.integers(0, 2, n),
                        "y": rng.integers(0, 4, n).astype(float), "p": rng.integers(0, 40, n) / 7.0, "w": rng.uniform(.3, 1, n)})
    pdf.loc[pdf.g == 3, "y"] = 0.0
    df = spark.createDataFrame(pdf)
    got = {(r.g, r.h): r for r in ordered.gini_by(df, "y", "p", "w", keys=["g", "h"]).collect()}
    assert len(got) == 8
    for (g, h), r in got.items():
        one = ordered.gini_parts(df.where((F.col("g") == g) & (F.col("h") == h)), "y", "p", "w")
        assert [r.gini_raw, r.gini_perfect, r.gini] == pytest.approx([one["gini_raw"], one["gini_perfect"], one["gini"]], abs=1e-12)
    assert got[3, 0].gini == 0.0
    sub = pdf[(pdf.g == 1) & (pdf.h == 1)]

    def area(order):
        cw, cy = np.cumsum(order.w) / order.w.sum(), np.cumsum(order.y * order.w) / (order.y * order.w).sum()
        return np.trapezoid(cy, cw) - 0.5
    want = area(sub.sort_values(["p", "IDpol"], ascending=[False, True])), area(sub.sort_values(["y", "IDpol"], ascending=[False, True]))
    assert [got[1, 1].gini_raw, got[1, 1].gini_perfect] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("n", [1, 299, 2000, 9999, 10_000, 20_000])
def test_sample_is_that_of_the_smallest_hashes(spark, monkeypatch, n):
    monkeypatch.setattr(ordered, "_PREFIX", 1)
    monkeypatch.setattr(ordered, "_ORDERED", 40)
    ids = list(range(9_000)) + [77] * 997 + [None] * 3
    df = spark.createDataFrame([(i,) for i in ids], "IDpol long")
    import hashlib
    key = {i: ("g" if i is None else hashlib.md5(f"42:{i}".encode()).hexdigest()) for i in set(ids)}
    got = [r.IDpol for r in ordered.seeded_sample(df, n).collect()]
    assert sorted(map(str, got)) == sorted(map(str, sorted(ids, key=lambda i: key[i])[:n]))


def test_seeded_sample_exact_size(spark):
    df = spark.range(1, 2001).withColumnRenamed("id", "IDpol")
    a = ordered.seeded_sample(df, 300)
    b = ordered.seeded_sample(df, 300)
    assert a.count() == 300
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())
