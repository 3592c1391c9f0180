"""Model jobs: design frames, GLMs, boosting, attributions, isotonic,
engine bundle round trip."""
import dataclasses
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import attribution, boosting, features, glm, isotonic, metrics
from riskloom.plans import catalog, engine
from riskloom.sources.bundle import load_engine, save_engine, versions
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def train(spark):
    return catalog.training_frame(spark, SF_SMALL).cache()


@pytest.fixture(scope="module")
def enc(train):
    return features.fit_encoding(train)


def test_design_frame_finite_and_batch_independent(spark, train, enc):
    flat = features.design_columns(train, enc, keep=["IDpol"]).toPandas().set_index("IDpol")
    assert np.isfinite(flat.to_numpy(dtype=float)).all()
    assert flat.shape[1] > len(enc.num_cols)
    t = train.toPandas().set_index("IDpol")
    assert np.allclose(flat["Density"], np.log1p(t.loc[flat.index, "Density"]))
    one = train.limit(1)
    i = one.first().IDpol
    single = features.design_columns(one, enc, keep=["IDpol"]).toPandas().set_index("IDpol")
    assert np.allclose(single.loc[i].to_numpy(float), flat.loc[i].to_numpy(float))
    unseen = one.withColumn("Area", F.lit("Z")).withColumn("VehBrand", F.lit(None).cast("string"))
    u = features.design_columns(unseen, enc).toPandas()
    assert (u[[c for c in u.columns if c.startswith(("Area_", "VehBrand_"))]] == 0).all().all()


def test_poisson_glm_one_factor_closed_form(spark):
    rng = np.random.default_rng(0)
    n = 1200
    pdf = pd.DataFrame({"g": rng.choice(list("abc"), n), "Exposure": rng.uniform(.3, 1, n),
                        "w": rng.uniform(.5, 1.5, n)})
    pdf["ClaimNb"] = rng.poisson(0.1 * pdf.Exposure)
    df = spark.createDataFrame(pdf)
    e = features.fit_encoding(df, ["g"], [])
    m = glm.fit_poisson_frequency(features.design_frame(df, e), weight="w")
    lv = features.design_frame(spark.createDataFrame([("a",), ("b",), ("c",)], "g string"), e)
    got = {r.g: r.prediction for r in glm.predict_glm(m, lv).collect()}
    for g, x in pdf.groupby("g"):
        assert got[g] == pytest.approx((x.w * x.ClaimNb).sum() / (x.w * x.Exposure).sum(), rel=1e-8)


def test_gamma_glm_runs_with_weights(spark, train, enc):
    c = train.filter("sev_count > 0").withColumn("avg_claim", F.col("sev_total") / F.col("sev_count"))
    m = glm.fit_gamma_severity(features.design_frame(c, enc), weight=None)
    p = glm.predict_glm(m, features.design_frame(c, enc), "sev", floor=1e-3).toPandas()
    assert np.isfinite(p.sev).all() and (p.sev > 0).all()


def test_gamma_glm_reads_its_rows_once(spark):
    """The iterations do not work out the claim policies again."""
    seen = spark.sparkContext.accumulator(0)

    def noted(x):
        seen.add(1)
        return x

    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(list("abc"), 300), "avg_claim": rng.gamma(2, 400, 300), "sev_count": 1})
    df = spark.createDataFrame(pdf)
    e = features.fit_encoding(df, ["g"], [])
    df = df.withColumn("avg_claim", F.udf(noted, "double").asNondeterministic()("avg_claim"))
    m = glm.fit_gamma_severity(features.design_frame(df, e))
    assert m.summary.numIterations > 2 and seen.value == 300
    got = {r.g: r.prediction for r in glm.predict_glm(m, features.design_frame(spark.createDataFrame([("a",), ("b",), ("c",)], "g string"), e)).collect()}
    for g, x in pdf.groupby("g"):
        assert got[g] == pytest.approx(x.avg_claim.mean(), rel=1e-6)


@pytest.fixture(scope="module")
def gbm(train, enc):
    return boosting.fit_boosted(train, enc, "ClaimNb", "Exposure", None, "poisson", rounds=6,
                                learning_rate=0.3, min_rows=20, valid=train, patience=None,
                                state_every=3)


def test_poisson_boosting_deviance_falls(gbm, train):
    devs = [d for _, d in gbm.history]
    assert all(b < a for a, b in zip(devs, devs[1:]))
    p = boosting.predict_boosted(gbm, train, "rate").toPandas()
    assert np.isfinite(p.rate).all() and (p.rate > 0).all()


def test_attributions_are_additive(gbm, train):
    a = attribution.attributions(gbm, train)
    s = attribution.raw_score(gbm, train)
    j = a.join(s, "IDpol").toPandas()
    assert np.allclose(j["raw"], j["score"], atol=1e-9)
    d = j["drivers"].iloc[0]
    assert len(d) == 3 and abs(d[0]["effect"]) >= abs(d[1]["effect"]) >= abs(d[2]["effect"])
    top = attribution.top_factors(a, 8).toPandas()
    assert len(top) == 8 and top.mean_abs_effect.is_monotonic_decreasing


def test_tweedie_and_power_search(spark, train, enc):
    from riskloom.plans.runs import tweedie_power_search
    best, means = tweedie_power_search(train, enc, [1.5, 1.7, 1.9], n_folds=2, rounds=2,
                                       learning_rate=0.3, min_rows=20)
    assert best in (1.5, 1.7, 1.9)
    assert means.count() == 3


def test_isotonic_pools_by_hand(spark):
    """Weighted blocks of 1, 3|2, 5 at predictions 10..40 and a prediction
    that half of the rows share; constant beyond the ends."""
    rows = [(10.0, 1.0, 2.0), (20.0, 3.0, 1.0), (30.0, 2.0, 3.0)] + [(40.0, 5.0 + i % 2, 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "p double, y double, w double")
    m = isotonic.fit_isotonic(df, "p", "y", "w")
    at = spark.createDataFrame([(0.0,), (10.0,), (20.0,), (30.0,), (35.0,), (40.0,), (99.0,)], "p double")
    got = [r.c for r in isotonic.apply_isotonic(m, at, "p", "c").collect()]
    assert got == pytest.approx([1.0, 1.0, 2.25, 2.25, (2.25 + 5.5) / 2, 5.5, 5.5])


def plain_pav(points):
    """[(x, y, w)] in order of x -> fitted value per point."""
    stack = []
    for x, y, w in points:
        stack.append([y * w, w, 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] > stack[-1][0] * stack[-2][1]:
            a = stack.pop()
            stack[-1] = [p + q for p, q in zip(stack[-1], a)]
    return [s / w for s, w, n in stack for _ in range(n)]


@pytest.mark.parametrize("shape", ["noisy", "reversed", "steps", "hot"])
def test_isotonic_over_ranges_equals_plain_pooling(spark, shape):
    """10^5 distinct predictions over many ranges: little pooling, one pool of
    everything, blocks that reach over several ranges, half of the rows on one
    prediction."""
    rng = np.random.default_rng(1)
    n = 100_000
    x = np.sort(rng.uniform(0, 1000, n))
    y = {"noisy": x + rng.normal(0, 300, n), "reversed": -x, "hot": x + rng.normal(0, 50, n),
         "steps": np.where((x > 200) & (x < 700), 900 - x, x) + rng.normal(0, 5, n)}[shape]
    w = rng.uniform(.5, 1.5, n)
    if shape == "hot":
        x[n // 4: 3 * n // 4] = x[n // 2]
    pdf = pd.DataFrame({"p": x, "y": y, "w": w})
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        m = isotonic.fit_isotonic(spark.createDataFrame(pdf.sample(frac=1, random_state=0)), "p", "y", "w")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    pooled = pdf.assign(wy=pdf.y * pdf.w).groupby("p", as_index=False)[["wy", "w"]].sum()
    fitted = plain_pav(list(zip(pooled.p, pooled.wy / pooled.w, pooled.w)))
    at = spark.createDataFrame(pd.DataFrame({"i": range(len(pooled)), "p": pooled.p}).iloc[::37])
    got = isotonic.apply_isotonic(m, at, "p", "c").toPandas().set_index("i").c
    assert np.allclose(got, np.array(fitted)[got.index], rtol=1e-9, atol=1e-7)
    ends = isotonic.apply_isotonic(m, spark.createDataFrame([(-1e9,), (1e9,), (float("nan"),), (None,)], "p double"), "p", "c")
    got = {str(r.p): r.c for r in ends.collect()}
    assert got["-1000000000.0"] == pytest.approx(fitted[0]) and got["1000000000.0"] == pytest.approx(fitted[-1])
    assert got["nan"] is None and got["None"] is None


def test_isotonic_map_is_linear_work(spark, monkeypatch):
    """No frame reaches from a row to the end of its range: Spark would read
    the rest of the range for every row.  Values between points, beyond the
    ends and in ranges without points."""
    plans, real = [], isotonic.cut_lineage

    def noted(df):
        plans.append(df._jdf.queryExecution().toString().lower())
        return real(df)

    monkeypatch.setattr(isotonic, "cut_lineage", noted)
    points = spark.createDataFrame([(10.0 * i, float(i * i)) for i in range(1, 20)], "x double, y double")
    at = spark.range(5000).select((F.col("id") / 20).alias("p"))
    got = isotonic.apply_isotonic(isotonic.IsotonicFit(points), at, "p", "c").toPandas()
    x = np.arange(1, 20)
    assert np.allclose(got.c, np.interp(got.p, 10.0 * x, x ** 2.0)) and len(got) == 5000
    assert any("unboundedpreceding" in p for p in plans) and not any("unboundedfollowing" in p for p in plans)


def test_isotonic_of_nothing(spark):
    none = spark.createDataFrame([(1.0, None, 1.0), (None, 2.0, 1.0), (3.0, 1.0, 0.0)], "p double, y double, w double")
    m = isotonic.fit_isotonic(none, "p", "y", "w")
    assert m.points.count() == 0
    assert [r.c for r in isotonic.apply_isotonic(m, none, "p", "c").collect()] == [None] * 3


def test_calibration_by_hand(spark):
    """Two bins of two rows: |1.5 - 1| + |2 - 3.5| of the weights, over the mean."""
    df = spark.createDataFrame([(1, 1.0, 0.5), (2, 2.0, 1.5), (3, 1.0, 3.0), (4, 3.0, 4.0)], "IDpol long, y double, p double")
    err = metrics.auto_calibration_error(df, "y", "p", n_bins=2).first()[0]
    assert err == pytest.approx((0.5 * 0.5 + 0.5 * 1.5) / 1.75)
    none = df.withColumn("y", F.lit(0.0))
    assert metrics.balance_ratio(none, "y", "p").first()[0] is None
    assert metrics.auto_calibration_error(none, "y", "p", n_bins=2).first()[0] is None


def test_balance_exact(spark):
    df = spark.createDataFrame([(4.0, 1.0, 2.0), (1.0, 3.0, 1.0)], "y double, p double, w double")
    assert metrics.balance_ratio(df, "y", "p").first()[0] == pytest.approx(0.8)
    assert metrics.balance_ratio(df, "y", "p", "w").first()[0] == pytest.approx(5 / 9)


def test_engine_bundle_round_trip(spark, train, tmp_path):
    eng = engine.fit_engine(train, rounds=3, learning_rate=0.3, patience=None, min_rows=20)
    rows = train.limit(50)
    before = engine.calibrated_pure_premium(eng, rows).select("IDpol", "premium").toPandas()
    path = f"{spark.conf.get('spark.checkpoint.dir')}/bundle-{uuid.uuid4().hex}"
    save_engine(eng, path)
    eng2 = load_engine(spark, path)
    after = engine.calibrated_pure_premium(eng2, rows).select("IDpol", "premium").toPandas()
    m = before.merge(after, on="IDpol")
    assert np.allclose(m.premium_x, m.premium_y)
    assert (m.premium_x >= 0).all()
    rep = engine.diagnose_with_engine(eng2, rows).toPandas()
    assert rep.risk_percentile.between(0, 100).all()
    assert ((rep.estimated_gross_premium > rep.pure_premium) | (rep.pure_premium == 0)).all()   # the lowest pool may have no claim
    assert rep.cohort.notna().all()
    assert rep.drivers.map(len).eq(3).all()
    assert [t.rows.tolist() for t in eng2.freq.trees] == [t.rows.tolist() for t in eng.freq.trees]
    with pytest.raises(FileNotFoundError):
        load_engine(spark, path + "-missing")
    with pytest.raises(FileNotFoundError):
        load_engine(spark, path, 9)

    # a save that is cut short leaves the version before in force
    cut = dataclasses.replace(eng, factors=None)
    with pytest.raises(AttributeError):
        save_engine(cut, path)
    assert versions(spark, path) == [eng2.version] and load_engine(spark, path).version == eng2.version
    newer = save_engine(eng, path, keep=2)
    assert newer == eng2.version + 2 and versions(spark, path) == [eng2.version, newer]
    assert save_engine(eng, path, keep=1) == newer + 1 and versions(spark, path) == [newer + 1]


def test_market_stats_histogram(spark):
    df = spark.createDataFrame(pd.DataFrame({"premium": np.linspace(0, 1000, 1000)}))
    from riskloom.operators import market
    h = market.market_histogram(df, "premium", 30).toPandas()
    assert len(h) == 30 and h["count"].sum() == 1000
    ref, _ = np.histogram(np.clip(df.toPandas().premium, 0, np.quantile(df.toPandas().premium, .99)), bins=30)
    assert (h.sort_values("bin")["count"].to_numpy() == ref).all()
    s = market.market_summary(df, "premium").first()
    assert s.n == 1000 and s.median == pytest.approx(500.0)


@pytest.mark.parametrize("vals", [[5.0] * 50, [5.0] * 199 + [9.0], [1.0] * 150 + [2.0, 3.0] * 25])
def test_histogram_degenerate_markets(spark, vals):
    from riskloom.operators import market
    df = spark.createDataFrame(pd.DataFrame({"premium": vals}))
    h = market.market_histogram(df, "premium", 30).toPandas().sort_values("bin")
    m = np.asarray(vals)
    lo, hi = m.min(), np.quantile(m, .99)
    if hi <= lo:
        hi = lo + 1
    ref, edges = np.histogram(np.clip(m, lo, hi), bins=30)
    assert (h["count"].to_numpy() == ref).all()
    assert np.allclose(h.lo_edge.to_numpy(), np.round(edges[:-1], 2))
    s = market.market_summary(df, "premium").first()
    assert s.p99 == round(hi, 2)


class Asked(Exception):
    pass


@pytest.mark.parametrize("query", ["poisson_gbm", "policy_drivers", "top_factors", "engine_diagnosis", "tweedie_gbm",
                                   "tweedie_power_search"])
def test_registered_fits_ask_for_the_whole_job(spark, monkeypatch, query):
    """Rounds, patience, rate, powers and folds of the reference."""
    from riskloom import schema
    from riskloom.plans import catalog, runs
    asked = {}

    def fit(*args, **kw):
        asked.update(kw)
        raise Asked

    monkeypatch.setattr(boosting, "fit_boosted", fit)
    if query == "tweedie_power_search":
        monkeypatch.setattr(runs, "tweedie_power_search", lambda t, enc, grid=schema.TWEEDIE_POWER_GRID, **kw: fit(grid=grid, **kw))
    with pytest.raises(Asked):
        catalog.QUERIES[query](spark, SF_SMALL)
    assert asked["learning_rate"] == 0.05
    if query == "tweedie_power_search":
        assert asked["grid"] == [1.5, 1.6, 1.7, 1.8, 1.9] and asked["n_folds"] == 3 and asked["rounds"] == 150
    elif query == "tweedie_gbm":
        assert asked["rounds"] == 100
    else:
        assert asked["rounds"] == 2000 and asked["patience"] == 50
