"""Raking: hand-solved tables, the two properties of fitted weights (margins
hit, odds ratios kept), uncovered levels, configuration errors."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.functions.columns import weight_product
from riskloom.operators import raking


def _table(spark, counts, names=("a", "b")):
    """One row per unit of each cell of ``counts``."""
    rows = [(*cell, i) for cell, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", i int")


def _cell_weights(df, names=("a", "b"), col="rake_weight"):
    rows = df.groupBy(*names).agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.sum(col).alias("w")).collect()
    assert all(r.lo == pytest.approx(r.hi) for r in rows)
    return {tuple(r[n] for n in names): (r.lo, r.w) for r in rows}


def test_one_margin_by_hand(spark):
    df = _table(spark, {("p",): 30, ("q",): 15, ("r",): 5}, ("a",))
    got = _cell_weights(raking.rake(df, {"a": {"p": 0.3, "q": 0.5, "r": 0.2}}), ("a",))
    assert got[("p",)][0] == pytest.approx(0.5) and got[("q",)][0] == pytest.approx(25 / 15)
    assert got[("r",)][0] == pytest.approx(2.0)


def test_independent_margins_by_hand(spark):
    """Odds ratio 1: the fitted table is the product of the margins."""
    df = _table(spark, {("x", "u"): 12, ("x", "v"): 18, ("y", "u"): 8, ("y", "v"): 12})
    got = _cell_weights(raking.rake(df, {"a": {"x": 0.25, "y": 0.75}, "b": {"u": 0.7, "v": 0.3}}))
    want = {("x", "u"): 8.75, ("x", "v"): 3.75, ("y", "u"): 26.25, ("y", "v"): 11.25}
    for cell, total in want.items():
        assert got[cell][1] == pytest.approx(total, rel=1e-6)


def test_margins_hit_and_odds_kept(spark):
    counts = {("x", "u"): 40, ("x", "v"): 7, ("y", "u"): 9, ("y", "v"): 25, ("z", "u"): 14, ("z", "v"): 30}
    a, b = {"x": 0.3, "y": 0.25, "z": 0.45}, {"u": 0.55, "v": 0.45}
    got = {k: w for k, (_, w) in _cell_weights(raking.rake(_table(spark, counts), {"a": a, "b": b}, tol=1e-12)).items()}
    n = sum(counts.values())
    for lv, share in a.items():
        assert sum(w for (x, _), w in got.items() if x == lv) / n == pytest.approx(share, abs=1e-9)
    for lv, share in b.items():
        assert sum(w for (_, y), w in got.items() if y == lv) / n == pytest.approx(share, abs=1e-9)

    def odds(t, lv):
        return t["x", "u"] * t[lv, "v"] / (t["x", "v"] * t[lv, "u"])

    for lv in ("y", "z"):
        assert odds(got, lv) == pytest.approx(odds(counts, lv), rel=1e-9)


def test_uncovered_absent_and_null_levels(spark):
    """One pass by hand: levels outside the target keep their weight, targets
    without rows do nothing, a base weight counts."""
    df = spark.createDataFrame([("p", 2.0), ("p", 2.0), ("q", 1.0), ("w", 3.0), (None, 2.0)], "a string, bw double")
    rows = raking.rake(df, {"a": {"p": 0.2, "q": 0.3, "gone": 0.5}}, "bw", max_iter=1).collect()
    raw = {"p": 2.0 * 0.2 * 10 / 4, "q": 1.0 * 0.3 * 10 / 1, "w": 3.0, None: 2.0}     # shares of a total of 10
    mean = (2 * raw["p"] + raw["q"] + raw["w"] + raw[None]) / 5
    for r in rows:
        assert r.rake_weight == pytest.approx(raw[r.a] / mean)


def test_nothing_to_rake(spark):
    df = _table(spark, {("p",): 4}, ("a",))
    for margins in ({"a": {}}, {"missing": {"k": 1.0}}, {}):
        assert [r.rake_weight for r in raking.rake(df, margins).collect()] == [1.0] * 4
    off = dict(raking.DEFAULT_CONFIG, enabled=False)
    assert [r.rake_weight for r in raking.rake_from_config(df, off).collect()] == [1.0] * 4
    assert raking.rake(df.limit(0), {"a": {"p": 1.0}}).count() == 0


def test_config_hits_the_age_target_and_reports_problems(spark):
    df = spark.range(6000).select((F.col("id") % 71 + 17).cast("int").alias("DrivAge"))
    res = raking.rake_from_config(df, raking.DEFAULT_CONFIG, "fremtpl2")
    assert res.columns == ["DrivAge", "rake_weight"]
    from riskloom.functions.bands import age_band
    shares = {r.b: r.w / 6000 for r in res.groupBy(age_band("DrivAge").alias("b")).agg(
        F.sum("rake_weight").alias("w")).collect()}
    assert shares == pytest.approx(S.DRIVAGE_TARGET, abs=1e-6)
    with pytest.raises(KeyError, match="no raking margins"):
        raking.rake_from_config(df, raking.DEFAULT_CONFIG, "unknown")
    with pytest.raises(KeyError, match="needs column"):
        raking.rake_from_config(df, raking.DEFAULT_CONFIG, "ausprivauto")
    no_target = dict(raking.DEFAULT_CONFIG, target_margins={"Gender": S.GENDER_TARGET})
    with pytest.raises(KeyError, match="no target"):
        raking.rake_from_config(df, no_target, "fremtpl2")


def test_mapped_gender_margin(spark):
    """Letters and words map to the same level; others keep weight 1."""
    df = spark.createDataFrame([("M",)] * 6 + [("Female",)] * 3 + [("F",)], "Gender string")
    got = {r.Gender: r.rake_weight for r in raking.rake_from_config(df, raking.DEFAULT_CONFIG, "ausprivauto").collect()}
    assert got["M"] == pytest.approx(S.GENDER_TARGET["Male"] / 0.6)
    assert got["F"] == got["Female"] == pytest.approx(S.GENDER_TARGET["Female"] / 0.4)


def test_repeated_total_rows_are_an_error(spark):
    rows = [("계", S.STAT_TOTAL, S.STAT_MALE, "10"), ("계", S.STAT_TOTAL, S.STAT_MALE, "12"),
            ("계", S.STAT_TOTAL, S.STAT_FEMALE, "9")]
    frame = spark.createDataFrame(rows, "ITM_NM string, C1_NM string, C2_NM string, DT string")
    with pytest.raises(Exception, match="several rows"):
        raking.gender_shares(frame).collect()
    one_sex = raking.gender_shares(frame.limit(0)).collect()
    assert [r.share for r in one_sex] == [None, None]


def test_training_weight_product_and_mean(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"IDpol": range(800), "DrivAge": rng.integers(18, 90, 800),
                        "Exposure": rng.uniform(.3, 1, 800)})
    df = spark.createDataFrame(pdf)
    w = raking.training_weight(df, raking.DEFAULT_CONFIG, "fremtpl2", base_weight="Exposure")
    rw = raking.rake_from_config(df, raking.DEFAULT_CONFIG, "fremtpl2")
    j = w.join(rw.select("IDpol", "rake_weight"), "IDpol").toPandas()
    assert np.allclose(j.weight, j.Exposure * j.rake_weight)
    assert j.rake_weight.mean() == pytest.approx(1.0, abs=1e-9)
    assert weight_product() is None
    assert raking.training_weight(df, None, base_weight=None).columns == df.columns


def test_margin_builders_from_rows(spark):
    rows = [("계", "총계", "남자", "19640954"), ("계", "총계", "여자", "15066335"), ("계", "1종", "남자", "1")]
    g = raking.gender_shares(spark.createDataFrame(rows, "ITM_NM string, C1_NM string, C2_NM string, DT string"))
    got = {r.level: r.share for r in g.collect()}
    assert got == {"Male": 0.566, "Female": 0.434}
    age_rows = [("계", n, "총계", str(v)) for n, v in
                [("20세 미만", 10), ("25세", 333), ("35세", 333), ("총계", 1000), ("45세", 324), ("xx", 5)]]
    a = raking.age_shares(spark.createDataFrame(age_rows, "ITM_NM string, C1_NM string, C2_NM string, DT string"))
    got = {r.level: r.share for r in a.collect()}
    assert got["<20"] == 0.0 and abs(sum(got.values()) - 1.0) < 1e-9
    with pytest.raises(RuntimeError):
        bad = spark.createDataFrame([(None, None, None, None, "key expired")], S.STAT_ROW)
        raking.read_stat_rows_checked(bad)
