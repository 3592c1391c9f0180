"""FIXTURES.md §4: known values of the fixture at sf0.001 and sf0.01."""
import pytest
from pyspark.sql import functions as F

from riskloom.functions.bands import age_band
from riskloom.operators import clean, metrics, ordered
from riskloom.plans import catalog
from riskloom.sources import fixtures as fx

KNOWN = {
    "/root/testdata/sf0.001": dict(policies=1470, claims=631, sum_nb=535, max_nb=4, sum_exp=754.5,
                                   mism=23, orphans=10, kept=621, with_claims=500,
                                   sev=3098889.9449, pp=21712697.5136, pred=165415.3,
                                   gini=(0.1973963439, 0.4161910395, 0.4742926329), ace=0.9728436949,
                                   balance=0.0271563051, pdev=1.0298734121, cells=42, small_cells=11),
    "/root/testdata/sf0.01": dict(policies=14700, claims=6384, sum_nb=5457, max_nb=4, sum_exp=7542.730137,
                                  mism=216, orphans=132, kept=6252, with_claims=5097,
                                  sev=31731583.9057, pp=210727982.0335, pred=1672277.03,
                                  gini=(0.193153549, 0.4092505553, 0.4719689356), ace=0.9731951938,
                                  balance=0.0268048062, pdev=1.034240708, cells=42, small_cells=0),
}


@pytest.mark.parametrize("sf", sorted(KNOWN))
def test_fixture_known_values(spark, sf):
    k = KNOWN[sf]
    freq, sev = clean.coerce(*catalog.raw_frames(spark, sf))
    c = clean.consistency_report(freq, sev).first()
    assert (c.n_policies, c.n_claim_records) == (k["policies"], k["claims"])
    assert (c.n_mismatched_policies, c.n_orphan_claims) == (k["mism"], k["orphans"])
    raw = fx.policies(spark, sf).agg(F.sum("ClaimNb"), F.max("ClaimNb"), F.sum("Exposure")).first()
    assert (raw[0], raw[1]) == (k["sum_nb"], k["max_nb"])
    assert raw[2] == pytest.approx(k["sum_exp"], abs=1e-6)
    t = catalog.scored_frame(spark, sf).cache()
    s = t.agg(F.sum("sev_count"), F.count_if(F.col("sev_count") > 0), F.sum("sev_total"),
              F.sum("pure_premium"), F.sum("pred")).first()
    assert (s[0], s[1]) == (k["kept"], k["with_claims"])
    assert s[2] == pytest.approx(k["sev"], abs=1e-3)
    assert s[3] == pytest.approx(k["pp"], abs=1e-3)
    assert s[4] == pytest.approx(k["pred"], abs=1e-2)
    g = ordered.gini_parts(t, "pure_premium", "pred", "Exposure")
    assert (g["gini_raw"], g["gini_perfect"], g["gini"]) == pytest.approx(k["gini"], abs=1e-9)
    r = metrics.calibration_report(t, "pure_premium", "pred", "Exposure").first()
    assert r.auto_cal_error == pytest.approx(k["ace"], abs=1e-9)
    assert r.balance == pytest.approx(k["balance"], abs=1e-9)
    d = metrics.poisson_deviance(t.withColumn("mu", 0.4 * F.col("Exposure")), "ClaimNb", "mu", "Exposure")
    assert d.first()[0] == pytest.approx(k["pdev"], abs=1e-8)
    cells = t.groupBy(age_band("DrivAge"), "Area").count()
    assert cells.count() == k["cells"]
    assert cells.filter("count < 30").count() == k["small_cells"]


def test_age_band_shares_sf001(spark):
    t = catalog.training_frame(spark, "/root/testdata/sf0.01")
    n = t.count()
    sh = {r[0]: r[1] / n for r in t.groupBy(age_band("DrivAge")).count().collect()}
    want = {"<20": .028299, "20s": .134218, "30s": .136054, "40s": .139116, "50s": .140068,
            "60s": .13966, "70+": .282585}
    for b, v in want.items():
        assert sh[b] == pytest.approx(v, abs=1e-6)
