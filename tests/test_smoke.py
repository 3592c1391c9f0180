"""Micro-cases of the cleaning rules, report columns and bands."""
import pytest
from pyspark.sql import functions as F

from riskloom.functions import bands, columns
from riskloom.operators import clean, ordered


def test_consistency_micro_case(spark):
    # 11: two claims stated, two found; 12: two stated, one found; 13: one stated, none; 14: none stated, one found
    freq = spark.createDataFrame([(11, 2.0), (12, 2.0), (13, 1.0), (14, 0.0), (15, None)], "IDpol long, ClaimNb double")
    sev = spark.createDataFrame([(11, 8.0), (11, 3.5), (12, 1.0), (14, 6.0), (40, 2.0), (41, 2.0), (None, 9.0)],
                                "IDpol long, ClaimAmount double")
    r = clean.consistency_report(freq, sev).first().asDict()
    assert r == {"n_policies": 5, "n_claim_records": 7, "n_mismatched_policies": 2, "n_orphan_claims": 3}


def test_severity_aggregate_micro_case(spark):
    sev = spark.createDataFrame([(21, 0.25), (22, None), (21, 4.5), (None, 7.0), (21, None), (23, 31.0)],
                                "IDpol long, ClaimAmount double")
    got = {r["IDpol"]: (r["sev_total"], r["sev_count"]) for r in clean.aggregate_severity(sev).collect()}
    assert got == {21: (4.75, 2), 22: (0.0, 0), 23: (31.0, 1)}


def test_coverage_tier_and_gross_up(spark):
    df = spark.createDataFrame([(29.999,), (30.0,), (52.0,), (69.999,), (70.0,), (100.0,)], "p double")
    tiers = [r[0] for r in df.select(columns.coverage("p")["tier"]).collect()]
    assert tiers == ["low_risk", "standard", "standard", "standard", "high_risk", "high_risk"]
    g = spark.createDataFrame([(330.0,)], "pp double").select(columns.gross_up("pp", 0.3, 0.1)).first()[0]
    assert g == pytest.approx(550.0)
    with pytest.raises(ValueError):
        columns.gross_up("pp", 0.6, 0.4)


def test_quote_strip(spark):
    df = spark.createDataFrame([("'Regular'", '"E"', " 'B12'", "R82")], "VehGas string, Area string, VehBrand string, Region string")
    r = df.select(*[columns.strip_quotes(c).alias(c) for c in df.columns]).first()
    assert (r.VehGas, r.Area, r.VehBrand, r.Region) == ("Regular", "E", "B12", "R82")


def test_gini_by_hand(spark):
    """Four rows, outcomes 3 and 1 at the top of the perfect order: the curve
    0.75, 1, 1, 1 has area 0.71875, the reversed prediction 0, 0, 0.25, 1."""
    df = spark.createDataFrame([(1, 3.0, 1.0), (2, 1.0, 2.0), (3, 0.0, 3.0), (4, 0.0, 4.0)], "IDpol long, y double, p double")
    g = ordered.gini_parts(df, "y", "p")
    assert g["gini_perfect"] == pytest.approx(0.71875 - 0.5) and g["gini_raw"] == pytest.approx(0.1875 - 0.5)
    assert ordered.gini_parts(df, "y", "y")["gini"] == pytest.approx(1.0)


def test_age_bands(spark):
    df = spark.createDataFrame([(a,) for a in [16, 19, 20, 29, 30, 39, 40, 59, 60, 69, 70, 101, None]], "DrivAge int")
    got = [r[0] for r in df.select(bands.age_band("DrivAge")).collect()]
    assert got == ["<20", "<20", "20s", "20s", "30s", "30s", "40s", "50s", "60s", "60s", "70+", "70+", None]


def test_bonus_and_vehage_bands(spark):
    df = spark.createDataFrame([(49, 0), (59, 1), (60, 2), (99, 5), (100, 6), (149, 10), (150, 11), (350, 16), (-1, -1)],
                               "BonusMalus int, VehAge int")
    got = df.select(bands.bonus_band("BonusMalus"), bands.vehage_band("VehAge")).collect()
    assert [r[0] for r in got] == ["50–59", "50–59", "60–79", "80–99", "100–149", "100–149", "150+", "150+", None]
    assert [r[1] for r in got] == ["0–1", "0–1", "2–5", "2–5", "6–10", "6–10", "11–15", "16+", None]


def test_stat_age_band(spark):
    df = spark.createDataFrame([("20세 미만",), ("25~29세",), ("70세 이상",), ("합계",)], "n string")
    assert [r[0] for r in df.select(bands.stat_age_band("n")).collect()] == ["20s", "20s", "70+", None]


def test_quote_validation_defaults_first(spark):
    from riskloom.schema import QUOTE
    q = spark.createDataFrame([(1, None, None, 10, None, None, None, None, None, None),
                               (2, None, None, None, None, None, None, None, None, None),
                               (3, 6, 2, 40, 400, 10, "B1", "'Diesel'", "C", "R24")],
                              "IDpol long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in QUOTE.fields))
    valid, bad = clean.validate_quotes(q)
    assert sorted(r.IDpol for r in valid.collect()) == [2]
    reasons = {r.IDpol: r.reasons for r in bad.collect()}
    assert reasons == {1: ["DrivAge<16"], 3: ["BonusMalus>350"]}
    assert valid.first().VehGas == "Regular" and valid.first().BonusMalus == 50


def test_helper_columns(spark):
    df = spark.createDataFrame([(150.0, 100.0, 0.5, float("nan")), (0.0, 0.0, 2e-7, 120.0), (None, 50.0, None, -3.0)],
                               "pp double, med double, exp double, pct double")
    r = df.select(columns.median_ratio("pp", "med").alias("ratio"),
                  columns.clamp_percentile("pct").alias("clamped"),
                  columns.floor_at("exp", 1e-6).alias("floored"),
                  columns.rate_from_count(F.lit(1.0), "exp").alias("rate"),
                  columns.exposure_offset("exp").alias("off")).collect()
    assert r[0].ratio == 1.5 and r[1].ratio is None and r[2].ratio is None
    assert [x.clamped for x in r] == [0.0, 100.0, 0.0]
    assert r[1].floored == 1e-6 and r[2].floored is None
    assert r[0].rate == 2.0 and r[1].rate == pytest.approx(1e6)
    assert r[1].off == pytest.approx(-13.815510557964274)
    assert columns.weight_product(None, None) is None


def test_round_dp_half_away_from_zero(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.125,), (1.005,)], "x double")
    got = [r[0] for r in df.select(columns.round_dp("x", 0)).collect()]
    assert got == [3.0, -3.0, 0.0, 1.0]
    got2 = [r[0] for r in df.select(columns.round_dp("x", 2)).collect()]
    assert got2[2] == 0.13
