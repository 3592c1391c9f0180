"""Registered queries: each takes ``(spark, sf_dir)`` and returns a
DataFrame computed from the driver's tables (through the fixture frames).

Doubles are rounded to 6 dp at the end (sums are order-dependent in the
last digits); counts are BIGINT.  Column names equal the oracle SQL's."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.functions import bands
from riskloom.functions.columns import (average_claim, clamp_percentile, count_from_rate, floor_at, rate_from_count,
                                        round_dp)
from riskloom.operators import (attribution, boosting, clean, features, glm, isotonic, market, metrics,
                                ordered, raking, report)
from riskloom.plans import engine, runs
from riskloom.session import cut_lineage, ensure_checkpoint_dir
from riskloom.streaming import quotes as quotes_stream
from riskloom.sources import bundle
from riskloom.sources import fixtures as fx
from riskloom.sources import tables


def r6(c):
    return round_dp(c, 6)


def raw_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Policy and claim frames as they arrive (before coercion)."""
    return fx.policies(spark, sf_dir), fx.claims(spark, sf_dir)


def training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A03 over the fixture: coerce (P01/P02) → preprocess."""
    freq, sev = clean.coerce(*raw_frames(spark, sf_dir))
    return clean.preprocess(freq, sev)


def policy_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy side of the training table: coerced and capped, no claims
    attached (for queries that never look at claims)."""
    freq, _ = clean.coerce(*raw_frames(spark, sf_dir))
    return clean.cap_policies(freq)


def premium_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies with the analytic premium (the market for steps that must
    not depend on a fitted model)."""
    return fx.policies(spark, sf_dir).withColumn("premium", fx.analytic_premium_col())


# ----------------------------------------------------------------- queries

def q_training_table(spark, sf_dir):
    t = training_frame(spark, sf_dir)
    return t.select("IDpol", "ClaimNb", "Exposure", "VehPower", "VehAge", "DrivAge", "BonusMalus",
                    "Density", "VehBrand", "VehGas", "Area", "Region", r6("sev_total").alias("sev_total"),
                    "sev_count", r6("pure_premium").alias("pure_premium"))


def q_factor_frequency(spark, sf_dir):
    return market.factor_frequency(policy_frame(spark, sf_dir))


def q_severity_aggregate(spark, sf_dir):
    _, sev = clean.coerce(*raw_frames(spark, sf_dir))
    a = clean.aggregate_severity(sev)
    return a.select("IDpol", r6("sev_total").alias("sev_total"), F.col("sev_count").cast("long"))


def q_consistency_report(spark, sf_dir):
    freq, sev = clean.coerce(*raw_frames(spark, sf_dir))
    return clean.consistency_report(freq, sev)


def q_orphan_claims(spark, sf_dir):
    freq, sev = clean.coerce(*raw_frames(spark, sf_dir))
    o = clean.orphan_claims(freq, sev)
    return o.select("IDpol", "claim_no", r6("ClaimAmount").alias("ClaimAmount"), r6("qty").alias("qty"))


def q_nominal_clean(spark, sf_dir):
    freq, _ = clean.coerce(*raw_frames(spark, sf_dir))
    return freq.select("IDpol", "ClaimNb", r6("Exposure").alias("Exposure"),
                       "VehBrand", "VehGas", "Area", "Region")


#: Column order of the public policy file (not the order of the schema).
CSV_ORDER = ["IDpol", "ClaimNb", "Exposure", "Area", "VehPower", "VehAge", "DrivAge", "BonusMalus", "VehBrand",
             "VehGas", "Density", "Region"]


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _csv_frames(spark, sf_dir, policy_columns):
    """The fixture tables written as header CSV and read back."""
    base = _scratch(spark, "csv")
    pol, clm = raw_frames(spark, sf_dir)
    pol.select(*policy_columns).write.option("header", True).csv(f"{base}/policy.csv")
    clm.select("ClaimAmount", "IDpol").write.option("header", True).csv(f"{base}/claim.csv")
    return tables.load_raw(spark, f"{base}/policy.csv", f"{base}/claim.csv")


def q_csv_policy_scan(spark, sf_dir):
    """S01–S03 + P01/P02: header CSV in the public file's column order, read
    by name with the raw types (numbers that may hold junk as strings), then
    coerced and quote-stripped."""
    freq, _ = clean.coerce(*_csv_frames(spark, sf_dir, CSV_ORDER))
    return freq.select("IDpol", "ClaimNb", r6("Exposure").alias("Exposure"),
                       "VehPower", "VehAge", "DrivAge", "BonusMalus", "VehBrand", "VehGas", "Area", "Region")


def q_csv_claim_scan(spark, sf_dir):
    """S02 + P01: the claim file, its columns in another order than declared."""
    _, sev = clean.coerce(*_csv_frames(spark, sf_dir, CSV_ORDER))
    return sev.groupBy("IDpol").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("ClaimAmount")).alias("amount"))


def q_csv_missing_id(spark, sf_dir):
    """A policy file without ids gets the row numbers 0..n-1; the other
    columns stay in place (sums over all rows)."""
    freq, _ = _csv_frames(spark, sf_dir, [c for c in CSV_ORDER if c != "IDpol"])
    return freq.agg(F.count(F.lit(1)).alias("n"), F.min("IDpol").alias("first_id"), F.max("IDpol").alias("last_id"),
                    F.count_distinct("IDpol").alias("n_ids"), F.sum("VehPower").alias("power"),
                    F.sum("DrivAge").alias("age"), F.sum("BonusMalus").alias("bonus"))


def malformed_quote_lines(quotes: DataFrame) -> DataFrame:
    """The fixture's quotes as JSON lines, some of them spoilt: words and
    fractions for whole numbers, whole numbers as text, no id, no JSON."""
    kind = F.col("IDpol") % 7
    fields = [F.col(c) for c in quotes.columns if c not in ("IDpol", "DrivAge", "VehPower")]
    ident = F.when(kind != 4, F.col("IDpol")).alias("IDpol")
    age = F.when(kind == 1, F.lit("abc")).when(kind == 2, F.concat(F.col("DrivAge").cast("string"), F.lit(".7"))).otherwise(
        F.col("DrivAge").cast("string")).alias("DrivAge")
    power = F.col("VehPower").alias("VehPower")
    line = F.to_json(F.struct(ident, age, power, *fields))
    return quotes.select(F.when(kind == 3, F.concat(F.lit("not json "), F.col("IDpol").cast("string")))
                         .otherwise(line).alias("value"))


def _reason_counts(bad: DataFrame, valid: DataFrame) -> DataFrame:
    return (bad.groupBy(F.concat_ws(",", "reasons").alias("reasons")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("IDpol"), F.lit(0)).alias("ids"))
        .unionByName(valid.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("IDpol"), F.lit(0)).alias("ids"))
                     .withColumn("reasons", F.lit("valid"))))


def q_malformed_quotes(spark, sf_dir):
    """S06 + F03: malformed JSON lines are quarantined with their reasons."""
    base = _scratch(spark, "quotes")
    malformed_quote_lines(fx.quotes(fx.policies(spark, sf_dir))).write.text(base)
    valid, bad = clean.validate_quotes(tables.read_quotes(spark, base))
    return _reason_counts(bad, valid)


def q_malformed_quote_stream(spark, sf_dir):
    """T01 over the same malformed lines: the stream's quarantine and valid
    output add up to the batch's."""
    base = _scratch(spark, "quote-stream")
    malformed_quote_lines(fx.quotes(fx.policies(spark, sf_dir))).repartition(3).write.text(f"{base}/in")
    pf = premium_frame(spark, sf_dir).select("IDpol", "premium")
    query = quotes_stream.start_quote_stream(
        spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", cut_lineage(pf), None,
        lambda d: d.withColumn("premium", fx.analytic_premium_col()))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return _reason_counts(quotes_stream.read_stream_output(spark, f"{base}/out", "quarantine"),
                          quotes_stream.read_stream_output(spark, f"{base}/out"))


def q_factor_bands(spark, sf_dir):
    t = policy_frame(spark, sf_dir)
    return t.select("IDpol", *bands.factor_bands(prefix="band_"))


def q_quote_validation(spark, sf_dir):
    q = fx.quotes(fx.policies(spark, sf_dir))
    checked = clean.quote_reasons(clean.apply_quote_defaults(q))
    return checked.select("IDpol", "DrivAge", "BonusMalus",
                          (F.size("reasons") == 0).alias("valid"),
                          F.concat_ws(",", "reasons").alias("reasons"))


def q_market_summary(spark, sf_dir):
    return market.market_summary(premium_frame(spark, sf_dir), "premium")


def q_market_histogram(spark, sf_dir):
    return market.market_histogram(premium_frame(spark, sf_dir), "premium", bins=30)


def q_cohort_stats(spark, sf_dir):
    return market.cohort_stats(premium_frame(spark, sf_dir), "premium")


def _cohorts(spark, sf_dir, min_count):
    pf = premium_frame(spark, sf_dir)
    return market.cohort_lookup(pf, market.cohort_stats(pf, "premium"), min_count=min_count)


def q_cohort_lookup(spark, sf_dir):
    c = _cohorts(spark, sf_dir, 30)
    return c.select("IDpol", "cohort_group", "cohort_level", F.col("cohort_count").cast("long"),
                    "cohort_mean", "cohort_median")


def q_cohort_fallback(spark, sf_dir):
    """D05 with a minimum large enough that cells fall back to bands/overall."""
    c = _cohorts(spark, sf_dir, 400)
    return c.select("IDpol", "cohort_group", "cohort_level", F.col("cohort_count").cast("long"),
                    "cohort_mean", "cohort_median")


def q_market_position(spark, sf_dir):
    pf = premium_frame(spark, sf_dir)
    stats = market.cohort_stats(pf, "premium")
    c = market.cohort_premium_ratio(market.cohort_lookup(pf, stats), "premium")
    pos = market.market_position(c, pf, "premium", "premium", bins=30)
    return pos.select("IDpol", "market_bin", "cohort_level", r6("median_ratio").alias("median_ratio"))


def q_risk_percentile(spark, sf_dir):
    pf = premium_frame(spark, sf_dir)
    r = ordered.risk_percentile(pf.select("IDpol", "premium"), pf, "premium", "premium")
    return r.select("IDpol", r6("risk_percentile").alias("risk_percentile"))


def scored_frame(spark, sf_dir):
    """Training table with the analytic premium as prediction."""
    return training_frame(spark, sf_dir).withColumn("pred", fx.analytic_premium_col())


def q_balance_ratio(spark, sf_dir):
    b = metrics.balance_ratio(scored_frame(spark, sf_dir), "pure_premium", "pred", "Exposure")
    return b.select(r6("balance").alias("balance"))


def q_poisson_deviance(spark, sf_dir):
    s = scored_frame(spark, sf_dir).withColumn("mu", 0.4 * F.col("Exposure"))
    d = metrics.poisson_deviance(s, "ClaimNb", "mu", "Exposure")
    return d.select(r6("poisson_deviance").alias("poisson_deviance"))


def q_gamma_deviance(spark, sf_dir):
    s = clean.claim_policies(scored_frame(spark, sf_dir)).withColumn(
        "avg_claim", average_claim("sev_total", "sev_count"))
    d = metrics.gamma_deviance(s, "avg_claim", "pred", "sev_count")
    return d.select(r6("gamma_deviance").alias("gamma_deviance"))


def q_tweedie_deviance(spark, sf_dir):
    s = scored_frame(spark, sf_dir)
    d = metrics.tweedie_deviance(s, "pure_premium", "pred", "Exposure", power=1.7)
    return d.select(r6("tweedie_deviance").alias("tweedie_deviance"))


def q_normalized_gini(spark, sf_dir):
    g = ordered.normalized_gini(scored_frame(spark, sf_dir), "pure_premium", "pred", "Exposure")
    return g.select(*[r6(c).alias(c) for c in g.columns])


def q_calibration_bins(spark, sf_dir):
    b = metrics.calibration_bins(scored_frame(spark, sf_dir), "pure_premium", "pred", "Exposure")
    return b.select("bin", F.col("n").cast("long"), r6("w_sum").alias("w_sum"),
                    r6("actual").alias("actual"), r6("predicted").alias("predicted"))


def q_auto_calibration(spark, sf_dir):
    r = metrics.calibration_report(scored_frame(spark, sf_dir), "pure_premium", "pred", "Exposure")
    return r.select(r6("balance").alias("balance"), r6("auto_cal_error").alias("auto_cal_error"))


def q_grouped_split(spark, sf_dir):
    return ordered.split_label(policy_frame(spark, sf_dir)).select("IDpol", "split")


def q_grouped_kfold(spark, sf_dir):
    return ordered.group_kfold(policy_frame(spark, sf_dir)).select("IDpol", "fold")


def q_grouped_kfold_claims(spark, sf_dir):
    """W05 over the claims: policies with several claims stay whole, folds are
    balanced by claims."""
    claims = fx.claims(spark, sf_dir)
    folds = ordered.group_kfold(claims, n_folds=3)
    return folds.groupBy("IDpol").agg(F.max("fold").alias("fold"), F.count(F.lit(1)).alias("n_claims"))


def q_early_stopping_split(spark, sf_dir):
    train, _ = ordered.grouped_split(policy_frame(spark, sf_dir))
    tr2, val = ordered.early_stopping_split(train)
    return (tr2.select("IDpol", F.lit("fit").alias("part"))
               .unionByName(val.select("IDpol", F.lit("validation").alias("part"))))


def q_seeded_sample(spark, sf_dir):
    return ordered.seeded_sample(policy_frame(spark, sf_dir), 1000).select("IDpol", "ClaimNb")


def valid_quotes(spark, sf_dir):
    """F04 → F03 over the fixture quotes; valid rows with their premium."""
    q = fx.quotes(fx.policies(spark, sf_dir))
    valid, _ = clean.validate_quotes(q)
    return valid.withColumn("premium", fx.analytic_premium_col())


def q_gross_premium_tiers(spark, sf_dir):
    """X01 for every valid quote against the policy market."""
    rep = report.build_report(valid_quotes(spark, sf_dir), premium_frame(spark, sf_dir),
                              loading={"expense_ratio": 0.25, "profit_margin": 0.05})
    return report.flatten_report(rep)


def q_diagnosis_report(spark, sf_dir):
    """X02 for every valid quote: report + cohort + bands."""
    pf = premium_frame(spark, sf_dir)
    cohorts = market.cohort_stats(pf, "premium")
    rep = report.diagnose(valid_quotes(spark, sf_dir), pf, cohorts,
                          loading={"expense_ratio": 0.25, "profit_margin": 0.05})
    return report.flatten_report(rep)


def stat_frames(spark, sf_dir):
    return fx.statistics_rows(fx.policies(spark, sf_dir))


def q_license_gender_margin(spark, sf_dir):
    return raking.gender_shares(stat_frames(spark, sf_dir)["license_gender"])


def q_license_age_margin(spark, sf_dir):
    return raking.age_shares(stat_frames(spark, sf_dir)["license_age"])


def q_vehicle_margin(spark, sf_dir):
    return raking.vehicle_shares(stat_frames(spark, sf_dir)["vehicle"])


def q_all_margins(spark, sf_dir):
    st = stat_frames(spark, sf_dir)
    return raking.all_margins(st["license_gender"], st["license_age"], st["vehicle"])


def q_post_stratify(spark, sf_dir):
    """Driver-age raking of the training table from the config."""
    w = raking.rake_from_config(policy_frame(spark, sf_dir), raking.DEFAULT_CONFIG, "fremtpl2")
    return w.select("IDpol", r6("rake_weight").alias("rake_weight"))


def q_rake_mapped_gender(spark, sf_dir):
    """G02 + P16: letters mapped to the levels of the gender target."""
    t = fx.policies(spark, sf_dir).select("IDpol", F.when(F.col("VehPower") % 2 == 0, "M").otherwise("F").alias("Gender"))
    w = raking.rake_from_config(t, raking.DEFAULT_CONFIG, "ausprivauto")
    return w.select("IDpol", "Gender", r6("rake_weight").alias("rake_weight"))


def q_rake_two_margins(spark, sf_dir):
    """G01 with two margins at once (sex and driver-age band, the config's
    targets), iterated to convergence: sex follows the statistics rows' rule
    (VehPower even -> Male)."""
    t = policy_frame(spark, sf_dir).withColumns({
        "Gender": F.when(F.col("VehPower") % 2 == 0, "Male").otherwise("Female"),
        "AgeBand": bands.age_band("DrivAge")})
    w = raking.rake(t, {"Gender": raking.S.GENDER_TARGET, "AgeBand": raking.S.DRIVAGE_TARGET}, tol=1e-12)
    return w.select("IDpol", "Gender", "AgeBand", r6("rake_weight").alias("rake_weight"))


def q_weight_summary(spark, sf_dir):
    """G04 + A18: raking weights re-raked on the training split."""
    train, _ = ordered.grouped_split(policy_frame(spark, sf_dir))
    w = raking.training_weight(train, raking.DEFAULT_CONFIG, "fremtpl2")
    s = metrics.weight_summary(w, "weight")
    return s.select(*[r6(c).alias(c) for c in s.columns])


def q_design_matrix(spark, sf_dir):
    """GLM design columns of every training row (levels learnt)."""
    t = policy_frame(spark, sf_dir)
    enc = features.fit_encoding(t)
    d = features.design_columns(t, enc, keep=["IDpol"])
    return d.withColumn("Density", r6("Density"))


def q_poisson_glm_one_factor(spark, sf_dir):
    """M04/M06 with Area as the only factor: fitted claim rate per level."""
    t = cut_lineage(policy_frame(spark, sf_dir))
    enc = features.fit_encoding(t, ["Area"], [])
    model = glm.fit_poisson_frequency(features.design_frame(t, enc, keep=["ClaimNb", "Exposure"]))
    lv = features.design_frame(t.select("Area").distinct(), enc, keep=["Area"])
    return glm.predict_glm(model, lv, "rate").select("Area", r6("rate").alias("rate"))


def q_gamma_glm_one_factor(spark, sf_dir):
    """M05/M06 with Area as the only factor: fitted mean severity per level."""
    t = training_frame(spark, sf_dir)
    c = clean.claim_policies(t).withColumn("avg_claim", average_claim("sev_total", "sev_count"))
    c = cut_lineage(c)
    enc = features.fit_encoding(c, ["Area"], [])
    model = glm.fit_gamma_severity(features.design_frame(c, enc, keep=["avg_claim", "sev_count"]))
    lv = features.design_frame(c.select("Area").distinct(), enc, keep=["Area"])
    return glm.predict_glm(model, lv, "severity").select("Area", r6("severity").alias("severity"))


def q_isotonic_binned(spark, sf_dir):
    """M11/M12 on the ten rank bins of the analytic premium."""
    b = metrics.calibration_bins(scored_frame(spark, sf_dir), "pure_premium", "pred", "Exposure")
    b = cut_lineage(b)
    model = isotonic.fit_isotonic(b, "predicted", "actual", "w_sum")
    return isotonic.apply_isotonic(model, b, "predicted", "fitted").select("bin", r6("fitted").alias("fitted"))


def q_calibrated_premium(spark, sf_dir):
    """M11/M12 on every policy: isotonic map of the analytic premium to the
    observed pure premium, weight exposure × raking."""
    s = raking.training_weight(scored_frame(spark, sf_dir), raking.DEFAULT_CONFIG, "fremtpl2",
                               base_weight="Exposure")
    s = cut_lineage(s)
    model = isotonic.fit_isotonic(s, "pred", "pure_premium", "weight")
    return isotonic.apply_isotonic(model, s, "pred", "calibrated").select(
        "IDpol", r6("pred").alias("pred"), round_dp("calibrated", 4).alias("calibrated"))


def q_own_bands(spark, sf_dir):
    """Each valid quote's band per factor with the market frequency of
    that band (the band the report highlights)."""
    freq = market.factor_frequency(policy_frame(spark, sf_dir))
    ob = market.own_bands(valid_quotes(spark, sf_dir), freq)
    return ob.select("IDpol", "feature", "band", "ord", "n", "frequency")


def q_baseline_metrics(spark, sf_dir):
    """GLM baseline run on the fixture; metric table (S10 rows)."""
    freq, sev = raw_frames(spark, sf_dir)
    return runs.baseline_run(freq, sev)


# ------------------------------------------------- fitted models (rows-only)

#: Share of rows and features that every round draws.
SAMPLING = {"row_fraction": S.GBM_ROW_FRACTION, "feature_fraction": S.GBM_FEATURE_FRACTION}


def _split_encoded(spark, sf_dir):
    t = cut_lineage(training_frame(spark, sf_dir))
    enc = features.fit_encoding(t)
    tr, te = ordered.grouped_split(t)
    return t, enc, tr, te


def _poisson_gbm(spark, sf_dir):
    """The Poisson GBM of the fixture and the test policies."""
    t, enc, tr, te = _split_encoded(spark, sf_dir)
    tr2, val = ordered.early_stopping_split(tr)
    tr2 = raking.training_weight(tr2, raking.DEFAULT_CONFIG, "fremtpl2", out="rw")
    val = raking.training_weight(val, raking.DEFAULT_CONFIG, "fremtpl2", out="rw")
    m = boosting.fit_boosted(tr2, enc, "ClaimNb", "Exposure", "rw", "poisson", rounds=S.GBM_ROUNDS,
                             learning_rate=S.GBM_RATE, valid=val, patience=S.GBM_PATIENCE, **SAMPLING)
    return m, te


def q_poisson_gbm(spark, sf_dir):
    """Poisson GBM with grouped early stopping; test predictions."""
    m, te = _poisson_gbm(spark, sf_dir)
    p = boosting.predict_boosted(m, te, "rate")
    return p.select("IDpol", r6("rate").alias("rate"), r6(F.col("rate") * F.col("Exposure")).alias("count"))


def q_tweedie_gbm(spark, sf_dir):
    """Tweedie(1.7) GBM on pure premium, weight exposure × raking."""
    t, enc, tr, te = _split_encoded(spark, sf_dir)
    tr = raking.training_weight(tr, raking.DEFAULT_CONFIG, "fremtpl2", base_weight="Exposure", out="tw")
    m = boosting.fit_boosted(tr, enc, "pure_premium", None, "tw", "tweedie", 1.7, rounds=S.TWEEDIE_ROUNDS,
                             learning_rate=S.GBM_RATE, **SAMPLING)
    p = boosting.predict_boosted(m, te, "pred").withColumn("pred", floor_at("pred", 1e-6))
    return p.select("IDpol", r6("pred").alias("pure_premium_pred"))


def q_tweedie_power_search(spark, sf_dir):
    """M10 + A19 + K06: mean validation Gini per power, best power flagged."""
    t, enc, tr, te = _split_encoded(spark, sf_dir)
    tr = raking.training_weight(tr, raking.DEFAULT_CONFIG, "fremtpl2", out="rw")
    best, means = runs.tweedie_power_search(tr, enc, n_folds=S.SEARCH_FOLDS, weight="rw", rounds=S.SEARCH_ROUNDS,
                                            learning_rate=S.GBM_RATE)
    return means.select("power", r6("mean_score").alias("mean_gini"),
                        (F.col("power") == F.lit(best)).alias("is_best"))


def q_policy_drivers(spark, sf_dir):
    """M16 + K04: top-3 signed attributions of the Poisson GBM per test policy."""
    m, te = _poisson_gbm(spark, sf_dir)
    a = attribution.attributions(m, te)
    cols = []
    for i in range(3):
        cols += [F.col("drivers")[i]["feature"].alias(f"driver{i + 1}"),
                 F.col("drivers")[i]["effect"].alias(f"effect{i + 1}")]
    return a.select("IDpol", r6("base").alias("base"), r6("raw").alias("raw"), *cols)


def q_top_factors(spark, sf_dir):
    """Mean |attribution| per feature over the test policies, top 8."""
    m, te = _poisson_gbm(spark, sf_dir)
    f = attribution.top_factors(attribution.attributions(m, te), 8)
    return f.select("feature", r6("mean_abs_effect").alias("mean_abs_effect"))


def q_engine_diagnosis(spark, sf_dir):
    """M15 → X02 with fitted models for every test policy (with drivers)."""
    t, enc, tr, te = _split_encoded(spark, sf_dir)
    m, _ = _poisson_gbm(spark, sf_dir)
    eng = engine.fit_engine(tr, freq=m)
    rep = engine.diagnose_with_engine(eng, te)
    return report.flatten_report(rep, extra=[F.col("drivers")[0]["feature"].alias("driver1")])


def q_stat_rows_scan(spark, sf_dir):
    """The statistics rows as one JSON list per table, read back."""
    out = None
    for name, rows in stat_frames(spark, sf_dir).items():
        path = _scratch(spark, f"stat-{name}")
        listed = rows.agg(F.to_json(F.collect_list(F.struct("ITM_NM", "C1_NM", "C2_NM", "DT"))))   # a row per published cell
        listed.coalesce(1).write.text(path)
        read = tables.read_stat_rows(spark, path).select(F.lit(name).alias("source"), "ITM_NM", "C1_NM", "C2_NM", "DT")
        out = read if out is None else out.unionByName(read)
    return out


def q_report_json(spark, sf_dir):
    """The reports as JSON lines, read back."""
    pf = premium_frame(spark, sf_dir)
    rep = report.diagnose(valid_quotes(spark, sf_dir), pf, market.cohort_stats(pf, "premium"),
                          loading={"expense_ratio": 0.25, "profit_margin": 0.05})
    path = _scratch(spark, "reports")
    tables.write_reports(rep, path)
    return report.flatten_report(spark.read.schema(rep.schema).json(path))


def q_prediction_scale(spark, sf_dir):
    """Claims per year of exposure, counts back from the rate, and the
    floors of predictions."""
    t = training_frame(spark, sf_dir).withColumn("rate", rate_from_count("ClaimNb", "Exposure"))
    return t.select("IDpol", r6("rate").alias("rate"), r6(count_from_rate("rate", "Exposure")).alias("count"),
                    floor_at(count_from_rate("rate", "Exposure"), S.COUNT_FLOOR).alias("floored_count"),
                    r6(floor_at("sev_total", S.SEVERITY_FLOOR)).alias("floored_severity"),
                    r6(floor_at("pure_premium", S.TWEEDIE_FLOOR)).alias("floored_premium"))


def q_percentile_clamp(spark, sf_dir):
    """P25 on positions that leave the scale, are missing or not a number."""
    place = (F.when(F.col("IDpol") % 11 == 0, F.lit(float("nan"))).when(F.col("IDpol") % 13 == 0, F.lit(None))
             .otherwise((F.col("BonusMalus") - 60) * 2.5))
    return fx.policies(spark, sf_dir).select("IDpol", clamp_percentile(place).alias("percentile"))


def q_rake_identity_margin(spark, sf_dir):
    """G01 with P17 and F08: the area itself as a margin; a margin without a
    target and one without its column are skipped."""
    t = policy_frame(spark, sf_dir).withColumn("zone", bands.transformed("identity", "Area", {}))
    target = {"A": 0.1, "B": 0.1, "C": 0.3, "D": 0.2, "E": 0.2, "F": 0.1}
    w = raking.rake(t, {"zone": target, "VehGas": {}, "absent": {"x": 1.0}})
    return w.select("IDpol", "zone", r6("rake_weight").alias("rake_weight"))


def q_metric_comparison(spark, sf_dir):
    """U02 over S10 rows: two models' metric rows side by side."""
    s = scored_frame(spark, sf_dir).withColumn("flat", F.lit(250.0))
    rows = None
    for model, p in (("analytic", "pred"), ("constant", "flat")):
        found = metrics.calibration_report(s, "pure_premium", p, "Exposure").first().asDict()
        found["mean_prediction"] = s.agg(F.avg(p)).first()[0]
        part = tables.metric_rows(spark, "comparison", model, found)
        rows = part if rows is None else rows.unionByName(part)
    return rows.where("metric <> 'auto_cal_error'").groupBy("metric").pivot("model", ["analytic", "constant"]).agg(
        r6(F.first("value"))).select("metric", "analytic", "constant")


def _stored_engine(spark, sf_dir):
    """The engine of the training policies as a bundle in the shared folder."""
    tr, te = ordered.grouped_split(cut_lineage(training_frame(spark, sf_dir)))
    path = _scratch(spark, "bundle")
    bundle.save_engine(engine.fit_engine(tr), path)
    return path, te


def q_bundle_diagnosis(spark, sf_dir):
    """S07 → S08 → X02: the engine is fitted, saved, read back and diagnoses
    every test policy."""
    path, te = _stored_engine(spark, sf_dir)
    rep = engine.diagnose_with_engine(bundle.load_engine(spark, path), te)
    return report.flatten_report(rep, extra=[F.col("drivers")[0]["feature"].alias("driver1")])


def _quote_files(spark, sf_dir, path) -> int:
    """All quotes as JSON files, written by as many tasks as the session runs
    at once; returns the files of a quarter of them."""
    at_once = max(1, spark.sparkContext.defaultParallelism // 4)
    fx.quotes(fx.policies(spark, sf_dir)).repartition(4 * at_once, "IDpol").write.json(path)
    return at_once


def q_bundle_stream_diagnosis(spark, sf_dir):
    """T01 with the fitted engine of a bundle: all quotes as a stream of files."""
    path, _ = _stored_engine(spark, sf_dir)
    base = _scratch(spark, "bundle-stream")
    at_once = _quote_files(spark, sf_dir, f"{base}/in")
    query = quotes_stream.start_bundle_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", path, at_once)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    out = quotes_stream.read_stream_output(spark, f"{base}/out")
    return report.flatten_report(out, extra=["engine_version"])


def q_boosting_metrics(spark, sf_dir):
    """GLM, boosted and Tweedie models with power search; metric table."""
    return runs.boosting_run(*raw_frames(spark, sf_dir))


def q_evaluation_metrics(spark, sf_dir):
    """Gini, balance and auto-calibration before and after isotonic; the
    global top factors are rows of model ``top_factors``."""
    rows, factors = runs.evaluation_run(*raw_frames(spark, sf_dir))
    return rows.unionByName(factors.select(
        F.lit("evaluation").alias("run"), F.lit("top_factors").alias("model"), F.col("feature").alias("metric"),
        F.col("mean_abs_effect").alias("value")))


def q_diagnosis_examples(spark, sf_dir):
    """Engine fit, bundle, reports of five example test policies."""
    rep, _ = runs.diagnosis_run(*raw_frames(spark, sf_dir), _scratch(spark, "diagnosis-run"))
    return report.flatten_report(rep, extra=[F.col("drivers")[0]["feature"].alias("driver1")])


def q_stream_diagnosis(spark, sf_dir):
    """Quotes written as JSON files, read as a stream (a quarter of the
    files per trigger), diagnosed per micro-batch against the policy market."""
    base = _scratch(spark, "stream")
    at_once = _quote_files(spark, sf_dir, f"{base}/in")
    pf = premium_frame(spark, sf_dir)
    cohorts = cut_lineage(market.cohort_stats(pf, "premium"))
    mk = cut_lineage(pf.select("IDpol", "premium"))
    query = quotes_stream.start_quote_stream(
        spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", mk, cohorts,
        lambda d: d.withColumn("premium", fx.analytic_premium_col()),
        {"expense_ratio": 0.25, "profit_margin": 0.05}, at_once)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    out = quotes_stream.read_stream_output(spark, f"{base}/out")
    return report.flatten_report(out)


QUERIES = {
    "training_table": q_training_table,
    "factor_frequency": q_factor_frequency,
    "severity_aggregate": q_severity_aggregate,
    "consistency_report": q_consistency_report,
    "orphan_claims": q_orphan_claims,
    "nominal_clean": q_nominal_clean,
    "csv_policy_scan": q_csv_policy_scan,
    "csv_claim_scan": q_csv_claim_scan,
    "csv_missing_id": q_csv_missing_id,
    "malformed_quotes": q_malformed_quotes,
    "malformed_quote_stream": q_malformed_quote_stream,
    "rake_mapped_gender": q_rake_mapped_gender,
    "factor_bands": q_factor_bands,
    "quote_validation": q_quote_validation,
    "market_summary": q_market_summary,
    "market_histogram": q_market_histogram,
    "cohort_stats": q_cohort_stats,
    "cohort_lookup": q_cohort_lookup,
    "cohort_fallback": q_cohort_fallback,
    "market_position": q_market_position,
    "risk_percentile": q_risk_percentile,
    "balance_ratio": q_balance_ratio,
    "poisson_deviance": q_poisson_deviance,
    "gamma_deviance": q_gamma_deviance,
    "tweedie_deviance": q_tweedie_deviance,
    "normalized_gini": q_normalized_gini,
    "calibration_bins": q_calibration_bins,
    "auto_calibration": q_auto_calibration,
    "grouped_split": q_grouped_split,
    "grouped_kfold": q_grouped_kfold,
    "early_stopping_split": q_early_stopping_split,
    "seeded_sample": q_seeded_sample,
    "gross_premium_tiers": q_gross_premium_tiers,
    "diagnosis_report": q_diagnosis_report,
    "license_gender_margin": q_license_gender_margin,
    "license_age_margin": q_license_age_margin,
    "vehicle_margin": q_vehicle_margin,
    "all_margins": q_all_margins,
    "post_stratify": q_post_stratify,
    "weight_summary": q_weight_summary,
    "rake_two_margins": q_rake_two_margins,
    "design_matrix": q_design_matrix,
    "poisson_glm_one_factor": q_poisson_glm_one_factor,
    "gamma_glm_one_factor": q_gamma_glm_one_factor,
    "isotonic_binned": q_isotonic_binned,
    "calibrated_premium": q_calibrated_premium,
    "own_bands": q_own_bands,
    "baseline_metrics": q_baseline_metrics,
    "poisson_gbm": q_poisson_gbm,
    "tweedie_gbm": q_tweedie_gbm,
    "tweedie_power_search": q_tweedie_power_search,
    "policy_drivers": q_policy_drivers,
    "top_factors": q_top_factors,
    "engine_diagnosis": q_engine_diagnosis,
    "stream_diagnosis": q_stream_diagnosis,
    "grouped_kfold_claims": q_grouped_kfold_claims,
    "stat_rows_scan": q_stat_rows_scan,
    "report_json": q_report_json,
    "prediction_scale": q_prediction_scale,
    "percentile_clamp": q_percentile_clamp,
    "rake_identity_margin": q_rake_identity_margin,
    "metric_comparison": q_metric_comparison,
    "bundle_diagnosis": q_bundle_diagnosis,
    "bundle_stream_diagnosis": q_bundle_stream_diagnosis,
    "boosting_metrics": q_boosting_metrics,
    "evaluation_metrics": q_evaluation_metrics,
    "diagnosis_examples": q_diagnosis_examples,
}

FLAGSHIP = "diagnosis_report"
