"""The diagnosis engine: fit (M15), premium (M13, M14) and diagnosis with
fitted models (X02 + M16)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.functions.columns import average_claim, floor_at
from riskloom.operators import attribution, boosting, clean, features, glm, isotonic, market, ordered, report
from riskloom.operators.raking import DEFAULT_CONFIG, training_weight
from riskloom.session import beside, cut_lineage
from riskloom.sources.bundle import Engine


def pure_premium(eng: Engine | dict, df: DataFrame, out: str = "raw_premium") -> DataFrame:
    """``max(rate · max(severity, 1e-3), 1e-8)`` — boosted frequency
    rate times the Gamma GLM severity."""
    enc, freq, sev = (eng.encoding, eng.freq, eng.severity) if isinstance(eng, Engine) else \
        (eng["encoding"], eng["freq"], eng["severity"])
    d = boosting.predict_boosted(freq, df, "_rate")
    d = features.design_frame(d, enc, "_glm_x", keep=d.columns)
    m = sev.copy()
    m.set(m.getParam("featuresCol"), "_glm_x")
    d = glm.predict_glm(m, d, "_sev", floor=S.SEVERITY_FLOOR)
    drop = ["_glm_x", "_rate", "_sev"]
    return d.withColumn(out, floor_at(F.col("_rate") * F.col("_sev"), S.PREMIUM_FLOOR)).drop(*drop)


def calibrated_pure_premium(eng: Engine, df: DataFrame, out: str = "premium") -> DataFrame:
    """Isotonic map of M13."""
    d = pure_premium(eng, df, "_raw_pp")
    return isotonic.apply_isotonic(eng.isotonic, d, "_raw_pp", out).drop("_raw_pp")


def fit_engine(df: DataFrame, cfg: dict | None = DEFAULT_CONFIG, seed: int = 42, rounds: int = S.GBM_ROUNDS,
               learning_rate: float = S.GBM_RATE, patience: int | None = S.GBM_PATIENCE, max_depth: int = 5,
               min_rows: int = 100, loading: dict | None = None,
               freq: boosting.BoostedModel | None = None) -> Engine:
    """Bands, frequency GBM with grouped early stopping, Gamma
    severity on claim policies, isotonic on the training rows (weight
    exposure × raking), then the unweighted market (A08 input), cohorts
    (A10) and factor frequencies (A11) — all from ``df`` (a training table).
    ``freq`` reuses an already fitted frequency model (same encoding)."""
    loading = loading if loading is not None else {"expense_ratio": S.EXPENSE_RATIO,
                                                    "profit_margin": S.PROFIT_MARGIN}
    enc = freq.encoding if freq is not None else features.fit_encoding(df)

    def severity():
        claims = clean.claim_policies(df).withColumn("avg_claim", average_claim("sev_total", "sev_count"))
        claims = training_weight(claims, cfg, "fremtpl2", out="_rw")
        return glm.fit_gamma_severity(features.design_frame(claims, enc, keep=["avg_claim", "sev_count", *(
            ["_rw"] if "_rw" in claims.columns else [])]), weight="_rw" if "_rw" in claims.columns else None)

    with beside(df.sparkSession, severity) as severity_fit:
        if freq is None:
            tr2, val = ordered.early_stopping_split(df, seed=seed)
            tr2 = training_weight(tr2, cfg, "fremtpl2", out="_rw")
            val = training_weight(val, cfg, "fremtpl2", out="_rw")
            wcol = "_rw" if "_rw" in tr2.columns else None
            freq = boosting.fit_boosted(tr2, enc, S.CLAIM_NB, S.EXPOSURE, wcol, "poisson", rounds=rounds,
                                        learning_rate=learning_rate, max_depth=max_depth, min_rows=min_rows,
                                        valid=val, patience=patience, seed=seed, row_fraction=S.GBM_ROW_FRACTION,
                                        feature_fraction=S.GBM_FEATURE_FRACTION)
    sev = severity_fit.result()
    part = {"encoding": enc, "freq": freq, "severity": sev}
    scored = cut_lineage(pure_premium(part, df, "_raw_pp"))       # scored once, for isotonic and market
    weighted = training_weight(scored, cfg, "fremtpl2", base_weight=S.EXPOSURE, out="_iso_w")
    iso = isotonic.fit_isotonic(weighted, "_raw_pp", "pure_premium", "_iso_w" if "_iso_w" in weighted.columns
                                else S.EXPOSURE)
    eng = Engine(enc, freq, sev, iso, None, None, None, loading)
    mk = cut_lineage(isotonic.apply_isotonic(iso, scored, "_raw_pp", "premium").select(S.ID, "DrivAge", "Area", "premium"))
    eng.market = mk.select(S.ID, "premium")
    eng.cohorts = cut_lineage(market.cohort_stats(mk, "premium"))
    eng.factors = cut_lineage(market.factor_frequency(df))
    return eng


def diagnose_with_engine(eng: Engine, rows: DataFrame, with_drivers: bool = True,
                         id_col: str = S.ID, market_index=None) -> DataFrame:
    """X02 with fitted models for a whole table of policies/quotes:
    calibrated premium (M14) → drivers (M16/K04) → report (X01) → cohort
    (D05) → bands."""
    scored = calibrated_pure_premium(eng, rows)
    drivers_col = None
    if with_drivers and eng.freq.trees:
        carried = scored.columns
        scored = attribution.attributions(eng.freq, scored, id_col, keep=carried).select(*carried, "drivers")
        scored = cut_lineage(scored)          # every tree for every row once: the report reads it several times
        drivers_col = "drivers"
    return report.diagnose(scored, eng.market, eng.cohorts, "premium", "premium", id_col,
                           eng.loading, drivers_col, market_index=market_index)
