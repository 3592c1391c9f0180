"""Oracle SQL (DuckDB dialect, also mostly valid Spark SQL) for each
registered query.  Every query starts with the fixture CTEs."""
from __future__ import annotations

from riskloom.sources.fixtures import CLAIM_SQL, POLICY_SQL, PREMIUM_SQL, QUOTE_SQL, STAT_SQL

STRIP = "chr(39) || chr(34) || ' '"


def with_fixtures(*ctes: str) -> str:
    return "WITH " + ",\n".join([CLAIM_SQL, POLICY_SQL, PREMIUM_SQL, QUOTE_SQL, STAT_SQL, *ctes]) + "\n"


# Coerced + capped policies, orphan-free claims, severity clip, training table.
TRAINING_CTES = [
    f"""fc AS (
  SELECT IDpol,
         CASE WHEN CAST(ClaimNb AS DOUBLE) > 4 THEN 4e0 ELSE CAST(ClaimNb AS DOUBLE) END AS ClaimNb,
         CASE WHEN Exposure > 1e0 THEN 1e0 ELSE Exposure END AS Exposure,
         VehPower, VehAge, DrivAge, BonusMalus, Density,
         trim(VehBrand, {STRIP}) AS VehBrand, trim(VehGas, {STRIP}) AS VehGas,
         trim(Area, {STRIP}) AS Area, trim(Region, {STRIP}) AS Region
  FROM policy)""",
    """sc AS (SELECT * FROM claim WHERE IDpol IN (SELECT IDpol FROM fc))""",
    """clip AS (SELECT quantile_cont(ClaimAmount, 0.995) AS c FROM sc)""",
    """sagg AS (
  SELECT IDpol, sum(CASE WHEN ClaimAmount > c THEN c ELSE ClaimAmount END) AS sev_total,
         count(ClaimAmount) AS sev_count
  FROM sc CROSS JOIN clip GROUP BY IDpol)""",
    """train AS (
  SELECT fc.*, coalesce(sagg.sev_total, 0e0) AS sev_total,
         CAST(coalesce(sagg.sev_count, 0) AS BIGINT) AS sev_count,
         coalesce(sagg.sev_total, 0e0) / CASE WHEN fc.Exposure < 1e-6 THEN 1e-6 ELSE fc.Exposure END AS pure_premium
  FROM fc LEFT JOIN sagg ON sagg.IDpol = fc.IDpol)""",
]

BAND_CTES = [
    """bands AS (
  SELECT IDpol, ClaimNb, Exposure,
         CASE WHEN DrivAge IS NULL THEN NULL WHEN DrivAge < 20 THEN '<20' WHEN DrivAge < 30 THEN '20s'
              WHEN DrivAge < 40 THEN '30s' WHEN DrivAge < 50 THEN '40s' WHEN DrivAge < 60 THEN '50s'
              WHEN DrivAge < 70 THEN '60s' ELSE '70+' END AS b_DrivAge,
         CASE WHEN BonusMalus >= 0 AND BonusMalus < 60 THEN '50–59' WHEN BonusMalus >= 60 AND BonusMalus < 80 THEN '60–79'
              WHEN BonusMalus >= 80 AND BonusMalus < 100 THEN '80–99' WHEN BonusMalus >= 100 AND BonusMalus < 150 THEN '100–149'
              WHEN BonusMalus >= 150 AND BonusMalus < 1e9 THEN '150+' END AS b_BonusMalus,
         CASE WHEN VehAge >= 0 AND VehAge < 2 THEN '0–1' WHEN VehAge >= 2 AND VehAge < 6 THEN '2–5'
              WHEN VehAge >= 6 AND VehAge < 11 THEN '6–10' WHEN VehAge >= 11 AND VehAge < 16 THEN '11–15'
              WHEN VehAge >= 16 AND VehAge < 1e9 THEN '16+' END AS b_VehAge,
         Area AS b_Area, trim(VehGas, chr(39) || chr(34) || ' ') AS b_VehGas
  FROM train)""",
    """band_order(feature, band, ord, title) AS (VALUES
  ('DrivAge', '<20', 0, '운전자 나이'), ('DrivAge', '20s', 1, '운전자 나이'), ('DrivAge', '30s', 2, '운전자 나이'),
  ('DrivAge', '40s', 3, '운전자 나이'), ('DrivAge', '50s', 4, '운전자 나이'), ('DrivAge', '60s', 5, '운전자 나이'),
  ('DrivAge', '70+', 6, '운전자 나이'),
  ('BonusMalus', '50–59', 0, '할인할증(BonusMalus)'), ('BonusMalus', '60–79', 1, '할인할증(BonusMalus)'),
  ('BonusMalus', '80–99', 2, '할인할증(BonusMalus)'), ('BonusMalus', '100–149', 3, '할인할증(BonusMalus)'),
  ('BonusMalus', '150+', 4, '할인할증(BonusMalus)'),
  ('VehAge', '0–1', 0, '차령'), ('VehAge', '2–5', 1, '차령'), ('VehAge', '6–10', 2, '차령'),
  ('VehAge', '11–15', 3, '차령'), ('VehAge', '16+', 4, '차령'),
  ('Area', 'A', 0, '지역코드'), ('Area', 'B', 1, '지역코드'), ('Area', 'C', 2, '지역코드'),
  ('Area', 'D', 3, '지역코드'), ('Area', 'E', 4, '지역코드'), ('Area', 'F', 5, '지역코드'),
  ('VehGas', 'Diesel', 0, '연료'), ('VehGas', 'Regular', 1, '연료'))""",
    """long_bands AS (
  SELECT 'DrivAge' AS feature, b_DrivAge AS band, ClaimNb, Exposure FROM bands
  UNION ALL SELECT 'BonusMalus', b_BonusMalus, ClaimNb, Exposure FROM bands
  UNION ALL SELECT 'VehAge', b_VehAge, ClaimNb, Exposure FROM bands
  UNION ALL SELECT 'Area', b_Area, ClaimNb, Exposure FROM bands
  UNION ALL SELECT 'VehGas', b_VehGas, ClaimNb, Exposure FROM bands)""",
    """factor_freq AS (
  SELECT o.feature, o.title, o.band, o.ord, CAST(count(*) AS BIGINT) AS n,
         round(sum(coalesce(l.ClaimNb, 0e0)) / sum(CASE WHEN l.Exposure < 1e-6 THEN 1e-6 ELSE l.Exposure END), 4) AS frequency
  FROM long_bands l JOIN band_order o ON o.feature = l.feature AND o.band = l.band
  GROUP BY o.feature, o.title, o.band, o.ord)""",
]

SQL = {
    "training_table": with_fixtures(*TRAINING_CTES) + """
SELECT IDpol, ClaimNb, Exposure, VehPower, VehAge, DrivAge, BonusMalus, Density, VehBrand, VehGas,
       Area, Region, round(sev_total, 6) AS sev_total, sev_count, round(pure_premium, 6) AS pure_premium
FROM train""",
    "factor_frequency": with_fixtures(*TRAINING_CTES, *BAND_CTES) + """
SELECT feature, title, band, ord, n, frequency FROM factor_freq""",
}


def age_band_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} < 20 THEN '<20' WHEN {c} < 30 THEN '20s' "
            f"WHEN {c} < 40 THEN '30s' WHEN {c} < 50 THEN '40s' WHEN {c} < 60 THEN '50s' "
            f"WHEN {c} < 70 THEN '60s' ELSE '70+' END")


def split_hash_sql(c: str, seed: str = "42") -> str:
    return f"(CAST(('0x' || substr(md5(concat('{seed}:', CAST({c} AS VARCHAR))), 1, 8)) AS BIGINT) % 10000)"


UNCAPPED_CTE = f"""fu AS (
  SELECT IDpol, CAST(ClaimNb AS DOUBLE) AS ClaimNb, Exposure, VehPower, VehAge, DrivAge, BonusMalus, Density,
         trim(VehBrand, {STRIP}) AS VehBrand, trim(VehGas, {STRIP}) AS VehGas,
         trim(Area, {STRIP}) AS Area, trim(Region, {STRIP}) AS Region
  FROM policy)"""

MARKET_CTES = [
    """pf AS (SELECT p.*, pr.pred AS premium FROM policy p JOIN premium pr ON pr.IDpol = p.IDpol)""",
    """m AS (SELECT premium AS v FROM pf WHERE isfinite(premium))""",
    f"""cb AS (SELECT IDpol, {age_band_sql('DrivAge')} AS ab, Area AS ar, premium AS pp FROM pf)""",
    """cs AS (
  SELECT 'cell' AS level, ab AS age_band, ar AS area, CAST(count(pp) AS BIGINT) AS count,
         round(avg(pp), 2) AS mean, round(median(pp), 2) AS median
  FROM cb WHERE ab IS NOT NULL AND ar IS NOT NULL GROUP BY ab, ar
  UNION ALL
  SELECT 'age', ab, NULL, CAST(count(pp) AS BIGINT), round(avg(pp), 2), round(median(pp), 2)
  FROM cb WHERE ab IS NOT NULL GROUP BY ab
  UNION ALL
  SELECT 'overall', NULL, NULL, CAST(count(*) AS BIGINT), round(avg(pp), 2), round(median(pp), 2) FROM cb)""",
    """hr0 AS (SELECT min(v) AS lo, max(v) AS mx,
                  CASE WHEN quantile_cont(v, 0.99) <= min(v) THEN min(v) + 1 ELSE quantile_cont(v, 0.99) END AS hi
           FROM m)""",
    """hr AS (SELECT lo, hi FROM hr0)""",
]


def cohort_pick_sql(min_count: int) -> str:
    return f"""coh AS (
  SELECT p.IDpol, p.pp,
    CASE WHEN c.count >= {min_count} THEN p.ab || ' · Area ' || p.ar
         WHEN a.count >= {min_count} THEN p.ab || ' 연령대' ELSE '전체 시장' END AS cohort_group,
    CASE WHEN c.count >= {min_count} THEN 'cell' WHEN a.count >= {min_count} THEN 'age' ELSE 'overall' END AS cohort_level,
    CASE WHEN c.count >= {min_count} THEN c.count WHEN a.count >= {min_count} THEN a.count ELSE o.count END AS cohort_count,
    CASE WHEN c.count >= {min_count} THEN c.mean WHEN a.count >= {min_count} THEN a.mean ELSE o.mean END AS cohort_mean,
    CASE WHEN c.count >= {min_count} THEN c.median WHEN a.count >= {min_count} THEN a.median ELSE o.median END AS cohort_median
  FROM cb p
  LEFT JOIN cs c ON c.level = 'cell' AND c.age_band = p.ab AND c.area = p.ar
  LEFT JOIN cs a ON a.level = 'age' AND a.age_band = p.ab
  LEFT JOIN cs o ON o.level = 'overall')"""


def bin_sql(v: str, bins: int = 30) -> str:
    """numpy.histogram bin of ``v`` clipped to [lo, hi] (needs lo, hi in scope)."""
    x = f"least(greatest({v}, lo), hi)"
    e = lambda i: f"(CASE WHEN ({i}) = {bins} THEN hi ELSE lo + CAST({i} AS DOUBLE) * ((hi - lo) / {bins}) END)"
    i0 = f"CAST(floor(({x} - lo) * ({bins} / (hi - lo))) AS INTEGER)"
    i1 = f"(CASE WHEN {i0} >= {bins} THEN {bins - 1} ELSE {i0} END)"
    i2 = f"(CASE WHEN {x} < {e(i1)} THEN {i1} - 1 ELSE {i1} END)"
    return f"(CASE WHEN {x} >= {e(i2 + ' + 1')} AND {i2} <> {bins - 1} THEN {i2} + 1 ELSE {i2} END)"


SCORED_CTE = """scored AS (SELECT t.*, pr.pred FROM train t JOIN premium pr ON pr.IDpol = t.IDpol)"""


def gini_cte(name: str, order: str) -> str:
    return f"""{name} AS (
  SELECT w, yw,
         coalesce(sum(yw) OVER (ORDER BY {order} DESC, IDpol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before,
         row_number() OVER (ORDER BY {order} DESC, IDpol) AS rn
  FROM gs)"""


CAL_CTES = [
    """cal AS (SELECT IDpol, pure_premium AS y, pred AS p, Exposure AS w FROM scored)""",
    """calr AS (SELECT *, row_number() OVER (ORDER BY p, IDpol) AS rn, count(*) OVER () AS n FROM cal)""",
    """calb AS (SELECT *, CASE WHEN n <= 1 THEN 0
                          ELSE greatest(CAST(ceil(CAST(rn - 1 AS DOUBLE) * 10 / (n - 1)) AS INTEGER) - 1, 0) END AS bin
           FROM calr)""",
    """bins AS (SELECT bin, count(*) AS n, sum(w) AS w_sum, sum(w * y) / sum(w) AS actual,
                  sum(w * p) / sum(w) AS predicted FROM calb GROUP BY bin)""",
]

_TW = 1.7

SQL.update({
    "severity_aggregate": with_fixtures() + """
SELECT IDpol, round(coalesce(sum(ClaimAmount), 0e0), 6) AS sev_total, CAST(count(ClaimAmount) AS BIGINT) AS sev_count
FROM claim WHERE IDpol IS NOT NULL GROUP BY IDpol""",
    "consistency_report": with_fixtures(UNCAPPED_CTE) + """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM fu) AS n_policies,
       (SELECT CAST(count(*) AS BIGINT) FROM claim) AS n_claim_records,
       (SELECT CAST(count(*) AS BIGINT) FROM fu
          LEFT JOIN (SELECT IDpol, count(ClaimAmount) AS c FROM claim WHERE IDpol IS NOT NULL GROUP BY IDpol) a
            ON a.IDpol = fu.IDpol
        WHERE fu.ClaimNb > 0 AND coalesce(a.c, 0) <> fu.ClaimNb) AS n_mismatched_policies,
       (SELECT CAST(count(*) AS BIGINT) FROM claim c
        WHERE NOT EXISTS (SELECT 1 FROM fu WHERE fu.IDpol = c.IDpol)) AS n_orphan_claims""",
    "orphan_claims": with_fixtures(UNCAPPED_CTE) + """
SELECT IDpol, claim_no, round(ClaimAmount, 6) AS ClaimAmount, round(qty, 6) AS qty FROM claim c
WHERE NOT EXISTS (SELECT 1 FROM fu WHERE fu.IDpol = c.IDpol)""",
    "nominal_clean": with_fixtures(UNCAPPED_CTE) + """
SELECT IDpol, ClaimNb, round(Exposure, 6) AS Exposure, VehBrand, VehGas, Area, Region FROM fu""",
    "factor_bands": with_fixtures(*TRAINING_CTES, *BAND_CTES[:1]) + """
SELECT IDpol, b_DrivAge AS band_DrivAge, b_BonusMalus AS band_BonusMalus, b_VehAge AS band_VehAge,
       b_Area AS band_Area, b_VehGas AS band_VehGas FROM bands""",
    "quote_validation": with_fixtures("""qd AS (
  SELECT IDpol, coalesce(VehPower, 6) AS VehPower, coalesce(VehAge, 2) AS VehAge, coalesce(DrivAge, 40) AS DrivAge,
         coalesce(BonusMalus, 50) AS BonusMalus, coalesce(Density, 1000) AS Density FROM quote)""") + """
SELECT IDpol, DrivAge, BonusMalus,
       NOT (VehPower < 1 OR VehAge < 0 OR DrivAge < 16 OR BonusMalus < 50 OR BonusMalus > 350 OR Density < 0) AS valid,
       concat_ws(',', CASE WHEN VehPower < 1 THEN 'VehPower<1' END, CASE WHEN VehAge < 0 THEN 'VehAge<0' END,
                 CASE WHEN DrivAge < 16 THEN 'DrivAge<16' END, CASE WHEN BonusMalus < 50 THEN 'BonusMalus<50' END,
                 CASE WHEN BonusMalus > 350 THEN 'BonusMalus>350' END, CASE WHEN Density < 0 THEN 'Density<0' END) AS reasons
FROM qd""",
    "market_summary": with_fixtures(*MARKET_CTES) + """
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(v), 2) AS mean, round(quantile_cont(v, 0.5), 2) AS median,
       round(min(v), 2) AS min, round(max(v), 2) AS max,
       round(CASE WHEN quantile_cont(v, 0.99) <= min(v) THEN min(v) + 1 ELSE quantile_cont(v, 0.99) END, 2) AS p99,
       round(quantile_cont(v, 0.1), 2) AS q10, round(quantile_cont(v, 0.25), 2) AS q25,
       round(quantile_cont(v, 0.5), 2) AS q50, round(quantile_cont(v, 0.75), 2) AS q75,
       round(quantile_cont(v, 0.9), 2) AS q90
FROM m""",
    "market_histogram": with_fixtures(*MARKET_CTES, f"""hc AS (SELECT {bin_sql('v')} AS bin, count(*) AS c FROM m, hr GROUP BY 1)""") + """
SELECT CAST(s.range AS INTEGER) AS bin,
       round(lo + CAST(s.range AS DOUBLE) * ((hi - lo) / 30), 2) AS lo_edge,
       round(CASE WHEN s.range + 1 = 30 THEN hi ELSE lo + CAST(s.range + 1 AS DOUBLE) * ((hi - lo) / 30) END, 2) AS hi_edge,
       CAST(coalesce(hc.c, 0) AS BIGINT) AS count
FROM range(30) s CROSS JOIN hr LEFT JOIN hc ON hc.bin = s.range""",
    "cohort_stats": with_fixtures(*MARKET_CTES) + """
SELECT level, age_band, area, count, mean, median FROM cs""",
    "cohort_lookup": with_fixtures(*MARKET_CTES, cohort_pick_sql(30)) + """
SELECT IDpol, cohort_group, cohort_level, cohort_count, cohort_mean, cohort_median FROM coh""",
    "cohort_fallback": with_fixtures(*MARKET_CTES, cohort_pick_sql(400)) + """
SELECT IDpol, cohort_group, cohort_level, cohort_count, cohort_mean, cohort_median FROM coh""",
    "market_position": with_fixtures(*MARKET_CTES, cohort_pick_sql(30)) + f"""
SELECT IDpol, {bin_sql('pp')} AS market_bin, cohort_level,
       round(CASE WHEN cohort_median > 0 THEN pp / cohort_median END, 6) AS median_ratio
FROM coh, hr""",
    "risk_percentile": with_fixtures(*MARKET_CTES) + """
SELECT IDpol, round(100e0 * (rank() OVER (ORDER BY premium) - 1) / count(*) OVER (), 6) AS risk_percentile FROM pf""",
    "balance_ratio": with_fixtures(*TRAINING_CTES, SCORED_CTE) + """
SELECT round(sum(Exposure * pred) / sum(Exposure * pure_premium), 6) AS balance FROM scored""",
    "poisson_deviance": with_fixtures(*TRAINING_CTES, SCORED_CTE) + """
SELECT round(2 * sum(Exposure * CASE WHEN ClaimNb > 0 THEN ClaimNb * ln(ClaimNb / (0.4e0 * Exposure)) - ClaimNb + 0.4e0 * Exposure
                                     ELSE 0.4e0 * Exposure END) / sum(Exposure), 6) AS poisson_deviance
FROM scored""",
    "gamma_deviance": with_fixtures(*TRAINING_CTES, SCORED_CTE) + """
SELECT round(2 * sum(sev_count * (ln(pred / (sev_total / sev_count)) + (sev_total / sev_count) / pred - 1)) / sum(sev_count), 6) AS gamma_deviance
FROM scored WHERE sev_count > 0""",
    "tweedie_deviance": with_fixtures(*TRAINING_CTES, SCORED_CTE) + f"""
SELECT round(2 * sum(Exposure * (pow(pure_premium, {2 - _TW!r}) / {(1 - _TW) * (2 - _TW)!r}
                                 - pure_premium * pow(pred, {1 - _TW!r}) / {1 - _TW!r}
                                 + pow(pred, {2 - _TW!r}) / {2 - _TW!r})) / sum(Exposure), 6) AS tweedie_deviance
FROM scored""",
    "normalized_gini": with_fixtures(*TRAINING_CTES, SCORED_CTE,
        """gs AS (SELECT IDpol, pure_premium AS y, pred AS p, Exposure AS w, pure_premium * Exposure AS yw FROM scored)""",
        """gt AS (SELECT sum(w) AS W, sum(yw) AS YW FROM gs)""",
        gini_cte("g1", "p"), gini_cte("g2", "y"),
        """graw AS (SELECT sum(CASE WHEN rn > 1 THEN w * (before + yw / 2) END) / (SELECT W * YW FROM gt) - 0.5 AS v FROM g1)""",
        """gper AS (SELECT sum(CASE WHEN rn > 1 THEN w * (before + yw / 2) END) / (SELECT W * YW FROM gt) - 0.5 AS v FROM g2)""") + """
SELECT round(graw.v, 6) AS gini_raw, round(gper.v, 6) AS gini_perfect, round(graw.v / gper.v, 6) AS gini FROM graw, gper""",
    "calibration_bins": with_fixtures(*TRAINING_CTES, SCORED_CTE, *CAL_CTES) + """
SELECT bin, CAST(n AS BIGINT) AS n, round(w_sum, 6) AS w_sum, round(actual, 6) AS actual, round(predicted, 6) AS predicted FROM bins""",
    "auto_calibration": with_fixtures(*TRAINING_CTES, SCORED_CTE, *CAL_CTES,
        """bt AS (SELECT sum(w_sum) AS W, sum(w_sum * actual) AS WY FROM bins)""") + """
SELECT round((SELECT sum(w * pred) / sum(w * y) FROM (SELECT Exposure AS w, pure_premium AS y, pred FROM scored)), 6) AS balance,
       round(sum(w_sum / W * abs(actual - predicted) / (WY / W)), 6) AS auto_cal_error
FROM bins, bt""",
    "grouped_split": with_fixtures(*TRAINING_CTES) + f"""
SELECT IDpol, CASE WHEN {split_hash_sql('IDpol')} < 2000 THEN 'test' ELSE 'train' END AS split FROM train""",
    "grouped_kfold": with_fixtures(*TRAINING_CTES) + f"""
SELECT IDpol, CAST((row_number() OVER (ORDER BY md5(concat('42:', CAST(IDpol AS VARCHAR))), IDpol) - 1) % 5 AS INTEGER) AS fold
FROM train""",
    "early_stopping_split": with_fixtures(*TRAINING_CTES) + f"""
SELECT IDpol, CASE WHEN {split_hash_sql('IDpol', '42:es')} < 1500 THEN 'validation' ELSE 'fit' END AS part
FROM train WHERE {split_hash_sql('IDpol')} >= 2000""",
    "seeded_sample": with_fixtures(*TRAINING_CTES) + """
SELECT IDpol, ClaimNb FROM train ORDER BY md5(concat('42:', CAST(IDpol AS VARCHAR))), IDpol LIMIT 1000""",
})

_GROSS_DENOM = 1.0 - 0.25 - 0.05

QUOTE_CTES = [
    f"""qv AS (
  SELECT IDpol, coalesce(VehPower, 6) AS VehPower, coalesce(VehAge, 2) AS VehAge, coalesce(DrivAge, 40) AS DrivAge,
         coalesce(BonusMalus, 50) AS BonusMalus, coalesce(Density, 1000) AS Density,
         trim(coalesce(VehBrand, 'B1'), {STRIP}) AS VehBrand, trim(coalesce(VehGas, 'Regular'), {STRIP}) AS VehGas,
         trim(coalesce(Area, 'C'), {STRIP}) AS Area, trim(coalesce(Region, 'R24'), {STRIP}) AS Region
  FROM quote)""",
    """qp AS (
  SELECT *, (0.05e0 + 0.002e0 * abs(DrivAge - 45) + 0.001e0 * (BonusMalus - 50)) * (800e0 + 10e0 * VehPower) AS premium
  FROM qv
  WHERE NOT (VehPower < 1 OR VehAge < 0 OR DrivAge < 16 OR BonusMalus < 50 OR BonusMalus > 350 OR Density < 0))""",
    """mkt AS (SELECT premium AS v, count(*) AS c FROM pf WHERE isfinite(premium) GROUP BY premium)""",
    """qu AS (SELECT premium AS v, 0 AS kind, IDpol AS id, 0 AS c FROM qp
          UNION ALL SELECT v, 1, 0, c FROM mkt)""",
    """qw AS (SELECT id, kind, 100e0 * coalesce(sum(c) OVER (ORDER BY v, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                    / (SELECT sum(c) FROM mkt) AS pct
          FROM qu)""",
    """qr AS (SELECT id, pct FROM qw WHERE kind = 0)""",
    f"""rep AS (
  SELECT qp.*, qr.pct, round(qp.premium, 2) AS pure_premium, round(qr.pct, 1) AS risk_percentile,
         CASE WHEN qr.pct >= 70 THEN 'high_risk' WHEN qr.pct >= 30 THEN 'standard' ELSE 'low_risk' END AS tier,
         round(qp.premium / {_GROSS_DENOM!r}, 2) AS estimated_gross_premium,
         '순보험료는 리스크 원가이며 실제 청구 보험료와 다릅니다.' AS disclaimer
  FROM qp JOIN qr ON qr.id = qp.IDpol)""",
    """rep2 AS (
  SELECT *, CASE tier WHEN 'high_risk' THEN '상향(보험료 절감)' WHEN 'standard' THEN '표준' ELSE '낮춤 가능' END AS deductible,
         CASE tier WHEN 'high_risk' THEN '필수 담보 중심' WHEN 'standard' THEN '표준 패키지' ELSE '보장 확대 여력' END AS coverage_limit
  FROM rep)""",
]

_REPORT_COLS = "IDpol, pure_premium, risk_percentile, tier, deductible, coverage_limit, disclaimer, estimated_gross_premium"

SQL.update({
    "gross_premium_tiers": with_fixtures(*MARKET_CTES, *QUOTE_CTES) + f"""
SELECT {_REPORT_COLS} FROM rep2""",
    "diagnosis_report": with_fixtures(*MARKET_CTES, *QUOTE_CTES, f"""qb AS (
  SELECT r.*, {age_band_sql('r.DrivAge')} AS ab, r.Area AS ar FROM rep2 r)""", """qc AS (
  SELECT q.*,
    CASE WHEN c.count >= 30 THEN 'cell' WHEN a.count >= 30 THEN 'age' ELSE 'overall' END AS cohort_level,
    CASE WHEN c.count >= 30 THEN q.ab || ' · Area ' || q.ar WHEN a.count >= 30 THEN q.ab || ' 연령대' ELSE '전체 시장' END AS cohort_group,
    CASE WHEN c.count >= 30 THEN c.count WHEN a.count >= 30 THEN a.count ELSE o.count END AS cohort_count,
    CASE WHEN c.count >= 30 THEN c.mean WHEN a.count >= 30 THEN a.mean ELSE o.mean END AS cohort_mean,
    CASE WHEN c.count >= 30 THEN c.median WHEN a.count >= 30 THEN a.median ELSE o.median END AS cohort_median
  FROM qb q
  LEFT JOIN cs c ON c.level = 'cell' AND c.age_band = q.ab AND c.area = q.ar
  LEFT JOIN cs a ON a.level = 'age' AND a.age_band = q.ab
  LEFT JOIN cs o ON o.level = 'overall')""") + f"""
SELECT {_REPORT_COLS}, cohort_group, cohort_level, cohort_count, cohort_mean, cohort_median,
       ab AS band_DrivAge,
       CASE WHEN BonusMalus >= 0 AND BonusMalus < 60 THEN '50–59' WHEN BonusMalus >= 60 AND BonusMalus < 80 THEN '60–79'
            WHEN BonusMalus >= 80 AND BonusMalus < 100 THEN '80–99' WHEN BonusMalus >= 100 AND BonusMalus < 150 THEN '100–149'
            WHEN BonusMalus >= 150 AND BonusMalus < 1e9 THEN '150+' END AS band_BonusMalus,
       CASE WHEN VehAge >= 0 AND VehAge < 2 THEN '0–1' WHEN VehAge >= 2 AND VehAge < 6 THEN '2–5'
            WHEN VehAge >= 6 AND VehAge < 11 THEN '6–10' WHEN VehAge >= 11 AND VehAge < 16 THEN '11–15'
            WHEN VehAge >= 16 AND VehAge < 1e9 THEN '16+' END AS band_VehAge,
       Area AS band_Area, VehGas AS band_VehGas
FROM qc""",
})

AGE_TARGET_VALUES = """age_target(level, share) AS (VALUES
  ('<20', 0.007e0), ('20s', 0.130e0), ('30s', 0.179e0), ('40s', 0.209e0), ('50s', 0.226e0), ('60s', 0.177e0), ('70+', 0.072e0))"""

MARGIN_CTES = [
    """gm AS (SELECT max(CASE WHEN C1_NM = '총계' AND C2_NM = '남자' THEN CAST(DT AS BIGINT) END) AS m,
                 max(CASE WHEN C1_NM = '총계' AND C2_NM = '여자' THEN CAST(DT AS BIGINT) END) AS f FROM stat_gender)""",
    """gender_m AS (SELECT 'Gender' AS margin, 'Male' AS level, round(m / (m + f), 3) AS share FROM gm
               UNION ALL SELECT 'Gender', 'Female', round(f / (m + f), 3) FROM gm)""",
    f"""ar AS (SELECT {age_band_sql("CAST(nullif(regexp_extract(C1_NM, '(\\d+)', 1), '') AS INT)")} AS level,
                  CAST(DT AS BIGINT) AS dt
           FROM stat_age WHERE C2_NM = '총계' AND C1_NM <> '총계')""",
    """ag AS (SELECT level, sum(dt) AS dt FROM ar WHERE level IS NOT NULL GROUP BY level)""",
    """bo(level, ord) AS (VALUES ('<20', 0), ('20s', 1), ('30s', 2), ('40s', 3), ('50s', 4), ('60s', 5), ('70+', 6))""",
    """aj AS (SELECT bo.level, bo.ord, coalesce(ag.dt, 0) AS dt FROM bo LEFT JOIN ag ON ag.level = bo.level)""",
    """ap AS (SELECT *, round(dt / sum(dt) OVER (), 3) AS prop FROM aj)""",
    """apr AS (SELECT *, round(1 - sum(prop) OVER (), 3) AS residual,
                  row_number() OVER (ORDER BY prop DESC, ord) AS rk FROM ap)""",
    """age_m AS (SELECT 'DrivAge' AS margin, level,
                    CASE WHEN rk = 1 AND residual <> 0 THEN round(prop + residual, 3) ELSE prop END AS share FROM apr)""",
    """vt AS (SELECT
      max(CASE WHEN ITM_NM = '계' AND C2_NM = '총계' THEN CAST(DT AS BIGINT) END) AS total,
      max(CASE WHEN ITM_NM = '계' AND C2_NM = '승용' THEN CAST(DT AS BIGINT) END) AS ptotal,
      max(CASE WHEN ITM_NM = '계' AND C2_NM = '승합' THEN CAST(DT AS BIGINT) END) AS t1,
      max(CASE WHEN ITM_NM = '계' AND C2_NM = '화물' THEN CAST(DT AS BIGINT) END) AS t2,
      max(CASE WHEN ITM_NM = '계' AND C2_NM = '특수' THEN CAST(DT AS BIGINT) END) AS t3,
      max(CASE WHEN ITM_NM = '자가용' AND C2_NM = '승용' THEN CAST(DT AS BIGINT) END) AS u0,
      max(CASE WHEN ITM_NM = '영업용' AND C2_NM = '승용' THEN CAST(DT AS BIGINT) END) AS u1,
      max(CASE WHEN ITM_NM = '관용' AND C2_NM = '승용' THEN CAST(DT AS BIGINT) END) AS u2
    FROM stat_vehicle)""",
    """veh_m AS (
      SELECT 'vehicle_type' AS margin, '승용' AS level, round(ptotal / total, 4) AS share FROM vt
      UNION ALL SELECT 'vehicle_type', '승합', round(t1 / total, 4) FROM vt
      UNION ALL SELECT 'vehicle_type', '화물', round(t2 / total, 4) FROM vt
      UNION ALL SELECT 'vehicle_type', '특수', round(t3 / total, 4) FROM vt
      UNION ALL SELECT 'passenger_use', '자가용', round(u0 / ptotal, 4) FROM vt
      UNION ALL SELECT 'passenger_use', '영업용', round(u1 / ptotal, 4) FROM vt
      UNION ALL SELECT 'passenger_use', '관용', round(u2 / ptotal, 4) FROM vt)""",
]


def post_strat_sql(source: str) -> list[str]:
    return [
        AGE_TARGET_VALUES,
        f"""psb AS (SELECT IDpol, {age_band_sql('DrivAge')} AS level FROM {source})""",
        """psn AS (SELECT level, count(*) AS n FROM psb GROUP BY level)""",
        """pst AS (SELECT sum(t.share) AS tsum FROM age_target t WHERE t.level IN (SELECT level FROM psn))""",
        """psw AS (
  SELECT b.IDpol, CASE WHEN t.share IS NULL THEN 1e0 ELSE t.share * (SELECT count(*) FROM psb) / n.n END AS w0
  FROM psb b JOIN psn n ON n.level IS NOT DISTINCT FROM b.level LEFT JOIN age_target t ON t.level = b.level)""",
        """psm AS (SELECT avg(w0) AS mw FROM psw)""",
        """ps AS (SELECT IDpol, w0 / mw AS rake_weight FROM psw, psm)""",
    ]


SQL.update({
    "license_gender_margin": with_fixtures(*MARGIN_CTES) + "SELECT margin, level, share FROM gender_m",
    "license_age_margin": with_fixtures(*MARGIN_CTES) + "SELECT margin, level, share FROM age_m",
    "vehicle_margin": with_fixtures(*MARGIN_CTES) + "SELECT margin, level, share FROM veh_m",
    "all_margins": with_fixtures(*MARGIN_CTES) + """
SELECT margin, level, share FROM gender_m UNION ALL SELECT margin, level, share FROM age_m
UNION ALL SELECT margin, level, share FROM veh_m""",
    "post_stratify": with_fixtures(*TRAINING_CTES, *post_strat_sql("train")) + """
SELECT IDpol, round(rake_weight, 6) AS rake_weight FROM ps""",
    "weight_summary": with_fixtures(*TRAINING_CTES, f"""trs AS (SELECT * FROM train WHERE {split_hash_sql('IDpol')} >= 2000)""",
                                    *post_strat_sql("trs")) + """
SELECT round(avg(rake_weight), 6) AS weight_mean, round(min(rake_weight), 6) AS weight_min,
       round(max(rake_weight), 6) AS weight_max FROM ps""",
})

_LEVELS = {
    "VehBrand": sorted(f"B{i}" for i in range(1, 15)),
    "VehGas": ["Diesel", "Regular"],
    "Area": list("ABCDEF"),
    "Region": sorted(f"R{11 + i}" for i in range(25)),
}
_DUMMIES = ",\n       ".join(
    f"CASE WHEN {c} = '{lv}' THEN 1e0 ELSE 0e0 END AS \"{c}_{lv}\""
    for c in ("VehBrand", "VehGas", "Area", "Region") for lv in _LEVELS[c][1:])

ISO_CTES = [
    """iso_pairs AS (
  SELECT a.bin AS j, b.bin AS k,
         (SELECT sum(x.w_sum * x.actual) / sum(x.w_sum) FROM bins x WHERE x.bin BETWEEN a.bin AND b.bin) AS avg_jk
  FROM bins a JOIN bins b ON a.bin <= b.bin)""",
    """iso_fit AS (
  SELECT i.bin, max(mn) AS fitted FROM bins i
  JOIN (SELECT p.j, i2.bin AS i, min(p.avg_jk) AS mn
        FROM iso_pairs p JOIN bins i2 ON p.j <= i2.bin AND p.k >= i2.bin GROUP BY p.j, i2.bin) q
    ON q.i = i.bin
  GROUP BY i.bin)""",
]

SQL.update({
    "design_matrix": with_fixtures(*TRAINING_CTES) + f"""
SELECT IDpol, CAST(VehPower AS DOUBLE) AS VehPower, CAST(VehAge AS DOUBLE) AS VehAge, CAST(DrivAge AS DOUBLE) AS DrivAge,
       CAST(BonusMalus AS DOUBLE) AS BonusMalus, round(ln(1 + Density), 6) AS Density,
       {_DUMMIES}
FROM train""",
    "poisson_glm_one_factor": with_fixtures(*TRAINING_CTES) + """
SELECT Area, round(sum(ClaimNb) / sum(CASE WHEN Exposure < 1e-6 THEN 1e-6 ELSE Exposure END), 6) AS rate
FROM train GROUP BY Area""",
    "gamma_glm_one_factor": with_fixtures(*TRAINING_CTES) + """
SELECT Area, round(sum(sev_total) / sum(sev_count), 6) AS severity FROM train WHERE sev_count > 0 GROUP BY Area""",
    "isotonic_binned": with_fixtures(*TRAINING_CTES, SCORED_CTE, *CAL_CTES, *ISO_CTES) + """
SELECT bin, round(fitted, 6) AS fitted FROM iso_fit""",
})

SQL.update({
    "own_bands": with_fixtures(*TRAINING_CTES, *BAND_CTES, *MARKET_CTES, *QUOTE_CTES, f"""qband AS (
  SELECT IDpol, 'DrivAge' AS feature, {age_band_sql('DrivAge')} AS band FROM qp
  UNION ALL SELECT IDpol, 'BonusMalus',
       CASE WHEN BonusMalus >= 0 AND BonusMalus < 60 THEN '50–59' WHEN BonusMalus >= 60 AND BonusMalus < 80 THEN '60–79'
            WHEN BonusMalus >= 80 AND BonusMalus < 100 THEN '80–99' WHEN BonusMalus >= 100 AND BonusMalus < 150 THEN '100–149'
            WHEN BonusMalus >= 150 AND BonusMalus < 1e9 THEN '150+' END FROM qp
  UNION ALL SELECT IDpol, 'VehAge',
       CASE WHEN VehAge >= 0 AND VehAge < 2 THEN '0–1' WHEN VehAge >= 2 AND VehAge < 6 THEN '2–5'
            WHEN VehAge >= 6 AND VehAge < 11 THEN '6–10' WHEN VehAge >= 11 AND VehAge < 16 THEN '11–15'
            WHEN VehAge >= 16 AND VehAge < 1e9 THEN '16+' END FROM qp
  UNION ALL SELECT IDpol, 'Area', Area FROM qp
  UNION ALL SELECT IDpol, 'VehGas', VehGas FROM qp)""") + """
SELECT q.IDpol, q.feature, q.band, f.ord, f.n, f.frequency
FROM qband q LEFT JOIN factor_freq f ON f.feature = q.feature AND f.band = q.band""",
})

SQL["csv_policy_scan"] = with_fixtures(UNCAPPED_CTE) + """
SELECT IDpol, ClaimNb, round(Exposure, 6) AS Exposure, VehPower, VehAge, DrivAge, BonusMalus, VehBrand, VehGas,
       Area, Region
FROM fu"""

SQL["csv_claim_scan"] = with_fixtures() + """
SELECT IDpol, count(*) AS n, round(sum(ClaimAmount), 6) AS amount FROM claim GROUP BY IDpol"""

SQL["csv_missing_id"] = with_fixtures() + """
SELECT count(*) AS n, CAST(0 AS BIGINT) AS first_id, count(*) - 1 AS last_id, count(*) AS n_ids,
       CAST(sum(VehPower) AS BIGINT) AS power, CAST(sum(DrivAge) AS BIGINT) AS age,
       CAST(sum(BonusMalus) AS BIGINT) AS bonus
FROM policy"""

SQL["malformed_quotes"] = with_fixtures("""spoilt AS (
  SELECT CASE WHEN IDpol % 7 NOT IN (3, 4) THEN IDpol END AS ident, IDpol % 7 AS kind,
         CASE WHEN IDpol % 7 IN (1, 2, 3) THEN 40 ELSE coalesce(DrivAge, 40) END AS age,
         CASE WHEN IDpol % 7 = 3 THEN 50 ELSE coalesce(BonusMalus, 50) END AS bonus,
         IDpol % 7 <> 3 AND VehPower < 1 AS p0, IDpol % 7 <> 3 AND VehAge < 0 AS v0,
         IDpol % 7 <> 3 AND Density < 0 AS d0, IDpol % 7 = 2 AND DrivAge IS NOT NULL AS fraction
  FROM quote)""") + """
SELECT CASE WHEN r = '' THEN 'valid' ELSE r END AS reasons, count(*) AS n,
       CAST(coalesce(sum(ident), 0) AS BIGINT) AS ids
FROM (SELECT ident, concat_ws(',', CASE WHEN kind = 1 OR fraction THEN 'DrivAge:type' END,
                CASE WHEN kind = 4 THEN 'IDpol:missing' END, CASE WHEN kind = 3 THEN 'line' END,
                CASE WHEN p0 THEN 'VehPower<1' END, CASE WHEN v0 THEN 'VehAge<0' END, CASE WHEN age < 16 THEN 'DrivAge<16' END,
                CASE WHEN bonus < 50 THEN 'BonusMalus<50' END, CASE WHEN bonus > 350 THEN 'BonusMalus>350' END,
                CASE WHEN d0 THEN 'Density<0' END) AS r
      FROM spoilt)
GROUP BY 1"""

SQL["malformed_quote_stream"] = SQL["malformed_quotes"]

SQL["rake_mapped_gender"] = with_fixtures("""g AS (
  SELECT IDpol, CASE WHEN VehPower % 2 = 0 THEN 'M' ELSE 'F' END AS Gender FROM policy),
gs AS (SELECT Gender, CAST(count(*) AS DOUBLE) AS n FROM g GROUP BY Gender)""") + """
SELECT g.IDpol, g.Gender,
       round(CASE WHEN g.Gender = 'M' THEN 0.566e0 ELSE 0.434e0 END * (SELECT sum(n) FROM gs) / gs.n
             / (SELECT sum(CASE WHEN Gender = 'M' THEN 0.566e0 ELSE 0.434e0 END) FROM gs), 6) AS rake_weight
FROM g JOIN gs ON g.Gender = gs.Gender"""

SQL["stream_diagnosis"] = SQL["diagnosis_report"]


def rake_two_margins_sql(passes: int) -> str:
    """IPF on (sex, age band) cells, ``passes`` passes unrolled: per pass and
    margin, every level's cells are scaled by target share / current share
    (current shares over the cells' totals ``n · r``)."""
    ctes = [AGE_TARGET_VALUES,
            """sex_target(level, share) AS (VALUES ('Male', 0.566e0), ('Female', 0.434e0))""",
            f"""rkr AS (SELECT IDpol, CASE WHEN VehPower % 2 = 0 THEN 'Male' ELSE 'Female' END AS g,
                        {age_band_sql('DrivAge')} AS a FROM train)""",
            """c0 AS MATERIALIZED (SELECT g, a, count(*) AS n, 1e0 AS r FROM rkr GROUP BY g, a)"""]
    prev = "c0"
    step = 0
    for _ in range(passes):
        for col, tgt in (("g", "sex_target"), ("a", "age_target")):
            step += 1
            cur = f"c{step}"
            ctes.append(f"""{cur} AS MATERIALIZED (
  SELECT c.g, c.a, c.n,
         CASE WHEN t.share IS NOT NULL AND s.sh > 0 THEN c.r * (t.share / s.sh) ELSE c.r END AS r
  FROM {prev} c
  LEFT JOIN (SELECT {col} AS lv, sum(n * r) / (SELECT sum(n * r) FROM {prev}) AS sh
             FROM {prev} GROUP BY {col}) s ON s.lv = c.{col}
  LEFT JOIN {tgt} t ON t.level = c.{col})""")
            prev = cur
    ctes.append(f"""rk_mean AS (SELECT sum(n * r) / sum(n) AS m FROM {prev})""")
    return with_fixtures(*TRAINING_CTES, *ctes) + f"""
SELECT x.IDpol, x.g AS Gender, x.a AS AgeBand, round(c.r / (SELECT m FROM rk_mean), 6) AS rake_weight
FROM rkr x JOIN {prev} c ON c.g = x.g AND c.a = x.a"""


SQL["rake_two_margins"] = rake_two_margins_sql(50)

# Isotonic regression by its min-max formula: the fit at the i-th distinct
# prediction is the largest, over starts a <= i, of the smallest, over ends
# b >= i, of the weighted means of a..b (prefix sums).
SQL["calibrated_premium"] = with_fixtures(*TRAINING_CTES, *post_strat_sql("train"), """iso_rows AS (
  SELECT t.IDpol, pr.pred, t.Exposure * ps.rake_weight AS w, t.pure_premium AS y
  FROM train t JOIN ps ON ps.IDpol = t.IDpol JOIN premium pr ON pr.IDpol = t.IDpol)""", """iso_at AS MATERIALIZED (
  SELECT pred, row_number() OVER (ORDER BY pred) AS i, sum(sw) OVER (ORDER BY pred) AS cw,
         sum(swy) OVER (ORDER BY pred) AS cy
  FROM (SELECT pred, sum(w) AS sw, sum(w * y) AS swy FROM iso_rows GROUP BY pred))""", """iso_mean AS (
  SELECT a.i AS a, b.i AS b, (b.cy - coalesce(p.cy, 0e0)) / (b.cw - coalesce(p.cw, 0e0)) AS m
  FROM iso_at a JOIN iso_at b ON b.i >= a.i LEFT JOIN iso_at p ON p.i = a.i - 1)""", """iso_fit AS (
  SELECT b AS i, max(low) AS f
  FROM (SELECT a, b, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS low FROM iso_mean) GROUP BY b)""") + """
SELECT r.IDpol, round(r.pred, 6) AS pred, round(f.f, 4) AS calibrated
FROM iso_rows r JOIN iso_at x ON x.pred = r.pred JOIN iso_fit f ON f.i = x.i"""

_AREA_TARGET = {"A": 0.1, "B": 0.1, "C": 0.3, "D": 0.2, "E": 0.2, "F": 0.1}

SQL.update({
    "stat_rows_scan": with_fixtures() + """
SELECT 'license_age' AS source, * FROM stat_age UNION ALL SELECT 'license_gender', * FROM stat_gender
UNION ALL SELECT 'vehicle', * FROM stat_vehicle""",
    "report_json": SQL["diagnosis_report"],
    "prediction_scale": with_fixtures(*TRAINING_CTES, """rated AS (
  SELECT *, ClaimNb / greatest(Exposure, 1e-6) AS rate, ClaimNb / greatest(Exposure, 1e-6) * Exposure AS c FROM train)""") + """
SELECT IDpol, round(rate, 6) AS rate, round(c, 6) AS count, greatest(c, 1e-8) AS floored_count,
       round(greatest(sev_total, 1e-3), 6) AS floored_severity, round(greatest(pure_premium, 1e-6), 6) AS floored_premium
FROM rated""",
    "percentile_clamp": with_fixtures() + """
SELECT IDpol, CASE WHEN IDpol % 11 = 0 OR IDpol % 13 = 0 THEN 0e0
                   ELSE least(greatest((BonusMalus - 60) * 2.5e0, 0e0), 100e0) END AS percentile FROM policy""",
    # one margin: a share over the share that is there, once
    "rake_identity_margin": with_fixtures(*TRAINING_CTES) + f"""
SELECT IDpol, Area AS zone, round(share / (count(*) OVER (PARTITION BY Area) / count(*) OVER ()), 6) AS rake_weight
FROM train JOIN (VALUES {", ".join(f"('{k}', {v}e0)" for k, v in _AREA_TARGET.items())}) t(level, share) ON level = Area""",
    "metric_comparison": with_fixtures(*TRAINING_CTES, SCORED_CTE) + """
SELECT 'balance' AS metric, round(sum(Exposure * pred) / sum(Exposure * pure_premium), 6) AS analytic,
       round(sum(Exposure * 250e0) / sum(Exposure * pure_premium), 6) AS constant FROM scored
UNION ALL SELECT 'mean_prediction', round(avg(pred), 6), 250e0 FROM scored""",
})
