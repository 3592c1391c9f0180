"""Cleaning, consistency and the training table (P01–P06, F01–F05, A01–A03,
D01–D03)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.functions.columns import cap, pure_premium, strip_quotes, to_double
from riskloom.operators.quantiles import exact_quantile_values
from riskloom.session import cut_lineage


def coerce(freq: DataFrame, sev: DataFrame, id_col: str = S.ID,
           amount_col: str = S.AMOUNT) -> tuple[DataFrame, DataFrame]:
    """P01 + P02: numeric coercion (bad -> NULL) and quote strip of every
    categorical present."""
    f_cols = []
    for c in freq.columns:
        if c in (S.CLAIM_NB, S.EXPOSURE):
            f_cols.append(to_double(c).alias(c))
        elif c in S.CATEGORICAL:
            f_cols.append(strip_quotes(F.col(c).cast("string")).alias(c))
        else:
            f_cols.append(F.col(c))
    s_cols = [to_double(c).alias(c) if c == amount_col else F.col(c) for c in sev.columns]
    return freq.select(*f_cols), sev.select(*s_cols)


def aggregate_severity(sev: DataFrame, id_col: str = S.ID,
                       amount_col: str = S.AMOUNT) -> DataFrame:
    """Per policy ``sev_total`` (sum, 0 when all amounts are NULL) and
    ``sev_count`` (non-NULL amounts).  NULL ids are dropped.  Partial
    aggregation happens map-side before the shuffle on the id."""
    return (sev.filter(F.col(id_col).isNotNull())
               .groupBy(id_col)
               .agg(F.coalesce(F.sum(amount_col), F.lit(0.0)).alias("sev_total"),
                    F.count(amount_col).alias("sev_count")))


def orphan_claims(freq: DataFrame, sev: DataFrame, id_col: str = S.ID) -> DataFrame:
    """Claims with no policy (a NULL id counts as orphan)."""
    ids = freq.select(id_col).filter(F.col(id_col).isNotNull())
    return sev.join(ids, sev[id_col] == ids[id_col], "left_anti")


def attach_claims(freq: DataFrame, sev: DataFrame, id_col: str = S.ID,
                  amount_col: str = S.AMOUNT) -> DataFrame:
    """Policy ⟕ aggregated claims."""
    return freq.join(aggregate_severity(sev, id_col, amount_col), id_col, "left")


def consistency_report(freq: DataFrame, sev: DataFrame, id_col: str = S.ID,
                       claim_count_col: str = S.CLAIM_NB) -> DataFrame:
    """One row ``n_policies, n_claim_records, n_mismatched_policies,
    n_orphan_claims`` on uncapped data."""
    merged = attach_claims(freq, sev, id_col)
    cn = F.col(claim_count_col)
    mism = (cn > 0) & (F.coalesce(F.col("sev_count"), F.lit(0)) != cn)
    left = merged.agg(F.count(F.lit(1)).alias("n_policies"),
                      F.count_if(mism).alias("n_mismatched_policies"))
    right = sev.agg(F.count(F.lit(1)).alias("n_claim_records"))
    orphans = orphan_claims(freq, sev, id_col).agg(F.count(F.lit(1)).alias("n_orphan_claims"))
    # Three one-row aggregates side by side (each is one row by construction).
    one = F.lit(1)
    return (left.withColumn("_k", one).join(right.withColumn("_k", one), "_k")
                .join(orphans.withColumn("_k", one), "_k")
                .select(F.col("n_policies").cast("long"), F.col("n_claim_records").cast("long"),
                        F.col("n_mismatched_policies").cast("long"),
                        F.col("n_orphan_claims").cast("long")))


def duplicate_policy_ids(freq: DataFrame, id_col: str = S.ID) -> DataFrame:
    """Ids that occur more than once (duplicates would double claim totals)."""
    return freq.groupBy(id_col).count().filter(F.col("count") > 1)


def severity_clip_value(sev: DataFrame, q: float | None = S.SEVERITY_CLIP_QUANTILE,
                        amount_col: str = S.AMOUNT) -> float | None:
    """P04 threshold: exact ``q`` quantile of the claim amounts (distributed
    selection, not a single-task percentile)."""
    if not q:
        return None
    return exact_quantile_values(sev, amount_col, {"clip": q})["clip"]


def cap_policies(freq: DataFrame, exposure_col: str = S.EXPOSURE, claim_col: str = S.CLAIM_NB,
                 cap_claim_nb: float = S.CAP_CLAIM_NB, cap_exposure: float = S.CAP_EXPOSURE) -> DataFrame:
    """Capped claim counts and exposures."""
    return freq.withColumns({claim_col: cap(claim_col, cap_claim_nb), exposure_col: cap(exposure_col, cap_exposure)})


def preprocess(freq: DataFrame, sev: DataFrame, id_col: str = S.ID,
               exposure_col: str = S.EXPOSURE, claim_col: str = S.CLAIM_NB,
               amount_col: str = S.AMOUNT, cap_claim_nb: float = S.CAP_CLAIM_NB,
               cap_exposure: float = S.CAP_EXPOSURE, drop_orphan_claims: bool = True,
               severity_clip_quantile: float | None = S.SEVERITY_CLIP_QUANTILE,
               clip_value: float | None = None) -> DataFrame:
    """A03 training table: caps (P03) → orphan removal (F01/D02) → severity
    clip at the exact quantile of the remaining claims (P04) → per-policy
    aggregation (A01) → left join (D01) → fills (P05) → pure premium (P06).

    ``clip_value`` overrides the quantile (e.g. a train-only threshold)."""
    f = cap_policies(freq, exposure_col, claim_col, cap_claim_nb, cap_exposure)
    s = sev
    if drop_orphan_claims:
        ids = f.select(id_col)
        s = s.join(ids, id_col, "left_semi")
    if clip_value is None and severity_clip_quantile:
        s = cut_lineage(s)
        clip_value = severity_clip_value(s, severity_clip_quantile, amount_col)
    if clip_value is not None:
        s = s.withColumn(amount_col, cap(amount_col, float(clip_value)))
    df = attach_claims(f, s, id_col, amount_col)
    return df.withColumns({
        "sev_total": F.coalesce(F.col("sev_total"), F.lit(0.0)),
        "sev_count": F.coalesce(F.col("sev_count"), F.lit(0)).cast("long"),
    }).withColumn("pure_premium", pure_premium("sev_total", exposure_col))


def claim_policies(df: DataFrame) -> DataFrame:
    """policies with at least one claim."""
    return df.filter(F.col("sev_count") > 0)


def apply_quote_defaults(quotes: DataFrame) -> DataFrame:
    """absent field -> default.  Runs before validation."""
    return quotes.withColumns({
        c: F.coalesce(F.col(c), F.lit(v)) for c, v in S.QUOTE_DEFAULTS.items() if c in quotes.columns
    })


def quote_reasons(quotes: DataFrame) -> DataFrame:
    """add ``reasons ARRAY<STRING>`` listing every type violation found
    by the reader (``type_errors``, if there) and every range violation."""
    checks = []
    for c, (lo, hi) in S.QUOTE_RANGES.items():
        if lo is not None:
            checks.append(F.when(F.col(c) < lo, F.lit(f"{c}<{lo}")))
        if hi is not None:
            checks.append(F.when(F.col(c) > hi, F.lit(f"{c}>{hi}")))
    reasons = F.array_compact(F.array(*checks))
    if "type_errors" not in quotes.columns:
        return quotes.withColumn("reasons", reasons)
    return quotes.withColumn("reasons", F.concat("type_errors", reasons)).drop("type_errors")


def validate_quotes(quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F04 → F03: (valid, quarantine) frames.  Quarantined rows keep their
    ``reasons``; valid rows have categoricals quote-stripped (P02)."""
    checked = quote_reasons(apply_quote_defaults(quotes))
    valid = (checked.filter(F.size("reasons") == 0).drop("reasons")
                    .withColumns({c: strip_quotes(c) for c in S.CATEGORICAL if c in quotes.columns}))
    bad = checked.filter(F.size("reasons") > 0)
    return valid, bad
