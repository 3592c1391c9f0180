"""Column expressions (JVM-side, codegen'd): coercion, caps, floors,
premium arithmetic, coverage tiers and report rounding."""
from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import schema as S


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_dp(c: Column | str, digits: int) -> Column:
    """Round half away from zero on the binary value scaled by ``10**digits``
    (``round(x * 10^d) / 10^d``).  Used for every reported rounding so
    results are bit-identical with engines that round this way (DuckDB)."""
    m = float(10 ** digits)
    return F.round(col(c) * F.lit(m)) / F.lit(m)


def to_double(c: Column | str) -> Column:
    """P01 numeric coercion: bad values become NULL (never NaN).  Strings go
    through ``try_cast``; NaN doubles are turned into NULL at ingest."""
    d = col(c).try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def strip_quotes(c: Column | str) -> Column:
    """Trim ``'``, ``"`` and blanks from both ends."""
    return F.trim(col(c), F.lit("'\" "))


def cap(c: Column | str, upper) -> Column:
    """Upper cap that keeps NULL as NULL (``least`` would not)."""
    c = col(c)
    return F.when(c > F.lit(upper), F.lit(upper)).otherwise(c)


def floor_at(c: Column | str, lower) -> Column:
    """P18 and friends: lower floor, NULL stays NULL."""
    c = col(c)
    return F.when(c < F.lit(lower), F.lit(lower)).otherwise(c)


def pure_premium(sev_total: Column | str, exposure: Column | str) -> Column:
    """``sev_total / max(Exposure, 1e-6)``."""
    return col(sev_total) / floor_at(exposure, S.EXPOSURE_FLOOR)


def average_claim(sev_total: Column | str, sev_count: Column | str) -> Column:
    """Average claim amount on policies with claims."""
    return F.try_divide(col(sev_total), col(sev_count))


def density_log(c: Column | str = "Density") -> Column:
    """P08."""
    return F.log1p(col(c).cast("double"))


def exposure_offset(c: Column | str = "Exposure") -> Column:
    """``log(max(Exposure, 1e-6))``."""
    return F.ln(floor_at(c, S.EXPOSURE_FLOOR))


def weight_product(*cols: Column | str | None) -> Column | None:
    """Product of the non-None weights; all None -> None."""
    present = [col(c) for c in cols if c is not None]
    if not present:
        return None
    return reduce(mul, present)


def rate_from_count(count: Column | str, exposure: Column | str) -> Column:
    """P20: frequency rate from an expected count."""
    return col(count) / floor_at(exposure, S.EXPOSURE_FLOOR)


def count_from_rate(rate: Column | str, exposure: Column | str) -> Column:
    """P20: expected count from a rate."""
    return col(rate) * col(exposure)


def check_loading(expense_ratio: float, profit_margin: float) -> float:
    denom = 1.0 - expense_ratio - profit_margin
    if denom <= 0:
        raise ValueError(f"expenses and profit take {expense_ratio + profit_margin:g} of the premium; it must be below 1")
    return denom


def gross_up(pp: Column | str, expense_ratio: float = S.EXPENSE_RATIO,
             profit_margin: float = S.PROFIT_MARGIN) -> Column:
    """``pp / (1 - expense_ratio - profit_margin)``; checked on the driver."""
    return col(pp) / F.lit(check_loading(expense_ratio, profit_margin))


def coverage_tier(percentile: Column | str) -> Column:
    """Tier name from the unrounded percentile."""
    p = col(percentile)
    return (F.when(p >= S.TIER_HIGH_FROM, "high_risk")
             .when(p >= S.TIER_STANDARD_FROM, "standard")
             .otherwise("low_risk"))


def coverage(percentile: Column | str) -> Column:
    """``STRUCT<tier, deductible, limit>``."""
    tier = coverage_tier(percentile)
    ded = F.lit(None).cast("string")
    lim = F.lit(None).cast("string")
    for name, (d, lm) in S.COVERAGE.items():
        ded = F.when(tier == name, F.lit(d)).otherwise(ded)
        lim = F.when(tier == name, F.lit(lm)).otherwise(lim)
    return F.struct(tier.alias("tier"), ded.alias("deductible"), lim.alias("limit"))


def median_ratio(premium: Column | str, median: Column | str) -> Column:
    """Premium / cohort median when the median is positive."""
    m = col(median)
    return F.when(m > 0, col(premium) / m)


def clamp_percentile(p: Column | str) -> Column:
    """P25: clamp to [0, 100]; non-numbers become 0."""
    p = col(p).cast("double")
    p = F.coalesce(F.nanvl(p, F.lit(0.0)), F.lit(0.0))
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(100.0))


def cohort_label(level: Column | str, age_band: Column | str, area: Column | str) -> Column:
    """Display label of a cohort level."""
    lv, ab, ar = col(level), col(age_band), col(area)
    return (F.when(lv == "cell", F.concat(ab, F.lit(S.COHORT_AREA_SEP), ar))
             .when(lv == "age", F.concat(ab, F.lit(S.COHORT_AGE_SUFFIX)))
             .otherwise(F.lit(S.COHORT_OVERALL)))


def finite(c: Column | str) -> Column:
    """not NULL, not NaN, not infinite."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
