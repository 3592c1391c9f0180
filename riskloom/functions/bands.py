"""Banding (P10–P15) and the named transforms of raking margins (P16 value
map, P17 identity)."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.functions.columns import col, strip_quotes


def _left_closed(v: Column, edges, labels, lower=None, upper=None) -> Column:
    """CASE over left-closed intervals ``[edges[i], edges[i+1])``.
    NULL is tested first so it never falls into the ELSE branch."""
    expr = F.lit(None).cast("string")
    # Build from the top interval down so the first matching WHEN wins.
    bounds = list(zip(edges[:-1], edges[1:], labels))
    out = None
    for lo, hi, lab in bounds:
        cond = (v >= F.lit(lo)) & (v < F.lit(hi))
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return F.when(v.isNull(), expr).otherwise(out.otherwise(expr))


def age_band(c: Column | str = "DrivAge") -> Column:
    """P10: ``<20, 20s … 60s, 70+`` (left-closed); NULL stays NULL."""
    v = col(c).cast("double")
    e = S.AGE_EDGES
    out = F.when(v.isNull(), F.lit(None).cast("string")).when(v < e[0], S.AGE_BANDS[0])
    for i in range(1, len(e)):
        out = out.when(v < e[i], S.AGE_BANDS[i])
    return out.otherwise(S.AGE_BANDS[-1])


def bonus_band(c: Column | str = "BonusMalus") -> Column:
    """BonusMalus bands, en-dash labels, outside [0, 1e9) -> NULL."""
    return _left_closed(col(c).cast("double"), S.BONUS_EDGES, S.BONUS_LABELS)


def vehage_band(c: Column | str = "VehAge") -> Column:
    """Vehicle-age bands."""
    return _left_closed(col(c).cast("double"), S.VEHAGE_EDGES, S.VEHAGE_LABELS)


def factor_bands(prefix: str = "band_") -> list[Column]:
    """The five band columns together."""
    return [
        age_band("DrivAge").alias(prefix + "DrivAge"),
        bonus_band("BonusMalus").alias(prefix + "BonusMalus"),
        vehage_band("VehAge").alias(prefix + "VehAge"),
        col("Area").alias(prefix + "Area"),
        strip_quotes("VehGas").alias(prefix + "VehGas"),
    ]


def stat_age_band(name: Column | str) -> Column:
    """First run of digits of a statistics age label -> age band;
    no digits -> NULL.  (A label like "20세 미만" parses as 20 -> ``20s``.)"""
    digits = F.regexp_extract(col(name), r"(\d+)", 1)
    lo = F.when(digits != "", digits.cast("int"))
    return age_band(lo)


def value_map(c: Column | str, mapping: dict) -> Column:
    """Replace by mapping; unmapped -> NULL."""
    if not mapping:
        return F.lit(None).cast("string")
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return F.try_element_at(m, col(c).cast("string"))


def identity(c: Column | str) -> Column:
    """P17."""
    return col(c)


def transformed(name: str, c: Column | str, spec: dict) -> Column:
    """The named transform of a raking margin, as a string level."""
    match name:
        case "age_band":
            level = age_band(c)
        case "value_map":
            level = value_map(c, spec.get("map", {}))
        case "identity":
            level = identity(c)
        case _:
            raise KeyError(f"no transform is called {name!r}")
    return level.cast("string")


def band_order_rows() -> list[tuple[str, str, int]]:
    """(feature, band, ord) rows of the fixed display order."""
    return [(f, b, i) for f in S.FACTORS for i, b in enumerate(S.BAND_ORDER[f])]
