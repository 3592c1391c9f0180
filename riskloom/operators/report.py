"""Diagnosis report over whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.functions.bands import factor_bands
from riskloom.functions.columns import coverage, gross_up, round_dp
from riskloom.operators.market import cohort_lookup
from riskloom.operators.market_index import indexed_percentile
from riskloom.operators.ordered import risk_percentile

DRIVER_TYPE = "array<struct<feature:string,effect:double>>"


def build_report(rows: DataFrame, market: DataFrame, premium_col: str = "premium",
                 market_col: str = "premium", id_col: str = S.ID,
                 loading: dict | None = None, drivers_col: str | None = None,
                 market_counted: bool = False, market_index=None) -> DataFrame:
    """X01 for every row: ``pure_premium`` (2 dp), ``risk_percentile``
    (1 dp, strict share of the market below), ``coverage`` struct from the
    unrounded percentile, ``drivers``, ``disclaimer`` and — only with a
    loading — ``estimated_gross_premium`` (2 dp).  With ``market_index``
    (a ``MarketIndex``) the percentile reads only the touched market ranges."""
    if market_index is not None:
        scored = indexed_percentile(rows, market_index, premium_col, id_col, out="_pct")
    else:
        scored = risk_percentile(rows, market, premium_col, market_col, out="_pct", counted=market_counted)
    drivers = F.col(drivers_col) if drivers_col else F.array().cast(DRIVER_TYPE)
    cols = {
        "pure_premium": round_dp(premium_col, 2),
        "risk_percentile": round_dp("_pct", 1),
        "coverage": coverage("_pct"),
        "drivers": drivers,
        "disclaimer": F.lit(S.DISCLAIMER),
    }
    if loading:
        cols["estimated_gross_premium"] = round_dp(gross_up(premium_col, **loading), 2)
    return scored.withColumns(cols).drop("_pct")


def band_map() -> "F.Column":
    """The five bands of a row as ``MAP<STRING,STRING>`` (D09 highlight)."""
    pairs = []
    for b, f in zip(factor_bands(), S.FACTORS):
        pairs += [F.lit(f), b]
    return F.create_map(*pairs)


def diagnose(rows: DataFrame, market: DataFrame, cohorts: DataFrame | None,
             premium_col: str = "premium", market_col: str = "premium", id_col: str = S.ID,
             loading: dict | None = None, drivers_col: str | None = None,
             min_count: int = S.COHORT_MIN_COUNT, market_counted: bool = False,
             market_index=None) -> DataFrame:
    """X02 over a whole table of policies or quotes: the report (X01), the
    cohort (D05, when cohort statistics exist) and the row's bands."""
    rep = build_report(rows, market, premium_col, market_col, id_col, loading, drivers_col,
                       market_counted, market_index)
    if cohorts is not None:
        rep = cohort_lookup(rep, cohorts, min_count=min_count)
        rep = rep.withColumn("cohort", F.when(F.col("cohort_level").isNotNull(), F.struct(
            F.col("cohort_group").alias("group"), F.col("cohort_level").alias("level"),
            F.col("cohort_count").alias("count"), F.col("cohort_mean").alias("mean"),
            F.col("cohort_median").alias("median")))).drop(
            "cohort_group", "cohort_level", "cohort_count", "cohort_mean", "cohort_median")
    return rep.withColumn("bands", band_map())


def flatten_report(rep: DataFrame, id_col: str = S.ID, extra: list | None = None) -> DataFrame:
    """Nested report -> flat columns (oracle comparison, CSV sinks), with
    ``extra`` expressions over the report."""
    cols = [F.col(id_col), "pure_premium", "risk_percentile",
            F.col("coverage.tier").alias("tier"), F.col("coverage.deductible").alias("deductible"),
            F.col("coverage.limit").alias("coverage_limit"), "disclaimer"]
    if "estimated_gross_premium" in rep.columns:
        cols.append("estimated_gross_premium")
    if "cohort" in rep.columns:
        cols += [F.col(f"cohort.{k}").alias(f"cohort_{k}") for k in ("group", "level", "count", "mean", "median")]
    if "bands" in rep.columns:
        cols += [F.col("bands")[f].alias(f"band_{f}") for f in S.FACTORS]
    return rep.select(*cols, *(extra or []))


def report_json(rep: DataFrame, id_col: str = S.ID) -> DataFrame:
    """One JSON document per row (non-ASCII kept as is)."""
    body = [c for c in rep.columns if c != id_col]
    return rep.select(F.col(id_col), F.to_json(F.struct(*body)).alias("report"))
