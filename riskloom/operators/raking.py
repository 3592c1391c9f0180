"""Re-weighting to population margins (G01–G04) and the margin builders
from published statistics rows (A14–A17).

A raked weight is the base weight times one factor per margin, and a factor
depends on the row's level alone.  So the state of the iteration is one small
map per margin (levels named by the target), never a weight per row: rows are
collapsed once to the combinations of their levels, and a step is a grouped
sum over that (distributed) cell table.  The finished factors go back to the
rows as map lookups, without a join.
"""
from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.functions.bands import stat_age_band, transformed
from riskloom.functions.columns import round_dp, weight_product

Factors = dict[str, dict[str, float]]


def _factor(level: Column, factors: dict[str, float]) -> Column:
    """A level's factor; 1 for a level the target does not name (or NULL)."""
    pairs = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in factors.items()))
    return F.coalesce(F.try_element_at(pairs, F.coalesce(level.cast("string"), F.lit(""))), F.lit(1.0))


def _raked(weight: Column, factors: Factors, levels: dict[str, Column]) -> Column:
    return reduce(lambda w, m: w * _factor(levels[m], factors[m]), factors, weight)


def margin_factors(cells: DataFrame, targets: dict[str, dict[str, float]], max_iter: int,
                   tol: float) -> Factors:
    """Iterative proportional fitting over ``cells`` (one string column per
    margin and ``_w``).  A margin's step sums the current weight per level and
    rescales each named level to its share; a pass that moved no share by
    ``tol`` or more ends the loop.  Only sums per named level are collected."""
    factors: Factors = {m: dict.fromkeys(t, 1.0) for m, t in targets.items()}
    levels = {m: F.col(f"`{m}`") for m in targets}
    for _ in range(max_iter):
        gaps = [0.0]
        for m, target in targets.items():
            named = F.when(levels[m].isin(list(target)), levels[m])
            held = {r["level"]: r["w"] or 0.0 for r in
                    cells.groupBy(named.alias("level")).agg(F.sum(_raked(F.col("_w"), factors, levels)).alias("w"))
                    .collect()}
            whole = sum(held.values())
            for level, share in target.items():
                if held.get(level, 0.0) > 0 and whole > 0:
                    gaps.append(abs(share - held[level] / whole))
                    factors[m][level] *= share * whole / held[level]
        if max(gaps) < tol:
            break
    return factors


def rake(df: DataFrame, target_margins: dict[str, dict], weight_col: str | None = None,
         max_iter: int = S.RAKING_MAX_ITER, tol: float = S.RAKING_TOL,
         out: str = "rake_weight") -> DataFrame:
    """IPF weights (mean 1) as column ``out``.  Margins without a target
    or without their column are skipped (F08); none left -> the base weight
    divided by its mean."""
    base = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    targets = {c: {str(k): float(v) for k, v in t.items()}
               for c, t in target_margins.items() if t and c in df.columns}
    cells = df.groupBy(*[F.col(f"`{c}`").cast("string").alias(c) for c in targets]).agg(
        F.sum(base).alias("_w"), F.count(F.lit(1)).alias("_n")).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    try:
        factors = margin_factors(cells, targets, max_iter, tol)
        total = cells.agg(F.sum(_raked(F.col("_w"), factors, {m: F.col(f"`{m}`") for m in targets})).alias("w"),
                          F.sum("_n").alias("n")).first()
    finally:
        cells.unpersist()
    mean = total["w"] / total["n"] if total["n"] and total["w"] else 1.0
    # Each row looks its factors up
    weight = _raked(base, factors, {m: F.col(f"`{m}`") for m in targets})
    return df.withColumn(out, weight / F.lit(mean))


def post_stratify(df: DataFrame, column: str, targets: dict[str, float],
                  weight_col: str | None = None, out: str = "rake_weight", **kw) -> DataFrame:
    """One margin: IPF on a single column (``share_target / share_observed``
    per level, then divided by the mean)."""
    return rake(df, {column: targets}, weight_col, out=out, **kw)


DEFAULT_CONFIG = {
    "enabled": True,
    "max_iter": S.RAKING_MAX_ITER,
    "tol": S.RAKING_TOL,
    "target_margins": {"Gender": S.GENDER_TARGET, "DrivAge": S.DRIVAGE_TARGET},
    "datasets": S.RAKING_DATASETS,
}


def with_margins(df: DataFrame, dataset: str, cfg: dict, prefix: str) -> tuple[DataFrame, dict[str, dict]]:
    """``df`` with one column ``prefix + margin`` per margin that the
    configuration maps for ``dataset`` (named transforms P10, P16, P17), and
    the targets under those names.  A dataset that is not configured, a source
    column that ``df`` lacks and a margin without a target are errors."""
    mapping = cfg.get("datasets", {}).get(dataset) or {}
    targets = cfg.get("target_margins", {})
    problems = [] if mapping else [f"no raking margins are configured for dataset {dataset!r}"]
    problems += [f"margin {m!r} of {dataset!r} needs column {src!r}" for m, (src, _, _) in mapping.items()
                 if src not in df.columns]
    problems += [f"margin {m!r} of {dataset!r} has no target shares" for m in mapping if not targets.get(m)]
    if problems:
        raise KeyError("; ".join(problems))
    mapped = {prefix + m: transformed(name, F.col(src), spec) for m, (src, name, spec) in mapping.items()}
    return df.withColumns(mapped), {prefix + m: targets[m] for m in mapping}


def rake_from_config(df: DataFrame, cfg: dict = DEFAULT_CONFIG, dataset: str | None = None,
                     out: str = "rake_weight") -> DataFrame:
    """Disabled -> unit weights; else G02 (with a dataset) and G01.  The
    mapped margin columns are not kept."""
    if not cfg.get("enabled", False):
        return df.withColumn(out, F.lit(1.0))
    options = {"max_iter": int(cfg.get("max_iter", S.RAKING_MAX_ITER)), "tol": float(cfg.get("tol", S.RAKING_TOL))}
    if dataset is None:
        return rake(df, cfg.get("target_margins", {}), out=out, **options)
    mapped, targets = with_margins(df, dataset, cfg, "__margin_")
    return rake(mapped, targets, out=out, **options).drop(*targets)


def training_weight(df: DataFrame, cfg: dict | None = DEFAULT_CONFIG, dataset: str | None = "fremtpl2",
                    base_weight: str | None = None, out: str = "weight") -> DataFrame:
    """Base weight × raking weight (P19), re-raked on this subset (each
    subset gets mean-1 raking weights).  No config and no base -> no weight
    column is added."""
    raked = df if cfg is None else rake_from_config(df, cfg, dataset, out="__rw")
    base = None if base_weight is None else F.col(base_weight).cast("double")
    weight = weight_product(base, None if cfg is None else "__rw")
    return df if weight is None else raked.withColumn(out, weight).drop("__rw")


# ------------------------------------------------------------- margin builders

def read_stat_rows_checked(rows: DataFrame) -> DataFrame:
    """S05 error signal: a row carrying ``errMsg`` means the source returned
    an error object instead of a list."""
    if "errMsg" in rows.columns:
        bad = rows.filter(F.col("errMsg").isNotNull()).select("errMsg").limit(1).collect()
        if bad:
            raise RuntimeError(f"statistics source error: {bad[0][0]}")
    return rows


def _single(name: str, wanted: Column) -> Column:
    """the count of the one row where ``wanted`` holds; NULL if there is
    none, an error if there are several."""
    return F.when(F.count_if(wanted) > 1, F.raise_error(F.lit(f"several rows for {name}")).cast("long")).otherwise(
        F.max(F.when(wanted, F.col("DT").cast("long"))))


def gender_shares(rows: DataFrame) -> DataFrame:
    """``Male``/``Female`` share of licence holders (3 dp) from the
    total row of each sex (F06)."""
    totals = F.col("C1_NM") == S.STAT_TOTAL
    g = rows.agg(*[_single(f"the total of {sex}", totals & (F.col("C2_NM") == code)).alias(sex)
                   for sex, code in (("Male", S.STAT_MALE), ("Female", S.STAT_FEMALE))])
    both = F.col("Male") + F.col("Female")
    return g.select(F.explode(F.array(*[
        F.struct(F.lit("Gender").alias("margin"), F.lit(sex).alias("level"),
                 round_dp(F.try_divide(F.col(sex).cast("double"), both), 3).alias("share"))
        for sex in ("Male", "Female")])).alias("r")).select("r.*")


def age_shares(rows: DataFrame) -> DataFrame:
    """Driver-age band shares (3 dp) over the licence-type total rows;
    the rounding residual goes to the largest band (first in band order on
    ties)."""
    spark = rows.sparkSession
    bands = spark.createDataFrame([(b, i) for i, b in enumerate(S.AGE_BANDS)], "level string, ord int")
    age = (rows.filter((F.col("C2_NM") == S.STAT_TOTAL) & (F.col("C1_NM") != S.STAT_TOTAL))
               .withColumn("level", stat_age_band("C1_NM"))
               .filter(F.col("level").isNotNull())
               .groupBy("level").agg(F.sum(F.col("DT").cast("long")).alias("dt")))
    j = F.broadcast(bands).join(age, "level", "left").withColumn("dt", F.coalesce("dt", F.lit(0)))
    whole = Window.partitionBy(F.lit(1))
    j = j.withColumn("prop", round_dp(F.try_divide(F.col("dt").cast("double"), F.sum("dt").over(whole)), 3))
    j = j.withColumn("residual", round_dp(F.lit(1.0) - F.sum("prop").over(whole), 3))
    j = j.withColumn("rk", F.row_number().over(whole.orderBy(F.col("prop").desc(), F.col("ord"))))
    share = F.when((F.col("rk") == 1) & (F.col("residual") != 0),
                   round_dp(F.col("prop") + F.col("residual"), 3)).otherwise(F.col("prop"))
    return j.select(F.lit("DrivAge").alias("margin"), "level", share.alias("share"))


def vehicle_shares(rows: DataFrame) -> DataFrame:
    """Vehicle-type shares of all registrations and use shares of
    passenger cars (4 dp, no residual step)."""
    cells = {"total": (S.VEHICLE_ALL, S.STAT_TOTAL), "ptotal": (S.VEHICLE_ALL, S.PASSENGER)}
    cells |= {f"t{i}": (S.VEHICLE_ALL, t) for i, t in enumerate(S.VEHICLE_TYPES)}
    cells |= {f"u{i}": (u, S.PASSENGER) for i, u in enumerate(S.PASSENGER_USES)}
    g = rows.agg(*[_single(f"{itm} / {c2}", (F.col("ITM_NM") == itm) & (F.col("C2_NM") == c2)).alias(name)
                   for name, (itm, c2) in cells.items()])
    shares = [("vehicle_type", t, f"t{i}", "total") for i, t in enumerate(S.VEHICLE_TYPES)]
    shares += [("passenger_use", u, f"u{i}", "ptotal") for i, u in enumerate(S.PASSENGER_USES)]
    return g.select(F.explode(F.array(*[
        F.struct(F.lit(margin).alias("margin"), F.lit(level).alias("level"),
                 round_dp(F.try_divide(F.col(part).cast("double"), F.col(whole)), 4).alias("share"))
        for margin, level, part, whole in shares])).alias("r")).select("r.*")


def all_margins(gender_rows: DataFrame, age_rows: DataFrame, vehicle_rows: DataFrame) -> DataFrame:
    """Every margin for one reference year as one ``(margin, level,
    share)`` table."""
    return (gender_shares(read_stat_rows_checked(gender_rows))
            .unionByName(age_shares(read_stat_rows_checked(age_rows)))
            .unionByName(vehicle_shares(read_stat_rows_checked(vehicle_rows))))
