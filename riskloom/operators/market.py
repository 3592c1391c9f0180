"""Market statistics, histogram, cohorts and rating-factor frequencies
(A08–A11, D05, D07–D09, F05, F07, U01)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.functions.bands import age_band, band_order_rows, factor_bands
from riskloom.functions.columns import cohort_label, finite, floor_at, median_ratio, round_dp
from riskloom.operators.quantiles import counted_quantiles, pivot_quantiles, value_counts
from riskloom.session import broadcast_if_small, cut_lineage


def band_order(spark) -> DataFrame:
    """D08 dimension: ``(feature, band, ord, title)`` — 30 fixed rows."""
    rows = [(f, b, o, S.FACTOR_TITLES[f]) for f, b, o in band_order_rows()]
    return spark.createDataFrame(rows, "feature string, band string, ord int, title string")


def factor_frequency(df: DataFrame, claim_col: str = S.CLAIM_NB,
                     exposure_col: str = S.EXPOSURE) -> DataFrame:
    """Per rating factor and band, ``n`` and ``Σclaims / Σmax(exposure,
    1e-6)`` (4 dp).  Bands outside the fixed order (NULL, unknown) are
    dropped by the inner join with the 30-row order table (D08).

    Plan: one scan → unpivot of the five band columns (U01, an Expand) →
    one partial+final hash aggregate on (feature, band) → broadcast join."""
    cn = F.coalesce(F.col(claim_col).cast("double"), F.lit(0.0)).alias("_cn")
    ex = floor_at(F.col(exposure_col).cast("double"), S.EXPOSURE_FLOOR).alias("_ex")
    wide = df.select(cn, ex, *[b.alias(f) for b, f in zip(factor_bands(), S.FACTORS)])
    long = wide.unpivot(["_cn", "_ex"], S.FACTORS, "feature", "band")
    agg = (long.groupBy("feature", "band")
               .agg(F.count(F.lit(1)).alias("n"), F.sum("_cn").alias("_claims"),
                    F.sum("_ex").alias("_exp")))
    order = F.broadcast(band_order(df.sparkSession))
    # ``ord`` carries the fixed display order (sort by feature, ord).
    return (agg.join(order, ["feature", "band"])
               .select("feature", "title", "band", "ord", F.col("n").cast("long").alias("n"),
                       round_dp(F.col("_claims") / F.col("_exp"), 4).alias("frequency")))


MARKET_PROBS = {"q10": 0.10, "q25": 0.25, "median": 0.50, "q75": 0.75, "q90": 0.90, "p99": 0.99}


def market_summary(market: DataFrame, value: str = "premium") -> DataFrame:
    """``n, mean, median, min, max, p99, q10, q25, q50, q75, q90`` of the
    finite market values (F05), rounded to 2 dp; ``p99`` is the histogram's
    upper clip (``min + 1`` when p99 <= min).  Empty -> one row, n = 0.

    The market is collapsed to (value, count) once; moments and exact
    quantiles both come from that table."""
    counts = value_counts(market, value).filter(finite("_v"))
    n = F.sum("_c")
    moments = counts.agg(F.coalesce(n, F.lit(0)).alias("n"), F.try_divide(F.sum(F.col("_v") * F.col("_c")), n).alias("mean"),
                         F.min("_v").alias("min"), F.max("_v").alias("max"))
    qs = pivot_quantiles(counted_quantiles(counts, MARKET_PROBS), [], list(MARKET_PROBS))
    one = F.lit(1)
    j = moments.withColumn("_k", one).join(qs.withColumn("_k", one), "_k", "left")
    r2 = lambda c: round_dp(c, 2)
    p99 = F.when(F.col("p99") <= F.col("min"), F.col("min") + 1.0).otherwise(F.col("p99"))
    return j.select(F.col("n").cast("long").alias("n"), r2("mean").alias("mean"),
                    r2("median").alias("median"), r2("min").alias("min"), r2("max").alias("max"),
                    round_dp(p99, 2).alias("p99"), r2("q10").alias("q10"), r2("q25").alias("q25"),
                    r2("median").alias("q50"), r2("q75").alias("q75"), r2("q90").alias("q90"))


def histogram_range(market: DataFrame, value: str = "premium") -> tuple[float, float, float, float] | None:
    """``(lo, hi, first, last)`` of the A09 histogram: values are clipped to
    ``[lo, hi]`` = [min, exact p99] (``hi = lo + 1`` when p99 <= min) and the
    equal-width edges span the clipped data, ``[lo, min(max, hi)]`` — one
    value only: ``±0.5`` around it, as NumPy does.  Scalars only; None when
    empty."""
    counts = value_counts(market, value).filter(finite("_v"))
    ends = counts.agg(F.min("_v").alias("lo"), F.max("_v").alias("mx")).first()
    lo, mx = ends["lo"], ends["mx"]
    if lo is None:
        return None
    hi = counted_quantiles(counts, {"p99": 0.99}).first()["q_value"]
    if hi <= lo:
        hi = lo + 1.0
    first, last = lo, min(mx, hi)
    if first == last:
        first, last = first - 0.5, last + 0.5
    return float(lo), float(hi), float(first), float(last)


def histogram_edges(lo: float, hi: float, bins: int) -> list[float]:
    """``bins + 1`` equal-width edges, computed as ``numpy.linspace`` does
    (``lo + i * step``, last edge exactly ``hi``)."""
    step = (hi - lo) / bins
    return [lo + i * step for i in range(bins)] + [hi]


def with_bin(df: DataFrame, v, lo: float, hi: float, bins: int, out: str = "bin",
             first: float | None = None, last: float | None = None) -> DataFrame:
    """D07 / A09 bin of a value: ``x`` = value clipped to ``[lo, hi]``; bin
    ``i`` holds ``edge_i <= x < edge_i+1`` over the edges of ``[first, last]``
    (default ``[lo, hi]``), the top edge in the last bin, values below the
    first edge in bin 0 — the bins of ``numpy.histogram``.  The index is
    arithmetic, then moved by one where rounding put it across an edge."""
    first = lo if first is None else first
    last = hi if last is None else last
    x = F.least(F.greatest(v, F.lit(lo)), F.lit(hi))
    step = (last - first) / bins
    guess = F.least(F.greatest(F.floor((x - F.lit(first)) / F.lit(step)), F.lit(0)), F.lit(bins - 1))

    def edge(i):
        return F.when(i >= bins, F.lit(last)).otherwise(F.lit(first) + i.cast("double") * F.lit(step))

    moved = F.when((guess > 0) & (x < edge(guess)), guess - 1).when(
        (guess < bins - 1) & (x >= edge(guess + 1)), guess + 1).otherwise(guess)
    return df.withColumn(out, moved.cast("int"))


def market_histogram(market: DataFrame, value: str = "premium", bins: int = 30) -> DataFrame:
    """``bin, lo_edge, hi_edge, count`` over ``[min, p99]`` with values
    above p99 in the last bin; empty bins kept (left join from the bin
    sequence).  Σcount = n; edges are ``bins + 1`` values (2 dp)."""
    bins = max(5, int(bins))
    spark = market.sparkSession
    rng = histogram_range(market, value)
    if rng is None:
        return spark.createDataFrame([], "bin int, lo_edge double, hi_edge double, count long")
    lo, hi, first, last = rng
    m = market.select(F.col(value).cast("double").alias("v")).filter(finite("v"))
    counts = with_bin(m, F.col("v"), lo, hi, bins, first=first, last=last).groupBy("bin").agg(
        F.count(F.lit(1)).alias("count"))
    e = histogram_edges(first, last, bins)
    seq = spark.createDataFrame([(i, e[i], e[i + 1]) for i in range(bins)],
                                "bin int, lo_edge double, hi_edge double")
    return (seq.join(F.broadcast(counts), "bin", "left")
               .select("bin", round_dp("lo_edge", 2).alias("lo_edge"),
                       round_dp("hi_edge", 2).alias("hi_edge"),
                       F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def market_position(quotes: DataFrame, market: DataFrame, premium_col: str = "premium",
                    value: str = "premium", bins: int = 30) -> DataFrame:
    """Histogram bin of each quote's premium (values below the
    first edge -> bin 0, above the top edge -> last bin)."""
    bins = max(5, int(bins))
    rng = histogram_range(market, value)
    if rng is None:
        return quotes.withColumn("market_bin", F.lit(None).cast("int"))
    lo, hi, first, last = rng
    return with_bin(quotes, F.col(premium_col).cast("double"), lo, hi, bins, "market_bin",
                    first=first, last=last)


def cohort_stats(df: DataFrame, premium_col: str = "premium", age_col: str = "DrivAge",
                 area_col: str = "Area") -> DataFrame:
    """A10: count/mean/median of the premium by (age_band, Area), by
    age_band and overall — ``level, age_band, area, count, mean, median``.

    One Expand (the grouping sets) collapses to (cohort, premium, count); the
    moments and the exact medians both come from that table.  Grouped levels
    drop rows whose data key is NULL; the overall level keeps every row (its
    count is the row count)."""
    base = df.select(age_band(age_col).alias("ab"), F.col(area_col).cast("string").alias("ar"),
                     F.col(premium_col).cast("double").alias("pp"))
    lv = F.explode(F.array(
        F.struct(F.lit("cell").alias("level"), F.col("ab").alias("age_band"), F.col("ar").alias("area")),
        F.struct(F.lit("age").alias("level"), F.col("ab").alias("age_band"),
                 F.lit(None).cast("string").alias("area")),
        F.struct(F.lit("overall").alias("level"), F.lit(None).cast("string").alias("age_band"),
                 F.lit(None).cast("string").alias("area"))))
    ex = (base.select(lv.alias("g"), "ab", "ar", "pp")
              .select("g.level", "g.age_band", "g.area", "ab", "ar", "pp")
              .filter((F.col("level") == "overall")
                      | ((F.col("level") == "age") & F.col("ab").isNotNull())
                      | ((F.col("level") == "cell") & F.col("ab").isNotNull() & F.col("ar").isNotNull())))
    keys = ["level", "age_band", "area"]
    counts = value_counts(ex, "pp", keys)
    priced = F.sum(F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(F.lit(0)))
    moments = counts.groupBy(*keys).agg(
        F.when(F.col("level") == "overall", F.sum("_c")).otherwise(priced).alias("count"),
        F.try_divide(F.sum(F.col("_v") * F.col("_c")), priced).alias("mean"))
    med = pivot_quantiles(counted_quantiles(counts, {"median": 0.5}, keys), keys, ["median"])
    on = [moments[k].eqNullSafe(med[k]) for k in keys]
    return (moments.join(med, on[0] & on[1] & on[2], "left")
                   .select(*[moments[k] for k in keys], F.col("count").cast("long").alias("count"),
                           round_dp("mean", 2).alias("mean"), round_dp("median", 2).alias("median")))


def cohort_lookup(rows: DataFrame, stats: DataFrame, age_col: str = "DrivAge",
                  area_col: str = "Area", min_count: int = S.COHORT_MIN_COUNT) -> DataFrame:
    """Each row's cohort — cell if it has ``>= min_count`` rows, else
    its age band if large enough, else the overall market (no minimum).
    Adds ``cohort_group, cohort_level, cohort_count, cohort_mean,
    cohort_median``.

    The statistics are written once and joined by cell and by band: broadcast
    if small when checked, else a shuffle join that splits a hot cell.  The one
    overall row becomes three literals (no constant-key join)."""
    st = cut_lineage(stats.select("level", "age_band", "area", F.col("count").cast("long").alias("count"),
                                  F.col("mean").cast("double").alias("mean"), F.col("median").cast("double").alias("median")))
    cell = broadcast_if_small(st.where("level = 'cell'").select(
        F.col("age_band").alias("_cab"), F.col("area").alias("_car"), F.col("count").alias("_cc"),
        F.col("mean").alias("_cm"), F.col("median").alias("_cmed")))
    age = broadcast_if_small(st.where("level = 'age'").select(
        F.col("age_band").alias("_aab"), F.col("count").alias("_ac"), F.col("mean").alias("_am"), F.col("median").alias("_amed")))
    ov = st.where("level = 'overall'").first()
    r = rows.withColumn("_ab", age_band(age_col)).withColumn("_ar", F.col(area_col).cast("string"))
    r = (r.join(cell, (F.col("_ab") == F.col("_cab")) & (F.col("_ar") == F.col("_car")), "left")
          .join(age, F.col("_ab") == F.col("_aab"), "left")
          .withColumns({"_oc": F.lit(ov["count"] if ov else None).cast("long"),
                        "_om": F.lit(ov["mean"] if ov else None).cast("double"),
                        "_omed": F.lit(ov["median"] if ov else None).cast("double")}))
    use_cell = F.col("_cc") >= min_count
    use_age = F.col("_ac") >= min_count
    has_ov = F.col("_oc").isNotNull()
    level = (F.when(use_cell, "cell").when(use_age, "age").when(has_ov, "overall"))
    pick = lambda a, b, c: F.when(use_cell, F.col(a)).when(use_age, F.col(b)).otherwise(F.col(c))
    out = r.withColumns({
        "cohort_level": level,
        "cohort_group": F.when(level.isNotNull(), cohort_label(level, F.col("_ab"), F.col("_ar"))),
        "cohort_count": pick("_cc", "_ac", "_oc"),
        "cohort_mean": pick("_cm", "_am", "_om"),
        "cohort_median": pick("_cmed", "_amed", "_omed"),
    })
    drop = ["_ab", "_ar", "_cab", "_car", "_cc", "_cm", "_cmed", "_aab", "_ac", "_am", "_amed",
            "_oc", "_om", "_omed"]
    return out.drop(*drop)


def cohort_premium_ratio(rows: DataFrame, premium_col: str = "premium") -> DataFrame:
    """P24 on a cohort lookup: premium / cohort median."""
    return rows.withColumn("median_ratio", median_ratio(premium_col, "cohort_median"))


def own_bands(rows: DataFrame, freq: DataFrame, id_col: str = S.ID) -> DataFrame:
    """Each row's band per factor joined to the market frequency of
    that band — long table ``id, feature, band, ord,
    n, frequency``.  ``freq`` is the 30-row A11 table (broadcast)."""
    wide = rows.select(id_col, *[b.alias(f) for b, f in zip(factor_bands(), S.FACTORS)])
    long = wide.unpivot([id_col], S.FACTORS, "feature", "band")
    # ``freq`` is the A11 table: at most 30 rows (inner join with the order).
    fq = F.broadcast(freq.select("feature", "band", "ord", "n", "frequency"))
    return long.join(fq, ["feature", "band"], "left")
