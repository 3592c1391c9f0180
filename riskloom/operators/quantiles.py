"""Exact quantiles (linear interpolation, as ``percentile`` / ``quantile_cont``
/ NumPy) computed without holding a whole group's values in one task.

Spark's exact ``percentile`` aggregate keeps a count per distinct value and
merges them in one buffer per group, which does not survive a group with
billions of distinct values.  Here every group is collapsed to ``(value,
count)`` first (map-side combine, so a hot value is one row), one running
count over ranges of ``(group, value)`` gives each value's ranks (a group of
any size spreads over many ranges), and the values that hold the wanted ranks
are picked by a join with a few targets per group.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import finite
from riskloom.operators.ordered import exclusive_prefix
from riskloom.session import broadcast_if_small, cut_lineage


def value_counts(df: DataFrame, value: str | Column, keys: list[str] | tuple = ()) -> DataFrame:
    """``keys…, _v, _c``: the distinct values of each group with their counts
    (NULL and non-finite values included), materialised once."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return cut_lineage(df.select(*keys, v.alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))


def counted_quantiles(counts: DataFrame, probs: dict[str, float], keys: list[str] | tuple = ()) -> DataFrame:
    """Long table ``keys…, q_name, q_value`` from ``value_counts``: the exact
    quantiles of the finite values (groups without any are absent)."""
    keys = list(keys)
    # NULL keys are told apart from every value by a flag that sorts with them
    flags = [f"_null_{k}" for k in keys]
    c = counts.filter(finite("_v")).withColumns({f: F.col(k).isNull() for f, k in zip(flags, keys)})
    order = [(x, False) for pair in zip(flags, keys) for x in pair] + [("_v", False)]
    ranked = cut_lineage(exclusive_prefix(c, order, {"c": F.col("_c")}).select(
        *keys, "_v", F.col("c_before").cast("long").alias("_from"), F.col("_c").cast("long").alias("_c")))
    groups = ranked.groupBy(*keys).agg(F.min("_from").alias("_first"), F.sum("_c").alias("_n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("q_name"), F.lit(float(q)).alias("q"))
                                 for name, q in probs.items()]))
    targets = groups.select(*[F.col(k).alias(f"_t_{k}") for k in keys], "_first", "_n", wanted.alias("_p")).select(
        "*", "_p.q_name", (F.col("_p.q") * (F.col("_n") - 1)).alias("_pos")).withColumn(
        "_r0", F.floor("_pos").cast("long")).withColumn("_r1", F.least(F.col("_r0") + 1, F.col("_n") - 1)).drop("_p")
    near = F.lit(True)
    for k in keys:
        near = near & ranked[k].eqNullSafe(targets[f"_t_{k}"])
    start = F.col("_from") - F.col("_first")

    def holds(rank: str) -> Column:
        return (start <= F.col(rank)) & (F.col(rank) < start + F.col("_c"))

    picked = ranked.join(broadcast_if_small(targets), near & (holds("_r0") | holds("_r1")))
    found = picked.groupBy(*keys, "q_name", "_pos", "_r0").agg(
        F.max(F.when(holds("_r0"), F.col("_v"))).alias("_v0"), F.max(F.when(holds("_r1"), F.col("_v"))).alias("_v1"))
    return found.select(*keys, "q_name",
                        (F.col("_v0") + (F.col("_pos") - F.col("_r0")) * (F.col("_v1") - F.col("_v0"))).alias("q_value"))


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float],
                    keys: list[str] | tuple = ()) -> DataFrame:
    """Long table ``keys…, q_name, q_value`` with the exact quantiles of
    ``value`` per group (NULL/NaN/inf values ignored; empty groups absent)."""
    return counted_quantiles(value_counts(df, value, keys), probs, keys)


def exact_quantile_values(df: DataFrame, value: str, probs: dict[str, float]) -> dict[str, float | None]:
    """Scalar quantiles of a whole column, as a small dict on the driver."""
    out: dict[str, float | None] = dict.fromkeys(probs)
    out.update({r["q_name"]: r["q_value"] for r in exact_quantiles(df, value, probs).collect()})
    return out


def pivot_quantiles(long_df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Long quantile table -> one column per quantile name (bounded names)."""
    aggs = [F.max(F.when(F.col("q_name") == nm, F.col("q_value"))).alias(nm) for nm in names]
    if keys:
        return long_df.groupBy(*keys).agg(*aggs)
    return long_df.agg(*aggs)
