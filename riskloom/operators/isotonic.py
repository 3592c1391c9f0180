"""Isotonic recalibration (M11, M12) without a single task or the driver
holding the points.

* Equal predictions are pooled first (summed weight, weighted mean: the same
  fit), so a prediction that half of the rows share is one point.
* The points are cut into ranges of the prediction; every task pools the
  violators of its own range in one pass (``_pooled``).
* What is left are violations between neighbouring ranges.  Each round looks at
  the ends of the ranges (one row per range), pairs neighbours whose boundary
  violates, and pools the pairs; a block that reaches over the boundary belongs
  to the lower range, the rest of the upper range stays where it is, so a range
  never grows.  Ranges whose boundaries hold are not touched.  A range that is
  swallowed disappears and its neighbours meet in the next round, so even
  wholly reversed data are done in about log2(ranges) rounds.
* The fitted map is a table of points.  Applying it orders the distinct
  predictions together with the points over ranges and joins the values back.

The driver sees one row per range.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import finite
from riskloom.session import cut_lineage, drop_scratch, write_scratch

_POOL = "part int, lo double, hi double, wy double, w double"


@dataclass
class IsotonicFit:
    """``points``: ``x, y``, the ends of the pools: linear between
    neighbouring points, constant beyond the first and the last."""
    points: DataFrame


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pool adjacent violators over rows ordered by (group, lo); groups of
    neighbouring rows are independent.  A pool keeps the range of its first row."""
    group, stack = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        for k in range(0, len(stack), 10_000):
            cols = list(zip(*stack[k:k + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.float64()) for c in cols[1:]]],
                                             ["part", "lo", "hi", "wy", "w"])

    for b in batches:
        for g, part, lo, hi, wy, w in zip(*[b.column(c).to_pylist() for c in ("grp", "part", "lo", "hi", "wy", "w")]):
            if g != group:
                yield from flush()
                group, stack = g, []
            while stack and stack[-1][3] * w > wy * stack[-1][4]:          # mean before > mean here
                part, lo, _, wy0, w0 = stack.pop()
                wy, w = wy + wy0, w + w0
            stack.append((part, lo, hi, wy, w))
    yield from flush()


def pools(points: DataFrame) -> DataFrame:
    """``part, lo, hi, wy, w`` of the isotonic fit of ``x, wy, w`` (distinct
    ``x``)."""
    spark = points.sparkSession
    ranged = points.repartitionByRange("x").withColumn("part", F.spark_partition_id()).sortWithinPartitions("x")
    own = ranged.select(F.lit(0).alias("grp"), "part", F.col("x").alias("lo"), F.col("x").alias("hi"), "wy", "w")
    table, path = write_scratch(own.mapInArrow(_pooled, _POOL), "isotonic")
    mean = F.col("wy") / F.col("w")
    while True:
        ends = table.groupBy("part").agg(F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last")).collect()
        ends.sort(key=lambda r: r["part"])
        pairs, i = {}, 0
        while i + 1 < len(ends):
            if ends[i]["last"] > ends[i + 1]["first"]:
                pairs[ends[i]["part"]] = pairs[ends[i + 1]["part"]] = ends[i]["part"]
                i += 1
            i += 1
        if not pairs:
            return table
        grouped = spark.createDataFrame(list(pairs.items()), "part int, grp int")          # at most a row per range
        meet = table.join(F.broadcast(grouped), "part").repartition("grp").sortWithinPartitions("grp", "lo")
        merged = meet.select("grp", "part", "lo", "hi", "wy", "w").mapInArrow(_pooled, _POOL)
        rest = table.join(F.broadcast(grouped), "part", "left_anti")
        (table, path), old = write_scratch(rest.unionByName(merged), "isotonic"), path
        drop_scratch(spark, old)


def fit_isotonic(df: DataFrame, pred: str, y: str, weight: str | None = None) -> IsotonicFit:
    """Monotone map prediction -> actual; constant beyond the ends
    (clip); labels are non-negative so fitted values are too.  Rows without a
    finite prediction, an actual value or a positive weight take no part."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    d = df.select(F.col(pred).cast("double").alias("x"), F.col(y).cast("double").alias("_y"), w.alias("_w"))
    d = d.filter(finite("x") & F.col("_y").isNotNull() & (F.col("_w") > 0))
    # -0.0 and 0.0 are one prediction
    points = d.groupBy((F.col("x") + 0.0).alias("x")).agg(F.sum(F.col("_w") * F.col("_y")).alias("wy"), F.sum("_w").alias("w"))
    fitted = pools(points)
    ends = fitted.select((F.col("wy") / F.col("w")).alias("y"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"))
    return IsotonicFit(cut_lineage(ends.select("x", "y")))


def apply_isotonic(model: IsotonicFit, df: DataFrame, pred: str, out: str = "calibrated") -> DataFrame:
    """Calibrated value of each prediction (linear between fitted
    points, constant outside); NULL where the prediction is not finite or
    nothing was fitted."""
    x = F.col(pred).cast("double") + 0.0
    asked = df.select(x.alias("_x")).filter(finite("_x")).distinct()
    known = model.points.select(F.col("x").alias("_x"), F.col("y").alias("_y"))
    values = known.unionByName(asked.withColumn("_y", F.lit(None).cast("double"))).groupBy("_x").agg(F.max("_y").alias("_y"))
    ranged = cut_lineage(values.repartitionByRange("_x").withColumn("_part", F.spark_partition_id()))
    point = F.when(F.col("_y").isNotNull(), F.struct("_x", "_y"))
    # Spark sums a frame that ends with the partition anew for every row, so what follows is looked for backwards
    up, down = (Window.partitionBy("_part").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("_x"), F.desc("_x")))
    lower, upper = (Window.partitionBy(F.lit(1)).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
                    for o in (F.asc("_part"), F.desc("_part")))                             # one row per range
    ends = ranged.groupBy("_part").agg(F.min(point).alias("first"), F.max(point).alias("last"))
    ends = ends.select("_part", F.last("last", True).over(lower).alias("_before"), F.last("first", True).over(upper).alias("_after"))
    near = ranged.withColumns({"_lo": F.last(point, True).over(up), "_hi": F.last(point, True).over(down)}).join(F.broadcast(ends), "_part")
    near = near.select("_x", F.coalesce("_lo", "_before").alias("lo"), F.coalesce("_hi", "_after").alias("hi"))
    x0, y0, x1, y1 = (F.col(c) for c in ("lo._x", "lo._y", "hi._x", "hi._y"))
    value = F.when(x0.isNull(), y1).when(x1.isNull() | (x0 == x1), y0).otherwise(
        y0 + (y1 - y0) * (F.col("_x") - x0) / (x1 - x0))
    mapped = cut_lineage(near.select("_x", value.alias(out)))
    return df.withColumn("_x", F.when(finite(pred), x)).join(mapped, "_x", "left").drop("_x")
