"""A range-partitioned market index for scoring many small batches.

``risk_percentile`` orders the whole market on every call.  A stream scores
many small batches against the same market, so the market is indexed once:

* distinct ``(value, count)`` rows are cut into value ranges by
  ``repartitionByRange`` and written to the shared checkpoint folder
  partitioned by range;
* a range table (one row per ``rows_per_range`` distinct values: lowest value,
  count before the range) stays on the driver.

A batch then needs only the ranges its quotes fall in: each quote gets its
range from the lowest values (``Bucketizer``, a JVM binary search), the
touched range partitions are read (partition pruning), and one window per
range counts the market values strictly below each distinct quoted value; the
range's offset completes the count, which comes back to the quotes by value.
Exact; the work per batch is bounded by the touched ranges, not the market,
and quotes that share a value do not meet in one task.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.functions.columns import finite
from riskloom.operators.ordered import market_counts
from riskloom.session import broadcast_if_small, cut_lineage, ensure_checkpoint_dir


@dataclass
class MarketIndex:
    path: str                 # Parquet, partitioned by ``range``: (_v, _c)
    ids: list[int]            # stored range ids of the non-empty ranges, in value order
    lows: list[float]         # lowest value of each of those ranges (ascending)
    offsets: list[int]        # market count before each of those ranges
    total: int                # market count


def build_market_index(market: DataFrame, value: str = "premium", n_ranges: int | None = None,
                       rows_per_range: int = 1_000_000) -> MarketIndex:
    """Index the finite market values once (written to the shared folder)."""
    spark = market.sparkSession
    counts = market_counts(market, value)
    if n_ranges is None:
        n_distinct = counts.count()
        n_ranges = max(1, -(-n_distinct // rows_per_range))
    path = f"{ensure_checkpoint_dir(spark)}/market-index-{uuid.uuid4().hex}"
    (counts.repartitionByRange(n_ranges, "_v").withColumn("range", F.spark_partition_id())
           .write.partitionBy("range").parquet(path))
    rows = sorted(spark.read.parquet(path).groupBy("range")
                  .agg(F.min("_v").alias("lo"), F.sum("_c").alias("c")).collect(),
                  key=lambda r: r["lo"])
    lows = [float(r["lo"]) for r in rows]
    cnt = [int(r["c"]) for r in rows]
    offsets = [0] + list(accumulate(cnt))[:-1]
    return MarketIndex(path, [int(r["range"]) for r in rows], lows, offsets, sum(cnt))


def indexed_percentile(rows: DataFrame, index: MarketIndex, value: str = "premium",
                       id_col: str = S.ID, out: str = "risk_percentile") -> DataFrame:
    """W03 against an indexed market: ``100 · count(m < v) / count(m)``."""
    spark = rows.sparkSession
    if index.total == 0 or not index.lows:
        return rows.withColumn(out, F.lit(None).cast("double"))
    splits = [float("-inf")] + index.lows[1:] + [float("inf")]
    q = rows.withColumn("_qv", F.col(value).cast("double"))
    ok = q.filter(finite("_qv"))
    bad = q.filter(~finite("_qv")).drop("_qv").withColumn(out, F.lit(None).cast("double"))
    if len(splits) > 2:
        ok = Bucketizer(splits=splits, inputCol="_qv", outputCol="_rb").transform(ok)
        ok = ok.withColumn("_rk", F.col("_rb").cast("int")).drop("_rb")
    else:
        ok = ok.withColumn("_rk", F.lit(0))
    ids = F.array(*[F.lit(i) for i in index.ids])
    ok = ok.withColumn("range", F.element_at(ids, F.col("_rk") + 1))
    ok = cut_lineage(ok)          # one micro-batch, read three times below
    touched = [r[0] for r in ok.select("range").distinct().collect()]
    market = spark.read.parquet(index.path).filter(F.col("range").isin(touched))
    off = F.element_at(F.array(*[F.lit(o) for o in index.offsets]).cast("array<bigint>"),
                       F.col("_rk") + 1)
    qs = ok.select("range", F.col("_qv").alias("_v"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_c"),
                   off.alias("_off")).distinct()
    ms = market.select("range", "_v", F.lit(1).alias("_kind"), F.col("_c").cast("long").alias("_c"),
                       F.lit(0).cast("long").alias("_off"))
    w = (Window.partitionBy("range").orderBy("_v", "_kind")
               .rowsBetween(Window.unboundedPreceding, -1))
    shares = cut_lineage(qs.unionByName(ms)
                         .withColumn("_below", F.coalesce(F.sum("_c").over(w), F.lit(0)) + F.col("_off"))
                         .filter(F.col("_kind") == 0)
                         .select(F.col("_v").alias("_qv"),
                                 (F.lit(100.0) * F.col("_below") / F.lit(float(index.total))).alias(out)))
    scored = ok.join(broadcast_if_small(shares), "_qv", "left").select(*rows.columns, out)
    return scored.unionByName(bad)
