"""Order-dependent operators at scale.

Global running sums (``ORDER BY`` without ``PARTITION BY``) put every row in
one task.  ``exclusive_prefix`` cuts the total order into ranges instead,
whatever the size:

* ``repartitionByRange`` on the composite order key (Spark's range
  partitioner: sampled bounds, JVM binary search; the tie-breaking id is part
  of the key, so one value holding a third of the rows is still split across
  ranges).  The rows are written with their range number to the shared folder
  (a reliable checkpoint): sampling never runs again, so ranges and offsets
  cannot drift apart, and a lost executor costs nothing;
* one window per range computes the in-range running sums;
* the totals of the ranges before it (one row per range, as many as the
  session's shuffle partitions) are joined in.

Nothing but single figures reaches the driver.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.functions.columns import finite
from riskloom.session import broadcast_if_small, cut_lineage

Order = list[tuple[str, bool]]  # (column, descending)


def exclusive_prefix(df: DataFrame, order: Order, sums: dict[str, Column] | None = None,
                     keys: list[str] | tuple = ()) -> DataFrame:
    """Add ``_rn`` (0-based row number in ``order``), ``_n`` (rows in all) and,
    for each ``name -> expr`` in ``sums``, ``name_before``: the sum of ``expr``
    over all rows strictly before this one, and ``name_total``.  ``order`` must
    be a total order (end it with a unique id).  With ``keys`` (without NULLs)
    every group has numbers and sums of its own; a group may spread over many
    ranges, and many groups share one."""
    sums, keys = sums or {}, list(keys)
    by = [F.col(k) for k in keys] + [F.col(c).desc() if desc else F.col(c).asc() for c, desc in order]
    ranged = cut_lineage(df.withColumns({f"_s_{k}": v.cast("double") for k, v in sums.items()})
                         .repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    per_range = ranged.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_cnt"), *[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums])
    every = Window.partitionBy(*(keys or [F.lit(1)]))
    earlier = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        "_part", *keys, F.coalesce(F.sum("_cnt").over(earlier), F.lit(0)).alias("_first"), F.sum("_cnt").over(every).alias("_n"),
        *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0.0)).alias(f"_o_{k}") for k in sums],
        *[F.sum(f"_t_{k}").over(every).alias(f"{k}_total") for k in sums])
    w = Window.partitionBy("_part", *keys).orderBy(*by)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # without keys one row per range: bounded by the number of shuffle partitions
    out = ranged.join(offsets if keys else F.broadcast(offsets), ["_part", *keys]).withColumn(
        "_rn", F.row_number().over(w) - 1 + F.col("_first"))
    for k in sums:
        out = out.withColumn(f"{k}_before", F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0.0)) + F.col(f"_o_{k}"))
    return out.drop("_part", "_first", *[f"_s_{k}" for k in sums], *[f"_o_{k}" for k in sums])


# ------------------------------------------------------------------ Gini

def gini_by(df: DataFrame, y: str, p: str, w: str | None = None, id_col: str = S.ID,
            keys: list[str] | tuple = ()) -> DataFrame:
    """Exposure-weighted normalised Gini of each group (of all rows
    without ``keys``) as ``keys…, gini_raw, gini_perfect, gini``.  Order by
    prediction descending (ties by id); ``cw = cumsum(w)/W``, ``cy =
    cumsum(y·w)/ΣYW``; trapezoid area minus 0.5, the curve starting at the
    first point; divided by the same quantity ordered by ``y``.  ``W <= 0`` or
    ``ΣYW <= 0`` -> 0; perfect = 0 -> 0.

    Along rows of equal ``y`` the second curve is a straight line, so it is
    drawn through one point per distinct ``y``."""
    keys = list(keys)
    wcol = F.col(w).cast("double") if w else F.lit(1.0)
    base = df.select(*keys, F.col(id_col).alias("_id"), F.col(y).cast("double").alias("_y"),
                     F.col(p).cast("double").alias("_p"), wcol.alias("_w")).withColumn("_yw", F.col("_y") * F.col("_w"))
    base = cut_lineage(base)
    under = F.col("_w") * (F.col("yw_before") + F.col("_yw") / 2)
    got = exclusive_prefix(base, [("_p", True), ("_id", False)], {"yw": F.col("_yw")}, keys)
    raw = got.groupBy(*keys).agg(F.sum(F.when(F.col("_rn") > 0, under)).alias("a"), F.sum("_w").alias("W"), F.sum("_yw").alias("YW"))
    levels = base.groupBy(*keys, "_y").agg(F.sum("_w").alias("_w"), F.sum("_yw").alias("_yw"),
                                           F.min_by("_w", "_id").alias("_w1"))
    best = exclusive_prefix(levels, [("_y", True)], {"yw": F.col("_yw")}, keys)
    start = F.when(F.col("_rn") == 0, F.col("_w1") * (F.col("_y") * F.col("_w1") / 2)).otherwise(F.lit(0.0))
    perfect = best.groupBy(*keys).agg(F.sum(under - start).alias("b"))
    one = keys or ["_k"]
    if not keys:
        raw, perfect = raw.withColumn("_k", F.lit(1)), perfect.withColumn("_k", F.lit(1))
    some = (F.col("W") > 0) & (F.col("YW") > 0)

    def scaled(a: str) -> Column:
        return F.coalesce(F.when(some, F.coalesce(F.col(a), F.lit(0.0)) / (F.col("W") * F.col("YW")) - 0.5), F.lit(0.0))

    out = raw.join(perfect, one).select(*keys, scaled("a").alias("gini_raw"), scaled("b").alias("gini_perfect"))
    return out.withColumn("gini", F.when(F.col("gini_perfect") != 0, F.col("gini_raw") / F.col("gini_perfect")).otherwise(0.0))


def gini_parts(df: DataFrame, y: str, p: str, w: str | None = None, id_col: str = S.ID) -> dict[str, float]:
    """W01 of all rows, as numbers on the driver."""
    return gini_by(df, y, p, w, id_col).first().asDict()


def normalized_gini(df: DataFrame, y: str, p: str, w: str | None = None, id_col: str = S.ID) -> DataFrame:
    """W01 as a one-row DataFrame ``gini_raw, gini_perfect, gini``."""
    return gini_by(df, y, p, w, id_col)


# ---------------------------------------------------- rank-first quantile bins

def rank_bins(df: DataFrame, p: str, n_bins: int, id_col: str = S.ID) -> DataFrame:
    """``bin`` = quantile bin of the rank (method "first", ties by id)
    of ``p``: ``greatest(ceil((rank-1)·q/(n-1)) - 1, 0)``; n = 1 -> 0."""
    pre = exclusive_prefix(df, [(p, False), (id_col, False)])
    place = F.ceil(F.try_divide(F.col("_rn").cast("double") * n_bins, F.col("_n") - 1)).cast("int") - 1
    return pre.withColumn("bin", F.greatest(F.coalesce(place, F.lit(0)), F.lit(0))).drop("_rn", "_n")


# ------------------------------------------------------------ risk percentile

def market_counts(market: DataFrame, market_value: str = "premium") -> DataFrame:
    """The market collapsed to ``(_v, _c)``: one row per distinct finite
    value with its multiplicity (a hot value becomes one row).  Precompute
    it once when many batches are scored against the same market."""
    return (market.select(F.col(market_value).cast("double").alias("_v")).filter(finite("_v"))
                  .groupBy("_v").agg(F.count(F.lit(1)).alias("_c")))


def risk_percentile(rows: DataFrame, market: DataFrame, value: str = "premium",
                    market_value: str = "premium", out: str = "risk_percentile",
                    counted: bool = False) -> DataFrame:
    """``100 · count(m < v) / count(m)`` for every row against the
    finite market values ``m`` (strict); NULL for a value that is not finite
    and for an empty market.

    Only distinct values are ordered: the market's with their counts and the
    rows' with count 0.  The shares below come back to the rows by value; the
    table of shares is written first, so a hot value is split in that join.
    With ``counted=True`` ``market`` is already ``market_counts(...)``."""
    mk = market if counted else market_counts(market, market_value)
    asked = rows.select(F.col(value).cast("double").alias("_v")).filter(finite("_v")).distinct()
    values = mk.select("_v", F.col("_c").cast("long").alias("_c")).unionByName(
        asked.withColumn("_c", F.lit(0).cast("long"))).groupBy("_v").agg(F.sum("_c").alias("_c"))
    pre = exclusive_prefix(values, [("_v", False)], {"below": F.col("_c")})
    shares = cut_lineage(pre.select("_v", F.try_divide(F.lit(100.0) * F.col("below_before"), F.col("below_total")).alias(out)))
    v = F.col(value).cast("double")
    return (rows.withColumn("_v", F.when(finite(v), v)).join(shares, "_v", "left").drop("_v"))


# ------------------------------------------------------------ splits, sample

def split_hash(id_col: str = S.ID, seed: int | str = 42) -> Column:
    """Stateless 0..9999 bucket of an id: first 8 hex digits of
    ``md5('<seed>:<id>')`` modulo 10000."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % 10000


def grouped_split(df: DataFrame, id_col: str = S.ID, test_size: float = 0.2,
                  seed: int | str = 42) -> tuple[DataFrame, DataFrame]:
    """Whole groups (ids) to train or test by a stateless hash; no
    shuffle.  Returns ``(train, test)``."""
    is_test = split_hash(id_col, seed) < int(round(10000 * test_size))
    return df.filter(~is_test), df.filter(is_test)


def split_label(df: DataFrame, id_col: str = S.ID, test_size: float = 0.2,
                seed: int | str = 42) -> DataFrame:
    """W04 as a column ``split`` ∈ {train, test}."""
    is_test = split_hash(id_col, seed) < int(round(10000 * test_size))
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def _packed(classes: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Longest-first packing of ``count`` groups of each ``size`` (descending)
    into ``k`` folds: every group goes to the lightest fold, the first of equal
    ones.  Groups of one size go round the same folds until the next fold is as
    light, so a class takes a few lines ``size, first rank, number, folds``."""
    load, out = [0] * k, []
    for size, count in classes:
        at = 0
        while at < count:
            low = min(load)
            turn = sorted((j for j in range(k) if load[j] < low + size), key=lambda j: (load[j], j))
            above = [x for x in load if x >= low + size]
            rounds = (min(above) - low) // size if above else count
            number = min(count - at, rounds * len(turn))
            out.append((size, at, number, turn))
            for i, j in enumerate(turn):
                load[j] += size * (number // len(turn) + (i < number % len(turn)))
            at += number
    return out


def group_kfold(df: DataFrame, id_col: str = S.ID, n_folds: int = 5, seed: int | str = 42) -> DataFrame:
    """``fold`` ∈ 0..k-1 per id (each group in exactly one fold), folds
    balanced by rows: groups are dealt by size, largest first, to the lightest
    fold, so folds differ by at most the largest group.  Groups of one size are
    dealt in the order of a seeded hash of their id.  NULL ids are one group.

    The driver sees a line per group size (at most sqrt(2 · rows) of them)."""
    sizes = df.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_size"))
    h = F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string"))), F.lit("g"))
    ranked = cut_lineage(exclusive_prefix(sizes.withColumn("_h", h), [("_h", False), ("_id", False)], keys=["_size"])
                         .select("_id", "_size", "_rn", "_n"))
    classes = [(r["_size"], r["n"]) for r in ranked.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()]
    lines = df.sparkSession.createDataFrame(_packed(sorted(classes, reverse=True), n_folds),
                                            "_size long, _from long, _many long, _folds array<int>")
    dealt = ranked.join(broadcast_if_small(lines), "_size").where(
        (F.col("_rn") >= F.col("_from")) & (F.col("_rn") < F.col("_from") + F.col("_many")))
    turn = ((F.col("_rn") - F.col("_from")) % F.size("_folds")).cast("int")
    folds = cut_lineage(dealt.select("_id", F.element_at("_folds", turn + 1).alias("fold")))
    return df.join(folds, F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id")


def early_stopping_split(train: DataFrame, id_col: str = S.ID, size: float = 0.15,
                         seed: int | str = 42) -> tuple[DataFrame, DataFrame]:
    """Nested validation split of the training groups, with another
    salt than the outer split."""
    return grouped_split(train, id_col, size, f"{seed}:es")


#: Hex digits of the hash that one pass of ``seeded_sample`` counts, and the
#: rows it orders at the end.
_PREFIX, _ORDERED = 3, 4096


def seeded_sample(df: DataFrame, n: int, id_col: str = S.ID, seed: int | str = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement (all rows when ``n >=
    rows``): those of the smallest seeded hashes of the id.

    Nothing is sorted but a few rows: counts of hash prefixes tell in which
    bucket the n-th row lies; the bucket is counted by longer prefixes until it
    is small; its order gives the last hash that is taken, and the sample is a
    filter.  Of rows that share the last id as many are taken as fit."""
    n = int(n)
    if n <= 0:
        return df.limit(0)
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    h = F.coalesce(h, F.lit("g"))                       # rows without an id come last
    keyed = df.select(h.alias("h"), F.col(id_col).alias("id"))
    prefix, left, size = "", n, None
    while size is None or (size > _ORDERED and len(prefix) < 32):
        inside = keyed.filter(F.col("h").startswith(prefix)) if prefix else keyed
        counts = inside.groupBy(F.substring("h", 1, len(prefix) + _PREFIX).alias("p")).agg(F.count(F.lit(1)).alias("c"))
        for p, c in sorted((r["p"], r["c"]) for r in counts.collect()):      # at most 16^3 + 1 rows
            if c >= left:
                prefix, size = p, c
                break
            left -= c
        else:
            return df
    last = keyed.filter(F.col("h").startswith(prefix)).groupBy("h", "id").agg(F.count(F.lit(1)).alias("c")).orderBy("h", "id")
    for r in last.toLocalIterator():
        if r["c"] >= left:
            break
        left -= r["c"]
    below = df.filter((h < r["h"]) | ((h == r["h"]) & (F.col(id_col) < F.lit(r["id"]))))
    return below.unionByName(df.filter((h == r["h"]) & F.col(id_col).eqNullSafe(F.lit(r["id"]))).limit(left))
