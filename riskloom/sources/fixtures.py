"""Policy, claim, premium and quote frames derived from the driver's
TPC-H-like tables (``orders``, ``customer``, ``lineitem``).

These are the views of FIXTURES.md written with the DataFrame API; the
oracle SQL uses the same definitions as leading CTEs.  All work grows with
the input tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim rows: returned line items with a large quantity."""
    li = table(spark, sf_dir, "lineitem")
    return (li.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 35))
              .select(F.col("l_orderkey").alias("IDpol"),
                      F.col("l_linenumber").alias("claim_no"),
                      (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 10).alias("ClaimAmount"),
                      F.col("l_quantity").alias("qty")))


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy rows: one per order (every 50th order left out, which leaves
    orphan claims), with quoted fuel values, exposures above 1 and claim
    counts that disagree with the claim rows on purpose."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    li = table(spark, sf_dir, "lineitem")
    nb = (li.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 37))
            .groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("nb")))
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    nbc = F.coalesce(F.col("nb"), F.lit(0))
    exposure = (F.when(ok % 97 == 0, F.lit(1.5))
                 .otherwise((1 + (ok * 7919) % 365).cast("double") / F.lit(365.0)))
    return (o.filter(ok % 50 != 0)
             .join(cu, cu.c_custkey == o.o_custkey)
             .join(nb, nb.l_orderkey == o.o_orderkey, "left")
             .select(ok.alias("IDpol"),
                     nbc.cast("int").alias("ClaimNb"),
                     exposure.alias("Exposure"),
                     (4 + ck % 9).cast("int").alias("VehPower"),
                     ((ok * 31) % 21).cast("int").alias("VehAge"),
                     (18 + (ck * 13 + ok) % 72).cast("int").alias("DrivAge"),
                     (50 + (ok * 17) % 61 + 30 * F.least(nbc, F.lit(4))).cast("int").alias("BonusMalus"),
                     (1 + F.floor(F.col("o_totalprice") / 20)).cast("int").alias("Density"),
                     F.concat(F.lit("B"), (1 + ck % 14).cast("string")).alias("VehBrand"),
                     F.when(ok % 2 == 0, F.lit("'Diesel'")).otherwise(F.lit("Regular")).alias("VehGas"),
                     F.substring(F.lit("ABCDEF"), (1 + ck % 6).cast("int"), 1).alias("Area"),
                     F.concat(F.lit("R"), (11 + F.col("c_nationkey")).cast("string")).alias("Region")))


def analytic_premium_col():
    """A premium that does not depend on a fitted model (ties are common)."""
    return ((0.05 + 0.002 * F.abs(F.col("DrivAge") - 45) + 0.001 * (F.col("BonusMalus") - 50))
            * (800.0 + 10.0 * F.col("VehPower")))


def quotes(policy: DataFrame) -> DataFrame:
    """Incoming quotes: the nine rating factors of every policy, with some
    invalid ages and some missing BonusMalus values (defaults apply)."""
    ident = F.col("IDpol")
    return policy.select(
        ident,
        "VehPower", "VehAge",
        F.when(ident % 41 == 0, F.lit(10)).otherwise(F.col("DrivAge")).cast("int").alias("DrivAge"),
        F.when(ident % 43 == 0, F.lit(None)).otherwise(F.col("BonusMalus")).cast("int").alias("BonusMalus"),
        "Density", "VehBrand", "VehGas", "Area", "Region")


def _stat_rows(counts: DataFrame, itm, c1, c2) -> DataFrame:
    return counts.select(itm.alias("ITM_NM"), c1.alias("C1_NM"), c2.alias("C2_NM"),
                         F.col("n").cast("string").alias("DT"), F.lit(None).cast("string").alias("errMsg"))


def statistics_rows(policy: DataFrame) -> dict[str, DataFrame]:
    """Published-statistics-like rows (``ITM_NM, C1_NM, C2_NM, DT``) counted
    from the policy table with CUBE totals (``총계`` / ``계``):

    * ``license_age``: C1 = age label ``"<DrivAge>세"``, C2 = licence class
      (``1종`` when VehAge < 10 else ``2종``);
    * ``license_gender``: C1 = licence class, C2 = sex (``남자`` when VehPower
      is even, else ``여자``);
    * ``vehicle``: ITM = use (Density mod 10: 0–7 ``자가용``, 8 ``영업용``, 9
      ``관용``), C2 = type from the brand number (1–10 ``승용``, 11 ``승합``,
      12–13 ``화물``, 14 ``특수``)."""
    tot, all_ = F.lit("총계"), F.lit("계")
    lic = F.when(F.col("VehAge") < 10, "1종").otherwise("2종")
    sex = F.when(F.col("VehPower") % 2 == 0, "남자").otherwise("여자")
    age = F.concat(F.col("DrivAge").cast("string"), F.lit("세"))
    d = F.col("Density") % 10
    use = F.when(d <= 7, "자가용").when(d == 8, "영업용").otherwise("관용")
    bn = F.substring(F.col("VehBrand"), 2, 3).cast("int")
    vtype = F.when(bn <= 10, "승용").when(bn == 11, "승합").when(bn <= 13, "화물").otherwise("특수")

    def cube(a, b):
        c = policy.select(a.alias("a"), b.alias("b")).cube("a", "b").agg(
            F.count(F.lit(1)).alias("n"), F.grouping("a").alias("ga"), F.grouping("b").alias("gb"))
        return c
    ca = cube(age, lic)
    cg = cube(lic, sex)
    cv = cube(use, vtype)
    pick = lambda g, v, t: F.when(F.col(g) == 1, t).otherwise(F.col(v))
    return {
        "license_age": _stat_rows(ca, all_, pick("ga", "a", tot), pick("gb", "b", tot)),
        "license_gender": _stat_rows(cg, all_, pick("ga", "a", tot), pick("gb", "b", tot)),
        "vehicle": _stat_rows(cv, pick("ga", "a", all_), tot, pick("gb", "b", tot)),
    }


# The same definitions as SQL text; used as leading CTEs of the oracle queries.
CLAIM_SQL = """claim AS (
  SELECT l_orderkey AS IDpol, l_linenumber AS claim_no,
         l_extendedprice * (1 - l_discount) / 10 AS ClaimAmount, l_quantity AS qty
  FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 35)"""

POLICY_SQL = """policy AS (
  SELECT o.o_orderkey AS IDpol,
         CAST(COALESCE(c.nb, 0) AS INT) AS ClaimNb,
         CASE WHEN o.o_orderkey % 97 = 0 THEN 1.5e0
              ELSE CAST(1 + (o.o_orderkey * 7919) % 365 AS DOUBLE) / 365e0 END AS Exposure,
         CAST(4 + o.o_custkey % 9 AS INT) AS VehPower,
         CAST((o.o_orderkey * 31) % 21 AS INT) AS VehAge,
         CAST(18 + (o.o_custkey * 13 + o.o_orderkey) % 72 AS INT) AS DrivAge,
         CAST(50 + (o.o_orderkey * 17) % 61 + 30 * least(COALESCE(c.nb, 0), 4) AS INT) AS BonusMalus,
         CAST(1 + floor(o.o_totalprice / 20) AS INT) AS Density,
         concat('B', CAST(1 + o.o_custkey % 14 AS VARCHAR(2))) AS VehBrand,
         CASE WHEN o.o_orderkey % 2 = 0 THEN concat(chr(39), 'Diesel', chr(39)) ELSE 'Regular' END AS VehGas,
         substr('ABCDEF', CAST(1 + o.o_custkey % 6 AS INT), 1) AS Area,
         concat('R', CAST(11 + cu.c_nationkey AS VARCHAR(2))) AS Region
  FROM orders o
  JOIN customer cu ON cu.c_custkey = o.o_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS nb FROM lineitem
             WHERE l_returnflag = 'R' AND l_quantity >= 37 GROUP BY l_orderkey) c
         ON c.l_orderkey = o.o_orderkey
  WHERE o.o_orderkey % 50 <> 0)"""

PREMIUM_SQL = """premium AS (
  SELECT IDpol, (0.05e0 + 0.002e0 * abs(DrivAge - 45) + 0.001e0 * (BonusMalus - 50)) * (800e0 + 10e0 * VehPower) AS pred
  FROM policy)"""

STAT_SQL = """stat_age AS (
  SELECT '계' AS ITM_NM, CASE WHEN grouping(a) = 1 THEN '총계' ELSE a END AS C1_NM,
         CASE WHEN grouping(b) = 1 THEN '총계' ELSE b END AS C2_NM, CAST(count(*) AS VARCHAR) AS DT
  FROM (SELECT CAST(DrivAge AS VARCHAR) || '세' AS a, CASE WHEN VehAge < 10 THEN '1종' ELSE '2종' END AS b FROM policy)
  GROUP BY CUBE (a, b)),
stat_gender AS (
  SELECT '계' AS ITM_NM, CASE WHEN grouping(a) = 1 THEN '총계' ELSE a END AS C1_NM,
         CASE WHEN grouping(b) = 1 THEN '총계' ELSE b END AS C2_NM, CAST(count(*) AS VARCHAR) AS DT
  FROM (SELECT CASE WHEN VehAge < 10 THEN '1종' ELSE '2종' END AS a,
               CASE WHEN VehPower % 2 = 0 THEN '남자' ELSE '여자' END AS b FROM policy)
  GROUP BY CUBE (a, b)),
stat_vehicle AS (
  SELECT CASE WHEN grouping(a) = 1 THEN '계' ELSE a END AS ITM_NM, '총계' AS C1_NM,
         CASE WHEN grouping(b) = 1 THEN '총계' ELSE b END AS C2_NM, CAST(count(*) AS VARCHAR) AS DT
  FROM (SELECT CASE WHEN Density % 10 <= 7 THEN '자가용' WHEN Density % 10 = 8 THEN '영업용' ELSE '관용' END AS a,
               CASE WHEN CAST(substr(VehBrand, 2, 3) AS INT) <= 10 THEN '승용'
                    WHEN CAST(substr(VehBrand, 2, 3) AS INT) = 11 THEN '승합'
                    WHEN CAST(substr(VehBrand, 2, 3) AS INT) <= 13 THEN '화물' ELSE '특수' END AS b FROM policy)
  GROUP BY CUBE (a, b))"""

QUOTE_SQL = """quote AS (
  SELECT IDpol, VehPower, VehAge,
         CAST(CASE WHEN IDpol % 41 = 0 THEN 10 ELSE DrivAge END AS INT) AS DrivAge,
         CAST(CASE WHEN IDpol % 43 = 0 THEN NULL ELSE BonusMalus END AS INT) AS BonusMalus,
         Density, VehBrand, VehGas, Area, Region
  FROM policy)"""
