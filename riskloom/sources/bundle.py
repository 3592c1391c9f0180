"""Engine bundle (S07, S08): versions of a fitted engine in a shared folder,
Parquet tables and MLlib models, no pickles.

    <dir>/v000001/model      (loss, power, init, lr)            Parquet
    <dir>/v000001/features   (feature, kind, ord, edge, level)  Parquet
    <dir>/v000001/trees      (tree, node, feature, left, value, n) Parquet, all trees in one table
    <dir>/v000001/severity   GeneralizedLinearRegressionModel   MLWriter
    <dir>/v000001/isotonic   (x, y)                             Parquet
    <dir>/v000001/market     (IDpol, premium)                   Parquet
    <dir>/v000001/cohorts    A10 table                          Parquet
    <dir>/v000001/factors    A11 table                          Parquet
    <dir>/v000001/loading    (expense_ratio, profit_margin)     Parquet
    <dir>/v000001/_COMPLETE  written last

A version without its marker does not exist for readers, so a save that is cut
short leaves the version before in force, and a reader of an older version is
not disturbed by a newer one.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.regression import GeneralizedLinearRegressionModel
from pyspark.sql import DataFrame, SparkSession

from riskloom.operators.boosting import Binning, BoostedModel, Tree
from riskloom.operators.features import Encoding
from riskloom.operators.isotonic import IsotonicFit
from riskloom.session import drop_scratch

MARKER = "_COMPLETE"


@dataclass
class Engine:
    """A fitted diagnosis engine: models plus precomputed tables."""
    encoding: Encoding
    freq: BoostedModel
    severity: GeneralizedLinearRegressionModel
    isotonic: IsotonicFit
    market: DataFrame          # IDpol, premium (calibrated pure premium of training policies)
    cohorts: DataFrame         # A10
    factors: DataFrame         # A11
    loading: dict | None = None
    version: int | None = None  # of the bundle it was read from


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _folders(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())


def _at(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/v{version:06d}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a bundle, ascending."""
    found = []
    for v in _folders(spark, path):
        fs, p = _fs(spark, f"{_at(path, v)}/{MARKER}")
        if fs.exists(p):
            found.append(v)
    return found


def _feature_rows(binning: Binning) -> list[tuple]:
    rows = []
    for name in binning.names:
        if name in binning.edges:
            rows += [(name, "num", i, float(e), None) for i, e in enumerate(binning.edges[name])] or [(name, "num", -1, None, None)]
        else:
            rows += [(name, "cat", i, None, lv) for i, lv in enumerate(binning.levels[name])] or [(name, "cat", -1, None, None)]
    return rows


def save_engine(engine: Engine, path: str, keep: int | None = None) -> int:
    """Write the engine as a new version and return its number.  With
    ``keep`` older complete versions beyond that number and all versions cut
    short are removed afterwards."""
    spark = engine.market.sparkSession
    version = max(_folders(spark, path), default=0) + 1
    to, f = _at(path, version), engine.freq
    spark.createDataFrame([(f.loss, float(f.power), float(f.init), float(f.learning_rate), engine.encoding.num_cols,
                            engine.encoding.cat_cols)],
                          "loss string, power double, init double, lr double, num array<string>, cat array<string>") \
        .write.parquet(f"{to}/model")
    spark.createDataFrame(_feature_rows(f.binning), "feature string, kind string, ord int, edge double, level string") \
        .write.parquet(f"{to}/features")
    nodes = [(k, i, int(t.feature[i]), [int(b) for b in np.flatnonzero(t.left[i])], float(t.value[i]), float(t.rows[i]))
             for k, t in enumerate(f.trees) for i in range(len(t.feature))]
    spark.createDataFrame(nodes, "tree int, node int, feature int, left array<int>, value double, n double") \
        .write.parquet(f"{to}/trees")
    engine.severity.write().save(f"{to}/severity")
    engine.isotonic.points.write.parquet(f"{to}/isotonic")
    engine.market.write.parquet(f"{to}/market")
    engine.cohorts.write.parquet(f"{to}/cohorts")
    engine.factors.write.parquet(f"{to}/factors")
    ld = engine.loading or {}
    spark.createDataFrame([(ld.get("expense_ratio"), ld.get("profit_margin"))],
                          "expense_ratio double, profit_margin double").write.parquet(f"{to}/loading")
    fs, marker = _fs(spark, f"{to}/{MARKER}")
    fs.create(marker, False).close()
    if keep is not None:
        kept = set(versions(spark, path)[-max(keep, 1):])
        for v in _folders(spark, path):
            if v not in kept and v < version:
                drop_scratch(spark, _at(path, v))
    return version


def load_engine(spark: SparkSession, path: str, version: int | None = None) -> Engine:
    """Restore a version (default: the newest complete one); a bundle or
    version that is not there is an explicit error."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"engine bundle {path} has no complete version {'' if version is None else version}; train it first")
    version = known[-1] if version is None else version
    at = _at(path, version)
    meta = spark.read.parquet(f"{at}/model").first()
    rows = spark.read.parquet(f"{at}/features").orderBy("feature", "ord").collect()
    edges: dict[str, list[float]] = {n: [] for n in meta["num"]}
    levels: dict[str, list[str]] = {n: [] for n in meta["cat"]}
    for r in rows:
        if r["ord"] >= 0:
            (edges if r["kind"] == "num" else levels)[r["feature"]].append(r["edge"] if r["kind"] == "num" else r["level"])
    enc = Encoding(list(meta["cat"]), list(meta["num"]), levels)
    binning = Binning(enc.tree_names(), edges, levels)
    n_bins = int(binning.widths.max())
    trees: dict[int, list] = {}
    for r in spark.read.parquet(f"{at}/trees").orderBy("tree", "node").collect():       # at most 2^depth nodes a tree
        trees.setdefault(r["tree"], []).append(r)
    built = []
    for k in sorted(trees):
        left = np.zeros((len(trees[k]), n_bins), bool)
        for r in trees[k]:
            left[r["node"], r["left"]] = True
        built.append(Tree(np.array([r["feature"] for r in trees[k]], np.int16), left,
                          np.array([r["value"] for r in trees[k]]), np.array([r["n"] for r in trees[k]])))
    freq = BoostedModel(meta["loss"], meta["power"], meta["init"], meta["lr"], built, enc, binning)
    ld = spark.read.parquet(f"{at}/loading").first()
    loading = None if ld["expense_ratio"] is None else {"expense_ratio": ld["expense_ratio"],
                                                        "profit_margin": ld["profit_margin"]}
    return Engine(enc, freq, GeneralizedLinearRegressionModel.load(f"{at}/severity"),
                  IsotonicFit(spark.read.parquet(f"{at}/isotonic")), spark.read.parquet(f"{at}/market"),
                  spark.read.parquet(f"{at}/cohorts"), spark.read.parquet(f"{at}/factors"), loading, version)
