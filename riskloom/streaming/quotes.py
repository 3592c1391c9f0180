"""Continuous diagnosis of incoming quotes.

``readStream`` of JSON quote files → ``foreachBatch``: defaults (F04) →
validation (F03) → premium → the batch diagnosis (X02) against the bundle
tables (market, cohorts).  The operator is stateless, so there is no
watermark; ``foreachBatch`` is needed because the risk percentile is an
ordered (non-time) window over the market, which streams do not allow; the
market is indexed once so a micro-batch touches only its value ranges.

Each micro-batch is written to ``<out>/valid/batch=<id>`` and
``<out>/quarantine/batch=<id>`` with overwrite, so a batch replayed after a
failure replaces its own output (idempotent); progress is tracked in the
query's checkpoint location.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.operators import clean, report
from riskloom.operators.market_index import build_market_index
from riskloom.plans.engine import diagnose_with_engine
from riskloom.sources.bundle import load_engine, versions
from riskloom.sources.tables import _exists, read_quote_stream


def diagnose_batch(quotes: DataFrame, market: DataFrame | None, cohorts: DataFrame | None,
                   scorer: Callable[[DataFrame], DataFrame], loading: dict | None = None,
                   id_col: str = S.ID, market_index=None) -> tuple[DataFrame, DataFrame]:
    """The batch path shared by batch and stream: (reports, quarantine)."""
    valid, bad = clean.validate_quotes(quotes)
    reps = report.diagnose(scorer(valid), market, cohorts, "premium", "premium", id_col, loading,
                           market_index=market_index)
    return reps, bad


def start_quote_stream(spark: SparkSession, source: str, out: str, checkpoint: str,
                       market: DataFrame, cohorts: DataFrame | None,
                       scorer: Callable[[DataFrame], DataFrame], loading: dict | None = None,
                       max_files_per_trigger: int = 1, trigger: dict | None = None):
    """Start T01; returns the ``StreamingQuery``.  The market is indexed
    once (distinct values cut into ranges, written to the shared checkpoint
    folder); each micro-batch reads only the ranges its quotes fall in."""
    stream = read_quote_stream(spark, source, max_files_per_trigger)
    index = build_market_index(market, "premium")

    def handle(batch: DataFrame, batch_id: int) -> None:
        reps, bad = diagnose_batch(batch, None, cohorts, scorer, loading, market_index=index)
        reps.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{out}/valid/batch={batch_id}")
        bad.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{out}/quarantine/batch={batch_id}")

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(**trigger) if trigger else w
    return w.start()


class BundleScorer:
    """The newest complete version of an engine bundle, looked up before every
    micro-batch; model, market index and cohorts change together."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.engine, self.index = spark, path, None, None

    def use(self, version: int) -> None:
        if self.engine is None or self.engine.version != version:
            self.engine = load_engine(self.spark, self.path, version)
            self.index = build_market_index(self.engine.market, "premium")


def start_bundle_stream(spark: SparkSession, source: str, out: str, checkpoint: str, bundle: str,
                        max_files_per_trigger: int = 1, trigger: dict | None = None):
    """T01 with a fitted engine: quotes are diagnosed with the bundle's newest
    complete version, so a new version is picked up between micro-batches.  A
    batch notes its version before it works (``<out>/versions``) and keeps it
    when it is replayed; every report carries it as ``engine_version``."""
    scorer = BundleScorer(spark, bundle)
    stream = read_quote_stream(spark, source, max_files_per_trigger)

    def handle(batch: DataFrame, batch_id: int) -> None:
        noted = f"{out}/versions/batch={batch_id}"
        if _exists(spark, f"{noted}/_SUCCESS"):
            version = spark.read.parquet(noted).first()["version"]
        else:
            known = versions(spark, bundle)
            if not known:
                raise FileNotFoundError(f"no complete engine version in {bundle}")
            version = known[-1]
            spark.createDataFrame([(version,)], "version int").write.mode("overwrite").parquet(noted)
        scorer.use(version)
        valid, bad = clean.validate_quotes(batch)
        reps = diagnose_with_engine(scorer.engine, valid, market_index=scorer.index)
        reps.withColumns({"batch": F.lit(batch_id), "engine_version": F.lit(version)}).write.mode("overwrite").parquet(
            f"{out}/valid/batch={batch_id}")
        bad.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/quarantine/batch={batch_id}")

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(**trigger) if trigger else w
    return w.start()


def read_stream_output(spark: SparkSession, out: str, kind: str = "valid") -> DataFrame:
    """Read back everything the stream wrote (all batches)."""
    return spark.read.option("basePath", f"{out}/{kind}").parquet(f"{out}/{kind}/batch=*")
