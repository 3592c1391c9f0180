"""The stream gives the same reports as the batch path."""
import uuid

from riskloom.operators import clean, market
from riskloom.plans import catalog
from riskloom.sources import fixtures as fx
from riskloom.streaming import quotes as qs
from tests.conftest import SF_SMALL


def test_stream_equals_batch(spark):
    base = f"{spark.conf.get('spark.checkpoint.dir')}/stream-test-{uuid.uuid4().hex}"
    q = fx.quotes(fx.policies(spark, SF_SMALL))
    q.repartition(3, "IDpol").write.json(f"{base}/in")
    pf = catalog.premium_frame(spark, SF_SMALL).cache()
    cohorts = market.cohort_stats(pf, "premium").cache()
    mk = pf.select("IDpol", "premium")

    def scorer(d):
        return d.withColumn("premium", fx.analytic_premium_col())
    loading = {"expense_ratio": 0.25, "profit_margin": 0.05}
    query = qs.start_quote_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", mk, cohorts,
                                  scorer, loading)
    query.processAllAvailable()
    query.stop()
    streamed = qs.read_stream_output(spark, f"{base}/out").drop("batch")
    reps, bad = qs.diagnose_batch(q, mk, cohorts, scorer, loading)
    from riskloom.operators.report import flatten_report
    a = flatten_report(streamed).toPandas().sort_values("IDpol").reset_index(drop=True)
    b = flatten_report(reps).toPandas().sort_values("IDpol").reset_index(drop=True)
    assert len(a) == len(b) > 0
    assert a.equals(b[a.columns])
    bad_stream = qs.read_stream_output(spark, f"{base}/out", "quarantine")
    assert bad_stream.count() == bad.count() > 0


def test_bundle_stream_picks_up_a_new_version(spark):
    """Two micro-batches, a new engine version between them; each batch equals
    the batch path with its version, and a replay keeps the version noted."""
    from riskloom.operators.report import flatten_report
    from riskloom.plans import engine
    from riskloom.sources.bundle import load_engine, save_engine
    base = f"{spark.conf.get('spark.checkpoint.dir')}/bundle-stream-{uuid.uuid4().hex}"
    train = catalog.training_frame(spark, SF_SMALL).cache()
    quotes = fx.quotes(fx.policies(spark, SF_SMALL))
    parts = [quotes.where("IDpol % 2 = 0"), quotes.where("IDpol % 2 = 1")]
    for k in range(2):
        save_engine(engine.fit_engine(train, rounds=2 + k, learning_rate=0.3, patience=None, min_rows=20), f"{base}/bundle")
        parts[k].coalesce(1).write.mode("append").json(f"{base}/in")
        query = qs.start_bundle_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", f"{base}/bundle")
        query.processAllAvailable()
        query.stop()
    out = qs.read_stream_output(spark, f"{base}/out")
    for version in (1, 2):
        want = engine.diagnose_with_engine(load_engine(spark, f"{base}/bundle", version), clean.validate_quotes(parts[version - 1])[0])
        a = flatten_report(out.where(f"engine_version = {version}")).toPandas().sort_values("IDpol").reset_index(drop=True)
        b = flatten_report(want).toPandas().sort_values("IDpol").reset_index(drop=True)
        assert len(a) == len(b) > 0
        assert a.equals(b[a.columns])
