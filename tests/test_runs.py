"""Composed runs L01 and L04 end to end on the smallest fixture."""
import uuid

import numpy as np

from riskloom.plans import catalog, runs
from riskloom.sources.bundle import load_engine
from tests.conftest import SF_SMALL


def test_baseline_run_metrics(spark):
    m = runs.baseline_run(*catalog.raw_frames(spark, SF_SMALL)).toPandas()
    assert set(m[m.model == "glm"].metric) == {"freq_poisson_deviance", "freq_gini", "sev_gamma_deviance", "pp_gini"}
    data = m[m.model == "data"].set_index("metric").value
    assert data["n_policies"] > 0 and data["n_repeated_ids"] == 0 and "n_orphan_claims" in data
    assert np.isfinite(m.value).all()


def test_diagnosis_run_writes_bundle(spark):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/bundle-{uuid.uuid4().hex}"
    rep, checked = runs.diagnosis_run(*catalog.raw_frames(spark, SF_SMALL), path, n_examples=5, rounds=3,
                                      learning_rate=0.3)
    rep = rep.toPandas()
    assert checked.count() == 5
    assert len(rep) == 5
    assert rep.risk_percentile.between(0, 100).all()
    assert all(len(d) == 3 for d in rep.drivers)
    eng = load_engine(spark, path)
    assert eng.market.count() > 0 and eng.factors.count() > 0


def test_boosting_run_metrics(spark):
    m = runs.boosting_run(*catalog.raw_frames(spark, SF_SMALL), grid=[1.5, 1.9], folds=2, rounds=2,
                          search_rounds=2, tweedie_rounds=2, learning_rate=0.3).toPandas()
    assert set(m.model) == {"data", "glm", "gbm", "tweedie_gbm"}
    assert m[m.metric == "tweedie_power"].value.iloc[0] in (1.5, 1.9)
    assert np.isfinite(m.value).all()


def test_evaluation_run_metrics(spark):
    m, factors = runs.evaluation_run(*catalog.raw_frames(spark, SF_SMALL), rounds=2, learning_rate=0.3)
    m = m.toPandas()
    assert set(m.model) == {"data", "raw_train", "isotonic_train", "raw_test", "isotonic_test"}
    bal = m[(m.metric == "balance")].set_index("model").value
    assert abs(bal["isotonic_train"] - 1) <= abs(bal["raw_train"] - 1) + 1e-9
    assert 0 < factors.count() <= 8


def test_runs_ask_for_the_whole_job():
    """Defaults of the composed runs and of the engine are the reference's."""
    import inspect

    from riskloom.plans import engine
    want = {"rounds": 2000, "patience": 50, "learning_rate": 0.05}
    for f in (runs.boosting_run, runs.evaluation_run, runs.diagnosis_run, engine.fit_engine):
        args = inspect.signature(f).parameters
        assert {k: args[k].default for k in want} == want
    args = inspect.signature(runs.boosting_run).parameters
    assert (args["search_rounds"].default, args["tweedie_rounds"].default, args["folds"].default) == (150, 100, 3)
    args = inspect.signature(runs.tweedie_power_search).parameters
    assert (args["rounds"].default, args["row_fraction"].default, args["feature_fraction"].default) == (150, 0.8, 0.8)
