"""Indexed risk percentile (stream path) equals the brute-force count."""
import numpy as np
import pandas as pd
import pytest

from riskloom.operators.market_index import build_market_index, indexed_percentile


@pytest.mark.parametrize("n_ranges", [1, 7, 40])
def test_indexed_percentile_brute_force(spark, n_ranges):
    rng = np.random.default_rng(2)
    m = np.round(rng.gamma(2, 50, 5000), 1)
    m[:1500] = 75.0                                   # a hot value
    market = spark.createDataFrame(pd.DataFrame({"premium": m}))
    idx = build_market_index(market, n_ranges=n_ranges)
    qs = np.concatenate([m[:30], [75.0, -1.0, 0.0, 1e9, m.max(), m.min()], rng.uniform(0, 400, 30)])
    quotes = spark.createDataFrame(pd.DataFrame({"IDpol": np.arange(len(qs)), "premium": qs}))
    got = indexed_percentile(quotes, idx).toPandas().sort_values("IDpol")
    ref = [(m < v).mean() * 100 for v in qs]
    assert np.allclose(got["risk_percentile"].to_numpy(), ref, atol=1e-12)


def test_quotes_of_one_value_do_not_meet_in_a_window(spark):
    """Only distinct values go through the windows, whatever the number of
    quotes; every quote gets its share, repeated and missing ids included."""
    market = spark.createDataFrame(pd.DataFrame({"premium": np.arange(100.0)}))
    quotes = spark.range(3000).selectExpr("if(id % 5 = 0, null, id % 7) as IDpol", "cast(id % 3 as double) as premium", "id as n")
    got = indexed_percentile(quotes, build_market_index(market, n_ranges=3))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan                      # the shares are written before they come back by value
    rows = got.groupBy("premium", "risk_percentile").count().orderBy("premium").collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.0, 1000), (1.0, 1.0, 1000), (2.0, 2.0, 1000)]
