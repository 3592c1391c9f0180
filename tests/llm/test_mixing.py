"""Mixing: targets, flow and the contract's totals."""
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskloom.llm import mixing
from tests.conftest import SF_MID, SF_SMALL


def test_targets_reshare_the_excess():
    sizes = {"b": 1000, "a": 10, None: 500, "c": 90}
    t = mixing.targets(sizes)                      # order a, b, c, null: weights 3, 1, 2, 3
    assert sum(t.values()) == pytest.approx(2400)
    assert t["a"] == 20 and t["c"] == 180
    assert t[None] == 1000 and t["b"] == pytest.approx(1200)
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0.0}


def test_flow_uses_overlap_before_repeats():
    flow = mixing.cheapest_flow([(("x",), 100.0), (("x", "y"), 100.0)], {"x": 150.0, "y": 50.0})
    assert flow[0]["x"] == pytest.approx(100)
    assert flow[1]["x"] == pytest.approx(50) and flow[1]["y"] == pytest.approx(50)
    flow = mixing.cheapest_flow([(("x",), 100.0), (("x", "y"), 100.0)], {"x": 100.0, "y": 100.0})
    assert sum(flow[0].values()) == pytest.approx(100)     # nothing repeats while the other pattern has words
    flow = mixing.cheapest_flow([(("y",), 100.0), (("x", "y"), 10.0)], {"x": 30.0, "y": 120.0})
    assert flow[1]["x"] == pytest.approx(20) and flow[0]["y"] == pytest.approx(120)


@pytest.mark.parametrize("sf,near", [(SF_SMALL, 0.04), (SF_MID, 0.005)])
def test_query_meets_its_targets(spark, sf, near):
    from riskloom.llm.queries import QUERIES
    docs = {d.doc_id: d for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_mixing"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        d = docs[r.doc_id]
        assert r.size == len((d.text or "").encode().split())
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
        size[d.source] += r.size
        taken[d.source] += r.taken
        target[d.source] = r.target
    want = mixing.targets(dict(size))
    for s in size:
        assert target[s] == want[s]
        # ten or fifty documents a source
        assert abs(target[s] - taken[s]) <= near * target[s]
    again = QUERIES["op6_mixing"](spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_empty_texts_are_not_taken_more_often_than_others(spark):
    rows = [(i, "a", None if i % 2 else "") for i in range(40)] + [(100, "a", "one two"), (101, "b", "x " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    copies = Counter(r.doc_id for r in mixing.mix(docs, F.array("source")).collect())
    assert max(copies.values()) <= mixing.MAX_EPOCHS


def test_odd_rows(spark, odd_documents, no_documents):
    rows = mixing.mixture(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.taken == 0 for r in rows if r.size == 0)
    copies = Counter(r.doc_id for r in mixing.mix(odd_documents, F.array("source")).collect())
    here = Counter(r.doc_id for r in odd_documents.collect())
    assert all(n <= mixing.MAX_EPOCHS * here[i] for i, n in copies.items())      # empty texts too
    taken = defaultdict(int)
    for r in rows:
        taken[r.doc_id] += r.taken // r.size if r.size else 0
    for i, n in taken.items():
        if n:
            assert copies[i] == n
    assert mixing.mix(odd_documents, F.array("source")).columns == odd_documents.columns
    assert mixing.mixture(no_documents).count() == 0 and mixing.mix(no_documents, F.array("source")).count() == 0
