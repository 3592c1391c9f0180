"""The pipeline stage by stage against brute force, and on odd rows."""
from collections import Counter

import pytest

import corpus_pipeline
from riskloom.llm import mixing, quality_classifier
from tests.conftest import SF_SMALL
from tests.llm.test_bpe import library
from tests.llm.test_line_dedup import brute_force as cut_lines
from tests.llm.test_simhash import brute_components, plain_fingerprint

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of each stage, each written and read again."""
    from riskloom.llm.common import written
    out, docs = {}, spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        result = written(stage(spark, docs, SF_SMALL), f"test-{name}")
        out[name] = (docs, result)
        docs = result
    return out


def test_stage_names_and_columns(steps):
    assert list(steps) == ["quality_classifier", "line_dedup", "simhash_near_dedup", "mixing", "bpe"]
    for name in list(steps)[:-1]:
        assert steps[name][1].columns == COLUMNS


def test_classifier_stage(spark, steps):
    before, after = steps["quality_classifier"]
    scores = quality_classifier.classify(before, spark.read.parquet(f"{SF_SMALL}/labels.parquet")).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in scores if r.predicted == 1)
    good = {r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").where("quality = 1").collect()}
    kept = {r.doc_id for r in after.collect()}
    assert len(good & kept) >= 0.9 * len(good)


def test_line_stage(steps):
    before, after = steps["line_dedup"]
    want = cut_lines(sorted((r.doc_id, r.text) for r in before.collect()))
    assert {r.doc_id: r.text for r in after.collect()} == want


def test_simhash_stage(steps):
    before, after = steps["simhash_near_dedup"]
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(brute_components(rows)))


def test_mixing_stage(steps):
    before, after = steps["mixing"]
    size = {r.doc_id: (r.source, len(r.text.encode().split())) for r in before.collect()}
    totals = Counter()
    for source, n in size.values():
        totals[source] += n
    taken, copies = Counter(), Counter(r.doc_id for r in after.collect())
    assert set(copies) <= set(size) and max(copies.values()) <= 2
    for i, c in copies.items():
        taken[size[i][0]] += c * size[i][1]
    for source, target in mixing.targets(dict(totals)).items():
        assert abs(taken[source] - target) <= 0.25 * target     # a handful of documents a source


def test_token_stage(steps):
    before, after = steps["bpe"]
    enc = library()
    want = Counter((r.doc_id, tuple(enc.encode_ordinary(r.text))) for r in before.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in after.collect()) == want


def test_run_is_the_chain_of_stages(spark, steps):
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    last = steps["bpe"][1].collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in rows) == sorted((r.doc_id, r.ids_sha256) for r in last)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_odd_rows(spark, odd_documents, no_documents, name):
    out = STAGES[name](spark, odd_documents, SF_SMALL)
    if name != "bpe":
        assert out.columns == odd_documents.columns
    out.count()
    assert STAGES[name](spark, no_documents, SF_SMALL).count() == 0
