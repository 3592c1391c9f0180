"""The lookup table by definition, placement, balance and stability."""
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import sharding
from tests.conftest import SF_SMALL


def test_table_follows_the_turns():
    names, slots = ["a", "b", "c"], 13
    owner = sharding.fill_table(names, slots)
    # replay from the preference lists written out in full
    prefs = []
    for n in names:
        h = [int.from_bytes(sharding.hashlib.sha256(f"{p}:{n}".encode()).digest()[:8], "big") for p in ("offset", "step")]
        prefs.append([(h[0] + j * (h[1] % (slots - 1) + 1)) % slots for j in range(slots)])
        assert sorted(prefs[-1]) == list(range(slots))
    want, turn = {}, 0
    while len(want) < slots:
        want[next(s for s in prefs[turn % 3] if s not in want)] = turn % 3
        turn += 1
    assert owner.tolist() == [want[s] for s in range(slots)]


def test_balance_and_few_moves():
    names = [f"s{i}" for i in range(20)]
    before = sharding.fill_table(names, 10_007)
    counts = np.bincount(before)
    assert counts.max() - counts.min() <= 1
    after = sharding.fill_table(names[:-1], 10_007)
    stayed = before != 19
    assert (before[stayed] != after[stayed]).mean() < 0.1
    with pytest.raises(ValueError):
        sharding.fill_table(names, 10_000)
    with pytest.raises(ValueError):
        sharding.fill_table([], 7)


def test_query_places_every_row(spark):
    from pyspark.sql import functions as F
    from riskloom.llm.queries import QUERIES
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    owner = sharding.fill_table([f"shard-{i:05d}" for i in range(sharding.SHARDS)])
    slot = {r.doc_id: r.s for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(sharding.SLOTS)).alias("s")).collect()}
    rows = QUERIES["op3_sharding"](spark, SF_SMALL).collect()
    assert {r.doc_id: (r.slot, r.shard) for r in rows} == {i: (s, f"shard-{owner[s]:05d}") for i, s in slot.items()}
    assert len(rows) == len(slot)


def test_odd_rows_and_files(spark, odd_documents, no_documents, tmp_path):
    rows = sharding.assign(odd_documents, shards=["x", "y"], slots=101).collect()
    assert len(rows) == odd_documents.count()
    assert len({r.shard for r in rows if r.doc_id == 2}) == 1
    assert sharding.assign(no_documents).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(odd_documents.withColumnRenamed("lang", "Shard"))
    sharding.write_shards(odd_documents, str(tmp_path / "s"), shards=3, slots=101)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter(r.doc_id for r in back.collect()) == Counter(r.doc_id for r in odd_documents.collect())


def test_hot_key_spreads_and_documents_are_whole(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F
    from riskloom.llm import queries
    hot = spark.range(4000, numPartitions=4).select(F.lit(7).alias("doc_id"), F.col("id").alias("n"))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    sharding.write_shards(hot, str(tmp_path / "hot"))
    spark.conf.set(coalesce, before)
    back = spark.read.parquet(str(tmp_path / "hot"))
    assert back.count() == 4000 and back.select("shard").distinct().count() == 1
    assert len(back.inputFiles()) > 1                        # one task would have left one file
    monkeypatch.setattr(queries, "scratch_path", lambda *_: str(tmp_path / "q"))
    n = queries.QUERIES["op3_sharding"](spark, SF_SMALL).count()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    written = spark.read.parquet(str(tmp_path / "q")).select(docs.columns)
    assert n == docs.count() and written.exceptAll(docs).isEmpty() and docs.exceptAll(written).isEmpty()
