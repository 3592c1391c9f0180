"""SimHash near-dedup by pigeonhole blocks.

* Fingerprint: 64 bits over the XXH64 (seed 42) of every 3-word shingle of the
  A-Z lower-cased whole text, one bit per majority; a batch function per row.
* Documents collapse to distinct fingerprints first, so any number of copies
  costs one node.
* A fingerprint is cut into four 16-bit blocks.  Two fingerprints at distance
  <= 2 differ in at most two blocks, so they agree on at least two: six keys
  (pairs of blocks, 32 bits each) bring every close pair together.
* Buckets of at most ``PAIR_BUCKET`` fingerprints are self-joined and verified
  with the Hamming distance.  Larger buckets would emit all pairs; there every
  fingerprint is sent to itself and its 32 one-bit flips outside the shared
  blocks.  Two fingerprints at distance <= 2 meet at a midpoint, fingerprints
  that meet are at distance <= 2, and a midpoint has at most 33 members: exact,
  linear in the bucket, no pair lost for the components.
* Components by contraction (``components.py``).

Defined cases: null and empty texts have fingerprint zero and link like any
other; a document repeated in the table gets the same row twice; null ids are
never a component's name unless nothing in it has an id (then null); empty
table, empty result; extra columns are carried by ``near_dedup`` untouched.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from riskloom.llm.common import free_name, written
from riskloom.llm.components import components

SHINGLE = 3
MAX_BITS = 2
BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
SEED = 42
PAIR_BUCKET = 8
#: Shingles whose bits are counted at once (memory bound for long texts).
STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - shingle + 1, 1)
    last = ends[min(shingle, len(words)) - 1:]
    ones = np.zeros(64, np.int64)
    for k in range(0, n, STEP):
        pieces = [joined[a:b] for a, b in zip(starts[k:min(k + STEP, n)].tolist(), last[k:k + STEP].tolist())]
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf(LongType())
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return fp(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def links(fps: DataFrame, max_bits: int = MAX_BITS, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Links (u, v) that join up exactly the components of "at most
    ``max_bits`` (1 or 2) differing bits" over the distinct ``fp``."""
    if not 1 <= max_bits <= 2:
        raise ValueError("four blocks and midpoints cover one or two differing bits")
    mask = (1 << BLOCK_BITS) - 1

    def signed(x: int) -> int:
        return x - (1 << 64) if x >= 1 << 63 else x

    sets = list(combinations(range(BLOCKS), BLOCKS - 2))
    masks = [signed(sum(mask << (BLOCK_BITS * b) for b in s)) for s in sets]
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)
    ])).alias("k")).select("fp", "k.t", "k.key")
    buckets = written(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-buckets")
    shared = written(keyed.join(buckets, ["t", "key"]), "simhash-shared")
    small = shared.where(F.col("n") <= pair_bucket).select("t", "key", "fp")
    other = small.withColumnRenamed("fp", "fp2")
    pairs = (small.join(other, ["t", "key"]).where("fp < fp2")
             .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_bits)
             .select(F.col("fp").alias("u"), F.col("fp2").alias("v")))
    flips = F.lit(None)
    for t, s in enumerate(sets):
        free = [F.lit(signed(1 << (BLOCK_BITS * b + i))) for b in range(BLOCKS) if b not in s for i in range(BLOCK_BITS)]
        flips = F.when(F.col("t") == t, F.array(F.lit(0).cast("long"), *[f.cast("long") for f in free])).otherwise(flips)
    meet = (shared.where(F.col("n") > pair_bucket)
            .select("t", "fp", F.explode(flips).alias("flip"))
            .groupBy("t", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
            .agg(F.collect_list("fp").alias("members")))          # at most 33 by construction
    if max_bits == 2:
        stars = (meet.where(F.size("members") > 1)
                 .select(F.array_min("members").alias("u"), F.explode("members").alias("v")).where("u <> v"))
    else:                                                          # distance 1: the midpoint is itself a member
        stars = (meet.where(F.array_contains("members", F.col("mid")))
                 .select(F.col("mid").alias("u"), F.explode("members").alias("v")).where("u <> v"))
    return pairs.union(stars).distinct()


def near_components(docs: DataFrame, text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) per row of ``docs``."""
    rows = written(docs.select("doc_id", F.xxhash64(text).alias("text_hash"),
                               fingerprint_column(F.col(text), shingle).alias("fp")), "simhash-fp")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    nodes = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    nodes = written(nodes, "simhash-roots")
    names = written(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names")
    named = written(nodes.join(names, "root").select("fp", "root", "component_id"), "simhash-named")
    return rows.join(named, "fp")


def near_dedup(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the smallest
    doc_id (of equal ids, the smallest text hash; of equal rows, one)."""
    h, wid, wh = (free_name(docs, c) for c in ("_text_hash", "_keep_id", "_keep_hash"))
    comp = near_components(docs, text, shingle, max_bits)
    keep = written(comp.groupBy("root").agg(
        F.min_by(F.struct("doc_id", "text_hash"),
                 F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))).alias("w"))
        .select(F.col("w.doc_id").alias(wid), F.col("w.text_hash").alias(wh)), "simhash-keep")
    marked = docs.withColumn(h, F.xxhash64(text))
    kept = marked.join(keep, marked["doc_id"].eqNullSafe(keep[wid]) & (marked[h] == keep[wh]))
    return kept.dropDuplicates(["doc_id", h]).select(*[f"`{c}`" for c in docs.columns])
