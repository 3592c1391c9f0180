"""MinHash near-dedup with odd sketches.

A document's set holds its distinct 4-word shingles (A-Z lower-cased; a shorter
text is one shingle).  Documents link at a Jaccard similarity of 0.8 or more.

1. One pass over the texts: shingles are hashed to 64 bits, ``SAMPLES`` MinHash
   samples are taken, the first ``BANDS x ROWS`` of them are banded, and all are
   folded into an odd sketch: sample i with value v flips bit hash(i, v) of
   ``BITS`` bits.  The whole set is folded into a second one of ``WHOLE`` bits
   (every hash flips a bit).  A 128-bit digest names the set.
2. Equal sets collapse to one node, so any number of copies costs one row.
3. Candidates share a band.  A pair at 0.8 shares none of the 32 bands of four
   rows with probability 5e-8.  In every band bucket a leader meets all members:
   linear work.  The leader is the member that shares most buckets with most
   others, so of an original and its edited copies the original, which is closer
   to every copy than the copies are to each other.
4. Samples that two sets share cancel in the XOR of their sketches, so its
   population count tells how many samples differ.  Pairs above ``reject_above``
   (exact distribution of the count at similarity 0.8: a link is refused with
   probability ``RISK`` at most) are dropped.  Linked sets of a and b shingles
   differ in (a + b) / 9 at most, which bounds the differing bits of the second
   sketches in the same way (``whole_cuts``): for sets of some hundred shingles
   nearly an exact count.  The pairs left are confirmed on the
   full sets, which are hashed again from the texts of the nodes in question.
   Every node is tested against its leader of the highest rank first; of its
   other leaders only those that this has left in another component, the most
   similar one before the rest; members and leaders bring their sketches to the
   bucket, so that only the pairs that pass become rows.
5. Buckets that still hold members of different components are searched whole:
   their members are cut into chunks (a component that fills chunks has its
   own), pairs of chunks that can hold a new link meet in one row each, and
   all cross-component pairs of such a row are tested by sketch.  Nothing is
   capped; a bucket whose members are all in one component costs nothing.
6. Components by contraction (``components.py``).

Defined cases: null, empty and blank texts have an empty set and are linked with
nothing, not even with each other; rows that share a doc_id are rows of their
own with one name; null ids are never a component's name unless nothing in it
has an id (then null); empty table, empty result; extra columns are carried by
``near_dedup`` untouched.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import free_name, written
from riskloom.llm.components import components

SHINGLE = 4
SIMILARITY = 80                 # percent
BANDS = 32
ROWS = 4
SAMPLES = 256
BITS = 512
WHOLE = 1024
RISK = 1e-7
CHUNK = 128
#: Shingles hashed at once (memory bound for long texts).
STEP = 1 << 15
_TURN = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = _mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(_TURN))
_FACTORS = _mixed(_PLACES) | np.uint64(1)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - width + 1, 1)
    last = ends[min(width, len(words)) - 1:]
    found = []
    for k in range(0, n, STEP):
        pieces = [joined[a:b] for a, b in zip(starts[k:min(k + STEP, n)].tolist(), last[k:k + STEP].tolist())]
        found.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(0)), np.uint64, len(pieces))))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def minhash(hashes: np.ndarray) -> np.ndarray:
    """``SAMPLES`` minima of the hashes under seeded orders."""
    out = np.full(SAMPLES, ~np.uint64(0))
    for k in range(0, len(hashes), 256):
        np.minimum(out, ((hashes[k:k + 256, None] ^ _PLACES) * _FACTORS).min(axis=0), out=out)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as 64-bit words."""
    bits = np.bincount((_mixed(samples + _PLACES) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def whole_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity bitmap of the set itself, as 64-bit words."""
    bits = np.bincount((_mixed(hashes ^ np.uint64(_TURN)) % np.uint64(WHOLE)).astype(np.int64), minlength=WHOLE) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def bands(samples: np.ndarray) -> np.ndarray:
    """One key per band; equal keys of different bands differ."""
    key = _mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_TURN))
    for column in samples[:BANDS * ROWS].reshape(BANDS, ROWS).T:
        key = _mixed(key ^ column) * np.uint64(_TURN)
    return key.view(np.int64)


@lru_cache
def reject_above(similarity: float = SIMILARITY / 100, samples: int = SAMPLES, bits: int = BITS,
                 risk: float = RISK) -> int:
    """Largest number of bits in which the sketches of two sets at
    ``similarity`` differ with a probability above ``risk`` of being passed:
    differing samples are binomial, each flips two bits."""
    odd = np.zeros(bits + 1)
    odd[0] = 1.0
    places = np.arange(bits + 1)
    total, weight = np.zeros(bits + 1), (similarity) ** samples
    for k in range(samples + 1):
        total += weight * odd
        weight *= (samples - k) / (k + 1) * (1 - similarity) / similarity
        for _ in range(2):
            up, down = odd * (bits - places) / bits, odd * places / bits
            odd = np.concatenate(([0.0], up[:-1])) + np.concatenate((down[1:], [0.0]))
    beyond = total[::-1].cumsum()[::-1]              # P(count >= c)
    return int(np.flatnonzero(beyond > risk)[-1])


@lru_cache
def whole_cuts(risk: float = RISK, bits: int = WHOLE) -> np.ndarray:
    """Entry m: the largest number of bits in which the sketches of sets that
    differ in m shingles or fewer differ with a probability above ``risk``;
    the last entry, for any larger m, refuses nothing."""
    odd, places, cuts = np.zeros(bits + 1), np.arange(bits + 1), []
    odd[0] = 1.0
    for _ in range(2 * bits):
        cuts.append(int(np.flatnonzero(odd[::-1].cumsum()[::-1] > risk)[-1]))
        up, down = odd * (bits - places) / bits, odd * places / bits
        odd = np.concatenate(([0.0], up[:-1])) + np.concatenate((down[1:], [0.0]))
    return np.maximum.accumulate([*cuts, bits])


def estimate(differing: float, samples: int = SAMPLES, bits: int = BITS) -> float:
    """Similarity from the number of bits in which two sketches differ."""
    inside = max(1 - 2 * differing / bits, 1e-9)
    return 1 + bits / 2 * float(np.log(inside)) / (2 * samples)


# --------------------------------------------------------------------- nodes

_SIGNED = "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>, sketch array<long>, whole array<long>"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size, digest, band keys and sketch per text."""
    def flat(rows: list) -> pa.Array:
        offsets = np.concatenate(([0], np.cumsum([0 if r is None else len(r) for r in rows])))
        values = [r for r in rows if r is not None]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values) if values else [], pa.int64()))

    for b in batches:
        sizes, digests, keys, sketches, wholes = [], [], [], [], []
        for text in b.column("text"):
            h = shingles(text.as_py())
            sizes.append(len(h))
            if not len(h):
                digests.append(None), keys.append(None), sketches.append(None), wholes.append(None)
                continue
            samples = minhash(h)
            digests.append(xxhash.xxh3_128_digest(h.tobytes()))
            keys.append(bands(samples))
            sketches.append(odd_sketch(samples))
            wholes.append(whole_sketch(h))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
             flat(keys), flat(sketches), flat(wholes)],
            ["doc_id", "text_hash", "n_shingles", "digest", "bands", "sketch", "whole"])


def _nodes(rows: DataFrame) -> DataFrame:
    """One row per distinct set: ``node`` (a number), its smallest document
    (of equal ids the smallest text hash), bands and sketch."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    sets = rows.where("n_shingles > 0").groupBy("digest").agg(
        F.min(first).alias("m"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"), F.first("whole").alias("whole"))
    return written(sets.select("digest", "m.doc_id", "m.text_hash", "n", "bands", "sketch", "whole")
                   .withColumn("node", F.monotonically_increasing_id()), "oddsketch-nodes")


def differing(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    out = F.lit(0)
    for i in range(BITS // 64):
        out = out + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return out


def _near(a: str, b: str, sa: str, sb: str) -> Column:
    """Whether sizes and sketches leave a pair."""
    sized = 100 * F.least(a, b) >= SIMILARITY * F.greatest(a, b)
    return sized & (differing(sa, sb) <= reject_above())


def _sketched(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) that sizes and sketches leave, with ``bits``."""
    u = nodes.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    v = nodes.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
    both = pairs.join(v, "v").join(u, "u")
    return both.where(_near("nu", "nv", "su", "sv")).select("u", "v", differing("su", "sv").alias("bits"))


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full sets are at least ``SIMILARITY`` percent alike."""
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    asked = nodes.join(wanted, "node").select(
        F.xxhash64("doc_id", "text_hash").alias("at"), "node", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    placed = docs.select(F.xxhash64("doc_id", "text_hash").alias("at"), "doc_id", "text_hash", "text")
    found = (placed.join(asked, "at").where(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
             .dropDuplicates(["at", "node"]))            # rows that are repeated in the table

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), pa.array([shingles(t.as_py()).tobytes() for t in b.column("text")], pa.binary())],
                ["node", "members"])

    sets = written(found.select("node", "text").mapInArrow(hashed, "node long, members binary"), "oddsketch-sets")

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["a"], b["b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * shared >= SIMILARITY * (len(x) + len(y) - shared))
            yield b.loc[keep, ["u", "v"]]

    full = (pairs.join(sets.select(F.col("node").alias("v"), F.col("members").alias("b")), "v")
            .join(sets.select(F.col("node").alias("u"), F.col("members").alias("a")), "u"))
    return written(full.select("u", "v", "a", "b").mapInPandas(alike, "u long, v long"), "oddsketch-links")


# ---------------------------------------------------------------- candidates

def _unresolved(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    ru = roots.select(F.col("node").alias("u"), F.col("root").alias("ru"))
    rv = roots.select(F.col("node").alias("v"), F.col("root").alias("rv"))
    return (pairs.join(rv, "v", "left").join(ru, "u", "left")
            .where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).drop("ru", "rv"))


def _rest(members: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (u, v) with ``bits`` of different components in one bucket that
    their sketches leave.  ``members``: (key, node)."""
    named = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    open_keys = written(named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"),
                                                 F.count(F.lit(1)).alias("n"))
                        .where("a <> b and n > 2").select("key"), "oddsketch-open")
    named = written(named.join(open_keys, "key"), "oddsketch-named")
    # a component that fills a chunk of the bucket has chunks of its own, the others are mixed
    large = written(named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("own")).where(F.col("own") >= CHUNK),
                    "oddsketch-large")
    mixed = named.join(large, ["key", "root"], "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("others"))
    dealt = (named.join(large, ["key", "root"], "left").join(mixed, "key", "left")
             .withColumn("pure", F.when(F.col("own").isNotNull(), F.col("root")))
             .withColumn("parts", F.ceil(F.coalesce("own", "others") / CHUNK).cast("long"))
             .withColumn("part", F.pmod(F.xxhash64("node", "key"), "parts")))
    sketches = nodes.select("node", "n", F.concat("sketch", "whole").alias("sketch"))   # the whole one behind the other
    chunks = written(dealt.join(sketches, "node").groupBy("key", "pure", "part").agg(
        F.collect_list("node").alias("nodes"), F.collect_list("root").alias("roots"), F.collect_list("n").alias("sizes"),
        F.flatten(F.collect_list("sketch")).alias("sketches")).withColumn("chunk", F.monotonically_increasing_id()),
        "oddsketch-chunks")                              # about CHUNK members each
    ends = chunks.select("key", "pure", "chunk")
    other = ends.select("key", F.col("pure").alias("pure2"), F.col("chunk").alias("chunk2"))
    met = ends.join(other, "key").where("chunk < chunk2 or (chunk = chunk2 and pure is null)").where(
        "pure is null or pure2 is null or pure <> pure2").select("chunk", "chunk2")
    right = chunks.select(F.col("chunk").alias("chunk2"), *[F.col(c).alias(f"{c}2") for c in ("nodes", "roots", "sizes", "sketches")])
    work = met.join(right, "chunk2").join(chunks.drop("key", "pure", "part"), "chunk")
    most, own = reject_above(), BITS // 64

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def column(b: pa.RecordBatch, name: str, i: int) -> np.ndarray:
            return b.column(name)[i].values.to_numpy(zero_copy_only=False)

        for b in batches:
            for i in range(b.num_rows):
                n1, n2 = column(b, "nodes", i), column(b, "nodes2", i)
                r1, r2 = column(b, "roots", i), column(b, "roots2", i)
                z1, z2 = column(b, "sizes", i), column(b, "sizes2", i)
                s1, s2 = column(b, "sketches", i).reshape(len(n1), -1), column(b, "sketches2", i).reshape(len(n2), -1)
                s1, s2 = s1.view(np.uint64), s2.view(np.uint64)
                bits = np.zeros((len(n1), len(n2)), np.int64)
                for w in range(own):
                    bits += np.bitwise_count(s1[:, w, None] ^ s2[None, :, w])
                ok = (bits <= most) & (r1[:, None] != r2) & (
                    100 * np.minimum(z1[:, None], z2) >= SIMILARITY * np.maximum(z1[:, None], z2))
                x, y = np.nonzero(ok)
                cuts = whole_cuts()
                whole = np.zeros(len(x), np.int64)
                for w in range(own, s1.shape[1]):
                    whole += np.bitwise_count(s1[x, w] ^ s2[y, w])
                near = whole <= cuts[np.minimum((z1[x] + z2[y]) // 9, len(cuts) - 1)]
                x, y = x[near], y[near]
                u, v = np.minimum(n1[x], n2[y]), np.maximum(n1[x], n2[y])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(bits[x, y])], ["u", "v", "bits"])

    return work.mapInArrow(pairs, "u long, v long, bits long").distinct()


def _joined(pairs: DataFrame, found: DataFrame, nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The confirmed links, joined by those that ``pairs`` (u, v, bits) add,
    and their components: first the most similar partner of every node, then
    what this leaves in different components."""
    nearest = written(pairs.groupBy("v").agg(F.min_by("u", F.struct("bits", "u")).alias("u")).select("u", "v"), "oddsketch-nearest")
    found = found.union(_confirmed(nearest, nodes, docs))
    left = _unresolved(pairs.select("u", "v"), components(found)).join(nearest, ["u", "v"], "left_anti")
    found = found.union(_confirmed(written(left, "oddsketch-left"), nodes, docs))
    return found, components(found)


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (u, v) between nodes that join up exactly the components of
    "similarity at least ``SIMILARITY`` percent".  ``docs``: ``doc_id,
    text_hash, text``."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    sizes = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "oddsketch-buckets")
    members = written(keyed.join(sizes, "key"), "oddsketch-members")
    known = written(members.groupBy("node").agg(F.sum("size").alias("rank")), "oddsketch-ranks")
    rank = F.struct("rank", F.xxhash64("node").alias("h"), "node")
    leaders = written(members.join(known, "node").groupBy("key").agg(F.max(rank).alias("best")), "oddsketch-leaders")
    ends = [F.least("node", "leader").alias("u"), F.greatest("node", "leader").alias("v")]
    # one leader per node first, that of the highest rank
    one = members.join(leaders, "key").groupBy("node").agg(F.max("best").alias("best")).select(
        "node", F.col("best.node").alias("leader")).where("node <> leader")
    first = written(_sketched(one.select(*ends).distinct(), nodes), "oddsketch-first")
    found = _confirmed(first.select("u", "v"), nodes, docs)
    # of the other leaders those in another component
    roots = written(components(found), "oddsketch-first-roots")
    led = leaders.select("key", F.col("best.node").alias("leader")).join(
        roots.select(F.col("node").alias("leader"), F.col("root").alias("led_by")), "leader", "left")
    named = members.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    split = written(named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key"),
                    "oddsketch-split")
    at_leader = nodes.select(F.col("node").alias("leader"), F.col("n").alias("nl"), F.col("sketch").alias("sl"))
    led = written(led.join(split, "key").join(at_leader, "leader").select(
        "key", "leader", F.coalesce("led_by", "leader").alias("led_by"), "nl", "sl"), "oddsketch-led")
    here = named.join(split, "key").join(nodes.select("node", "n", "sketch"), "node").alias("here")
    others = here.join(led.alias("led"), (F.col("here.key") == F.col("led.key")) & (F.col("root") != F.col("led_by"))
                       & _near("n", "nl", "sketch", "sl"))
    star = others.select(*ends, differing("sketch", "sl").alias("bits")).distinct()
    star = written(star.join(first, ["u", "v"], "left_anti"), "oddsketch-star")
    found, roots = _joined(star, found, nodes, docs)
    tested = first.select("u", "v").union(star.select("u", "v"))
    rest = _rest(members.select("key", "node"), nodes, roots).join(tested, ["u", "v"], "left_anti")
    return _joined(written(rest, "oddsketch-rest"), found, nodes, docs)[0]


def near_components(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, root, component_id) per row of ``docs``."""
    base = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    rows = written(base.mapInArrow(_describe, _SIGNED), "oddsketch-rows")
    nodes = _nodes(rows)
    roots = components(links(nodes, base))
    named = nodes.select("digest", "node", "doc_id").join(roots, "node", "left").select(
        "digest", "doc_id", F.coalesce("root", "node").alias("root"))
    named = written(named, "oddsketch-roots")
    names = written(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "oddsketch-names")
    named = written(named.join(names, "root").select("digest", "root", "component_id"), "oddsketch-named")
    slim = rows.select("doc_id", "text_hash", "n_shingles", "digest")
    filled = slim.where("n_shingles > 0").join(named, "digest").drop("digest")
    empty = slim.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("root"),
                                                F.col("doc_id").alias("component_id"))
    return filled.unionByName(empty)


def near_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that are linked, directly or through
    others, to a row of smaller doc_id; of rows that share the smallest id all
    stay."""
    wid, wh, h = (free_name(docs, c) for c in ("_keep_id", "_keep_hash", "_text_hash"))
    kept = near_components(docs, text).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias(wid), F.col("text_hash").alias(wh)).distinct()
    marked = docs.withColumn(h, F.xxhash64(text))
    joined = marked.join(kept, marked["doc_id"].eqNullSafe(kept[wid]) & (marked[h] == kept[wh]), "left_semi")
    return joined.drop(h)
