"""Document fingerprints from closed syncmers.

A k-mer of characters is a closed syncmer when its smallest s-mer (by a mixed
hash) is its first or its last one.  Whether a k-mer is chosen depends on the
k-mer alone, never on its context, so the same passage gives the same anchors
wherever it stands.  ``anchors`` lists (hash, position) of each whole text.
The fingerprint of a text is all its anchors, hash and position, in text order,
base64; it grows with the text.  The likeness of two fingerprints matches equal
anchors by position (``likeness``) and needs nothing beside the two strings.

``edited_neighbours`` compares each document with an edit of it (its last
third replaced by the beginning of the next document in descending id order)
and with that next document.  Quantiles of the ids cut them into parts (bounds
on the driver: four per shuffle partition); the first text of each part, one
row per part, is added to the end of the part before it.  Texts then move once,
by part, and each task walks its parts in order; nothing is written between.

Defined cases: null text counts as empty; a text shorter than k has one anchor
(its whole text), a longer one without a syncmer its k-mer of smallest hash, only
the empty text none and the empty fingerprint, which is like itself only; ids
are numbers; null ids come last in descending order; equal ids (one task walks
those of one id) and null ids (spread) are ordered by the hash of their texts,
and equal rows each get a row; a single document is its own next one; empty table, empty result; extra columns are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

K = 24
S = 8
BATCH_BYTES = 1 << 24
_BASE = 0x9E3779B97F4A7C15 | 1


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(c: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every ``width`` consecutive values, by doubling."""
    out, done, block, size = None, 0, c, 1
    while width:
        if width & 1:
            if out is None:
                out = block
            else:
                m = min(len(out), len(block) - done)
                out = out[:m] + block[done:done + m] * _power(done)
            done += size
        width >>= 1
        if width:
            block = block[:-size] + block[size:] * _power(size)
            size *= 2
    return out


def _window_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, size = v, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:len(v) - width + 1], out[width - size:]) if width > size else out


def anchors_of(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hashes uint64, positions) of the closed syncmers of a text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c = _mix(c + np.uint64(1))
    if len(c) < k:
        powers = np.array([pow(_BASE, i, 1 << 64) for i in range(len(c))], np.uint64)
        return _mix(np.array([(c * powers).sum(dtype=np.uint64) + np.uint64(len(c))], np.uint64)), np.zeros(1, np.int64)
    inner = _mix(_rolling(c, s))
    least = _window_min(inner, k - s + 1)
    at = np.flatnonzero((least == inner[:len(least)]) | (least == inner[k - s:]))
    hashes = _mix(_rolling(c, k))
    if not len(at):
        at = hashes.argmin(keepdims=True)
    return hashes[at], at


ANCHOR = np.dtype([("gap", "<u2"), ("hash", "<u4")])


def to_string(hashes: np.ndarray, at: np.ndarray) -> str:
    """Every anchor in text order: its distance from the one before (at most
    k - s, as closed syncmers guarantee) and the upper half of its hash."""
    out = np.empty(len(at), ANCHOR)
    out["gap"], out["hash"] = np.diff(at, prepend=0), hashes >> np.uint64(32)
    return base64.b64encode(out.tobytes()).decode()


def fingerprint(text: str, k: int = K, s: int = S) -> str:
    """The fingerprint of a whole text."""
    return to_string(*anchors_of(text, k, s))


def _ranked(fp: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys, positions) of a fingerprint, ascending by key; a key is an anchor's
    hash with its number among the anchors of that hash."""
    found = np.frombuffer(base64.b64decode(fp), ANCHOR)
    order = np.argsort(found["hash"], kind="stable")
    h = found["hash"][order].astype(np.uint64)
    number = np.arange(len(h), dtype=np.uint64)
    number -= number[np.searchsorted(h, h)]
    return (h << np.uint64(32)) | number, np.cumsum(found["gap"], dtype=np.int64)[order]


def _alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (ka, pa_), (kb, pb) = a, b
    if not len(ka) or not len(kb):
        return float(len(ka) == len(kb))
    near = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    same = kb[near] == ka
    _, votes = np.unique(pb[near[same]] - pa_[same], return_counts=True)
    matched = int(votes[votes >= min(2, len(ka), len(kb))].sum())
    return matched / (len(ka) + len(kb) - matched)


def likeness(a: str, b: str) -> float:
    """Positional likeness of two fingerprints, 0 to 1.

    Equal anchors (the i-th of a hash with the i-th) vote for the offset between
    their positions; an offset with two votes is a passage that both texts hold
    and its anchors match, wherever it stands.  A single vote counts only where
    a text has no more than one anchor.  The likeness is the number of matched
    anchors over those of both texts, matched ones counted once."""
    return _alike(_ranked(a), _ranked(b))


def anchors(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """(key, hash, pos): every anchor of every whole text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [anchors_of(t or "", k, s) for t in b.column("t").to_pylist()]
            own = pa.array(np.repeat(np.arange(len(found)), [len(h) for h, _ in found]))
            yield pa.RecordBatch.from_arrays(
                [b.column("k").take(own), *(pa.array(np.concatenate([f[i].view(np.int64) for f in found]), pa.int64())
                                            for i in (0, 1))], [key, "hash", "pos"])

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(
        run, f"`{key}` {kind}, hash bigint, pos bigint")


def _compare(key, text: str, own: tuple, following: str, other: tuple) -> tuple:
    n = len(text)
    cut = n // 3
    edited = text[:n - cut] + following[:cut]
    new = _read(edited) if cut else own
    return (key, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own[0], new[0],
            _alike(own[1], new[1]), _alike(own[1], other[1]))


def _read(text: str) -> tuple[str, tuple[np.ndarray, np.ndarray]]:
    fp = fingerprint(text)
    return fp, _ranked(fp)


def _parts(rows: DataFrame) -> DataFrame:
    """``rows`` with ``part``: ranges of ids of about equal row counts, numbered in
    descending order of ids; rows without an id follow, by ranges of ``h``."""
    spark = rows.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = F.percentile_approx(F.col("doc_id").cast("double"), [i / n for i in range(1, n)], 10 * n)
    bounds = sorted(set(rows.select(wanted).first()[0] or [0.0]))
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="x", outputCol="bucket", handleInvalid="keep")
    late = F.floor((F.col("h") / F.lit(2.0 ** 64) + 0.5) * n)
    rows = cut.transform(rows.withColumn("x", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))))
    part = F.when(F.col("doc_id").isNull(), len(bounds) + 2 + late).otherwise(len(bounds) + 1 - F.col("bucket"))
    return rows.select("doc_id", "t", "h", part.cast("int").alias("part"))


def edited_neighbours(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = (f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    out_schema = to_arrow_schema(StructType.fromDDL(result))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(out_schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema)], out_schema.names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out, size = None, [], 0
        for b in batches:
            for edge, key, t in zip(*(b.column(c).to_pylist() for c in ("edge", "doc_id", "t"))):
                own = _read(t)
                if last is not None:
                    out.append(_compare(*last, t, own))
                    size += len(out[-1][3]) + len(out[-1][4])
                last = None if edge else (key, t, own)
                if size > BATCH_BYTES:
                    yield batch(out)
                    out, size = [], 0
        yield batch(out)

    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = _parts(rows.withColumn("h", F.xxhash64("t")))
    # the first text of every part once more, as the end of the part before; the very first ends the last part
    firsts = rows.groupBy("part").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("h"))).alias("first"))
    w = Window.partitionBy(F.lit(1))
    to = F.coalesce(F.lag("part").over(w.orderBy("part")), F.max("part").over(w))
    firsts = firsts.select(F.col("part").alias("own"), to.alias("to"), F.col("first.doc_id").alias("i"),
                           F.bitwise_not("first.h").alias("j"))
    is_first = (F.col("part") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j"))
    edges = rows.join(F.broadcast(firsts), is_first).groupBy("own").agg(
        *[F.first(c).alias(c) for c in ("to", "doc_id", "t", "h")])
    every = rows.select("part", F.lit(False).alias("edge"), "doc_id", "t", "h").unionByName(
        edges.select(F.col("to").alias("part"), F.lit(True).alias("edge"), "doc_id", "t", "h"))
    ordered = every.repartitionByRange("part").sortWithinPartitions(
        "part", "edge", F.col("doc_id").desc_nulls_last(), "h")
    return ordered.select("edge", "doc_id", "t").mapInArrow(walk, result)
