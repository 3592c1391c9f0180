"""Merkle dataset manifest as a postorder append log.

A source's rows, in order of their id, are the leaves of a tree of ``ARITY``
children per node; all leaves have the same depth and the last node of a level
may have fewer children.  Its log lists the nodes in the order in which they
are completed: a node follows its last child at once.  Where a node stands
needs no lookup: before leaf ``i`` there are ``i`` leaves and ``floor(i / 3) +
floor(i / 9) + ...`` completed nodes, and a node of level ``l`` stands ``l``
places after its last leaf (``position``).

* Leaf digests are one scan with built-in functions; texts are not moved.
* ``exclusive_prefix`` numbers the leaves of every source over ranges, so a
  source that holds a third of the rows is spread like any other.
* Builders take aligned blocks of ``3^LEVELS`` leaves.  A block is a whole
  subtree, so its part of the log is one run of neighbouring positions, and a
  builder needs nothing from another.  The blocks' roots are the leaves of the
  next tier, until a source has one node; a thousand million rows take four
  tiers.  A group holds at most ``3^LEVELS`` members by construction.
* The roots of the sources, ordered by source, are the leaves of one more tree
  that is built the same way.
* Proofs: the siblings of a leaf below its block's root are read off the
  block's own segment at their closed-form positions; those above are the same
  for the whole block and are handed down once per block, tier by tier.

Every tier is a written table, so a lost executor costs one block, not a tree.

Defined cases: null values are ``-`` in a leaf, so null and empty text differ;
a null source is a source of its own and comes first; null ids come first in
their source and are never tampered with; rows that share an id are ordered by
their digest; repeated rows are leaves each; a source of one row has that leaf
as its root, a table of one source that source's root; empty table, empty log;
extra columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from riskloom.llm.common import crc_of_id, match_key, written
from riskloom.operators.ordered import exclusive_prefix

ARITY = 3
#: Levels that one builder completes: blocks of 243 leaves.
LEVELS = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# ------------------------------------------------------------- closed forms

def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def widths(n: int, levels: int | None = None) -> list[int]:
    """Nodes of each level above ``n`` leaves: until one is left, or for
    exactly ``levels`` levels."""
    out = [n]
    while len(out) <= levels if levels is not None else out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def position(level: int, index: int, n: int) -> int:
    """Place of a node in the log of a tree with ``n`` leaves."""
    last = min((index + 1) * ARITY ** level, n) - 1
    place, done = last + level, last // ARITY
    while done:
        place += done
        done //= ARITY
    return place


def subtree_log(leaves: Sequence[str], levels: int | None = None) -> list[str]:
    """The nodes over ``leaves`` in completion order."""
    last = len(widths(len(leaves), levels)) - 1
    pending: list[list[str]] = [[] for _ in range(last + 1)]
    log: list[str] = []
    for i, leaf in enumerate(leaves):
        node, level, final = leaf, 0, i == len(leaves) - 1
        log.append(node)
        while level < last:
            pending[level].append(node)
            if len(pending[level]) < ARITY and not final:
                break
            node = digest(pending[level])
            pending[level].clear()
            level += 1
            log.append(node)
    return log


def siblings(log: Sequence[str], index: int, n: int, levels: int | None = None) -> list[str]:
    """The other nodes of each run on the way from leaf ``index`` up, level by
    level, left to right, read off the log at their positions."""
    out = []
    for level, width in enumerate(widths(n, levels)[:-1]):
        first = index - index % ARITY
        out += [log[position(level, j, n)] for j in range(first, min(first + ARITY, width)) if j != index]
        index //= ARITY
    return out


def fold(leaf: str, index: int, n: int, proof: Sequence[str]) -> tuple[str, int]:
    """The root over ``leaf`` and the siblings at the head of ``proof``, and
    how many of them that took."""
    used = 0
    for width in widths(n)[:-1]:
        place = index % ARITY
        others = min(ARITY, width - (index - place)) - 1
        run = list(proof[used:used + others])
        used += others
        leaf = digest(run[:place] + [leaf] + run[place:])
        index //= ARITY
    return leaf, used


# ------------------------------------------------------------------- builders

def leaf_digest(text: Column | None = None) -> Column:
    """H of the fields of a row; ``text`` in place of the column of that name."""
    parts = []
    for f in FIELDS:
        v = text if f == "text" and text is not None else F.col(f)
        v = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


@F.pandas_udf(ArrayType(StringType()))
def _segment(leaves: pd.Series, levels: pd.Series) -> pd.Series:
    return pd.Series([subtree_log(list(m), None if lv < 0 else int(lv)) for m, lv in zip(leaves, levels)])


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _paths(nodes: pd.Series, size: pd.Series, levels: pd.Series, above: pd.Series) -> pd.Series:
    """For each leaf of a block its siblings up to the root of the tree."""
    out = []
    for log, n, lv, up in zip(nodes, size, levels, above):
        n, lv, up = int(n), None if lv < 0 else int(lv), list(up)
        out.append([siblings(log, i, n, lv) + up for i in range(n)])
    return pd.Series(out)


@dataclass
class Log:
    """A forest of trees by the column ``tree`` (one per value, null included).

    ``tiers[t]``: a row per block of tier ``t`` with ``tree, block, width``
    (leaves of that tier in the tree), ``levels`` (-1: up to the root),
    ``members`` (structs in leaf order, ``digest`` among their fields) and
    ``nodes``, the block's part of the log.  ``roots``: ``tree, n, root``."""
    tiers: list[DataFrame]
    roots: DataFrame


def append_log(leaves: DataFrame, carry: Sequence[str] = ()) -> Log:
    """Build the logs over ``leaves``: ``tree, idx`` (from 0), ``n`` (leaves of
    the tree), ``digest`` and the columns ``carry``."""
    block = ARITY ** LEVELS
    tiers: list[DataFrame] = []
    nodes, fields = leaves.withColumn("width", F.col("n")), ["idx", "digest", *carry]
    while True:
        grouped = nodes.groupBy("tree", F.floor(F.col("idx") / block).cast("long").alias("block"), "n", "width").agg(
            F.sort_array(F.collect_list(F.struct(*fields))).alias("members"))      # at most 3^LEVELS by construction
        tier = grouped.withColumn("levels", F.when(F.col("width") > block, F.lit(LEVELS)).otherwise(F.lit(-1)))
        tier = written(tier.withColumn("nodes", _segment(F.transform("members", lambda m: m["digest"]), F.col("levels"))),
                       f"merkle-tier{len(tiers)}")
        tiers.append(tier)
        top = F.element_at("nodes", -1)
        unfinished = tier.where("levels >= 0")
        if unfinished.isEmpty():
            break
        nodes = unfinished.select("tree", F.col("block").alias("idx"), "n",
                                  F.ceil(F.col("width") / block).cast("long").alias("width"), top.alias("digest"))
        fields = ["idx", "digest"]
    done = [t.where("levels < 0").select("tree", "n", F.element_at("nodes", -1).alias("root")) for t in tiers]
    roots = done[0]
    for d in done[1:]:
        roots = roots.unionByName(d)
    return Log(tiers, written(roots, "merkle-roots"))


def log_nodes(log: Log) -> DataFrame:
    """The logs as ``tree, position, level, idx, digest``."""
    @F.udf("array<struct<position:long,level:int,idx:long,digest:string>>")
    def places(nodes, levels, block, n, tier):
        out, base = [], tier * LEVELS
        first = block * ARITY ** LEVELS
        count = min(ARITY ** LEVELS, -(-n // ARITY ** base) - first)
        for level, width in enumerate(widths(count, None if levels < 0 else levels)):
            for j in range(width):
                if tier and not level:
                    continue                    # the leaves of a tier are the roots of the one below
                idx = first // ARITY ** level + j
                out.append((position(base + level, idx, n), base + level, idx, nodes[position(level, j, count)]))
        return out

    frames = [t.select("tree", F.inline(places("nodes", "levels", "block", "n", F.lit(i)))) for i, t in enumerate(log.tiers)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def paths(log: Log, fields: Sequence[str]) -> DataFrame:
    """``tree, n``, the leaf's fields and ``proof``: its siblings up to the
    root of its tree."""
    above = None
    for t in range(len(log.tiers) - 1, -1, -1):
        tier = log.tiers[t]
        if above is None:
            tier = tier.withColumn("above", F.array().cast("array<string>"))
        else:
            tier = match_key(tier, above, ["tree", "block"], "left").withColumn(
                "above", F.coalesce("above", F.array().cast("array<string>")))
        found = tier.select("tree", "n", F.explode(F.arrays_zip(
            "members", _paths("nodes", F.size("members"), "levels", "above").alias("proof"))).alias("m"))
        if t:
            above = written(found.select("tree", F.col("m.members.idx").alias("block"), F.col("m.proof").alias("above")),
                            f"merkle-above{t}")
    return found.select("tree", "n", *[F.col(f"m.members.{f}").alias(f) for f in fields], F.col("m.proof").alias("proof"))


# ------------------------------------------------------------------- manifest

@F.pandas_udf(StructType().add("proof_sha256", StringType()).add("folded_root", StringType()))
def _folded(leaf: pd.Series, idx: pd.Series, n: pd.Series, proof: pd.Series, place: pd.Series, trees: pd.Series,
            top: pd.Series) -> pd.DataFrame:
    out = []
    for a, i, m, low, j, s, high in zip(leaf, idx, n, proof, place, trees, top):
        sub, _ = fold(a, int(i), int(m), low)
        root, _ = fold(sub, int(j), int(s), high)
        out.append((digest([*low, *high]), root))
    return pd.DataFrame(out, columns=["proof_sha256", "folded_root"])


@dataclass
class Manifest:
    """``log``: the logs of the sources; ``top``: that of their roots."""
    log: Log
    top: Log


def manifest(docs: DataFrame, presented: Column | None = None) -> Manifest:
    """The logs over the rows of ``docs``.  ``presented``: a text that is
    claimed to be the row's and will be verified (default: the row's own)."""
    shown = leaf_digest() if presented is None else leaf_digest(presented)
    rows = docs.select("doc_id", "source", leaf_digest().alias("digest"), shown.alias("presented"))
    placed = exclusive_prefix(rows, [("source", False), ("doc_id", False), ("digest", False)])
    placed = written(placed.select("source", "doc_id", "digest", "presented", "_rn"), "merkle-leaves")
    sizes = written(placed.groupBy("source").agg(F.min("_rn").alias("first"), F.count(F.lit(1)).alias("n")),
                    "merkle-sizes")
    leaves = match_key(placed, sizes, ["source"], "inner").select(
        F.col("source").alias("tree"), (F.col("_rn") - F.col("first")).alias("idx"), "n", "digest", "doc_id", "presented")
    log = append_log(leaves, ["doc_id", "presented"])
    ordered = exclusive_prefix(log.roots, [("tree", False)])
    top = append_log(ordered.select(F.lit(0).alias("tree"), F.col("_rn").alias("idx"), F.col("_n").alias("n"),
                                    F.col("root").alias("digest"), F.col("tree").alias("source")), ["source"])
    return Manifest(log, top)


def root(m: Manifest) -> DataFrame:
    """One row ``root`` (none for an empty table)."""
    return m.top.roots.select("root")


def verified(m: Manifest) -> DataFrame:
    """Per leaf ``source, doc_id, leaf, subroot, root, proof`` (its siblings up
    to the root), ``proof_sha256``, ``folded_root`` from the presented text and
    the proof, and ``verified``."""
    upper = paths(m.top, ["idx", "digest", "source"]).join(m.top.roots.drop("n"), "tree").select(
        F.col("source").alias("tree"), F.col("idx").alias("place"), F.col("n").alias("trees"),
        F.col("digest").alias("subroot"), "root", F.col("proof").alias("upper"))
    upper = written(upper, "merkle-upper")
    leaves = match_key(paths(m.log, ["idx", "digest", "doc_id", "presented"]), upper, ["tree"], "inner")
    out = leaves.withColumn("f", _folded("presented", "idx", "n", "proof", "place", "trees", "upper"))
    return out.select(F.col("tree").alias("source"), "doc_id", F.col("digest").alias("leaf"), "subroot", "root",
                      F.concat("proof", "upper").alias("proof"), "f.proof_sha256", "f.folded_root",
                      (F.col("f.folded_root") == F.col("root")).alias("verified"))


def tampered_text() -> Column:
    """The text with its line feeds deleted where 2 divides the crc32 of the id."""
    hit = F.col("doc_id").isNotNull() & (crc_of_id() % 2 == 0)
    return F.when(hit, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
