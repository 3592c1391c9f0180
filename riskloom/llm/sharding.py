"""Sharding by a permutation-filled lookup table.

Every shard ranks the slots of a prime-sized table by its own permutation
(an offset and a step from the hash of its name); the shards take turns, each
claiming the first free slot on its list, until the table is full.  A row goes
to the slot of its key's hash: constant-time placement through a table whose
size is a parameter, so it is broadcast whatever the data's size.  Shares
differ by at most one slot, and when a shard is added or removed few slots
change hands besides its own.

Defined cases: null keys hash like any value and share one slot; equal keys
always meet, repeated rows included; a clash of column names with ``slot`` or
``shard`` is an error raised before anything runs; empty table, empty result;
other columns are carried along.
"""
from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = 64
#: Parts that the rows of one slot are dealt to.
SALTS = 1024


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """Index of the owning shard per slot."""
    if not is_prime(slots):
        raise ValueError(f"the number of slots must be prime, {slots} is not")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, at least one and at most one per slot")

    def number(name: str, purpose: str) -> int:
        return int.from_bytes(hashlib.sha256(f"{purpose}:{name}".encode()).digest()[:8], "big")

    place = [number(s, "offset") % slots for s in shards]
    step = [number(s, "step") % (slots - 1) + 1 for s in shards]
    owner = np.full(slots, -1, np.int32)
    left = slots
    while left:
        for i in range(len(shards)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % slots
            owner[place[i]] = i
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def assign(df: DataFrame, key: str = "doc_id", shards: Sequence[str] | int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` columns."""
    if {"slot", "shard"} & {c.lower() for c in df.columns}:
        raise ValueError("df already has a column named slot or shard")
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    owner = fill_table(names, slots)
    table = df.sparkSession.createDataFrame(
        pd.DataFrame({"slot": np.arange(slots, dtype=np.int32), "shard": np.array(names, object)[owner]}),
        "slot int, shard string")
    # the table has ``slots`` rows by construction, whatever df holds
    return (df.withColumn("slot", slot_of(F.col(f"`{key}`"), slots))
            .join(F.broadcast(table), "slot").select(*[f"`{c}`" for c in df.columns], "slot", "shard"))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: Sequence[str] | int = SHARDS,
                 slots: int = SLOTS) -> None:
    """Write ``df`` with its slots partitioned by shard.  Rows are dealt by
    slot and a salt, so neither a shard nor a hot key is gathered in one task;
    equal keys meet in the folder of their shard."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    assign(df, key, shards, slots).repartition(F.col("slot"), salt).write.option("compression", "zstd").partitionBy(
        "shard").parquet(path)
