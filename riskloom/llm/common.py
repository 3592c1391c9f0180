"""Helpers shared by the operators: words, row keys, scratch tables, skew-safe
joins."""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import ensure_checkpoint_dir

#: Word separators: space and the ASCII controls tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def text_of(col: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def chars_in(text: Column, negated_class: str) -> Column:
    """Number of code points outside ``negated_class`` (a ``[^...]`` class):
    everything in the class is deleted, the rest is counted."""
    return F.length(F.regexp_replace(text, negated_class + "+", "")).cast("long")


def crc_of_id(col: str = "doc_id") -> Column:
    """crc32 of the id as text (null: as empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts
    the lineage, survives lost executors, and is computed once however often
    it is read."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name not used in ``df`` (case-insensitively)."""
    used = {c.lower() for c in df.columns}
    name = base
    while name.lower() in used:
        name += "_"
    return name


def match_key(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys where a null equals a null; the key columns of the
    left side are kept."""
    ren = {k: f"__r_{k}" for k in keys}
    r = right.withColumnsRenamed(ren)
    cond = F.lit(True)
    for k, rk in ren.items():
        cond = cond & left[k].eqNullSafe(r[rk])
    return left.join(r, cond, how).drop(*ren.values())
