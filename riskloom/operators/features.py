"""Model frames.

Levels are learnt once (``StringIndexer``, alphabetical, one distributed
count per column) and persisted with the model, so a frame built at
inference time has exactly the training columns whatever the batch holds:
unseen or NULL categories become all-zero dummies (GLM) or the extra
"unknown" index (trees)."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.functions.columns import density_log, strip_quotes


@dataclass
class Encoding:
    """Training levels of the categorical columns (sorted) and the numeric
    columns — everything needed to rebuild a frame at inference."""
    cat_cols: list[str] = field(default_factory=lambda: list(S.CATEGORICAL))
    num_cols: list[str] = field(default_factory=lambda: list(S.NUMERIC))
    labels: dict[str, list[str]] = field(default_factory=dict)

    def dummy_names(self) -> list[str]:
        return [f"{c}_{lv}" for c in self.cat_cols for lv in self.labels[c][1:]]

    def glm_names(self) -> list[str]:
        return list(self.num_cols) + self.dummy_names()

    def tree_names(self) -> list[str]:
        return list(self.num_cols) + list(self.cat_cols)

    def to_rows(self) -> list[tuple[str, str, int]]:
        return [(c, lv, i) for c in self.cat_cols for i, lv in enumerate(self.labels[c])]


def _clean_cats(df: DataFrame, cat_cols: list[str]) -> DataFrame:
    return df.withColumns({c: strip_quotes(F.col(c).cast("string")) for c in cat_cols})


def fit_encoding(df: DataFrame, cat_cols=None, num_cols=None) -> Encoding:
    """Learn the sorted levels of every categorical column in one pass."""
    cat_cols = list(S.CATEGORICAL if cat_cols is None else cat_cols)
    num_cols = list(S.NUMERIC if num_cols is None else num_cols)
    if not cat_cols:
        return Encoding(cat_cols, num_cols, {})
    d = _clean_cats(df.select(*cat_cols), cat_cols)
    model = StringIndexer(inputCols=cat_cols, outputCols=[f"_{c}_i" for c in cat_cols],
                          stringOrderType="alphabetAsc", handleInvalid="keep").fit(d)
    labels = {c: list(lv) for c, lv in zip(cat_cols, model.labelsArray)}
    return Encoding(cat_cols, num_cols, labels)


def _numeric(c: str):
    return density_log(c) if c == "Density" else F.col(c).cast("double")


def numeric_columns(enc: Encoding) -> list:
    """Numerics as double, ``Density`` as ``log1p``."""
    return [_numeric(c).alias(c) for c in enc.num_cols]


def tree_inputs(enc: Encoding) -> list:
    """M03 for the boosted trees, in the order of ``tree_names``: numerics and
    the cleaned levels themselves, which the model's bins turn into numbers."""
    return [_numeric(c) for c in enc.num_cols] + [strip_quotes(F.col(c).cast("string")) for c in enc.cat_cols]


def design_frame(df: DataFrame, enc: Encoding, out: str = "features", keep=None) -> DataFrame:
    """Numerics + one dummy per training level except the first
    (alphabetical); unseen/NULL levels -> all zeros.  Adds vector ``out``;
    ``keep`` columns (default: all) pass through unchanged."""
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    pre = "__g_"
    nums = [e.alias(pre + c) for e, c in zip(numeric_columns(enc), enc.num_cols)]
    dummies = [F.when(strip_quotes(F.col(c).cast("string")) == lv, 1.0).otherwise(0.0).alias(f"{pre}{c}_{lv}")
               for c in enc.cat_cols for lv in enc.labels[c][1:]]
    names = [pre + n for n in enc.glm_names()]
    flat = df.select(*keep, *nums, *dummies)
    if not names:
        return flat.withColumn(out, F.array().cast("array<double>"))
    v = VectorAssembler(inputCols=names, outputCol=out, handleInvalid="keep").transform(flat)
    return v.drop(*names)


def design_columns(df: DataFrame, enc: Encoding, keep=None) -> DataFrame:
    """M01 as flat columns (no vector), e.g. for inspection or export."""
    keep = list(keep or [])
    d = _clean_cats(df, enc.cat_cols)
    dummies = [F.when(F.col(c) == lv, 1.0).otherwise(0.0).alias(f"{c}_{lv}")
               for c in enc.cat_cols for lv in enc.labels[c][1:]]
    return d.select(*keep, *numeric_columns(enc), *dummies)


def indexer(enc: Encoding, prefix: str = "") -> StringIndexerModel:
    """Indexer rebuilt from the persisted training labels (unseen -> last)."""
    return StringIndexerModel.from_arrays_of_labels(
        [enc.labels[c] for c in enc.cat_cols], inputCols=[prefix + c for c in enc.cat_cols],
        outputCols=[f"{prefix}{c}__idx" for c in enc.cat_cols], handleInvalid="keep")


def tree_frame(df: DataFrame, enc: Encoding, out: str = "tree_features", keep=None) -> DataFrame:
    """Numerics (double, log1p Density) + categorical indices carrying
    nominal metadata, so trees split on them as categories.  ``keep``
    columns (default: all) pass through unchanged."""
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    pre = "__t_"
    nums = [e.alias(pre + c) for e, c in zip(numeric_columns(enc), enc.num_cols)]
    cats = [strip_quotes(F.col(c).cast("string")).alias(pre + c) for c in enc.cat_cols]
    d = df.select(*keep, *nums, *cats)
    if enc.cat_cols:
        d = indexer(enc, pre).transform(d)
    names = [pre + c for c in enc.num_cols] + [f"{pre}{c}__idx" for c in enc.cat_cols]
    v = VectorAssembler(inputCols=names, outputCol=out, handleInvalid="keep").transform(d)
    return v.drop(*names, *[pre + c for c in enc.cat_cols])


def max_categories(enc: Encoding) -> int:
    """Largest category count of the tree frame (levels + unknown)."""
    return max([len(v) + 1 for v in enc.labels.values()] or [2])
