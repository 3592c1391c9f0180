"""Quality rules with risk-controlled cutoffs (native).

Rules reject a document when a ratio of its text exceeds a cutoff.  Cutoffs
are not tuned by eye: for every stratum (language), rule and candidate cutoff
the labelled good documents are counted, and the cutoff is *valid* when the
exact binomial test rejects "the rule falsely rejects more than ``alpha`` of
the good documents" at level ``delta / number of tests`` (Bonferroni over
strata x rules x cutoffs).  The strictest valid cutoff is used; a stratum
with too few labels has none and its documents pass the rule.  The per-rule
risk is ``alpha_total / number of rules``, so the union of all rules falsely
rejects at most ``alpha_total`` of a stratum's good documents, with
probability ``1 - delta`` for all strata at once.

The text is read in one pass without a shuffle (array expressions per row);
only narrow rows of numbers are joined with the labels and aggregated.

Defined cases: null text counts as empty (no words: base rule fails); a null
stratum is a stratum of its own; a document repeated in the table is judged
row by row; a doc_id labelled more than once is good only if every label says
so; labels of unknown documents and null ids are ignored; empty tables give
empty results (no labels: only the base rule); extra columns are ignored.
"""
from __future__ import annotations

from math import log, log1p

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import match_key, text_of, words_of, written

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
ALPHA_TOTAL = 0.06
DELTA = 0.1
#: Candidate cutoffs per rule, from strict to lax; a document fails a rule
#: when its ratio is above the cutoff.
GRID: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4),
    "dup_line_ratio": (0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8),
    "upper_ratio": (0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.8),
}


def _repeat_words(windows: Column, sorted_pairs: Column) -> Column:
    """Words covered by windows whose hash occurs at least twice, from the
    (hash, position) pairs in hash order."""
    n = F.size(sorted_pairs)
    hit = F.filter(
        F.transform(sorted_pairs, lambda p, i: F.when(
            ((i > 0) & (p["h"] == F.get(sorted_pairs, i - 1)["h"]))
            | ((i < n - 1) & (p["h"] == F.get(sorted_pairs, i + 1)["h"])), p["p"])),
        lambda p: p.isNotNull())
    start = F.struct(F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("t"))
    return F.aggregate(
        F.sort_array(hit), start,
        lambda a, p: F.struct((p + WINDOW).alias("e"),
                              (a["t"] + p + WINDOW - F.greatest(a["e"], p)).alias("t")),
        lambda a: a["t"])


def signals(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """Counts of every whole text: n_words, word_chars, n_symbols, n_lines
    (with a word), n_dup_lines, n_upper, n_repeat_words."""
    base = docs.select(*keep, text_of(text).alias("_t"))
    base = base.withColumn("_wh", F.transform(words_of(F.col("_t")), lambda w: F.xxhash64(w)))
    base = base.withColumn("n_words", F.size("_wh").cast("long"))
    base = base.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    base = base.select(
        *keep, "n_words", "_wh",
        F.length(F.regexp_replace("_t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"))
    windows = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")),
                    lambda i: F.xxhash64(*[F.get(F.col("_wh"), i + j) for j in range(WINDOW)]))
    ).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("_win", windows)
    pairs = F.when(
        F.size(F.array_distinct("_win")) < F.size("_win"),
        F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("p"))))
    ).otherwise(F.array().cast("array<struct<h:bigint,p:bigint>>"))
    base = base.withColumn("_pairs", pairs)
    return base.withColumn("n_repeat_words", _repeat_words(F.col("_win"), F.col("_pairs"))).drop(
        "_wh", "_win", "_pairs")


def ratios() -> dict[str, Column]:
    """The rules' ratios (0 where there is nothing to divide by)."""
    def over(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {"symbol_ratio": over("n_symbols", "word_chars"),
            "dup_line_ratio": over("n_dup_lines", "n_lines"),
            "upper_ratio": over("n_upper", "word_chars")}


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term in log space (no underflow for
    large n); 1 where k exceeds the mean, as the test fails there anyway."""
    odds = log(p) - log1p(-p)
    start = F.struct((n * F.lit(log1p(-p))).alias("t"), (n * F.lit(log1p(-p))).alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i) / (i + 1)) + F.lit(odds)
        hi, lo = F.greatest(a["s"], t), F.least(a["s"], t)
        return F.struct(t.alias("t"), (hi + F.log1p(F.exp(lo - hi))).alias("s"))

    terms = F.when(k > 0, F.sequence(F.lit(0).cast("long"), k.cast("long") - 1)).otherwise(
        F.array().cast("array<bigint>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(
        F.exp(F.aggregate(terms, start, step, lambda a: a["s"])))


def learn_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang",
                  grid: dict[str, tuple[float, ...]] = GRID,
                  alpha_total: float = ALPHA_TOTAL, delta: float = DELTA) -> DataFrame:
    """One row per stratum with the strictest valid cutoff of each rule (null:
    none is valid).  ``measured``: ids, stratum and the rules' ratios."""
    good = (labels.where(F.col("doc_id").isNotNull())
            .groupBy("doc_id").agg(F.min("quality").alias("_q")).where("_q = 1").select("doc_id"))
    calibration = measured.join(good, "doc_id", "left_semi")
    over = [F.sum((F.col(r) > F.lit(c)).cast("long")).alias(f"k_{r}_{i}")
            for r, cuts in grid.items() for i, c in enumerate(cuts)]
    counts = calibration.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), *over)
    # one row per stratum meets here, never documents
    counts = counts.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    size = sum(len(c) for c in grid.values())
    alpha = alpha_total / len(grid)
    level = F.lit(delta) / (F.col("strata") * size)
    picks = []
    for r, cuts in grid.items():
        valid = [F.when(binomial_cdf(F.col(f"k_{r}_{i}"), F.col("n"), alpha) <= level, F.lit(c))
                 for i, c in enumerate(cuts)]
        picks.append(F.coalesce(*valid).alias(f"cut_{r}"))
    return counts.select(stratum, F.col("n").alias("n_calibration"), *picks)


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text") -> DataFrame:
    """Signals, base verdict and ``kept`` for every row of ``docs``."""
    measured = signals(docs, text, ("doc_id", stratum)).withColumns(ratios())
    measured = written(measured, "rules-signals")
    cutoffs = written(learn_cutoffs(measured, labels, stratum), "rules-cutoffs")
    judged = match_key(measured, cutoffs, [stratum], "left")
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    passes = F.lit(True)
    for r in GRID:
        passes = passes & F.coalesce(F.col(r) <= F.col(f"cut_{r}"), F.lit(True))
    return judged.select(
        "doc_id", stratum, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & passes).alias("kept"),
        *[F.col(r) for r in GRID], *[F.col(f"cut_{r}") for r in GRID])
