"""Line dedup by winnowing over line hashes (native).

The lines with a word of each whole text, trimmed, are hashed.  A window is a
run of consecutive lines with ``min_words`` words that has fewer without its
last or without its first line: a long line is a window by itself, short lines
share one, and every run of enough words is a union of windows.  The smallest
hash of a window (the last on ties) is its fingerprint.  It depends on the
window's lines alone, so equal runs of enough words always share one: that is
winnowing's guarantee.  Only these selected lines are rows from there on.

Equal fingerprints are joined to their first position and the match is extended
to both sides over the windows of the line.  Windows that agree with the first
position have it as their first occurrence.  The others (a common short line
among different neighbours) are matched by their lines with one another, which
finds the first occurrence of each.  Deleted are all lines of a window that
occurs earlier, unless it overlaps the very lines it repeats.  So a line goes
exactly if some run of ``min_words`` words or more around it stands at an
earlier place (smaller doc_id, or further up), and one of its equals stays.

The first position per fingerprint is an aggregate with map-side combine, and
one row per fingerprint is joined back, so a passage that a third of the
documents share costs one row, never pairs; its table is written first, which
lets Spark split a hot group in the join.  Texts move once, to be cut.

Defined cases: null text has no lines and stays null; lines without a word
are kept and never part of a run; a document repeated in the table is one
document (its rows are cut alike); null ids come after all others; runs with
fewer than ``min_words`` words are left alone; a text whose lines all go is
empty; empty table, empty result; extra columns are carried by
``without_repeated_lines``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import free_name, text_of, words_of, written

MIN_WORDS = 6
TRIM = " \t\r\x0b\x0c"
PLACE = ["late", "doc_id", "text_hash"]


def _lines_with_words(lines: Column) -> Column:
    """(x, i) of the lines with a word: the trimmed line, its number in the text."""
    return F.filter(F.transform(lines, lambda x, i: F.struct(F.btrim(x, F.lit(TRIM)).alias("x"), i.alias("i"))),
                    lambda s: s["x"] != "")


def _windows(ls: Column, at: Column, min_words: int) -> Column:
    """The windows that begin with line ``at`` of ``ls``: (start, n, pos), pos
    the line with the smallest hash."""
    lines = [F.get(ls, at + j) for j in range(min_words)]
    out, words, least, pos = [], F.lit(0), None, at
    for j, line in enumerate(lines):
        before, words = words, words + F.coalesce(line["w"], F.lit(0))
        pos = F.when(line["h"] <= least, at + j).otherwise(pos) if j else at
        least = F.least(least, line["h"]) if j else line["h"]
        whole = line.isNotNull() & (words >= min_words) & ((before < min_words) | (words - lines[0]["w"] < min_words))
        out.append(F.when(whole, F.struct(at.alias("start"), F.lit(j + 1).alias("n"), pos.alias("pos"))))
    return F.filter(F.array(*out), lambda w: w.isNotNull())


def fingerprints(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(late, doc_id, text_hash, pos, fp, low, around, spans): a row per selected
    line with its number among the lines with a word, its hash, the windows
    (start, n) it was selected in, and the second hashes of their lines from
    number ``low`` on."""
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text_of(text).alias("t"))
    rows = rows.withColumn("lines", _lines_with_words(F.split("t", "\n")))
    rows = rows.select("doc_id", "text_hash", F.transform("lines", lambda s: F.struct(
        F.xxhash64(s["x"]).alias("h"), F.xxhash64(F.lit(7), s["x"]).alias("g"),
        F.least(F.size(words_of(s["x"])), F.lit(min_words)).alias("w"))).alias("ls")).where(F.size("ls") > 0)
    numbers = F.sequence(F.lit(0), F.size("ls") - 1)
    rows = rows.select("*", F.transform(numbers, lambda a: _windows(F.col("ls"), a, min_words)).alias("windows"))

    def selected(p: Column) -> Column:
        near = F.slice("windows", F.greatest(p - (min_words - 2), F.lit(1)), F.least(p + 1, F.lit(min_words)))
        mine = F.filter(F.flatten(near), lambda w: w["pos"] == p)
        return F.struct(p.alias("pos"), F.get(F.col("ls"), p)["h"].alias("fp"),
                        F.transform(mine, lambda w: F.struct(w["start"], w["n"])).alias("spans"))

    every = F.transform(F.sequence(F.lit(0), F.size("windows") - 1), selected)
    rows = rows.select("doc_id", "text_hash", "ls", F.inline(F.filter(every, lambda s: F.size(s["spans"]) > 0)))
    low = F.array_min(F.transform("spans", lambda s: s["start"]))
    high = F.array_max(F.transform("spans", lambda s: s["start"] + s["n"]))
    return rows.select(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash", "pos", "fp", low.alias("low"),
                       F.transform(F.slice("ls", low + 1, high - low), lambda s: s["g"]).alias("around"), "spans")


def repeated_lines(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, gone): the windows (start, n) of later repeated runs,
    in numbers of lines with a word."""
    found = written(fingerprints(docs, text, min_words), "lines-positions")
    place = F.struct(*PLACE, "pos", "low", "around")
    firsts = found.groupBy("fp").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("positions"))
    firsts = written(firsts.where("positions > 1").select("fp", "first"), "lines-firsts")

    shift = F.col("first.pos") - F.col("pos")
    alone = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash"))

    def extended(s: Column) -> Column:
        """The window's own lines, and whether they stand around the first position too."""
        own = F.slice("around", s["start"] - F.col("low") + 1, s["n"])
        there = s["start"] + shift - F.col("first.low")
        agrees = F.when(there < 0, F.lit(False)).otherwise(
            F.slice("first.around", F.greatest(there, F.lit(0)) + 1, s["n"]) == own)
        return F.struct(s["start"].alias("start"), s["n"].alias("n"), agrees.alias("agrees"),
                        (~alone | (-shift >= s["n"])).alias("apart"), F.when(~agrees, own).alias("run"))

    met = found.join(firsts, "fp").where(~alone | (shift != 0))
    met = written(met.select(*PLACE, "fp", F.inline(F.transform("spans", extended))), "lines-met")
    settled = met.where("agrees and apart").select("doc_id", "text_hash", "start", "n")

    open_ = met.where("not agrees")
    here = F.struct(*PLACE, "start")
    runs = open_.groupBy("fp", "run").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("positions"))
    runs = written(runs.where("positions > 1").select("fp", "run", "first"), "lines-runs")
    later = open_.join(runs, ["fp", "run"]).where(
        (here > F.col("first")) & (~alone | (F.col("start") - F.col("first.start") >= F.col("n"))))
    gone = settled.unionByName(later.select("doc_id", "text_hash", "start", "n"))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("gone"))


def without_repeated_lines(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS,
                           counts: bool = False) -> DataFrame:
    """The rows of ``docs`` with later repeated runs of lines deleted from
    ``text``; with ``counts`` also n_lines and n_removed."""
    h, rid, rh, gone, ls, real = (free_name(docs, c) for c in (
        "_line_hash", "_gone_id", "_gone_hash", "_gone", "_lines", "_real"))
    cut = repeated_lines(docs, text, min_words).select(
        F.col("doc_id").alias(rid), F.col("text_hash").alias(rh), F.col("gone").alias(gone))
    rows = docs.withColumn(h, F.xxhash64(text))
    rows = rows.join(cut, rows["doc_id"].eqNullSafe(cut[rid]) & (rows[h] == cut[rh]), "left")
    rows = rows.withColumn(ls, F.split(text_of(text), "\n"))
    rows = rows.withColumn(real, F.transform(_lines_with_words(F.col(ls)), lambda s: s["i"]))
    rows = rows.withColumn(gone, F.array_distinct(F.flatten(
        F.transform(gone, lambda s: F.slice(real, s["start"] + 1, s["n"])))))
    left = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(ls), i)), "\n"))
    columns = [kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        columns += [F.size(real).cast("long").alias("n_lines"),
                    F.coalesce(F.when(F.col(gone).isNotNull(), F.size(gone)), F.lit(0)).cast("long").alias("n_removed")]
    return rows.select(*columns)
