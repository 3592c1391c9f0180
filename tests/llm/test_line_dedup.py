"""Line dedup against a plain loop."""
import random
from collections import Counter

import pytest

from riskloom.llm import line_dedup
from tests.conftest import SF_MID, SF_SMALL


def brute_force(docs, min_words=line_dedup.MIN_WORDS):
    """docs: (id, text) in id order -> id -> cut text.  A line goes if any run
    around it with enough words stands at an earlier place, not overlapping it;
    as a line has a word, runs of up to ``min_words`` lines are all that matter."""
    first, out = {}, {}
    for i, text in docs:
        lines = (text or "").split("\n")
        real = [j for j, x in enumerate(lines) if x.strip(line_dedup.TRIM)]
        keys = [lines[j].strip(line_dedup.TRIM) for j in real]
        words = [len(x.encode().split()) for x in keys]
        gone = set()
        for s in range(len(real)):
            for e in range(s + 1, min(s + min_words, len(real)) + 1):
                if sum(words[s:e]) >= min_words:
                    where = first.setdefault(tuple(keys[s:e]), (i, s))
                    if where[0] != i or s - where[1] >= e - s:
                        gone.update(real[s:e])
        out[i] = text if not gone else "\n".join(x for j, x in enumerate(lines) if j not in gone)
    return out


@pytest.mark.parametrize("min_words", [1, 6, 12])
def test_equals_brute_force(spark, min_words):
    frame = spark.read.parquet(f"{SF_MID if min_words == 6 else SF_SMALL}/documents.parquet")
    docs = sorted((d.doc_id, d.text) for d in frame.collect())
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(frame, min_words=min_words).collect()}
    want = brute_force(docs, min_words)
    assert got == want and any(want[i] != t for i, t in docs)


def test_no_long_line_stays_repeated(spark):
    frame = spark.read.parquet(f"{SF_MID}/documents.parquet")

    def long_lines(texts):
        seen = Counter(x.strip(line_dedup.TRIM) for t in texts for x in (t or "").split("\n"))
        return {x: n for x, n in seen.items() if len(x.encode().split()) >= line_dedup.MIN_WORDS}

    before = long_lines(r.text for r in frame.collect())
    after = long_lines(r.text for r in line_dedup.without_repeated_lines(frame).collect())
    assert max(before.values()) > 1 and set(after.values()) == {1} and set(after) == set(before)


def test_random_short_lines(spark):
    rng = random.Random(5)
    for _ in range(3):
        docs = [(i, "\n".join(rng.choice(["a", "b c", "d", "e f g", "", "h i j k l m", "n o p q"])
                              for _ in range(rng.randrange(25)))) for i in range(120)]
        frame = spark.createDataFrame(docs, "doc_id bigint, text string")
        got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(frame).collect()}
        assert got == brute_force(docs)


def test_only_selected_lines_are_rows(spark):
    short = "\n".join(f"w{i}" for i in range(600))
    frame = spark.createDataFrame([(1, short), (2, "\n".join(["a line with six words here"] * 9))], "doc_id bigint, text string")
    rows = line_dedup.fingerprints(frame).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in rows}[2] == 9          # a long line is a run by itself
    assert {r.doc_id: r["count"] for r in rows}[1] < 300         # windows of short lines share their minima


def test_runs_blank_lines_and_overlaps(spark):
    block = "the first line of a passage\n\n  the second line of it \nand the third one here"
    copy = "one line of more than six words that is a whole document"
    docs = [(1, f"own start of one\n{block}\nown end of one"),
            (2, f"{block}\ntail of two that is new"),
            (3, "head of three\nthe second line of it\nand the third one here\nend of three"),
            (4, "\n".join(["again and again the same"] * 7)),
            (5, "of it\nno more"),
            (6, copy), (7, copy), (8, f"other neighbours\n{copy}\non both sides"),
            (9, "By\nTo\nOf\nAt\nIn\nOn\nUp"), (10, "x\nBy\nTo\nOf\nAt\nIn\nOn\nUp\ny")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(frame).collect()}
    assert got == brute_force(docs)
    assert got[2] == "\ntail of two that is new" and got[3] == "head of three\nend of three"
    assert got[4] == "\n".join(["again and again the same"] * 2)
    assert (got[6], got[7], got[8], got[10]) == (copy, "", "other neighbours\non both sides", "x\ny")


def test_hot_line_among_different_neighbours(spark):
    """A common short line has one first position; other windows around it find their own."""
    docs = [(i, f"The End\nstory {i % 40} closes here now") for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(frame).collect()}
    assert got == brute_force(docs) and sum(t == "" for t in got.values()) == 360


def test_odd_rows(spark, odd_documents, no_documents):
    out = line_dedup.without_repeated_lines(odd_documents)
    assert out.columns == odd_documents.columns and out.count() == odd_documents.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[3] is None and texts[4] == "" and texts[8].startswith("éà")
    assert line_dedup.without_repeated_lines(no_documents).count() == 0
