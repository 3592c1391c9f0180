"""Spelling variants by composing the vocabulary acceptor with a one-edit
transducer and the acceptor again.

The composed machine walks through triples (state of the first word, edit done
or not, state of the second).  Before the edit both words are in one state, as
the acceptor is deterministic; the edit leads to two states, and what both
accept from there are the ends of two near words.  All accepted pairs are
enumerated per initial state:

* Words have ``MIN_LENGTH`` = 7 code points or more, so two near words either
  share their first three code points (the edit comes later) or their last
  four.  The machine is therefore started in the states that three code points
  lead to, and, over the reversed words, in those that four lead to.  A pair is
  reported by the first machine that can reach it, so by one only.
* A state below which more than ``STATE_WORDS`` words lie is never given to one
  task.  Its own edit arcs become rows keyed by (state, rest of the word after
  the edit), at most one per letter and one more in a group, which Spark joins;
  the words move on to the states behind it, until every state is small.
* A task gets the words of one state (a bounded list), builds the minimal
  acceptor (equal right languages are one state) and enumerates the pairs of
  every state once, however many prefixes lead to it.

The vocabulary is an aggregate with map-side combine over the runs of letters;
what crosses the network are distinct words, never texts.

Defined cases: null, empty and blank texts have no words; a null id counts as
empty text in the checksum; repeated rows count as often as they stand there;
words of equal count tie by code-point order; a word of one occurrence is not
in the vocabulary and so is near to nothing; empty table, empty result; extra
columns are ignored.
"""
from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from riskloom.llm.common import text_of, written

RUN = "[A-Za-z\u00C0-\u00FF]+"
MIN_LENGTH = 7
MIN_COUNT = 2
#: A misspelling is set where this divides the checksum of document and run.
DELETE_EVERY = 31
#: A form is this many times as frequent as its variant.
RATIO = 10
#: Words below an initial state that one task enumerates.
STATE_WORDS = 4000
#: Code points of the initial states, forwards and from the end.
HEAD, TAIL = 3, 4
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# ---------------------------------------------------------------- vocabulary

def vocabulary(docs: DataFrame, text: str = "text", misspell: bool = True, min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: the distinct words and how often they occur.  With
    ``misspell`` the contract's deletions are applied first."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text_of(text), F.lit(RUN), F.lit(0))).alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")
    low = F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", _UPPER, _UPPER.lower()))
    runs = runs.select("doc_id", low.alias("run"))
    word = F.col("run")
    if misspell:
        key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
        h = F.crc32(key.cast("binary"))
        at = (h % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(h % DELETE_EVERY == 0, cut).otherwise(word)
    words = runs.select(word.alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


# ------------------------------------------------------------------ automata

class Acceptor:
    """Minimal acyclic acceptor of sorted distinct words, from the state that
    their first ``depth`` code points lead to.

    A state knows how many words it accepts, and an arc how many come before
    it, so the words of a state are numbered and pairs are pairs of numbers.
    Unbranched stretches are walked in loops, so a word may be very long."""

    def __init__(self, words: Sequence[str], depth: int = 0):
        self.arcs: list[dict[str, tuple[int, int]]] = []     # letter -> (state, words before it)
        self.final: list[bool] = []
        self.size: list[int] = []
        self._known: dict[tuple, int] = {}
        self._ends: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._pairs: dict[int, list[tuple[int, int]]] = {}
        self.words = words
        self.start = self._state(0, len(words), depth)

    def _interned(self, final: bool, arcs: tuple[tuple[str, int], ...]) -> int:
        state = self._known.setdefault((final, arcs), len(self.arcs))
        if state == len(self.arcs):
            before, placed = int(final), {}
            for letter, q in arcs:
                placed[letter] = (q, before)
                before += self.size[q]
            self.arcs.append(placed)
            self.final.append(final)
            self.size.append(before)
        return state

    def _state(self, lo: int, hi: int, depth: int) -> int:
        words, first = self.words, depth
        while len(words[lo]) > depth and words[lo][depth] == words[hi - 1][depth]:
            depth += 1                                        # one arc, no word ends here
        final = len(words[lo]) == depth
        at, arcs = lo + final, []
        while at < hi:
            letter = words[at][depth]
            end = bisect_right(words, letter, at, hi, key=lambda w: w[depth])
            arcs.append((letter, self._state(at, end, depth + 1)))
            at = end
        state = self._interned(final, tuple(arcs))
        for letter in reversed(words[lo][first:depth]):
            state = self._interned(False, ((letter, state),))
        return state

    def common(self, p: int, q: int) -> list[tuple[int, int]]:
        """Ends accepted from both states, by number: the composed states with
        the edit done."""
        found = self._ends.get((p, q))
        if found is None:
            if p == q:
                found = [(i, i) for i in range(self.size[p])]
            else:
                found = [(0, 0)] if self.final[p] and self.final[q] else []
                a, b = self.arcs[p], self.arcs[q]
                for letter in a.keys() & b.keys():
                    (x, i0), (y, j0) = a[letter], b[letter]
                    found += [(i0 + i, j0 + j) for i, j in self.common(x, y)]
            self._ends[p, q] = found
        return found

    def near(self, p: int) -> list[tuple[int, int]]:
        """Pairs of words from one state, the edit not done: each unordered
        pair once, the edit at the first place where the words differ."""
        while len(self.arcs[p]) == 1 and not self.final[p]:
            p = next(iter(self.arcs[p].values()))[0]
        found = self._pairs.get(p)
        if found is None:
            found, arcs = [], self.arcs[p]
            letters = sorted(arcs)
            for k, b in enumerate(letters):
                q, j0 = arcs[b]
                for a in letters[:k]:                                     # replaced
                    x, i0 = arcs[a]
                    found += [(i0 + i, j0 + j) for i, j in self.common(x, q)]
                if self.final[p] and self.final[q]:                       # inserted before the end
                    found.append((0, j0))
                behind = self.arcs[q]
                for c in letters:                                         # inserted before c
                    if c != b and c in behind:
                        (x, i0), (y, j1) = arcs[c], behind[c]
                        found += [(i0 + i, j0 + j1 + j) for i, j in self.common(x, y)]
                found += [(j0 + i, j0 + j) for i, j in self.near(q)]
            self._pairs[p] = found
        return found


def first_difference(u: str, v: str) -> int:
    at = 0
    for a, b in zip(u, v):
        if a != b:
            break
        at += 1
    return at


def near_below(words: Sequence[str], depth: int, backwards: bool) -> list[tuple[str, str]]:
    """Near pairs of words that share ``depth`` code points; of reversed words
    only those that differ before the first initial state."""
    words = sorted(words)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 2 * max(map(len, words)) + 1000))
    machine = Acceptor(words, depth)
    found = [(words[i], words[j]) for i, j in machine.near(machine.start)]
    if not backwards:
        return found
    turned = [(u[::-1], v[::-1]) for u, v in found]
    return [(u, v) for u, v in turned if first_difference(u, v) < HEAD]


@F.pandas_udf(LongType())
def _branch(low: pd.Series, high: pd.Series) -> pd.Series:
    """Code points that all words between two have in common at their start."""
    return pd.Series([first_difference(a, b) for a, b in zip(low, high)], dtype="int64")


# --------------------------------------------------------------------- pairs

def _enumerated(states: DataFrame) -> DataFrame:
    """Pairs of small states: ``back, state, words``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for back, state, words in zip(b.column("back"), b.column("state"), b.column("words")):
                pairs = near_below(words.as_py(), len(state.as_py()), back.as_py())
                for k in range(0, len(pairs), 20_000):
                    part = pairs[k:k + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in part], pa.string()),
                                                      pa.array([v for _, v in part], pa.string())], ["u", "v"])

    return states.select("back", "state", "words").mapInArrow(run, "u string, v string")


def _own_arcs(moved: DataFrame) -> DataFrame:
    """Pairs whose edit is an arc of the (large) state itself.  ``moved``:
    ``back, state, s``; a group holds a word per letter and one more."""
    depth = F.length("state")
    edited = moved.where(F.length("s") > depth).select(
        "back", "state", F.substring("s", depth + 2, F.length("s")).alias("rest"),
        F.substring("s", depth + 1, F.lit(1)).alias("letter"), "s")
    plain = moved.select("back", "state", F.substring("s", depth + 1, F.length("s")).alias("rest"),
                         F.lit("").alias("letter"), "s")
    groups = edited.unionByName(plain).groupBy("back", "state", "rest").agg(
        F.sort_array(F.collect_list(F.struct("letter", "s"))).alias("m")).where(F.size("m") > 1)
    first = F.substring("rest", 1, 1)
    pairs = groups.select("back", "state", "rest", F.posexplode("m").alias("i", "a"), "m").select(
        "back", "rest", "a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    # an insertion counts where it is the first difference
    pairs = pairs.where((F.col("a.letter") != "") | (first != F.col("b.letter")))
    u, v = F.col("a.s"), F.col("b.s")
    out = pairs.select(F.when(F.col("back"), F.reverse(u)).otherwise(u).alias("u"),
                       F.when(F.col("back"), F.reverse(v)).otherwise(v).alias("v"), "back")
    early = F.substring("u", 1, HEAD) != F.substring("v", 1, HEAD)
    return out.where(~F.col("back") | early).select("u", "v")


def near_pairs(words: DataFrame, state_words: int = STATE_WORDS) -> DataFrame:
    """Unordered pairs ``u, v`` of near words, each once.  ``words``: a column
    ``word`` of distinct words of at least ``HEAD + TAIL`` code points."""
    both = words.select(F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("s")),
                                          F.struct(F.lit(True).alias("back"), F.reverse("word").alias("s")))).alias("x"))
    at = F.when(F.col("back"), F.substring("s", 1, TAIL)).otherwise(F.substring("s", 1, HEAD))
    moved = both.select("x.back", "x.s").withColumn("state", at)
    pairs: DataFrame | None = None
    while True:
        moved = written(moved, "spelling-words")
        sizes = written(moved.groupBy("back", "state").agg(
            F.count(F.lit(1)).alias("size"), F.min("s").alias("low"), F.max("s").alias("high")).where("size > 1"),
            "spelling-states")
        small = moved.join(sizes.where(F.col("size") <= state_words).select("back", "state"), ["back", "state"]).groupBy(
            "back", "state").agg(F.collect_list("s").alias("words"))
        found = _enumerated(small)
        large = sizes.where(F.col("size") > state_words)
        last = large.isEmpty()
        if not last:
            # on to where the words of the state part
            large = large.select("back", "state", _branch("low", "high").cast("int").alias("depth"))
            hot = moved.join(large, ["back", "state"])
            hot = written(hot.select("back", "s", F.substring("s", F.lit(1), F.col("depth")).alias("state")), "spelling-hot")
            found = found.unionByName(_own_arcs(hot))
            depth = F.length("state")
            moved = hot.where(F.length("s") > depth).select("back", "s", F.substring("s", F.lit(1), depth + 1).alias("state"))
        found = written(found, "spelling-pairs")
        pairs = found if pairs is None else pairs.unionByName(found)
        if last:
            return pairs


# --------------------------------------------------------------------- forms

def variants(vocab: DataFrame, ratio: int = RATIO, state_words: int = STATE_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``vocab``
    (``word, n``)."""
    vocab = written(vocab.select("word", "n"), "spelling-vocabulary")
    pairs = near_pairs(vocab, state_words)
    both = pairs.union(pairs.select("v", "u"))
    counts = vocab.select(F.col("word").alias("v"), F.col("n").alias("m"))
    best = both.join(counts, "v").groupBy(F.col("u").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("v").alias("near"))).alias("b"))
    known = vocab.join(best, "word", "left")
    frequent = -F.col("b.less") >= ratio * F.col("n")
    known = written(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                 F.when(frequent, F.col("b.near")).alias("form"),
                                 F.when(frequent, -F.col("b.less")).alias("form_n")), "spelling-forms")
    # follow forms: counts grow tenfold at every step, so chains are short
    roots = written(known.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(roots.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        roots = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    out = known.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

