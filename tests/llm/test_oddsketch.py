"""Odd-sketch near-dedup against brute force over all pairs."""
import random

import numpy as np
import pytest

from riskloom.llm import oddsketch
from tests.conftest import SF_SMALL


def plain_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(b" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1)))


def plain_components(rows):
    """[(doc_id, text)] -> sorted [(doc_id, n, component)]"""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                shared = len(a & b)
                if 100 * shared >= 80 * (len(a) + len(b) - shared):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def near_copies(rng, words, count, change):
    """Variants of one text: each has ``change`` words replaced."""
    out = []
    for _ in range(count):
        w = list(words)
        for at in rng.sample(range(len(w)), change):
            w[at] = f"x{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def test_query_equals_brute_force(spark):
    from riskloom.llm.queries import QUERIES
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = QUERIES["op12_oddsketch"](spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = got.collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == plain_components(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


@pytest.mark.parametrize("chunk", [4, 128])
def test_groups_around_the_threshold(spark, monkeypatch, chunk):
    """Groups whose members are alike, just alike, or just not alike: the
    leaders settle some, the search of whole buckets the others."""
    monkeypatch.setattr(oddsketch, "CHUNK", chunk)
    rng = random.Random(11)
    rows, at = [], 0
    for size, change in ((400, 4), (400, 9), (400, 10), (400, 11), (60, 1)):
        words = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for text in near_copies(rng, words, 40, change):
            rows.append((at, text))
            at += 1
    rows += [(at + i, rows[i][1]) for i in range(0, 30, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows)
    assert 40 < len({c for _, _, c in want}) < 190
    assert found(oddsketch.near_components(docs)) == want


def test_sketch_cut_passes_links(spark):
    """The cut refuses hardly any pair at the similarity, and refuses pairs
    far below it; the estimate is close."""
    rng = np.random.default_rng(3)
    cut = oddsketch.reject_above()

    def counts(shared, own, trials):
        out = []
        for _ in range(trials):
            h = rng.integers(0, 2 ** 63, shared + 2 * own, dtype=np.uint64)
            a = oddsketch.odd_sketch(oddsketch.minhash(h[:shared + own]))
            b = oddsketch.odd_sketch(oddsketch.minhash(np.concatenate((h[:shared], h[shared + own:]))))
            out.append(int(np.bitwise_count((a ^ b).view(np.uint64)).sum()))
        return np.array(out)

    linked = counts(800, 100, 300)
    assert linked.max() <= cut
    assert abs(oddsketch.estimate(linked.mean()) - 0.8) < 0.02
    assert abs(oddsketch.estimate(counts(95, 2, 200).mean()) - 95 / 99) < 0.02
    assert counts(250, 375, 200).min() > cut


def test_odd_rows(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert found(oddsketch.near_components(odd_documents)) == plain_components(rows)
    kept = oddsketch.near_dedup(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "8", "None"]
    assert oddsketch.near_components(no_documents).count() == 0
    assert oddsketch.near_dedup(no_documents).count() == 0
    lone = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, None)], "doc_id long, text string")
    assert found(oddsketch.near_components(lone)) == sorted([(None, 3, None), (None, 3, None), (7, 0, 7)], key=str)


def test_whole_sketch_bounds_the_difference(spark):
    """No linked pair is refused, and of sets of some hundred shingles those at
    0.7, which the sketches of the samples leave, are."""
    rng = np.random.default_rng(5)
    cuts = oddsketch.whole_cuts()
    assert cuts[0] == 0 and cuts[1] == 1 and cuts[40] <= 40 and cuts[-1] == oddsketch.WHOLE

    def passed(shared, own, trials=100):
        n = 0
        for _ in range(trials):
            h = rng.integers(0, 2 ** 63, shared + 2 * own, dtype=np.uint64)
            a = oddsketch.whole_sketch(h[:shared + own])
            b = oddsketch.whole_sketch(np.concatenate((h[:shared], h[shared + own:])))
            n += int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) <= cuts[min((2 * shared + 2 * own) // 9, len(cuts) - 1)]
        return n

    for size in (1, 30, 200, 1000, 20_000):
        assert passed(8 * size, size) == 100
    assert passed(210, 45) == 0 and passed(210, 45, 1) == 0                # 0.7: 300 shingles in either or both


def test_pairs_below_the_similarity_make_no_rows(spark, monkeypatch):
    """A group whose members are about 0.7 alike, all in one bucket or another:
    the search of whole buckets gives back no pair for confirmation."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = list(enumerate(near_copies(rng, words, 120, 11)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes, real = [], oddsketch._rest

    def counted(*a):
        found = real(*a)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(oddsketch, "_rest", counted)
    want = plain_components(rows)
    assert found(oddsketch.near_components(docs)) == want
    links = 0
    sets = [plain_set(t) for _, t in rows]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            links += 80 <= 100 * len(a & b) / len(a | b)
    assert sizes[0] <= links + 300, (sizes, links)
