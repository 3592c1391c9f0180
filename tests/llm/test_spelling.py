"""Spelling variants against brute force over words and deletions."""
import random
import re
import zlib
from collections import Counter

import pytest

from riskloom.llm import spelling
from tests.conftest import SF_SMALL


def lowered(run):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def plain_vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def is_near(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    u, v = sorted((u, v), key=len)
    at = 0
    while at < len(u) and u[at] == v[at]:
        at += 1
    return u[at + 1:] == v[at + 1:] if len(u) == len(v) else u[at:] == v[at + 1:]


def plain_pairs(words):
    """Words that share a deletion (of one of them or of both) are candidates."""
    by = {}
    for w in words:
        for cut in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            by.setdefault(cut, set()).add(w)
    return {(u, v) for group in by.values() for u in group for v in group if u < v and is_near(u, v)}


def plain_variants(counts):
    near = {}
    for u, v in plain_pairs(counts):
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x))
        if counts[best] >= 10 * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near.get(w, [])), counts.get(form.get(w))))
    return sorted(out)


def as_rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def unordered(rows):
    pairs = [tuple(sorted((r.u, r.v))) for r in rows]
    assert len(pairs) == len(set(pairs))
    return set(pairs)


def test_query_equals_brute_force(spark):
    from riskloom.llm.queries import QUERIES
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = QUERIES["op11_spelling"](spark, SF_SMALL)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(plain_vocabulary(rows))
    assert as_rows(got) == want
    assert any(w[4] for w in want)


def test_acceptor_is_minimal_and_numbers_its_words():
    words = sorted({a + b + c for a in ("ab", "b", "abc") for b in ("", "x", "yy") for c in ("end", "ending")})
    m = spelling.Acceptor(words)
    assert m.size[m.start] == len(words)

    def language(p):
        return tuple(([""] if m.final[p] else []) + [c + w for c in sorted(m.arcs[p]) for w in language(m.arcs[p][c][0])])

    assert list(language(m.start)) == words
    assert len({language(p) for p in range(len(m.arcs))}) == len(m.arcs)


@pytest.mark.parametrize("state_words", [2, 30, 4000])
def test_pairs_equal_brute_force(spark, state_words):
    """Dense words over few letters; small states force moves into deeper ones."""
    rng = random.Random(7)
    words = {"".join(rng.choice("abÀ") for _ in range(rng.randrange(7, 11))) for _ in range(700)}
    words |= {"commonhead" + "".join(rng.choice("xy") for _ in range(rng.randrange(0, 6))) for _ in range(60)}
    words |= {"a" * 7, "a" * 8, "a" * 9, "ba" + "a" * 6, "a" * 6 + "b"}
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    assert unordered(spelling.near_pairs(frame, state_words).collect()) == {tuple(sorted(p)) for p in plain_pairs(words)}


def test_very_long_words():
    long = "ab" * 20_000
    words = [long, long + "c", "x" + long[1:], long[:-1] + "q", long[:20_000] + "z" + long[20_000:], "abababa"]
    found = {tuple(sorted(p)) for p in spelling.near_below([w for w in words if w.startswith("aba")], 3, False)}
    found |= {tuple(sorted(p)) for p in spelling.near_below([w[::-1] for w in words if w.endswith("baba"[:4]) or w.endswith("abab")], 4, True)}
    want = {tuple(sorted((u, v))) for u in words for v in words if is_near(u, v)}
    assert found >= {p for p in want if p[0].startswith("aba") and p[1].startswith("aba")}


def test_forms_chain_and_ties(spark):
    counts = {"variant": 5000, "variamt": 40, "variam": 9, "varianta": 3, "gruppen": 30, "grüppen": 30, "grappen": 3,
              "gruppenn": 2, "alone123"[:7] + "x": 2}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_rows(spelling.variants(frame)) == plain_variants(counts)
    chain = {"aaaaaaa": 100_000, "aaaaaab": 9_000, "aaaaacb": 800, "aaaadcb": 70, "aaaedcb": 6}
    got = as_rows(spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert got == plain_variants(chain) and {r[2] for r in got} == {"aaaaaaa"}


def test_odd_rows(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert as_rows(spelling.variants(spelling.vocabulary(odd_documents))) == plain_variants(plain_vocabulary(rows))
    assert spelling.variants(spelling.vocabulary(no_documents)).count() == 0
    texts = [(None, "Überraschung ÜBERRASCHUNG überraschung"), (None, "Überraschung"), (3, None), (4, "  "), (5, "×÷×÷×÷×÷ ×÷×÷×÷×÷")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert as_rows(spelling.variants(spelling.vocabulary(docs))) == plain_variants(plain_vocabulary(texts))
