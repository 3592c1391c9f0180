"""Closed syncmers and edited neighbours against plain loops."""
import base64
import hashlib
import struct
from collections import Counter

import numpy as np

from riskloom.llm import syncmers
from tests.conftest import SF_SMALL


def plain_neighbours(docs):
    """docs in descending order -> id, edited text, next text."""
    for i, (key, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        cut = len(text) // 3
        yield key, text, text[:len(text) - cut] + following[:cut], following


def plain_anchors(text):
    """(upper half of the hash, position) of every anchor."""
    h, at = syncmers.anchors_of(text)
    return [(int(x) >> 32, int(i)) for x, i in zip(h, at)]


def decoded(fp):
    """The anchors that a fingerprint holds, six bytes each."""
    raw, out, pos = base64.b64decode(fp), [], 0
    for i in range(0, len(raw), 6):
        gap, h = struct.unpack("<HI", raw[i:i + 6])
        pos += gap
        out.append((h, pos))
    return out


def plain_likeness(a, b):
    """Equal anchors, the i-th of a hash with the i-th, vote for their offset."""
    if not a or not b:
        return float(len(a) == len(b))

    def places(x):
        out = {}
        for h, i in x:
            out.setdefault(h, []).append(i)
        return out

    pa, pb = places(a), places(b)
    votes = Counter(j - i for h in pa for i, j in zip(pa[h], pb.get(h, [])))
    matched = sum(n for n in votes.values() if n >= min(2, len(a), len(b)))
    return matched / (len(a) + len(b) - matched)


def check(rows, docs):
    assert len(rows) == len(docs)
    got = {r.doc_id: r for r in rows}
    after = {k: docs[(i + 1) % len(docs)][0] for i, (k, _) in enumerate(docs)}
    for key, text, edited, following in plain_neighbours(docs):
        r = got[key]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, ed, nx = (plain_anchors(t) for t in (text, edited, following))
        assert decoded(r.fingerprint) == own and decoded(r.edited_fingerprint) == ed
        # the likeness follows from the returned strings
        assert r.near_edited == syncmers.likeness(r.fingerprint, r.edited_fingerprint) == plain_likeness(own, ed)
        assert r.near_next == syncmers.likeness(r.fingerprint, got[after[key]].fingerprint) == plain_likeness(own, nx)


def test_query_equals_plain_loop(spark):
    from riskloom.llm.queries import QUERIES
    docs = sorted(((d.doc_id, d.text or "") for d in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()),
                  reverse=True)
    rows = QUERIES["op10_syncmers"](spark, SF_SMALL).collect()
    check(rows, docs)
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.9


def test_syncmers_by_definition():
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcde "), 400))
    for k, s in ((24, 8), (11, 4), (9, 8), (7, 7)):
        inner = syncmers._mix(syncmers._rolling(syncmers._mix(
            np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)), s))
        want = [i for i in range(len(text) - k + 1)
                if min(inner[i:i + k - s + 1]) in (inner[i], inner[i + k - s])]
        h, at = syncmers.anchors_of(text, k, s)
        assert at.tolist() == want
        # context free: a k-mer alone gives the same hash
        for i, x in list(zip(at, h))[:20]:
            assert syncmers.anchors_of(text[i:i + k], k, s)[0].tolist() == [x]


def test_short_texts_have_fingerprints():
    rng = np.random.default_rng(7)
    for n in range(1, 61):
        for _ in range(20):
            a, b = ("".join(rng.choice(list("abcdefghij klmnop"), n)) for _ in range(2))
            own = syncmers.fingerprint(a)
            assert own and syncmers.likeness(own, own) == 1.0
            if n >= 10:
                assert syncmers.likeness(own, syncmers.fingerprint(b)) == 0.0


def test_passage_in_a_long_text_is_seen():
    rng = np.random.default_rng(11)
    letters = list("abcdefghij klmnop")
    for _ in range(10):
        passage, long = ("".join(rng.choice(letters, n)) for n in (500, 40_000))
        a, b = plain_anchors(passage), plain_anchors(long[:9000] + passage + long[9000:])
        got = syncmers.likeness(syncmers.fingerprint(passage), syncmers.fingerprint(long[:9000] + passage + long[9000:]))
        assert got == len(a) / len(b) > 0


def test_positions_decide():
    """Anchors of the same passages in another order match by passage; equal
    anchors at scattered places do not."""
    rng = np.random.default_rng(12)
    a, b = ("".join(rng.choice(list("abcdefghij klmnop"), 2000)) for _ in range(2))
    swapped = syncmers.likeness(syncmers.fingerprint(a + b), syncmers.fingerprint(b + a))
    assert swapped > 0.9
    h, at = syncmers.anchors_of(a)
    lone = syncmers.to_string(h, np.cumsum(np.arange(1, len(h) + 1)))          # the same hashes, no common offset
    assert syncmers.likeness(syncmers.to_string(h, at), lone) < 0.2


def test_gaps_are_bounded():
    rng = np.random.default_rng(13)
    for text in ("a" * 70_000, "ab" * 40_000, "".join(rng.choice(list("ab "), 80_000))):
        assert np.diff(syncmers.anchors_of(text)[1], prepend=0).max() <= syncmers.K - syncmers.S


def test_odd_rows(spark, odd_documents, no_documents):
    rows = syncmers.edited_neighbours(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[2]) == 2 and by[3][0].fingerprint == "" and by[1][0].fingerprint == by[2][0].fingerprint
    assert by[4][0].near_next == 1.0                       # empty beside null: both empty
    assert syncmers.edited_neighbours(no_documents).count() == 0
    single = syncmers.edited_neighbours(odd_documents.where("doc_id = 1")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0
    found = {(r.doc_id, r.hash, r.pos) for r in syncmers.anchors(odd_documents).collect()}
    want = set()
    for d in odd_documents.collect():
        h, at = syncmers.anchors_of(d.text or "")
        want |= {(d.doc_id, *x) for x in zip(h.view(np.int64).tolist(), at.tolist())}
    assert found == want
