"""SimHash against brute force over all pairs."""
import random

import pytest
import xxhash

from riskloom.llm import simhash
from riskloom.llm.components import components
from tests.conftest import SF_SMALL


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))]
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids_fps, max_bits=2):
    n = len(ids_fps)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(ids_fps[i][1] ^ ids_fps[j][1]).count("1") <= max_bits:
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if ids_fps[i][0] is not None:
            r = find(i)
            least[r] = min(least.get(r, ids_fps[i][0]), ids_fps[i][0])
    return [least.get(find(i)) for i in range(n)]


def test_query_equals_brute_force(spark):
    from riskloom.llm.queries import QUERIES
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    fps = [(d.doc_id, plain_fingerprint(d.text)) for d in docs]
    want = {i: (f"{fp:016x}", c) for (i, fp), c in zip(fps, brute_components(fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash"](spark, SF_SMALL).collect()}
    assert got == want


@pytest.mark.parametrize("max_bits", [1, 2])
@pytest.mark.parametrize("bucket", [1, 8])
def test_links_keep_every_component(spark, max_bits, bucket):
    """Dense neighbourhoods: buckets above and below the pair limit."""
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {c for c in centres}
    for c in centres:
        for _ in range(60):
            x = c
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    found = {r.node: r.root for r in components(simhash.links(frame, max_bits, bucket)).collect()}
    want = brute_components(list(zip(signed, fps)), max_bits)
    groups_want, groups_got = {}, {}
    for f, w in zip(signed, want):
        groups_want.setdefault(w, set()).add(f)
        groups_got.setdefault(found.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups_want.values())) == sorted(map(sorted, groups_got.values()))


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(3).shuffle(order)
    chain = spark.createDataFrame(list(zip(order, order[1:])), "u bigint, v bigint")
    rows = components(chain).collect()
    assert len(rows) == n and len({r.root for r in rows}) == 1
    assert components(chain.limit(0)).count() == 0


def test_odd_rows(spark, odd_documents, no_documents):
    rows = simhash.near_components(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    name = {r.doc_id: r.component_id for r in rows}
    assert name[2] == 1 and name[9] == 1           # copies, and the same words in other case
    assert name[3] == name[4] == name[5] == 3      # null, empty, blank: fingerprint zero
    assert name[None] is None and name[6] == 6
    kept = simhash.near_dedup(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "6", "7", "8", "None"]
    assert simhash.near_components(no_documents).count() == 0
    assert simhash.near_dedup(no_documents).count() == 0
