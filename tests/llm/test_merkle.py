"""Merkle manifest against a plain tree built level by level."""
import hashlib
import zlib

import pytest

from riskloom.llm import merkle
from tests.conftest import SF_SMALL


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_levels(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        a = levels[-1]
        levels.append([h(*a[i:i + 3]) for i in range(0, len(a), 3)])
    return levels


def plain_proof(levels, i):
    out = []
    for a in levels[:-1]:
        run = i - i % 3
        out.append((i % 3, [a[j] for j in range(run, min(run + 3, len(a))) if j != i]))
        i //= 3
    return out


def plain_postorder(n):
    """(level, index) of every node in the order of a depth-first walk."""
    widths = [n]
    while widths[-1] > 1:
        widths.append((widths[-1] + 2) // 3)
    out = []

    def walk(level, i):
        if level:
            for c in range(3 * i, min(3 * i + 3, widths[level - 1])):
                walk(level - 1, c)
        out.append((level, i))

    walk(len(widths) - 1, 0)
    return out


def plain_leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_manifest(rows):
    """The contract's columns, from plain Python, as a sorted list."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, shown = {}, {}
    for s in sources:
        group = []
        for r in by_source[s]:
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            text = r["text"].replace("\n", "") if hit and r["text"] is not None else r["text"]
            group.append((r["doc_id"], plain_leaf(r, r["text"]), plain_leaf(r, text)))
        group.sort(key=lambda g: (g[0] is not None, g[0] or 0, g[1]))
        trees[s], shown[s] = plain_levels([g[1] for g in group]), group
    top = plain_levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (doc_id, leaf, presented) in enumerate(shown[s]):
            steps = plain_proof(trees[s], i) + plain_proof(top, k)
            node = presented
            for place, others in steps:
                node = h(*others[:place], node, *others[place:])
            proof = h(*[d for _, others in steps for d in others])
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def as_rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 80, 81, 82, 250])
def test_positions_are_those_of_a_postorder_walk(n):
    walk = plain_postorder(n)
    assert [merkle.position(level, i, n) for level, i in walk] == list(range(len(walk)))
    leaves = [h(str(i)) for i in range(n)]
    levels = plain_levels(leaves)
    assert merkle.subtree_log(leaves) == [levels[level][i] for level, i in walk]


def test_query_equals_plain_trees(spark):
    from riskloom.llm.queries import QUERIES
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    got = QUERIES["op13_merkle"](spark, SF_SMALL)
    assert list(got.columns) == list(COLUMNS)
    got = as_rows(got)
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("levels", [1, 2])
def test_many_tiers(spark, monkeypatch, levels):
    """Blocks of three and nine leaves: up to five tiers, a hot source among them."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = [(i, "hot" if i % 3 else f"s{i % 11}", "en", i, f"text\n{i}") for i in range(160)] + [
        (500, "alone", None, None, None), (501, None, "en", 1, "x\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    m = merkle.manifest(docs, merkle.tampered_text())
    assert len(m.log.tiers) > 2
    assert as_rows(merkle.verified(m)) == plain_manifest(docs.collect())
    nodes = {}
    for r in merkle.log_nodes(m.log).collect():
        nodes.setdefault(r.tree, {})[r.position] = (r.level, r.idx, r.digest)
    for tree, n, root in m.log.roots.collect():
        walk = plain_postorder(n)
        assert sorted(nodes[tree]) == list(range(len(walk)))
        assert [nodes[tree][p][:2] for p in range(len(walk))] == walk
        assert nodes[tree][len(walk) - 1][2] == root


def test_a_changed_row_fails_alone(spark):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([(i, "a", "en", 1, f"t{i}") for i in range(50)],
                                 "doc_id long, source string, lang string, n_chars long, text string")
    shown = F.when(F.col("doc_id") == 17, F.lit("other")).otherwise(F.col("text"))
    bad = [r.doc_id for r in merkle.verified(merkle.manifest(docs, shown)).where("not verified").collect()]
    assert bad == [17]


def test_odd_rows(spark, odd_documents, no_documents):
    got = as_rows(merkle.verified(merkle.manifest(odd_documents, merkle.tampered_text())))
    assert got == plain_manifest(odd_documents.collect())
    m = merkle.manifest(no_documents)
    assert merkle.verified(m).count() == 0 and merkle.root(m).count() == 0
