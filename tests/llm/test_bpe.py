"""Merge replay against the tiktoken library."""
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from riskloom.llm import bpe
from tests.conftest import SF_SMALL

PATH = public_tokenizers.path(bpe.RANKS)


def library():
    ranks = {t: i for i, t in enumerate(bpe.load_ranks(PATH)) if t}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_tiktoken(spark):
    from riskloom.llm.queries import QUERIES
    enc = library()
    want = {}
    for d in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        ids = enc.encode_ordinary(d.text or "")
        want[d.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                          hashlib.sha256((d.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op8_bpe"](spark, SF_SMALL).collect()}
    assert got == want


def test_replay_of_runs_and_random_text():
    rng = random.Random(1)
    texts = ["a" * 1001, "=" * 667, " " * 502, "", None, "the the  the\n\n\n\t x", "é" * 77, "日本語" * 9, "😀" * 15]
    for alphabet in ("ab ", "-= \n", "erthnaeo ", "".join(map(chr, range(32, 0x2fff)))):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(40)]
    enc, own = library(), bpe.codec(PATH, public_tokenizers.PATTERN)
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == enc.encode_ordinary(text or "")
        assert own.decode(ids) == (text or "").encode()


def test_chunks_do_not_change_ids(spark, odd_documents, no_documents):
    def rows(limit):
        return sorted(bpe.encode_documents(odd_documents, chunk_chars=limit).collect(), key=str)

    assert rows(20) == rows(10 ** 9)
    assert len(rows(20)) == odd_documents.count()
    assert bpe.encode_documents(no_documents).count() == 0


def test_decode_is_the_round_trip(spark, odd_documents):
    encoded = bpe.encode_documents(odd_documents)
    back = {r.doc_id: bytes(r.payload) for r in bpe.decode_documents(encoded).collect()}
    for r in odd_documents.collect():
        assert back[r.doc_id] == (r.text or "").encode()
