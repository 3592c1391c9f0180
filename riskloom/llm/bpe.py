"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each task cuts its documents into pieces (the tokenizer's pattern), numbers
the distinct pieces of a chunk of documents once, and replays the merges over
all distinct pieces together: an inverted index holds, for every adjacent
token pair that has a rank, the positions where it occurs; ranks are taken in
ascending order, all occurrences of the pair are merged in one array step, and
only the touched neighbours give new pairs to the index.  The documents then
read their ids off the encoded pieces.  No shuffle; a chunk is bounded by
``CHUNK_CHARS`` (a single longer text is a chunk of its own).

Merging the occurrences of one rank together equals merging them one by one
unless a merge opens a pair of lower rank; the vocabulary is tested for that
(``Merges.eager``), and for such tokens only the first occurrence in each
piece is merged before the index is asked again.

Defined cases: null text encodes to no ids like the empty text; every row is
encoded for itself, so repeated rows and ids, null ids and extra columns make
no difference; empty table, empty result.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

RANKS = "byte_bpe_50k.tiktoken"
CHUNK_CHARS = 32_000_000


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Merges:
    """The merge table of a vocabulary: for tokens a, b the rank of a + b."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        rank = {t: i for i, t in enumerate(tokens) if t}
        self.byte = np.array([rank[bytes([i])] for i in range(256)], np.int64)
        left, right, out = [], [], []
        for t, r in rank.items():
            for cut in range(1, len(t)):
                a, b = rank.get(t[:cut]), rank.get(t[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    out.append(r)
        a, b, r = (np.array(x, np.int64) for x in (left, right, out))
        key = a << 32 | b
        order = np.argsort(key)
        self.key, self.rank = key[order], r[order]
        eager = np.ones(len(tokens), bool)
        eager[a[r < a]] = False
        eager[b[r < b]] = False
        self.eager = eager

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it does not merge."""
        if not len(a):
            return np.empty(0, np.int64)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], -1)


def replay(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Encode all pieces; returns (ids, offsets): piece i has
    ids[offsets[i]:offsets[i + 1]]."""
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.concatenate(([0], np.cumsum(lens)))
    n = int(starts[-1])
    if n == 0:
        return np.empty(0, np.int64), np.zeros(len(pieces) + 1, np.int64)
    tok = merges.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    piece = np.repeat(np.arange(len(pieces)), lens)
    nxt = np.arange(1, n + 1)
    nxt[starts[1:][lens > 0] - 1] = -1                 # -1: end of the piece
    prv = np.arange(-1, n - 1)
    prv[starts[:-1][lens > 0]] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = defaultdict(list)
    heap: list[int] = []

    def note(pos: np.ndarray, ranks: np.ndarray) -> None:
        """File positions under the ranks of their pairs."""
        hit = ranks >= 0
        pos, ranks = pos[hit], ranks[hit]
        if len(pos) == 0:
            return
        order = np.argsort(ranks, kind="stable")
        pos, ranks = pos[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for r, p in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(pos, cuts)):
            if r not in index:
                heapq.heappush(heap, r)
            index[r].append(p)

    first = np.flatnonzero(nxt >= 0)
    note(first, merges.lookup(tok[first], tok[nxt[first]]))
    while heap:
        rank = heapq.heappop(heap)
        found = index.pop(rank)
        pos = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        pos = pos[alive[pos]]
        pos = pos[nxt[pos] >= 0]
        pos = pos[merges.lookup(tok[pos], tok[nxt[pos]]) == rank]
        if len(pos) == 0:
            continue
        if not merges.eager[rank]:
            lead = np.concatenate(([True], piece[pos[1:]] != piece[pos[:-1]]))
            rest = pos[~lead]
            pos = pos[lead]
            if len(rest):
                heapq.heappush(heap, rank)
                index[rank].append(rest)
        elif len(pos) > 1:
            # overlapping occurrences (a run of one token): every second one, from the left
            chained = np.concatenate(([False], nxt[pos[:-1]] == pos[1:]))
            if chained.any():
                at = np.arange(len(pos))
                run = np.maximum.accumulate(np.where(chained, -1, at))
                pos = pos[(at - run) % 2 == 0]
        gone = nxt[pos]
        after = nxt[gone]
        tok[pos] = rank
        alive[gone] = False
        nxt[pos] = after
        inner = after >= 0
        prv[after[inner]] = pos[inner]
        before = prv[pos]
        touched = np.concatenate((before[before >= 0], pos[inner]))
        touched = np.unique(touched)
        note(touched, merges.lookup(tok[touched], tok[nxt[touched]]))
    counts = np.bincount(piece[alive], minlength=len(pieces))
    return tok[alive], np.concatenate(([0], np.cumsum(counts)))


class _Numbers(dict):
    """piece -> its number, in order of first sight."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        self.merges = Merges(load_ranks(path))
        self.find = regex.compile(pattern).findall

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (uint32) of each text."""
        numbers = _Numbers()
        number = numbers.__getitem__
        docs = [np.fromiter(map(number, self.find(t or "")), np.int32) for t in texts]
        ids, offsets = replay([p.encode("utf-8", "surrogatepass") for p in numbers], self.merges)
        ids = ids.astype(np.uint32)
        size = np.diff(offsets)
        out = []
        for d in docs:
            n = size[d]
            shift = np.cumsum(n) - n
            out.append(ids[np.repeat(offsets[d] - shift, n) + np.arange(int(n.sum()))])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.merges.tokens.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a vocabulary file, built once per Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows regrouped to chunks of about ``limit`` characters of ``t``."""
    held, chars = [], 0
    for batch in batches:
        start = 0
        for i, n in enumerate(pc.fill_null(pc.utf8_length(batch.column("t")), 0).to_pylist()):
            chars += n
            if chars >= limit:
                held.append(batch.slice(start, i + 1 - start))
                yield pa.Table.from_batches(held)
                held, chars, start = [], 0, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def encode_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None,
                     pattern: str = public_tokenizers.PATTERN, with_ids: bool = True,
                     chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per row: the key, n_tokens, ids_sha256, decoded_sha256 and, with
    ``with_ids``, the ids themselves as an array."""
    path = path or public_tokenizers.path(RANKS)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<bigint>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for chunk in _chunks(batches, chunk_chars):
            encoded = c.encode(chunk.column("t").to_pylist())
            columns = {
                key: chunk.column("k").combine_chunks(),
                "n_tokens": pa.array([len(x) for x in encoded], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in encoded]),
                "decoded_sha256": pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in encoded])}
            if with_ids:
                ends = np.concatenate(([0], np.cumsum([len(x) for x in encoded])))
                columns["ids"] = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(np.concatenate(encoded).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ids: str = "ids", key: str = "doc_id", path: str | None = None,
                     pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(key, payload binary): the bytes of each row's ids."""
    path = path or public_tokenizers.path(RANKS)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            payload = pa.array([c.decode(np.array(x or [], np.int64)) for x in b.column("i").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("k"), payload], [key, "payload"])

    return encoded.select(encoded[key].alias("k"), encoded[ids].alias("i")).mapInArrow(
        run, f"`{key}` {kind}, payload binary")
