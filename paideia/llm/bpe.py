"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The queue has a bucket for each merge rank that is wanted just now; a bucket holds the positions of
left halves in the linked list of parts. Three levels of bitmaps say which buckets are filled, so the
next rank is three find-first-set steps away, whatever the length of the piece. Positions whose pair
has changed since they were queued are stale and are skipped. Encoding a piece of n bytes takes
O(n) queue steps (a bucket is sorted once, when it is drained). The distinct pieces of a stretch of text
are encoded together, some thousands in one list and one queue, and decoded.

Results for odd input: null text counts as empty and has no ids; an empty table gives an empty
table; texts of any length are taken whole; rows that share an id are encoded each on its own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, text_of

#: Distinct pieces that a task remembers, and the longest piece that it does.
CACHE_PIECES, CACHE_LENGTH = 250_000, 48
#: Pieces that share a queue: more share its steps, but leave the processor's caches.
TOGETHER = 4000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankQueue:
    """Positions by rank; ``drain`` empties the bucket of the lowest rank.

    ``low`` has a bit for each rank, ``mid`` for each word of ``low``, ``top`` for each word of ``mid``.
    """

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self, ranks: int) -> None:
        self.buckets: list[list[int] | None] = [None] * ranks
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def open(self, rank: int, positions: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = positions
        word, block = rank >> 6, rank >> 12
        self.low[word] |= 1 << (rank & 63)
        self.mid[block] |= 1 << (word & 63)
        self.top |= 1 << block

    def drain(self) -> tuple[int, list[int]]:
        top = self.top
        block = (top & -top).bit_length() - 1
        mid = self.mid[block]
        word = block << 6 | (mid & -mid).bit_length() - 1
        low = self.low[word]
        rank = word << 6 | (low & -low).bit_length() - 1
        low &= low - 1
        self.low[word] = low
        if not low:
            mid &= mid - 1
            self.mid[block] = mid
            if not mid:
                self.top = top & (top - 1)
        positions, self.buckets[rank] = self.buckets[rank], None
        return rank, positions


class Merges:
    """A vocabulary's ranks, ready for merging parts by id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.numbers = [*range(self.size), -1]
        #: For a part's id, by the id of the part before or after it, the rank of the token that they join to.
        none: dict[int, int] = {}
        self.before, self.after = [none] * self.size, [none] * self.size
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    for own, part, other in ((self.after, left, right), (self.before, right, left)):
                        if own[part] is none:
                            own[part] = {}
                        own[part][other] = rank
        #: The same for two bytes; -1 where there is none.
        self.two = np.full((256, 256), -1)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.two[token[0], token[1]] = rank

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece: in each, the lowest rank, at its leftmost place, merges first.

        All pieces share one linked list (with a break after each) and one queue: what a piece merges
        depends on its own ranks alone, so that the order among pieces is free.
        """
        whole = list(map(self.ranks.get, pieces))
        rest = [p for p, w in zip(pieces, whole) if w is None and p]
        found = chain.from_iterable(self._merge(rest[k : k + TOGETHER]) for k in range(0, len(rest), TOGETHER))
        return [[w] if w is not None else next(found) if p else [] for p, w in zip(pieces, whole)]

    def _merge(self, pieces: list[bytes]) -> list[list[int]]:
        if not pieces:
            return []
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        starts, end = np.append(0, ends[:-1]), len(raw)  # at ``end`` is a part that joins none: what comes before and after each piece
        wanted = np.full(end + 1, -1)
        wanted[: end - 1] = self.two[raw[:-1], raw[1:]]
        wanted[ends - 1] = -1
        queue = RankQueue(self.size)
        buckets, start_bucket, before, after = queue.buckets, queue.open, self.before, self.after
        # Lists share their numbers, so that the loop's memory stays near.
        places = list(range(end + 1))
        at = np.flatnonzero(wanted >= 0)
        at = at[np.argsort(wanted[at], kind="stable")]
        firsts = np.flatnonzero(np.diff(wanted[at], prepend=-1))
        own, cuts = list(map(places.__getitem__, at.tolist())), [*firsts.tolist(), len(at)]
        for rank, low, high in zip(wanted[at[firsts]].tolist(), cuts, cuts[1:]):
            start_bucket(rank, own[low:high])
        want = list(map(self.numbers.__getitem__, wanted.tolist()))
        nxt, prv = [*places[1:], end], [end, *places[:-1]]
        for a, b in zip(starts.tolist(), ends.tolist()):
            prv[a] = nxt[b - 1] = end
        ids = [*map(self.byte_ids.__getitem__, raw.tobytes()), -1]
        while queue.top:
            rank, positions = queue.drain()
            if len(positions) > 1:
                positions.sort()
            joins_after, joins_before = after[rank].get, before[rank].get
            for i in positions:
                if want[i] != rank:  # stale
                    continue
                j = nxt[i]
                k = nxt[j]
                ids[i], nxt[i], want[j], prv[k] = rank, k, -2, i
                r = want[i] = joins_after(ids[k], -1)
                if r >= 0:
                    bucket = buckets[r]
                    if bucket is None:
                        start_bucket(r, [i])
                    else:
                        bucket.append(i)
                h = prv[i]
                r = want[h] = joins_before(ids[h], -1)
                if r >= 0:
                    bucket = buckets[r]
                    if bucket is None:
                        start_bucket(r, [h])
                    else:
                        bucket.append(h)
        stays = np.array(want[:end]) != -2
        left = np.array(ids[:end])[stays].tolist()
        cuts = [0, *np.cumsum(stays)[ends - 1].tolist()]
        return [left[low:high] for low, high in zip(cuts, cuts[1:])]


class Codec:
    """Encoder and decoder of one vocabulary; remembers short pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.merges = Merges(load_ranks(path))
        self.tokens = {rank: token for token, rank in self.merges.ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}
        self.split = regex.compile(pattern).findall
        #: Of each piece that is remembered, its ids as text; of those whose ids stand for other bytes than its own, these bytes.
        self.ids: dict[str, str] = {}
        self.other: dict[str, bytes] = {}

    def encode(self, text: str) -> list[int]:
        pieces = self.split(text)
        distinct = list(dict.fromkeys(pieces))
        ids = dict(zip(distinct, self.merges.encode([p.encode() for p in distinct])))
        return [i for p in pieces for i in ids[p]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, SHA-256 of the ids as text, SHA-256 of the decoded bytes."""
        split = [self.split(t) for t in texts]
        new = list(set().union(*split) - self.ids.keys())
        raw = [p.encode() for p in new]
        found = self.merges.encode(raw)
        name = self.names.__getitem__
        self.ids.update(zip(new, [" ".join(map(name, ids)) for ids in found]))
        self.other.update((p, back) for p, own, back in zip(new, raw, map(self.decode, found)) if own != back)
        ids_of = self.ids.__getitem__
        out = []
        for pieces in split:
            if not pieces:
                out.append((0, _EMPTY, _EMPTY))
                continue
            ids = " ".join(map(ids_of, pieces))
            back = "".join(pieces).encode() if not self.other else b"".join([self.other[p] if p in self.other else p.encode() for p in pieces])
            out.append((ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
        if len(self.ids) - len(new) > CACHE_PIECES:
            self.ids = {p: self.ids[p] for p in new}
        for p in new:
            if len(p) > CACHE_LENGTH:
                del self.ids[p]
        return out


_EMPTY = hashlib.sha256(b"").hexdigest()


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _parts(values, chars: int = 1 << 20) -> Iterator[list[str]]:
    part, size = [], 0
    for value in values:
        part.append(value.as_py())
        size += len(part[-1])
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int): the ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = pa.array([own.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).transform(in_arrow, run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary): the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            raw = pa.array([own.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").transform(in_arrow, run, "doc_id long, decoded binary")


def encoding_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            rows = [row for part in _parts(batch.column(1)) for row in own.digests(part)]
            n, ids, raw = zip(*rows) if rows else ((), (), ())
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.ids.clear()  # the worker may serve other operators next

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).transform(in_arrow, run, SCHEMA)
