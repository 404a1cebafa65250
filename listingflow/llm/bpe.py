"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, others by merging over linked bytes."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import in_chunks, spread, texts_of
from .units import Recent, UnitEncoder


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys in n slots, one displacement per bucket of keys.

    A slot holds its key, so strings outside the set are told apart.
    """

    def __init__(self, keys: list[bytes], values: list[int], per_bucket: int = 4):
        n = self.n = len(keys)
        self.buckets = max(1, n // per_bucket)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        slot_of, taken = np.zeros(n, np.int64), np.zeros(n, bool)
        shift = np.zeros(self.buckets, np.int64)
        tries = np.arange(256, dtype=np.uint64)[:, None]
        for b in np.argsort(bounds[:-1] - bounds[1:], kind="stable").tolist():
            members = order[bounds[b] : bounds[b + 1]]
            if not len(members):
                break
            h, start, found = hashes[members][None, :], 0, False
            while not found:
                slots = self._slots(h, tries + np.uint64(start))
                rows = np.sort(slots, axis=1)
                for k in np.flatnonzero(~taken[slots].any(axis=1) & (rows[:, 1:] != rows[:, :-1]).all(axis=1)).tolist()[:1]:
                    shift[b], slot_of[members], found = start + k, slots[k], True
                    taken[slots[k]] = True
                start += len(tries)
        self.shift = shift.tolist()
        self.keys, self.values = [b""] * n, [0] * n
        for i, s in enumerate(slot_of.tolist()):
            self.keys[s], self.values[s] = keys[i], values[i]

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h >> np.uint64(20)) ^ (d * np.uint64(0x9E3779B97F4A7C15))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def get(self, key: bytes) -> int:
        """The value of a key, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        x = (h >> 20) ^ (self.shift[h % self.buckets] * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        slot = ((x * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 32) % self.n
        return self.values[slot] if self.keys[slot] == key else -1


class Pairs(dict):
    """The rank of two tokens joined, by their ids, or -1; asked of the perfect hash once, as long as it is remembered."""

    def __init__(self, rank: PerfectHash, token: dict[int, bytes], most: int = 300_000):
        self.rank, self.token, self.most = rank, token, most

    def __missing__(self, pair: int) -> int:
        if len(self) >= self.most:
            self.clear()
        r = self[pair] = self.rank.get(self.token[pair >> 32] + self.token[pair & 0xFFFFFFFF])
        return r


class Merger:
    """Joins the bytes of a pre-token: the pair of lowest rank, the leftmost of equals, until no pair has a rank."""

    def __init__(self, rank: PerfectHash, token: dict[int, bytes]):
        self.byte = [rank.get(bytes([b])) for b in range(256)]
        self.pairs = Pairs(rank, token)

    def __call__(self, piece: bytes) -> list[int]:
        ids, rank_of, push = list(map(self.byte.__getitem__, piece)), self.pairs.__getitem__, heapq.heappush
        pop = heapq.heappop
        n = len(ids)
        ranks = [rank_of(a << 32 | b) for a, b in zip(ids, ids[1:])]  # of the pair that begins at each place
        bits = 12 if n < 1 << 12 else 40  # a heap entry is rank and place in one number, a small one for all but the longest
        low = (1 << bits) - 1
        heap = [r << bits | i for i, r in enumerate(ranks) if r >= 0]
        if not heap:
            return ids
        heapq.heapify(heap)
        ranks.append(-1)
        before, after = list(range(-1, n - 1)), list(range(1, n + 2))
        while heap:
            e = pop(heap)
            r, i = e >> bits, e & low
            if ranks[i] != r:
                continue  # one of the two was joined meanwhile
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], ranks[i], ranks[j] = r, -1, -1, -1
            if k < n:
                before[k] = i
                if (s := rank_of(r << 32 | ids[k])) >= 0:
                    ranks[i] = s
                    push(heap, s << bits | i)
            if (k := before[i]) >= 0:
                s = ranks[k] = rank_of(ids[k] << 32 | r)
                if s >= 0:
                    push(heap, s << bits | k)
        return [i for i in ids if i >= 0]


class Codec:
    """Encoder and decoder of one file of ranks."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        tokens, ids = [base64.b64decode(t) for t, _ in pairs], [int(i) for _, i in pairs]
        self.rank = PerfectHash(tokens, ids)
        self.merge = Merger(self.rank, dict(zip(ids, tokens)))
        self.matches = regex.compile(pattern).findall
        self.known = Recent(self.encode_word)
        length = np.zeros(max(ids) + 1, np.int64)
        length[ids] = [len(t) for t in tokens]
        self.length, self.begin = length, np.concatenate([[0], np.cumsum(length)])[:-1]
        ordered = sorted(zip(ids, tokens))
        self.bytes = np.frombuffer(b"".join(t for _, t in ordered), np.uint8)
        self.encoder = UnitEncoder(self.encode_part)

    def encode_part(self, part: str) -> list[int]:
        out = []
        for word in self.matches(part):
            out += self.known[word]
        return out

    def encode_word(self, word: str) -> list[int]:
        piece = word.encode()
        whole = self.rank.get(piece)
        return [whole] if whole >= 0 else self.merge(piece)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encoder(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.begin[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.bytes[at].tobytes()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Ids of each document (doc_id, text) and the bytes they decode to: doc_id, n_tokens, ids (packed
    little-endian unsigned 32-bit), decoded.

    Null and empty texts have no ids. Repeated rows and null ids are encoded row by row; an empty
    table gives no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in in_chunks(batches):
            ids = c.encode(texts_of(batch))
            columns = [
                batch.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                pa.array([c.decode(x) for x in ids], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
