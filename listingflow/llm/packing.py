"""Packing of tokenized documents into sequences by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_chunks, remembered, spread, texts_of
from .units import Recent, UnitEncoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

#: Byte-level vocabularies write a byte as a printable character: itself, or else the next one from 256 on.
_PRINTABLE = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_AS_LETTERS = "".join(chr(b if b in _PRINTABLE else 256 + b - sum(p < b for p in _PRINTABLE)) for b in range(256))


def tokenizer_encoder(path: str) -> UnitEncoder:
    """Ids by the tokenizers library, one encoder per worker.

    The library's model encodes each distinct match of the split pattern. No special token is added; a text that spells one out
    is encoded by the library as a whole, which takes it for that token.
    """
    encoders = remembered("packing")
    if path not in encoders:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        tokenize, matches = whole.model.tokenize, regex.compile(public_tokenizers.PATTERN).findall
        spelled = [t.content for t in whole.get_added_tokens_decoder().values()]
        known = Recent(lambda word: [t.id for t in tokenize(charmap_decode(word.encode(), "strict", _AS_LETTERS)[0])], most=100_000)  # what is asked for again is a part, mostly

        def encode(part: str) -> list[int]:
            word = part.rstrip(",.!")
            if word.isalpha() or word[1:].isalpha() and word[0] == " ":
                words = (word, part[len(word) :]) if len(word) < len(part) else (word,)
            else:
                words = matches(part)
            out = []
            for word in words:
                out += known[word]
            return out

        encoders[path] = UnitEncoder(encode, spelled=spelled, whole=lambda text: whole.encode(text, add_special_tokens=False).ids)
    return encoders[path]


def karmarkar_karp(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of `sizes` in `windows` groups with near-equal sums.

    Every item starts as a partition of its own. The two partitions with the widest spread are
    merged, the fullest group of one with the emptiest of the other, until one partition is left.
    """
    n = len(sizes)
    left, right = np.full(n * (windows + 1), -1, np.int64), np.full(n * (windows + 1), -1, np.int64)
    used = n  # nodes below n are the items; later ones join two nodes
    heap = []
    for i, size in enumerate(sizes):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[-1], nodes[-1] = size, i
        heap.append((-size, i, sums, nodes))
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, more, others = heapq.heappop(heap)
        sums, a, b = sums + more[::-1], nodes, others[::-1]  # both rise, so one is turned round
        nodes = np.where(a < 0, b, a)
        both = np.flatnonzero((a >= 0) & (b >= 0))
        left[used : used + len(both)], right[used : used + len(both)] = a[both], b[both]
        nodes[both] = np.arange(used, used + len(both))
        used += len(both)
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        sums = sums - sums[0]
        heapq.heappush(heap, (-int(sums[-1]), tie, sums, nodes))
        tie += 1
    groups = []
    for top in heap[0][3].tolist() if heap else []:
        items, stack = [], [top] if top >= 0 else []
        while stack:
            if (x := stack.pop()) < n:
                items.append(x)
            else:
                stack += [int(left[x]), int(right[x])]
        groups.append(sorted(items))
    return groups


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups that hold at most `capacity` each; one more window, or more, whenever one overflows."""
    if not sizes:
        return []
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = karmarkar_karp(sizes, windows)
        over = sum(max(0, sum(sizes[i] for i in g) - capacity) for g in groups)
        if not over:
            return [g for g in groups if g]
        windows += max(1, over // capacity)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, piece: int = 512, block: int = 1024) -> DataFrame:
    """Pack the documents (doc_id, text) into sequences of at most `capacity` ids.

    A document's ids are followed by `end_id`. Full sequences are cut off its front; what is left
    is cut into pieces of at most `piece` ids, which are dealt into near-equal windows, `block`
    pieces at a time within a task, so that nothing is shuffled and memory is bounded. Returns a
    row per piece: doc_id, start, length, ids (packed little-endian unsigned 32-bit), doc_tokens,
    sequence_id and offset (gapless in the sequence).

    Null and empty texts hold the end id alone. Null ids, repeated rows and ties are packed row by
    row. An empty table gives no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokenizer_encoder(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 36
        end = np.array([end_id], "<u4").tobytes()
        held: list[tuple] = []
        schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        def dealt() -> list[tuple]:
            nonlocal sequence
            rows = []
            for group in windows_for([p[2] for p in held], capacity):
                offset = 0
                for i in group:
                    rows.append((*held[i], sequence, offset))
                    offset += held[i][2]
                sequence += 1
            held.clear()
            return rows

        for batch in in_chunks(batches):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts_of(batch))):
                ids = ids.astype("<u4").tobytes() + end
                n, at = len(ids) // 4, 0
                while n - at >= capacity:
                    rows.append((doc, at, capacity, ids[4 * at : 4 * (at + capacity)], n, sequence, 0))
                    sequence, at = sequence + 1, at + capacity
                while at < n:
                    size = min(piece, n - at)
                    held.append((doc, at, size, ids[4 * at : 4 * (at + size)], n))
                    at += size
                if len(held) >= block:
                    rows += dealt()
            yield batch_of(rows)
        yield batch_of(dealt())

    return spread(docs.select("doc_id", "text")).mapInArrow(run, SCHEMA)
