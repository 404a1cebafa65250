"""Removal of passages that recur word for word, located by Aho-Corasick automata."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import compress
from math import isqrt

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .anchors import by_part, by_turn, kept, pack, parts_for, recurring, runs_of, shard_keys, short, signed, sorted_keys, unpack
from .common import sharded
from .hashing import window_hashes
from .wording import Known, Numbers, hashed_words, numbered, word_hashes

#: Words of the passages that one automaton holds; a shard with more of them compiles several.
AUTOMATON_WORDS = 300_000


def _texts(table: pa.Table) -> tuple[list[int], list[bytes], np.ndarray]:
    """The number of each row's text, the distinct texts, and how often each stands in the shard."""
    number: dict[bytes, int] = {}
    own = [number.setdefault(t or b"", len(number)) for t in table["text"].cast(pa.binary()).to_pylist()]
    return own, list(number), np.bincount(own, minlength=len(number))


def stretches(texts: list[bytes], keys: tuple[np.ndarray, np.ndarray], length: int, q: int) -> Iterator[tuple[int, int, bytes]]:
    """(text, key, words) of each run of windows whose anchor recurs; of a heavy anchor, each window by itself,
    with its own hash for a key."""
    split: tuple[int, list[bytes]] = -1, []
    for runs in runs_of(hashed_words(texts), length, q):
        which, heavy = kept(runs, keys)
        columns = (runs.sequence[which], signed(runs.key[which]), runs.first[which], runs.count[which], heavy)
        for k, key, first, count, many in zip(*(c.tolist() for c in columns)):
            if k != split[0]:
                split = k, texts[k].split()
            if many:
                for a in range(first, first + count):
                    body = b" ".join(split[1][a : a + length])
                    yield k, xxhash.xxh3_64_intdigest(body) - (1 << 63), body
            else:
                yield k, key, b" ".join(split[1][first : first + count + length - 1])


def confirmed_passages(found: dict[tuple[int, bytes], int], times: list[int], length: int) -> list[list[bytes]]:
    """For each stretch (key, words), its passages: the longest runs of windows that occur twice or more among the
    stretches of its key, each of which occurs `times` times.

    Windows are compared word by word; hashes only bring equal ones together.
    """
    titles = list(found)
    keys = np.array([k for k, _ in titles], np.int64)
    _, group, sizes = np.unique(keys, return_inverse=True, return_counts=True)
    alone = sizes[group] == 1
    out = [[body] if single and n > 1 else [] for (_, body), n, single in zip(titles, times, alone.tolist())]
    some = np.flatnonzero(~alone).tolist()
    if not some:
        return out
    numbers, words = Numbers(), [titles[k][1].split() for k in some]
    ids = [numbered(w, numbers) for w in words]
    joined = np.concatenate(ids)
    n_words = np.array([len(x) for x in ids])
    windows = n_words - length + 1
    begin = np.cumsum([0, *n_words[:-1]])
    own = np.repeat(np.arange(len(some)), windows)
    first = np.cumsum([0, *windows[:-1]])
    place = begin[own] + np.arange(len(own)) - first[own]
    owner, total = group[some][own], np.array(times, np.int64)[some][own]
    for salt in range(64):
        hashes = window_hashes(word_hashes(b"%d %d" % (salt, x) for x in range(len(numbers)))[joined], length)[place]
        order = np.lexsort((hashes, owner))
        equal = np.zeros(len(order), bool)
        equal[1:] = (owner[order][1:] == owner[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
        pairs = np.flatnonzero(equal)
        if all((joined[place[order[x]][:, None] + np.arange(length)] == joined[place[order[x - 1]][:, None] + np.arange(length)]).all() for x in np.array_split(pairs, len(pairs) // 50_000 + 1)):
            break  # no two different windows have one hash
    start = np.flatnonzero(~equal)
    twice = np.empty(len(order), np.int8)
    twice[order] = np.repeat(np.add.reduceat(total[order], start) > 1, np.diff(np.append(start, len(order))))
    for k, w, a, n in zip(some, words, first.tolist(), windows.tolist()):
        edge = np.flatnonzero(np.diff(twice[a : a + n], prepend=np.int8(0), append=np.int8(0))).tolist()
        out[k] = [b" ".join(w[i : j + length - 1]) for i, j in zip(edge[::2], edge[1::2])]
    return out


def occurrences(passages: list[bytes], texts: list[bytes]) -> list[np.ndarray]:
    """Which words of each text lie in an occurrence of a passage, as automata of the passages find them.

    A node of an automaton looks through its branches one by one, so a word goes in as two letters, each
    of which has about as many values as the square root of the number of words.
    """
    learned = Numbers({b"": 0})  # for words that no passage has
    own = numbered(b" ".join(passages).split(), learned)
    numbers = Known(learned)
    base = isqrt(len(numbers)) + 1
    gap = lambda x: x + 0x800 * (x >= 0xD800)  # noqa: E731  letters that are none

    def spelled(words: np.ndarray) -> str:
        letters = np.empty((len(words), 2), "<u4")
        letters[:, 0], letters[:, 1] = gap(words // base + 1), gap(words % base + base + 2)
        return letters.tobytes().decode("utf-32-le")

    sizes, spelling = [p.count(b" ") + 1 for p in passages], spelled(own)
    spellings = [spelled(numbered(t.split(), numbers)) for t in texts]
    edges = [np.zeros(len(s) // 2 + 1, np.int32) for s in spellings]
    at = first = 0
    while at < len(passages):
        automaton, held = ahocorasick.Automaton(ahocorasick.STORE_LENGTH), 0
        while at < len(passages) and held < AUTOMATON_WORDS:
            automaton.add_word(spelling[2 * first : 2 * (first + sizes[at])])
            held, first, at = held + sizes[at], first + sizes[at], at + 1
        automaton.make_automaton()
        for s, edge in zip(spellings, edges):
            found = np.array(list(automaton.iter(s)), np.int64).reshape(-1, 2)
            found = found[found[:, 0] % 2 == 1] // 2  # last word and length
            np.add.at(edge, found[:, 0] + 1 - found[:, 1], 1)
            np.add.at(edge, found[:, 0] + 1, -1)
    return [np.cumsum(e[:-1]) > 0 for e in edges]


def dedup_passages(docs: DataFrame, length: int = 35, q: int = 8, shard_bytes: int = 6 << 20, carry: Sequence[str] = ()) -> DataFrame:
    """Remove from each document (doc_id, text) every word covered by `length` consecutive words that also
    start anywhere else, the same document included: doc_id, n_words, n_removed, text (the words kept,
    joined by one space, or the text as it was if none goes), and the columns named by `carry`.

    Texts are dealt into shards. Each shard names the anchors of its windows; anchors that recur come
    back, and the shard sends the words around them, each distinct stretch once with its number of
    occurrences. Where an anchor's stretches meet, windows that occur at least twice in all are confirmed,
    word by word, and the passages that they make go to the shards that have the anchor. Each shard compiles
    its passages into automata, and streams all its documents through them: what they find goes. An
    anchor at very many places is not gathered: its windows are dealt by hashes of their own. Copies of a text
    within a shard count as one text that occurs several times.

    Null and empty texts have no words. Null ids and repeated rows are rows like others: a repeated row is a
    copy. A text longer than a shard makes one by itself, and is hashed in overlapping pieces. An empty table
    gives no rows. Other columns are ignored.
    """
    shards, n = sharded(docs.withColumn("doc_id", F.col("doc_id").cast("long")), shard_bytes, carry)
    parts = parts_for(n)

    def name(table: pa.Table) -> pa.Table:
        _, texts, times = _texts(table)
        keys = []
        for runs in runs_of(hashed_words(texts), length, q):
            keys += [runs.key, runs.key[times[runs.sequence] > 1]]  # a copied text has each anchor again
        return shard_keys(table["shard"][0].as_py(), keys, parts)

    again = recurring(shards.groupBy("shard").applyInArrow(name, "part int, shard int, block binary"), n)

    def send(table: pa.Table, keys: pa.Table) -> pa.Table:
        _, texts, times = _texts(table)
        found: dict[tuple[int, bytes], int] = {}
        for k, key, body in stretches(texts, sorted_keys(keys), length, q):
            found[key, body] = min(found.get((key, body), 0) + int(times[k]), 2)
        bodies = [b for _, b in found]
        columns = [np.array([k for k, _ in found], np.int64), np.array(list(found.values()), np.int64), np.array([len(b) for b in bodies], np.int64)]
        order, shares = by_part(short(columns[0].view(np.uint64)), parts)
        blocks = [pack([c[order[s]] for c in columns], [bodies[i] for i in order[s].tolist()]) for _, s in shares]
        shard = table["shard"][0].as_py() if table.num_rows else 0
        return pa.table({"part": pa.array([p for p, _ in shares], pa.int32()), "shard": pa.array([shard] * len(blocks), pa.int32()), "block": pa.array(blocks, pa.binary())})

    sent = shards.groupBy("shard").cogroup(again.groupBy("shard")).applyInArrow(send, "part int, shard int, block binary")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_turn(batches):
            found, times, rows = {}, [], []
            for shard, block in held:
                (keys, counts, sizes), joined = unpack(block, 3)
                end = np.cumsum(sizes)
                for key, n_times, a, b in zip(keys.tolist(), counts.tolist(), (end - sizes).tolist(), end.tolist()):
                    k = found.setdefault((key, joined[a:b]), len(found))
                    if k == len(times):
                        times.append(0)
                    times[k] += n_times
                    rows.append((shard, k))
            passages = confirmed_passages(found, times, length)
            to: dict[int, dict[bytes, None]] = {}
            for shard, k in rows:
                if passages[k]:
                    to.setdefault(shard, {}).update(dict.fromkeys(passages[k]))
            blocks = [pack([np.array([len(p) for p in own], np.int64)], own) for own in to.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(to), pa.int32()), pa.array(blocks, pa.binary())], names=["shard", "block"])

    confirmed = sent.repartition(n, "part").sortWithinPartitions("part").mapInArrow(confirm, "shard int, block binary")

    schema = StructType().add("doc_id", LongType()).add("n_words", LongType()).add("n_removed", LongType()).add("text", StringType())
    schema = StructType([*schema.fields, *(docs.schema[c] for c in carry)])

    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        own, texts, _ = _texts(table)
        passages: dict[bytes, None] = {}
        for block in found["block"].to_pylist():
            (sizes,), joined = unpack(block, 1)
            end = np.cumsum(sizes)
            passages.update(dict.fromkeys(joined[a:b] for a, b in zip((end - sizes).tolist(), end.tolist())))
        rows = []
        for text, gone in zip(texts, occurrences(list(passages), texts)):
            body = b" ".join(compress(text.split(), ~gone)) if gone.any() else text  # bytes are split at the white space that ends words
            rows.append((len(gone), int(gone.sum()), body.decode()))
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_words": pa.array([rows[k][0] for k in own], pa.int64()),
                "n_removed": pa.array([rows[k][1] for k in own], pa.int64()),
                "text": pa.array([rows[k][2] for k in own], pa.string()),
                **{c: table[f"carried_{k}"] for k, c in enumerate(carry)},
            }
        )

    return shards.groupBy("shard").cogroup(confirmed.groupBy("shard")).applyInArrow(remove, schema)
