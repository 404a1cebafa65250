"""Encoding of texts by parts that a byte-level tokenizer's split pattern never joins.

The pattern keeps one space with the word after it and never joins two words, so a text in which
no two white-space characters meet can be cut before every space and around every line end. Most
parts repeat, and each distinct part is encoded once per worker, as long as it is remembered.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd

from .wording import equal_spans, span_hashes

#: Two white-space characters in a row; such texts are cut one by one, with more care.
_RUN = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?= )|(?= \S)")


class Recent(dict):
    """What was made of words; of `most` words and more, those asked for since the last `most` new ones are kept."""

    def __init__(self, make: Callable[[str], list[int]], most: int = 250_000):
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(word)
        if ids is None:
            ids = self.make(word)
        self[word] = ids
        return ids


class UnitEncoder:
    """Turns texts into ids; `encode` gives the ids of one part, `whole` those of a text that has one of the texts `spelled`.

    Parts are found by their hashes, `most` of which are remembered (about 150 MB), and then compared
    byte by byte with the part that was learned; a batch with two parts of one hash is encoded part by part.
    """

    def __init__(self, encode: Callable[[str], list[int]], most: int = 1_400_000, spelled: Sequence[str] = (), whole: Callable[[str], list[int]] | None = None):
        self.encode, self.most, self.spelled, self.whole = encode, most, spelled, whole
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.places, self.bytes = np.zeros(1, np.int64), np.zeros(0, np.uint8)

    def _learn(self, keys: list[int], parts: list[bytes]) -> None:
        got = [self.encode(p.decode()) for p in parts]
        n = len(self.known)
        self.known.update(zip(keys, range(n, n + len(keys))))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(g) for g in got])])
        self.ids = np.concatenate([self.ids, np.array([i for g in got for i in g], np.uint32)])
        self.places = np.concatenate([self.places, self.places[-1] + np.cumsum([len(p) for p in parts])])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(parts), np.uint8)])

    def _one(self, text: str) -> np.ndarray:
        return np.array([i for p in _CUT.split(text) if p for i in self.encode(p)], np.uint32)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers."""
        out: list = [None] * len(texts)
        plain = []
        for k, text in enumerate(texts):
            if not text:
                out[k] = np.zeros(0, np.uint32)
            elif any(x in text for x in self.spelled):
                out[k] = np.array(self.whole(text), np.uint32)
            elif _RUN.search(text):
                out[k] = self._one(text)
            else:
                plain.append(k)
        if plain:
            found = self._together([texts[k].encode() for k in plain])
            for k, ids in zip(plain, found if found is not None else map(self._one, [texts[k] for k in plain])):
                out[k] = ids
        return out

    def _together(self, texts: list[bytes]) -> list[np.ndarray] | None:
        """The ids of texts, or None if two of their parts, or one and a remembered one, have one hash and differ."""
        joined = b"".join([*texts, b"\0" * 8])
        data = np.frombuffer(joined, np.uint8)
        begin = np.cumsum([0, *map(len, texts)])
        line_ends = np.flatnonzero(data == 10)
        cut = np.zeros(begin[-1] + 1, bool)
        cut[np.flatnonzero(data == 32)] = cut[line_ends] = cut[line_ends + 1] = cut[begin] = True
        cuts = np.flatnonzero(cut)
        a, size = cuts[:-1], np.diff(cuts)
        back, keys = pd.factorize(span_hashes(data, a, size))
        if len(self.known) + len(keys) > self.most:
            self.forget()
        where = np.empty(len(keys), np.int64)  # a part of each hash
        where[back[::-1]] = np.arange(len(back))[::-1]
        listed = keys.tolist()
        index = np.fromiter((self.known.get(x, -1) for x in listed), np.int64, len(listed))
        new, old = np.flatnonzero(index < 0), np.flatnonzero(index >= 0)
        lead, held = where[old], index[old]
        if not np.array_equal(size, size[where][back]) or not np.array_equal(size[lead], self.places[held + 1] - self.places[held]):
            return None
        # of one size, up to eight bytes have a hash of their own; more are compared
        long, long_lead = np.flatnonzero(size > 8), np.flatnonzero(size[lead] > 8)
        first, lead, held = a[where][back][long], lead[long_lead], held[long_lead]
        if not equal_spans(data, a[long], data, first, size[long]) or not equal_spans(data, a[lead], self.bytes, self.places[held], size[lead]):
            return None
        if len(new):
            index[new] = len(self.known) + np.arange(len(new))
            first = a[where[new]]
            self._learn(keys[new].tolist(), [joined[i:j] for i, j in zip(first.tolist(), (first + size[where[new]]).tolist())])
        lengths, starts = (self.starts[index + 1] - self.starts[index])[back], self.starts[index][back]
        ends = np.cumsum(lengths)
        ids = self.ids[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])]
        return np.split(ids, np.concatenate([[0], ends])[np.searchsorted(cuts, begin[1:-1])])
