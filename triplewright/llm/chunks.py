"""A table of pieces of text met before, with the token ids of each.

Encoders that treat stretches between white space apart look most stretches up
and encode only new ones. Look-ups and gathers run over all texts of a step.
"""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable

import numpy as np

from triplewright.llm.batches import portable

#: Chunks that a table holds before those met only once since the last purge leave it.
MOST_CHUNKS = 900_000
#: Chunks that are encoded in one call.
LEARN_AT_ONCE = 20_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself where it prints, else the next from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def worker_cache() -> dict:
    """State that later tasks of the same Python worker find again."""
    gc.set_threshold(200_000, 20, 100)  # tables of plain strings have nothing for it to find
    home = sys.modules.setdefault("_triplewright_worker_cache", types.ModuleType("_triplewright_worker_cache"))
    return home.__dict__.setdefault("held", {})


class ChunkTable:
    """chunk -> ids. ``learn`` maps new chunks to (flat ids, ids in each; -1 for a chunk that has no ids of its own)."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.learn = learn
        self.reset([], np.empty(0, np.uint32), np.empty(0, np.int64))

    def reset(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.number = dict(zip(chunks, range(len(chunks)), strict=True))
        self.ids, self.used = ids.copy(), len(ids)
        self.size = sizes.copy()
        self.first = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        self.hits = np.zeros(len(chunks), np.uint8)

    def purge(self) -> None:
        keep = self.hits[: len(self.number)] > 1
        chunks = [c for c, k in zip(self.number, keep.tolist(), strict=True) if k]
        sizes, first = self.size[: len(keep)][keep], self.first[: len(keep)][keep]
        self.reset(chunks, self.gather(first, np.maximum(sizes, 0)), sizes)

    def gather(self, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        at = np.cumsum(sizes) - sizes
        return self.ids[np.repeat(first - at, sizes) + np.arange(int(sizes.sum()))]

    def add(self, chunks: list[str]) -> None:
        ids, sizes = self.learn(chunks)
        have = len(self.number)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used + len(ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        if have + len(chunks) > len(self.size):
            room = have + len(chunks)
            self.size, self.first, self.hits = (np.concatenate([x[:have], np.zeros(room, x.dtype)]) for x in (self.size, self.first, self.hits))
        held = np.maximum(sizes, 0)
        self.size[have : have + len(chunks)] = sizes
        self.first[have : have + len(chunks)] = self.used + np.cumsum(held) - held
        self.hits[have : have + len(chunks)] = 0
        self.used += len(ids)
        self.number.update(zip(chunks, range(have, have + len(chunks)), strict=True))

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks of each text -> (ids, ids in each text, texts with a chunk that has no ids of its own)."""
        if len(self.number) > MOST_CHUNKS:
            self.purge()
        chunks = [c for one in texts for c in one]
        number = self.number
        found = list(map(number.get, chunks))
        if None in found:
            new = list({c: None for c, n in zip(chunks, found, strict=True) if n is None})
            for at in range(0, len(new), LEARN_AT_ONCE):
                self.add(new[at : at + LEARN_AT_ONCE])
            found = [number[c] if n is None else n for c, n in zip(chunks, found, strict=True)]
        at = np.array(found, np.int64)
        size = self.size[at]
        self.note(at)
        odd_chunks = size < 0
        size = np.maximum(size, 0)
        ids = self.gather(self.first[at], size)
        ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
        lengths = np.diff(np.concatenate([[0], np.cumsum(size)])[ends], prepend=0)
        odd = np.diff(np.concatenate([[0], np.cumsum(odd_chunks)])[ends], prepend=0) > 0
        return ids, lengths, odd

    def note(self, at: np.ndarray) -> None:
        met = np.zeros(len(self.hits), bool)
        met[at] = True
        self.hits[met] = np.minimum(self.hits[met], 2) + 1


def splice(ids: np.ndarray, lengths: np.ndarray, whole: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Put the ids of texts that were encoded whole in their places."""
    if not whole:
        return ids, lengths
    parts = [whole.get(k, one) for k, one in enumerate(np.split(ids, np.cumsum(lengths)[:-1]))]
    return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


portable(__name__)
