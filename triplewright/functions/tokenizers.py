"""Tokenizers as arguments: makers of functions from a text to its pieces and their character offsets.

A maker is called once in each task, where a vocabulary's trie is built. Offsets ascend and don't
overlap, so the piece that holds a character is found by binary search.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"\w+|[^\w\s]")
#: Pieces, where each begins, and where each ends (exclusive).
Tokens = tuple[list[str], list[int], list[int]]
Tokenizer = Callable[[str], Tokens]
#: Pieces of a vocabulary, which goes to every task; letters of a word over which it is unknown.
MOST_PIECES, MOST_LETTERS = 1_000_000, 100
UNKNOWN = "[UNK]"


def word_tokens(most: int | None = 128) -> Callable[[], Tokenizer]:
    """Words and single signs."""

    def make() -> Tokenizer:
        def split(text: str) -> Tokens:
            found = []
            for m in WORDS.finditer(text):
                if len(found) == most:
                    break
                found.append(m)
            return [m[0] for m in found], [m.start() for m in found], [m.end() for m in found]

        return split

    return make


class PieceTrie:
    """A vocabulary by letters: pieces that begin a word, and pieces (written with ## before) that go on with one."""

    def __init__(self, vocabulary: Iterable[str]):
        self.roots: tuple[dict, dict] = {}, {}
        for piece in vocabulary:
            inner = piece.startswith("##") and len(piece) > 2
            node = self.roots[inner]
            for letter in piece[2 * inner :]:
                node = node.setdefault(letter, {})
            node[""] = piece

    def longest(self, word: str, at: int) -> str | None:
        """The longest piece that stands at this place of the word."""
        node, found = self.roots[at > 0], None
        for k in range(at, len(word)):
            node = node.get(word[k])
            if node is None:
                break
            found = node.get("", found)
        return found

    def pieces(self, word: str) -> list[str] | None:
        """Greedy longest pieces; None where some letter is in none."""
        out, at = [], 0
        while at < len(word):
            piece = self.longest(word, at) if len(word) <= MOST_LETTERS else None
            if piece is None:
                return None
            out.append(piece)
            at += len(piece) - 2 * (at > 0)
        return out


def word_pieces(vocabulary: Iterable[str], most: int | None = 128, lower: bool = False) -> Callable[[], Tokenizer]:
    """Words and signs cut into pieces of a vocabulary; a word that can't be cut is one unknown piece."""
    held = sorted({p for p in vocabulary if p})
    if len(held) > MOST_PIECES:
        raise ValueError(f"a vocabulary has at most {MOST_PIECES} pieces")

    def make() -> Tokenizer:
        trie, known = PieceTrie(held), {}

        def split(text: str) -> Tokens:
            pieces, starts, ends = [], [], []
            for m in WORDS.finditer(text):
                if most is not None and len(pieces) >= most:
                    break
                word = m[0].lower() if lower and len(m[0].lower()) == len(m[0]) else m[0]
                if word not in known:
                    if len(known) > MOST_PIECES:
                        known.clear()
                    known[word] = trie.pieces(word)
                at, found = m.start(), known[word]
                for piece in found or [UNKNOWN]:
                    size = len(word) if found is None else len(piece) - 2 * (at > m.start())
                    pieces.append(piece)
                    starts.append(at)
                    ends.append(at + size)
                    at += size
            return pieces[:most], starts[:most], ends[:most]

        return split

    return make


def char_to_token(starts: list[int], ends: list[int], char: int) -> int | None:
    """The piece that holds a character; None between pieces and past the last one."""
    at = bisect_right(starts, char) - 1
    return at if at >= 0 and char < ends[at] else None


def overlapping(starts: list[int], ends: list[int], start: int, end: int) -> tuple[int, int] | None:
    """The first and the last piece that share a character with [start, end)."""
    first, last = bisect_right(ends, start), bisect_right(starts, end - 1) - 1
    return (first, last) if first <= last and start < end else None


def token_rows(descriptions: DataFrame, make: Callable[[], Tokenizer]) -> DataFrame:
    """(entity_id, pos, piece, start, end): a row for each piece of each text; a null text has none."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = make()
        for batch in batches:
            found = [split(t or "") for t in batch.column(1).to_pylist()]
            sizes = [len(x[0]) for x in found]
            ids = batch.column(0).take(pa.array([i for i, n in enumerate(sizes) for _ in range(n)], pa.int32()))
            columns = [ids, pa.array([k for n in sizes for k in range(n)], pa.int32())]
            columns += [pa.array([v for x in found for v in x[k]], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["entity_id", "pos", "piece", "start", "end"])

    return descriptions.select(F.col("entity_id").cast("string"), F.col("text").cast("string")).mapInArrow(kernel, "entity_id string, pos int, piece string, start int, end int")
