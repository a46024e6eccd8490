"""Alias spans in texts as they are: any letter case, any white space between words.

The aliases of a description's entities become a trie with failure links, which is
walked once along the text, so that the cost of a place doesn't grow with the number of
aliases that may stand there. The current patterns are made of words and signs: each
space stands for one or more white spaces, and no word goes on at either end. The older
ones are made of letters: a space stands for any number of white spaces, none too, and
both ends are borders between a word and something else.

Aliases of which a text lacks a word (or, for the older pattern, the letters) are left out before
a trie is made; a few short ones are looked for one by one in its joined letters.

Aliases are stripped; empty ones match nothing. Letters are compared by their lower case,
where that is one letter. Matches of one alias text don't overlap. A description with very
many aliases is walked once for each BLOCK of them. A text is cut to its counted tokens before
it is exchanged.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.functions.text import MAX_TOKENS
from triplewright.functions.tokenizers import WORDS, Tokenizer, char_to_token, word_tokens

#: Aliases of one trie.
BLOCK = 4096
#: Letters of all aliases up to which each is looked for by itself: what a place costs has this bound too.
FEW = 1024
RUNS = re.compile(r"\S+")


class Automaton:
    """Sequences of units, found wherever they end in a stream: a trie whose nodes know the longest other beginning that ends there too."""

    def __init__(self, patterns: Sequence[Sequence[str]]):
        self.goes: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for k, units in enumerate(patterns):
            node = 0
            for u in units:
                if u not in self.goes[node]:
                    self.goes[node][u] = len(self.goes)
                    self.goes.append({})
                    self.ends.append([])
                node = self.goes[node][u]
            self.ends[node].append(k)
        self.fails, self.above = [0] * len(self.goes), [0] * len(self.goes)  # above: the nearest failure at which a pattern ends
        queue = deque(self.goes[0].values())
        while queue:
            node = queue.popleft()
            for u, child in self.goes[node].items():
                fail = self.fails[node]
                while fail and u not in self.goes[fail]:
                    fail = self.fails[fail]
                after = self.goes[fail].get(u, 0)
                self.fails[child] = after if after != child else 0
                self.above[child] = self.fails[child] if self.ends[self.fails[child]] else self.above[self.fails[child]]
                queue.append(child)

    def hits(self, stream: Sequence[str]) -> Iterator[tuple[int, int]]:
        """(pattern, place of its last unit), by places."""
        node = 0
        for at, u in enumerate(stream):
            while node and u not in self.goes[node]:
                node = self.fails[node]
            node = self.goes[node].get(u, 0)
            found = node if self.ends[node] else self.above[node]
            while found:
                for k in self.ends[found]:
                    yield k, at
                found = self.above[found]


def folded(x: str) -> str:
    low = x.lower()
    return low if len(low) == len(x) else "".join(c.lower() if len(c.lower()) == 1 else c for c in x)


def letters_of(text: str) -> str:
    """Letters without white space, each folded by itself (so that a final sigma is no other letter)."""
    joined = "".join(text.split())
    low = joined.replace("Σ", "σ").lower()
    return low if len(low) == len(joined) else "".join(map(folded, joined))


def units_of(text: str, letters: bool) -> tuple[Sequence[str], list[int], list[int]]:
    """Units, folded, with their starts and ends: words and signs, or letters without white space."""
    if letters:
        at = list(chain.from_iterable(range(*m.span()) for m in RUNS.finditer(text)))
        return letters_of(text), at, [i + 1 for i in at]
    found = list(WORDS.finditer(text))
    return [folded(m[0]) for m in found], [m.start() for m in found], [m.end() for m in found]


def _is_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def places(stream: str, patterns: list[str]) -> Iterator[tuple[int, int]]:
    """What ``Automaton.hits`` finds, one pattern after another."""
    for k, letters in enumerate(patterns):
        at = stream.find(letters)
        while at >= 0:
            yield k, at + len(letters) - 1
            at = stream.find(letters, at + 1)


def matches(text: str, aliases: list[str], legacy: bool = False) -> Iterator[tuple[int, int, int]]:
    """(number of the alias, start, end) of every match; of one alias text those that don't overlap, from left to right."""
    numbers: dict[str, list[int]] = {}
    for k, alias in enumerate(aliases):
        if alias.strip():
            numbers.setdefault(alias.strip(), []).append(k)
    few = legacy and sum(map(len, numbers)) <= FEW
    stream, starts, ends = units_of(text, legacy)
    there = set() if few else set(stream)
    known, patterns, gaps = [], [], []
    for alias in numbers:
        if few and letters_of(alias) not in stream:
            continue
        units, begin, end = units_of(alias, legacy)
        if few or there.issuperset(units):
            known.append(alias)
            patterns.append(units)
            gaps.append([0] + [b - a for a, b in zip(end[:-1], begin[1:], strict=True)])
    past = [0] * len(known)
    for k, last in places(stream, patterns) if few else Automaton(patterns).hits(stream) if known else ():
        first, spaces = last - len(patterns[k]) + 1, gaps[k]
        start, end = starts[first], ends[last]
        if start < past[k]:
            continue
        if legacy:
            fits = _is_word(text, start - 1) != _is_word(text, start) and _is_word(text, end - 1) != _is_word(text, end)
        else:
            fits = not _is_word(text, start - 1) and not _is_word(text, end)
        between = (starts[first + i] - ends[first + i - 1] for i in range(1, len(spaces)))
        if fits and all(b == 0 if not s else legacy or b >= s for b, s in zip(between, spaces[1:], strict=True)):
            past[k] = end
            yield from ((i, start, end) for i in numbers[known[k]])


def openings(descriptions: DataFrame, make: Callable[[], Tokenizer]) -> DataFrame:
    """(entity_id, text, starts, ends): the text up to its last token and one character more, and its tokens' places. Texts without a token are left out."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = make()
        for batch in batches:
            found = [(h, text, *split(text)[1:]) for h, text in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True)]
            found = [(h, text[: ends[-1] + 1], starts, ends) for h, text, starts, ends in found if ends]
            kinds = [pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], ["entity_id", "text", "starts", "ends"])

    texts = descriptions.select(F.col("entity_id").cast("string"), F.col("text").cast("string")).where("text is not null")
    return texts.mapInArrow(kernel, "entity_id string, text string, starts array<int>, ends array<int>")


def raw_alias_spans(pairs: DataFrame, descriptions: DataFrame, aliases: DataFrame, make: Callable[[], Tokenizer] | None = None, legacy: bool = False) -> DataFrame:
    """(h, entity, alias, pos, start, end, s, e): every match of every alias of ``entity`` in the text of ``h``.

    ``pairs`` has distinct (h, entity). s and e are the tokens of ``make`` that hold the
    first and the last letter of the match; matches past the last token fall away.
    """
    make = make or word_tokens(MAX_TOKENS)
    names = aliases.select(F.col("entity_id").alias("entity"), F.posexplode_outer("aliases").alias("pos", "alias")).where("alias is not null")  # outer: no filter makes the lists once more
    named = pairs.join(names, "entity")
    many = named.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    named = named.join(many, "h", "left").withColumn("block", F.pmod(F.xxhash64("entity", "pos"), F.coalesce("blocks", F.lit(1))))
    held = named.groupBy("h", "block").agg(F.collect_list(F.struct("entity", "alias", "pos")).alias("names"))  # about BLOCK at most
    rows = held.join(openings(descriptions, make).withColumnRenamed("entity_id", "h"), "h").select("h", "text", "starts", "ends", "names")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            begins, finishes, listed = (batch.column(k) for k in (2, 3, 4))
            tokens, firsts, lasts = (x.to_numpy(zero_copy_only=False).tolist() for x in (begins.offsets, begins.values, finishes.values))
            ends_at, held = finishes.offsets[0].as_py(), listed.offsets.to_numpy().tolist()
            entities, names, numbers = (listed.values.field(k).to_pylist() for k in range(3))
            for i, (h, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True)):
                a, b, own = tokens[i], tokens[i + 1], held[i]
                starts, ends = firsts[a:b], lasts[a - tokens[0] + ends_at : b - tokens[0] + ends_at]
                for k, start, end in matches(text, names[own : held[i + 1]], legacy):
                    s, e = char_to_token(starts, ends, start), char_to_token(starts, ends, end - 1)
                    if s is not None and e is not None:
                        out.append((h, entities[own + k], names[own + k], numbers[own + k], start, end, s, e))
            kinds = [pa.string()] * 3 + [pa.int32()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ["h", "entity", "alias", "pos", "start", "end", "s", "e"])

    return rows.mapInArrow(kernel, "h string, entity string, alias string, pos int, start int, end int, s int, e int")
