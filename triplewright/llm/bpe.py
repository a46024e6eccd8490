"""Byte-level BPE in numpy: batched merge rounds over a flat array of symbols.

A round looks every adjacent pair of every unfinished word up in the sorted pair
keys (binary search), takes each word's lowest rank and merges all its
occurrences, left to right. Words without a mergeable pair leave the array.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.llm.batches import map_batches, portable, text_steps
from triplewright.llm.chunks import ChunkTable, byte_letters, splice, worker_cache

#: The splitting rule of byte-level BPE vocabularies of this kind; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stands for the start of a text in a chunk's key.
START = "\x02"
FREE = np.iinfo(np.int32).max


def spread(values: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[first : first + size] of all rows, one after the other."""
    at = np.cumsum(sizes) - sizes
    return values[np.repeat(firsts - at, sizes) + np.arange(int(sizes.sum()))]


class Vocabulary:
    """Merge keys, ranks and the bytes of every token, from a tokenizer file's text."""

    def __init__(self, tokenizer_json: str):
        held = json.loads(tokenizer_json)
        vocab: dict[str, int] = held["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.of_byte = np.array([vocab[c] for c in letters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in held["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)[order]
        self.added = {x["content"]: x["id"] for x in held["added_tokens"]}
        spelled = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        table = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.byte_size = np.array([len(x) for x in table], np.int64)
        self.byte_first = np.cumsum(self.byte_size) - self.byte_size
        digits = [b"%d," % i for i in range(len(table))]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digit_size = np.array([len(x) for x in digits], np.int64)
        self.digit_first = np.cumsum(self.digit_size) - self.digit_size

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids in each)."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbol = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbol, done_word = [], []
        while len(symbol):
            key = symbol[:-1].astype(np.int64) << 32 | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(known, self.ranks[at], FREE), FREE).astype(np.int32)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(word)))
            out = low == FREE
            if out.any():
                done_symbol.append(symbol[out])
                done_word.append(word[out])
            take = (rank == low) & ~out
            where = np.flatnonzero(take)
            if len(where) and (near := np.diff(where, prepend=-2) == 1).any():  # in a run of one symbol every second pair waits
                begin = np.flatnonzero(~near)
                order = np.arange(len(where)) - np.repeat(begin, np.diff(begin, append=len(where)))
                where = where[order % 2 == 0]
            symbol[where] = self.merged[at[where]]
            left = ~out
            left[where + 1] = False
            symbol, word = symbol[left], word[left]
        if not done_word:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        all_words = np.concatenate(done_word)
        order = np.argsort(all_words, kind="stable")
        return np.concatenate(done_symbol)[order], np.bincount(all_words, minlength=len(words))

    def decode_bytes(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The bytes of each text's tokens."""
        sizes = self.byte_size[ids]
        flat = spread(self.bytes, self.byte_first[ids], sizes).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(lengths)].tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Texts of ids; bytes that are no UTF-8 become U+FFFD."""
        return [x.decode("utf-8", "replace") for x in self.decode_bytes(ids, lengths)]

    def decimals(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """Each text's ids as decimals joined by commas."""
        sizes = self.digit_size[ids]
        flat = spread(self.digits, self.digit_first[ids], sizes).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(lengths)].tolist()
        return [flat[a : b - 1] if b > a else b"" for a, b in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Whole texts to ids. Most texts are split at spaces and line feeds into chunks that a table knows."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary = vocabulary
        self.split = regex.compile(PATTERN)
        self.space = regex.compile(r"\s")
        self.table = ChunkTable(self.learn)

    def learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A chunk begins with a line feed, START or an implied space; other white space in it has no ids of its own."""
        full = [c[1:] if c[:1] == START else c if c[:1] == "\n" else " " + c for c in chunks]
        odd = np.array([self.space.search(c, 1) is not None for c in chunks])
        pieces = [self.split.findall(x) if not o else [] for x, o in zip(full, odd.tolist(), strict=True)]
        ids, counts = self.encode_pieces(pieces)
        return ids, np.where(odd, -1, counts)

    def encode_pieces(self, pieces: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        flat = [p for one in pieces for p in one]
        unique = {p: n for n, p in enumerate(dict.fromkeys(flat))}
        ids, sizes = self.vocabulary.merge([p.encode("utf-8") for p in unique])
        at = np.fromiter((unique[p] for p in flat), np.int64, len(flat))
        held = np.cumsum(np.array([0, *map(len, pieces)]))
        counts = np.diff(np.concatenate([[0], np.cumsum(sizes[at])])[held])
        return spread(ids, (np.cumsum(sizes) - sizes)[at], sizes[at]).astype(np.uint32), counts

    def whole(self, text: str) -> np.ndarray:
        """A text of any kind, by the splitting rule alone; added tokens stand for themselves."""
        import regex

        added = self.vocabulary.added
        parts = regex.split("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")", text) if added else [text]
        out = [np.array([added[p]], np.uint32) if k % 2 else self.encode_pieces([self.split.findall(p)])[0] for k, p in enumerate(parts)]
        return np.concatenate(out)

    def plain(self, text: str) -> bool:
        """White space is single spaces and line feeds between other characters, and no added token occurs."""
        if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or "\n " in text or " \n" in text or START in text:
            return False
        return not any(x in text for x in self.vocabulary.added)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids in each)."""
        plain = [self.plain(t or "") for t in texts]
        chunks = [(START + t).replace("\n", " \n").split(" ") if p else [] for t, p in zip(texts, plain, strict=True)]
        ids, lengths, odd = self.table.encode(chunks)
        whole = {k: self.whole(texts[k] or "") for k, p in enumerate(plain) if not p or odd[k]}
        return splice(ids, lengths, whole)


def worker_encoder(tokenizer_json: str) -> Encoder:
    held = worker_cache()
    key = "bpe", hash(tokenizer_json)
    if key not in held:
        held[key] = Encoder(Vocabulary(tokenizer_json))
    return held[key]


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _model(df: DataFrame, tokenizer_path: str):
    with open(tokenizer_path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't follow the data


def bpe_encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: every whole text's token ids. A null or empty text has none."""
    model = _model(df, tokenizer_path)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(model.value)
        for rows, texts in text_steps(batches):
            ids, lengths = encoder.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column(0), lists], ["doc_id", "ids"])

    return map_batches(_source(df, id_col, text_col), kernel, "doc_id long, ids array<int>")


def bpe_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of token ids; null ids give a null text, null elements are left out."""
    model = _model(df, tokenizer_path)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_encoder(model.value).vocabulary
        for batch in batches:
            lists = [None if x is None else [i for i in x if i is not None] for x in batch.column(1).to_pylist()]
            lengths = np.array([len(x or []) for x in lists], np.int64)
            texts = words.decode(np.array([i for x in lists for i in x or []], np.int64), lengths)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else t for x, t in zip(lists, texts, strict=True)], pa.string())], ["doc_id", "text"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")), kernel, "doc_id long, text string")


def bpe_digest(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids, and describe both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text is an empty one: no ids, hashes of the empty string. One row for each input row.
    """
    model = _model(df, tokenizer_path)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(model.value)
        words = encoder.vocabulary
        for rows, texts in text_steps(batches):
            ids, lengths = encoder.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(lengths.astype(np.int64)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in words.decimals(ids, lengths)]),
                    pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in words.decode(ids, lengths)]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_batches(_source(df, id_col, text_col), kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


portable(__name__)
