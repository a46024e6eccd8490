"""Token ids in Simple-8b words.

A 64-bit word holds a 4-bit selector and 60 bits of equally wide ids. Selector 0
is the escape: the next word is one raw id of up to 64 bits. Ids are cut into
blocks of ``BLOCK_IDS``; a segment lists where the words of each block begin, so
that a reader decodes any block alone, or all of them in a few numpy calls.

Segment: magic, then little-endian uint32 counts (documents, blocks, words),
uint32 ids of each document, uint32 first word of each block, uint64 words.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triplewright.llm.batches import map_batches, portable, text_steps
from triplewright.llm.chunks import ChunkTable, byte_letters, worker_cache
from triplewright.storage import Scratch, partitions_for

MAGIC = b"S8BSEG01"
BLOCK_IDS = 512
#: Ids of a segment, reached before it is closed; also what a task holds at once.
SEGMENT_IDS = 1_000_000
END_ID = 1
#: Body of a character class: letters that stay one letter under composition and lower-casing.
SETTLED = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f"

# Ids in a word by selector 1 to 14 of Simple-8b; their width is 60 // ids.
PER_WORD = [60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]


def widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, 1 at least, as uint8."""
    if not len(ids) or int(ids.max()) < 1 << 16:
        return np.maximum(np.frexp(np.arange(1 << 16, dtype=np.float32))[1], 1).astype(np.uint8)[ids]
    low, high = (np.frexp((ids >> np.uint64(shift) & np.uint64(0xFFFFFFFF)).astype(np.float64))[1] for shift in (0, 32))
    return np.maximum(np.where(high > 0, high + 32, low), 1).astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """uint64 ids to (words, first word of each block). Each block is packed greedily, all blocks in lockstep."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    n_blocks = -(-n // BLOCK_IDS)
    ids = np.concatenate([ids, np.zeros(n_blocks * BLOCK_IDS - n, np.uint64)])  # a block's tail packs as zeros
    grid = np.pad(widths(ids).reshape(n_blocks, BLOCK_IDS), ((0, 0), (0, 60)))
    choice = np.zeros((n_blocks, BLOCK_IDS), np.uint8)  # 0: the escape
    top, span = grid.copy(), 1
    for selector in range(len(PER_WORD), 0, -1):  # windows grow; the longest that fits stays
        while span < PER_WORD[selector - 1]:
            grow = min(span, PER_WORD[selector - 1] - span)
            top = np.maximum(top[:, : top.shape[1] - grow], top[:, grow:])
            span += grow
        choice[top[:, :BLOCK_IDS] <= 60 // span] = selector
    choice, takes = choice.reshape(-1), np.array([1, *PER_WORD])
    at, ends, met = np.arange(n_blocks) * BLOCK_IDS, (np.arange(n_blocks) + 1) * BLOCK_IDS, []
    while len(at):
        met.append(at)
        at = at + takes[choice[at]]
        open_ = at < ends
        at, ends = at[open_], ends[open_]
    firsts = np.sort(np.concatenate(met))
    chosen = choice[firsts]
    size = np.where(chosen == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    reach = np.concatenate([ids, np.zeros(60, np.uint64)])
    limit = (firsts // BLOCK_IDS + 1) * BLOCK_IDS
    for selector in np.unique(chosen).tolist():
        mine = chosen == selector
        if selector == 0:
            words[place[mine] + 1] = ids[firsts[mine]]
            continue
        per = PER_WORD[selector - 1]
        start = firsts[mine]
        value = reach[start[:, None] + np.arange(per)]
        value[start[:, None] + np.arange(per) >= limit[mine][:, None]] = 0
        value <<= np.arange(per, dtype=np.uint64) * np.uint64(60 // per)
        packed = np.bitwise_or.reduce(value, axis=1) | np.uint64(selector << 60)
        words[place[mine]] = packed
    return words, place[np.searchsorted(firsts, np.arange(n_blocks) * BLOCK_IDS)].astype(np.uint32)


def unpack(words: np.ndarray, blocks: np.ndarray, n: int) -> np.ndarray:
    """The n ids of packed words; ``blocks`` are the first words of the blocks."""
    if not n:
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    escape = np.flatnonzero(selector == 0)
    if len(escape):  # a raw word may itself look like an escape: of each run, every second one is raw
        run = np.cumsum(np.diff(escape, prepend=-2) != 1)
        order = np.arange(len(escape)) - np.searchsorted(run, run)
        raw[escape[order % 2 == 0] + 1] = True
    counts = np.where(raw, 0, np.array([1, *PER_WORD, 0])[selector])
    block = np.searchsorted(blocks, np.arange(len(words)), "right") - 1
    before = np.cumsum(counts) - counts
    start = before - before[blocks][block] + block * BLOCK_IDS
    out = np.zeros((len(blocks) + 1) * BLOCK_IDS, np.uint64)
    for kind in np.unique(selector[~raw]).tolist():
        mine = np.flatnonzero((selector == kind) & ~raw)
        if kind == 0:
            out[start[mine]] = words[mine + 1]
            continue
        per, word, at, end = PER_WORD[kind - 1], words[mine], start[mine], (block[mine] + 1) * BLOCK_IDS
        mask = np.uint64((1 << 60 // per) - 1)
        for j in range(per):
            inside = at + j < end
            out[(at + j)[inside]] = ((word >> np.uint64(j * (60 // per))) & mask)[inside]
    return out[:n]


def segment(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    words, blocks = pack(ids.astype(np.uint64))
    head = np.array([len(lengths), len(blocks), len(words)], "<u4")
    return b"".join([MAGIC, head.tobytes(), lengths.astype("<u4").tobytes(), blocks.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents, ids in each document)."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token segment")
    docs, blocks, words = np.frombuffer(data, "<u4", 3, len(MAGIC)).tolist()
    at = len(MAGIC) + 12
    lengths = np.frombuffer(data, "<u4", docs, at)
    first = np.frombuffer(data, "<u4", blocks, at + 4 * docs)
    packed = np.frombuffer(data, "<u8", words, at + 4 * (docs + blocks))
    return unpack(packed, first, int(lengths.sum(dtype=np.int64))), lengths


def word_encoder(tokenizer_json: str) -> Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]:
    """texts -> (ids, ids in each text), equal to the library's encoding of the whole texts.

    The vocabulary drops white space and neither its normalisation nor its
    splitting rule looks across a space or a line feed, so each stretch between
    them is encoded once and a table holds what it gave. A stretch of settled
    letters and then ASCII signs is two words for the library's model; any other
    stretch goes through the whole library.

    Settled letters are those that the library's normalisation keeps as one
    letter: canonical composition leaves every Latin letter up to U+017F as it
    is, and lower-casing gives one letter for each but U+0130, which becomes a
    letter and a combining mark. Marks count as signs for the splitting rule, so
    only beside settled letters, digits and white space is a full stop or a comma
    sure to stand alone, whatever the normalisation does to the text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    held = worker_cache()
    if ("words", hash(tokenizer_json)) in held:
        return held["words", hash(tokenizer_json)]
    library = Tokenizer.from_str(tokenizer_json)
    library.no_truncation()
    library.no_padding()
    model, letters = library.model, byte_letters()
    plain = re.compile(rf"([{SETTLED}]*)([!-/:-@\[-`{{-~]*)")
    added = [x.content for x in library.get_added_tokens_decoder().values()]
    beside = re.compile(rf"[^{SETTLED}0-9 \n][.,]|[.,][^{SETTLED}0-9 \n]")

    def of_word(word: str) -> list[int]:
        return [t.id for t in model.tokenize(word if word.isascii() else "".join([letters[b] for b in word.encode("utf-8")]))]

    def learn(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        sizes = np.empty(len(chunks), np.int64)
        for k, chunk in enumerate(chunks):
            before, m = len(ids), plain.fullmatch(chunk)
            if m and chunk not in added:
                for word in m.groups():
                    if word:
                        ids += of_word(word.lower())
            else:
                ids += library.encode(chunk, add_special_tokens=False).ids
            sizes[k] = len(ids) - before
        return np.array(ids, np.uint32), sizes

    table = ChunkTable(learn)

    def chunks(text: str) -> list[str]:
        """Full stops and commas stand alone where nothing but settled letters, digits and white space touches any, so that words are met more often."""
        if beside.search(text) is None:
            text = text.replace(".", " .").replace(",", " ,")
        return text.replace("\n", " ").split(" ")

    def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths, _ = table.encode([chunks(t or "") for t in texts])
        return ids, lengths

    held["words", hash(tokenizer_json)] = encode
    return encode


def write_tokens(df: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode every text, close it with ``end_id`` and write segments in ascending id order under ``path``.

    Files are Parquet rows (part, seg, skip, doc_ids, n_ids, payload): Spark's own
    committer makes a lost task harmless, and part and seg order the segments.
    Null ids come first; rows of one id follow each other by text hash. A null
    text is empty: its only id is ``end_id``.
    """
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't follow the data

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seg, skip = word_encoder(model.value), TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal seg, skip
            ids = np.concatenate(held)
            row = [[part], [seg], [skip], [list(doc_ids)], [len(ids)], [segment(ids, np.concatenate(lengths))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            seg, skip = seg + 1, skip + len(ids)
            for x in (doc_ids, held, lengths):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["part", "seg", "skip", "doc_ids", "n_ids", "payload"])

        for rows, texts in text_steps(batches):
            ids, size = encode(texts)
            ids = np.insert(ids, np.cumsum(size), end_id)
            doc_ids += rows.column(0).to_pylist()
            held.append(ids)
            lengths.append(size + 1)
            if sum(map(len, held)) >= SEGMENT_IDS:
                yield close()
        if doc_ids:
            yield close()

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = source.repartitionByRange(partitions_for(df), *order).sortWithinPartitions(*order)
    map_batches(ordered, kernel, "part int, seg int, skip long, doc_ids array<long>, n_ids long, payload binary").write.option("compression", "none").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document, from the files alone."""
    return _read(spark, path, "ids array<long>", lambda ids: ids.astype(np.int64))


def token_digest(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    return _read(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").data))


def _read(spark, path: str, column: str, value: Callable[[np.ndarray], object]) -> DataFrame:
    name, kind = column.split(" ", 1)
    kind = pa.list_(pa.int64()) if "array" in kind else pa.int64()
    rows = spark.read.parquet(path)
    # A row and a few bytes for each part file: what is broadcast follows the number of files, not of documents.
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                doc_ids, payload, first = (batch.column(k)[at] for k in range(3))
                ids, lengths = read_segment(payload.as_buffer().to_pybytes())
                ends = np.cumsum(lengths, dtype=np.int64)
                values = [value(ids[b - n : b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(first.as_py() + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(values, kind)], ["doc_id", "start", "n_tokens", name])

    joined = rows.join(F.broadcast(parts), "part").select("doc_ids", "payload", (F.col("base") + F.col("skip")).alias("first"))
    return map_batches(joined, kernel, f"doc_id long, start long, n_tokens long, {column}")


def token_file_digest(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of ``df`` to the shared folder and describe every document as read back from them."""
    scratch = Scratch(df.sparkSession, "tokens")
    path = f"{scratch.root}/segments"
    write_tokens(df, tokenizer_path, path, id_col, text_col)
    return token_digest(df.sparkSession, path)


portable(__name__)
