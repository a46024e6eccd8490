"""Best-fit packing of texts into bins of equal length, under conflicts.

Bins stand in order of what room they have left and carry two bitmaps: the
sources and the duplicate clusters that they hold. A text goes to the bin with
least room among those that have enough and share neither bit: the search starts
at the least sufficient room and goes on to the successor until bitmaps allow.
Longest texts are placed first; of equal rooms the older bin comes first.

Rows are dealt by hash into shards of about ``SHARD_ROWS`` rows, each packed on
its own, so that no task holds more, whatever source or cluster is common. Bins
never span shards, so a conflict can't either.

Longer texts fill whole bins of their own and leave a rest, which is packed as a
text. Texts without a word (null ones too) take no bin: null bin_id, one row. A
null source or cluster conflicts with nothing. Near copies of rows without an id
are no cluster; equal texts are. Repeated rows are packed as often
as they occur, and conflict with each other where a cluster is given.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplewright.llm import minhash
from triplewright.llm.batches import portable

#: Words in a bin, and rows in a shard, about.
CAPACITY, SHARD_ROWS = 2048, 8192
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, piece int, first_word long, n_words long, bin_id long, bin_offset int"


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each (size, source, cluster), placed in the order given; 0 < size <= capacity."""
    sources = {s: k for k, s in enumerate(dict.fromkeys(s for _, s, _ in items if s is not None))}
    often = Counter(c for _, _, c in items if c is not None)
    clusters = {c: k for k, c in enumerate(c for c, n in often.items() if n > 1)}  # a cluster met once can't conflict
    rooms: list[tuple[int, int]] = []  # (room left, bin), ascending
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    out = []
    for size, source, cluster in items:
        one = 1 << sources[source] if source is not None else 0
        two = 1 << clusters[cluster] if cluster in clusters else 0
        at = bisect_left(rooms, (size, -1))
        while at < len(rooms) and (source_bits[rooms[at][1]] & one or cluster_bits[rooms[at][1]] & two):
            at += 1
        if at < len(rooms):
            room, box = rooms.pop(at)
        else:
            room, box = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        out.append((box, capacity - room))
        source_bits[box] |= one
        cluster_bits[box] |= two
        if room > size:
            insort(rooms, (room - size, box))
    return out


def pack(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", cluster: Column | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, near: bool = False) -> DataFrame:
    """doc_id, piece, first_word, n_words, bin_id, bin_offset: the pieces of every row. ``cluster`` is a column expression over ``df``; by default equal texts are a cluster, with ``near`` also near-duplicate ones (components of ``minhash``)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(F.col(text_col)) if cluster is None else cluster.cast("long")
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        key.alias("cluster"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(id_col, text_col).alias("tie"),
        *([text.alias("text")] if near else []),
    )
    if near:
        found = minhash.clusters(rows, "doc_id", "text", ("source", "cluster", "size", "tie"))
        rows = found.withColumn("cluster", F.coalesce("comp", "cluster")).drop("comp")
    shards = max(1, -(-df.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(shards)))

    def shard_bins(table: pa.Table) -> pa.Table:
        held = sorted(zip(*(table.column(c).to_pylist() for c in ("size", "doc_id", "tie", "source", "cluster", "shard")), strict=True), key=lambda r: (-(r[0] % capacity), -r[0], r[1] is None, r[1] or 0, r[2]))
        rests = [(size % capacity, source, cluster) for size, _, _, source, cluster, _ in held if size % capacity]
        placed = best_fit(rests, capacity)
        base = held[0][5] << 24
        nxt, at = max((b for b, _ in placed), default=-1) + 1, 0
        out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
        for size, doc_id, _, _, _, _ in held:
            pieces = [(capacity, None)] * (size // capacity)
            if size % capacity:
                pieces.append((size % capacity, placed[at]))
                at += 1
            for k, (words, place) in enumerate(pieces or [(0, None)]):
                if place is None and words:
                    place, nxt = (nxt, 0), nxt + 1
                for name, value in zip(out, (doc_id, k, k * capacity, words, None if place is None else base + place[0], 0 if place is None else place[1]), strict=True):
                    out[name].append(value)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return rows.groupBy("shard").applyInArrow(shard_bins, SCHEMA)


portable(__name__)
