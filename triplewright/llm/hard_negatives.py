"""Hard-negative mining by a two-dimensional block matrix product.

Rows are dealt by label into blocks (a label's rows by hash into blocks of about
ROW_BLOCK, its anchors into blocks of about ANCHOR_BLOCK), and the dimensions of each block
into chunks of DIM_CHUNK: panels of (block, chunk). A product is then, as in SUMMA:

1. each row panel meets the anchor panels of its chunk and gives partial int64 score
   tiles; 2. tiles of one (anchor block, row block) are shuffled together and added;
3. each whole tile is reduced where it was added, to a few rows for every anchor.

Two products are needed, and no pair is scored twice: the first meets only blocks that may share a
label and keeps each anchor's first positives; the second meets the others too, skips
tiles of one label, and keeps the first rows of every (anchor, positive) window. A
task holds two panels or two tiles at a time, and a row panel is copied once for
ANCHORS_PER_TASK anchor blocks. Tiles travel in the smallest whole numbers that hold them.

Rows with a null id, label or vector, or a null or non-finite component, take no part.
Rows that repeat an id are rows of their own, none of them a partner of one of its own
id's; a repeated anchor row has its results again, and a repeated positive row is a
positive again. Ties go to the smaller id. A window whose positive score is negative
is empty. An empty table gives an empty one; columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplewright.llm.batches import map_batches, portable
from triplewright.llm.whole_vectors import best_of, matrix, narrow, packed, products, unpacked, whole_rows
from triplewright.storage import Scratch

ROW_BLOCK, ANCHOR_BLOCK, DIM_CHUNK = 2048, 128, 32
#: Buckets of labels: the driver learns their sizes. Labels that meet in a bucket share blocks.
BUCKETS = 1024
#: Anchor blocks that one copy of a row panel serves; tiles that a task adds one after the other, where there are more than shuffle partitions.
ANCHORS_PER_TASK, TILES_PER_TASK = 64, 64
PANEL = "kind string, block long, bucket int, chunk int, panel binary"
WINDOWS = "array<struct<anchor:long,positive:long,positive_id:long,positive_score:long>>"


def _panels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Panels of rows (kind, block, bucket, row, vec_id, label, vec) that come sorted by kind and block."""

    def made(key: tuple[str, int, int], parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        rows, ids, labels = (table[c].to_numpy() for c in ("row", "vec_id", "label"))
        vectors = matrix(table["vec"].combine_chunks())
        order = np.lexsort((rows, ids))
        for chunk in range(max(1, -(-vectors.shape[1] // DIM_CHUNK))):
            part = narrow(vectors[order, chunk * DIM_CHUNK : (chunk + 1) * DIM_CHUNK])
            own = {"labels": labels[order]} | ({"rows": rows[order], "ids": ids[order]} if not chunk else {})
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([key[2]], pa.int32()), pa.array([chunk], pa.int32()), pa.array([packed(part=part, **own)], pa.binary())], [x.split()[0] for x in PANEL.split(", ")])

    held, now = [], None
    for batch in batches:
        blocks = batch.column(1).to_numpy()
        kinds = batch.column(0).to_pylist()
        cuts = [0, *[i for i in range(1, len(blocks)) if blocks[i] != blocks[i - 1] or kinds[i] != kinds[i - 1]], len(blocks)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low == high:
                continue
            key = (kinds[low], int(blocks[low]), batch.column(2)[low].as_py())
            if now is not None and key != now:
                yield from made(now, held)
                held = []
            now = key
            held.append(batch.slice(low, high - low))
    if held:
        yield from made(now, held)


def _partial_tiles(same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tiles (a, b, chunk, tile, anchors, rows, windows) of (b, chunk, salt, a, panel, windows) that come sorted with a row panel (null a) before the anchor panels.

    Only chunk 0 carries what the rows of a tile are. Tiles without a pair of equal (``same``) or different labels are left out.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, whose = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                b, chunk, _, a, data, windows = (batch.column(k)[at] for k in range(6))
                if not a.is_valid:
                    rows, whose, own = unpacked(data.as_py()), (b.as_py(), chunk.as_py()), data.as_py()
                    continue
                if whose != (b.as_py(), chunk.as_py()):
                    continue  # the rows' vectors have no such chunk: zeros
                anchors = unpacked(data.as_py())
                if same:
                    use = np.isin(anchors["labels"], rows["labels"]).any()
                else:
                    use = len(np.unique(np.concatenate([anchors["labels"], rows["labels"]]))) > 1
                if not use:
                    continue
                tile = packed(tile=narrow(products(anchors["part"], rows["part"])))
                first = not chunk.as_py()
                columns = [[a.as_py()], [b.as_py()], [chunk.as_py()], [tile], [data.as_py() if first else None], [own if first else None]]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], batch.column(5).slice(at, 1)], ["a", "b", "chunk", "tile", "anchors", "rows", "windows"])

    return kernel


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict, np.ndarray, list[dict]]]:
    """(anchors, rows, whole tile, windows) from partial tiles that come sorted by tile and chunk."""
    now, total, held = None, None, None
    for batch in batches:
        for at in range(batch.num_rows):
            key = (batch.column(0)[at].as_py(), batch.column(1)[at].as_py())
            part = unpacked(batch.column(3)[at].as_py())["tile"]
            if key != now:
                if now is not None:
                    yield held[0], held[1], total, held[2]
                now, total = key, part.astype(np.int64)
                held = unpacked(batch.column(4)[at].as_py()), unpacked(batch.column(5)[at].as_py()), batch.column(6)[at].as_py() or []
            else:
                total += part
    if now is not None:
        yield held[0], held[1], total, held[2]


def _positives(k: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, rows, tile, _ in _sums(batches):
            x, y = np.nonzero((anchors["labels"][:, None] == rows["labels"]) & (anchors["ids"][:, None] != rows["ids"]))
            keep = best_of(x, tile[x, y], rows["ids"][y], k)
            x, y = x[keep], y[keep]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (anchors["rows"][x], anchors["ids"][x], rows["rows"][y], rows["ids"][y], tile[x, y])], ["anchor", "anchor_id", "positive", "positive_id", "positive_score"])

    return kernel


def _negatives(k: int, least: int, most: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, rows, tile, windows in _sums(batches):
            place = {r: i for i, r in enumerate(anchors["rows"].tolist())}
            at = np.array([place[w["anchor"]] for w in windows], np.int64)
            score = [w["positive_score"] for w in windows]
            low, high = (np.array(v, np.int64) for v in ([-(-least * s // 100) for s in score], [most * s // 100 for s in score]))
            found = []
            for begin in range(0, len(at), len(anchors["rows"])):  # as many windows at once as the tile has rows
                part = slice(begin, begin + len(anchors["rows"]))
                there = tile[at[part]]
                fits = (there >= low[part, None]) & (there <= high[part, None]) & (anchors["labels"][at[part], None] != rows["labels"])
                x, y = np.nonzero(fits)
                keep = best_of(x, there[x, y], rows["ids"][y], k)
                found.append((begin + x[keep], y[keep]))
            x, y = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
            columns = {
                "anchor": anchors["rows"][at[x]], "anchor_id": anchors["ids"][at[x]],
                "positive": np.array([w["positive"] for w in windows], np.int64)[x], "positive_id": np.array([w["positive_id"] for w in windows], np.int64)[x],
                "negative_id": rows["ids"][y], "positive_score": np.array(score, np.int64)[x], "negative_score": tile[at[x], y],
            }
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))

    return kernel


class _Product:
    """Panels of one table, and the products of their blocks."""

    def __init__(self, df: DataFrame, asks: Column, label: Column, id_col: str, vector_col: str):
        self.scratch = Scratch(df.sparkSession, "negatives")
        self.least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = whole_rows(df.where(label.isNotNull()), id_col, vector_col, label=label.cast("long"), asks=F.coalesce(asks, F.lit(False)))
        held = self.scratch.keep(rows.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int")), "rows")
        sizes = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("long")).alias("asks")).collect()  # BUCKETS rows at most
        self.blocks: dict[str, dict[int, tuple[int, int]]] = {}  # kind -> bucket -> its first block, and how many it has
        for kind, column, size in (("b", "n", ROW_BLOCK), ("a", "asks", ANCHOR_BLOCK)):
            at, self.blocks[kind] = 0, {}
            for r in sorted(sizes):
                if r[column]:
                    self.blocks[kind][r["bucket"]] = at, -(-r[column] // size)
                    at += self.blocks[kind][r["bucket"]][1]
        both = self._dealt(held, "b").unionByName(self._dealt(held.where("asks"), "a"))
        tasks = max(self.least, -(-sum(n for _, n in self.blocks["b"].values()) // 16))
        self.panels = self.scratch.keep(map_batches(both.repartition(tasks, "kind", "block").sortWithinPartitions("kind", "block"), _panels, PANEL), "panels")

    def _of(self, kind: str, part: int) -> Column:
        """The bucket's first block (part 0) or its number of blocks (part 1)."""
        listed = ", ".join(f"{self.blocks[kind].get(b, (0, 0))[part]}L" for b in range(BUCKETS))
        return F.get(F.expr(f"array({listed})"), F.col("bucket"))

    def _dealt(self, rows: DataFrame, kind: str) -> DataFrame:
        block = self._of(kind, 0) + F.pmod(F.xxhash64("row"), F.greatest(self._of(kind, 1), F.lit(1)))
        return rows.select(F.lit(kind).alias("kind"), block.alias("block"), "bucket", "row", "vec_id", "label", "vec")

    def tiles(self, kernel, schema: str, same: bool, windows: DataFrame | None = None) -> DataFrame:
        """The reduced tiles; ``windows`` has (a, windows) for the anchor blocks that are wanted."""
        anchors, rows = self.panels.where("kind = 'a'"), self.panels.where("kind = 'b'")
        n_a, n_b = (sum(n for _, n in self.blocks[k].values()) for k in "ab")
        anchors = anchors.select(F.col("block").alias("a"), "bucket", "chunk", "panel")
        if windows is None:
            anchors = anchors.withColumn("windows", F.lit(None).cast(WINDOWS))
        else:
            anchors = anchors.join(windows, "a")
            # What the windows of a block are stands with its first chunk.
            anchors = anchors.withColumn("windows", F.when(F.col("chunk") == 0, F.col("windows")))
        of_bucket = self._of("a", 1) if same else F.lit(n_a).cast("long")
        salts = F.ceil(F.greatest(of_bucket, F.lit(1)) / ANCHORS_PER_TASK).cast("int")
        first, count = (self._of("b", 0), self._of("b", 1)) if same else (F.lit(0).cast("long"), F.lit(n_b).cast("long"))
        salt = F.pmod(F.xxhash64("a"), salts).cast("int")
        to = anchors.where(count > 0).select(F.explode(F.sequence(first, first + count - 1)).alias("b"), "chunk", salt.alias("salt"), "a", "panel", "windows")
        copies = rows.select(F.col("block").alias("b"), "chunk", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(None).cast("long").alias("a"), "panel", F.lit(None).cast(WINDOWS).alias("windows"))
        tasks = max(self.least, -(-n_b // 4))
        met = copies.unionByName(to).repartition(tasks, "b", "chunk", "salt").sortWithinPartitions("b", "chunk", "salt", F.col("a").asc_nulls_first())
        partial = map_batches(met, _partial_tiles(same), f"a long, b long, chunk int, tile binary, anchors binary, rows binary, windows {WINDOWS}")
        tasks = max(self.least, -(-n_a * n_b // TILES_PER_TASK))
        return map_batches(partial.repartition(tasks, "a", "b").sortWithinPartitions("a", "b", "chunk"), kernel, schema)


def mine(df: DataFrame, asks: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows that ``asks``; ``label`` is a column expression. For each anchor and each of its first ``positives`` rows of its
    label, the first ``negatives`` rows of another label whose score is from ``least`` to ``most`` percent of the positive's.
    """
    run = _Product(df, asks, label, id_col, vector_col)
    near = run.tiles(_positives(positives), "anchor long, anchor_id long, positive long, positive_id long, positive_score long", same=True)
    order = Window.partitionBy("anchor").orderBy(F.col("positive_score").desc(), "positive_id", "positive")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    # Which block an anchor is in follows from its row and bucket; the panels know.
    near = run.scratch.keep(near.where("positive_score >= 0"), "positives")
    anchors = run.scratch.keep(map_batches(run.panels.where("kind = 'a' and chunk = 0").select("block", "panel"), _members, "a long, anchor long"), "anchors")
    windows = near.join(anchors, "anchor").groupBy("a").agg(F.collect_list(F.struct("anchor", "positive", "positive_id", "positive_score")).alias("windows"))  # a block's anchors at most
    found = run.tiles(_negatives(negatives, least, most), "anchor long, anchor_id long, positive long, positive_id long, negative_id long, positive_score long, negative_score long", same=False, windows=windows)
    order = Window.partitionBy("anchor", "positive").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, anchor): the rows of each anchor block."""
    for batch in batches:
        for at in range(batch.num_rows):
            rows = unpacked(batch.column(1)[at].as_py())["rows"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), batch.column(0)[at].as_py(), np.int64)), pa.array(rows)], ["a", "anchor"])


portable(__name__)
