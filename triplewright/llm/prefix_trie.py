"""The prefix trie of rebuilt conversations: one row for each distinct sequence of first turns.

1. Turns are numbered inside their conversation from one range-sorted table, so a
   conversation with a third of all rows is dealt over tasks. A rebuilt conversation c
   is the first h turns of conversation c - c % 5, then its own turns after its first h.
2. A prefix is known by a digest: running sums of hashes of (place, role, text), taken
   in blocks of a bounded length, then across the blocks. The least conversation and the
   number of conversations of each digest are one grouping.
3. A conversation owns a prefix if it is the least that has it; then it owns all its
   longer ones too. The first owned depth is found by binary search, in each block of
   BLOCK digests at once: every round joins all blocks' middle digests with the minima.
4. Owned depths form a chain for each conversation, which hangs on the chain that owns
   the prefix one shorter. Leaves and saved bytes are summed over chains bottom-up by
   doubling pointers (as many rounds as the logarithm of the height of the tree), then
   along each chain from its end.
5. The conversations that end at a node are put in order by ranges and joined in pieces;
   a task then hashes the pieces of a node one after the other.

Defined results of odd input: rows without a conv_id take no part; null role or text
counts as empty; null turns stand first; turns of one number go by the SHA-256 of their
role and text, and repeated rows are turns of their own. ``%`` keeps the sign, so -3
goes with conversation 0. A conversation may have no turn after rebuilding: it ends at
the root. An empty table has no root. Columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplewright.llm.batches import map_batches, portable
from triplewright.operators.ordering import ranked
from triplewright.storage import Scratch, partitions_for

#: Conversations of a family, and one more than the most turns that one takes from the first of its family.
FAMILY, SHARED = 5, 9
#: Digests that a search row holds; places of a running sum that one task adds.
BLOCK, RUN = 64, 4096
#: 32-bit words of a turn's hash that are summed: sums of two thousand million turns fit a long.
WORDS = 5
#: Ids joined into one piece of text.
PIECE = 4096


def numbered_turns(df: DataFrame, scratch: Scratch, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(c, pos, content, bytes): turns with their place in the conversation, from 1."""
    role, text = (F.coalesce(F.col(f"`{x}`").cast("string"), F.lit("")) for x in (role_col, text_col))
    content = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = df.where(F.col(f"`{conv_col}`").isNotNull()).select(F.col(f"`{conv_col}`").cast("long").alias("c"), F.struct(F.col(f"`{conv_col}`").cast("long").alias("c"), F.col(f"`{turn_col}`").alias("turn"), content.alias("content"), F.monotonically_increasing_id().alias("tie")).alias("o"), F.octet_length(text).cast("long").alias("bytes"))
    placed = ranked(scratch.keep(rows, "turns"), "o", "place").select("c", "place", F.col("o.content").alias("content"), "bytes")
    firsts = scratch.keep(placed.groupBy("c").agg(F.min("place").alias("first")), "firsts")
    return scratch.keep(placed.join(firsts, "c").select("c", (F.col("place") - F.col("first") + 1).alias("pos"), "content", "bytes"), "numbered")


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(c, m): conversations and their rebuilt lengths; (c, d, content, bytes): their turns."""
    sizes = turns.groupBy("c").agg(F.max("pos").alias("n")).withColumns({"h": F.crc32(F.col("c").cast("string")) % SHARED, "base": F.col("c") - F.col("c") % FAMILY})
    sizes = scratch.keep(sizes, "sizes")
    convs = sizes.join(sizes.select(F.col("c").alias("base"), F.col("n").alias("there")), "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = scratch.keep(convs.select("c", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("m")), "convs")
    own = turns.join(convs.select("c", "h", "taken"), "c").where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "content", "bytes")
    start = turns.where(F.col("pos") < SHARED).select(F.col("c").alias("base"), "pos", "content", "bytes")
    shared = convs.where("taken > 0").select("c", "base", "taken").join(start, "base").where("pos <= taken").select("c", F.col("pos").alias("d"), "content", "bytes")
    return convs.select("c", "m"), own.unionByName(shared)


def running_sums(rows: DataFrame, key: str, place: Column, values: list[str]) -> DataFrame:
    """``values`` replaced by their sums over all rows of the key up to this place (whole numbers from 0, each once). No task adds more than RUN places of a key."""
    dealt = rows.withColumns({"__place": place, "__run": F.floor(place / RUN)})
    inside = Window.partitionBy(key, "__run").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumns({v: F.sum(v).over(inside) for v in values})
    last = dealt.groupBy(key, "__run").agg(*[F.max_by(v, "__place").alias(v) for v in values])
    over = Window.partitionBy(key).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    base = last.select(key, "__run", *[F.sum(v).over(over).alias(f"__{v}") for v in values]).where("__run > 0")
    out = dealt.join(base, [key, "__run"], "left")
    return out.withColumns({v: F.col(v) + F.coalesce(f"__{v}", F.lit(0)) for v in values}).select(*rows.columns)


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(c, d, digest, bytes): every prefix of every rebuilt conversation, the empty one too."""
    words = [f"w{k}" for k in range(WORDS)]
    tag = F.sha2(F.concat(F.col("d").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("content")), 256)
    hashed = turns.withColumn("tag", tag).select("c", "d", "bytes", *[F.conv(F.substring("tag", 8 * k + 1, 8), 16, 10).cast("long").alias(w) for k, w in enumerate(words)])
    none = convs.select("c", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("bytes"), *[F.lit(0).cast("long").alias(w) for w in words])
    sums = running_sums(hashed.unionByName(none), "c", F.col("d"), words)
    return sums.select("c", "d", F.unhex(F.md5(F.concat_ws(",", *[F.col(x).cast("string") for x in ("d", *words)]))).alias("digest"), "bytes")


def first_owned(paths: DataFrame, minima: DataFrame) -> DataFrame:
    """(c, f, above): the first depth that c owns, one past its end if none, and the digest of the prefix before it. For the owner of the root: as if the root weren't owned."""
    d = F.col("d")
    blocks = F.array_compact(F.array(F.when(d > 0, F.floor((d - 1) / BLOCK)), F.when(d % BLOCK == 0, F.floor(d / BLOCK))))
    held = paths.select("c", F.explode(blocks).alias("block"), F.struct("d", "digest").alias("x")).groupBy("c", "block").agg(F.array_sort(F.collect_list("x")).alias("x"))  # BLOCK + 1 at most
    state = held.select("c", F.col("x")[0]["d"].alias("s"), F.transform("x", lambda y: y["digest"]).alias("digests"), F.size("x").alias("size"))
    state = state.withColumns({"low": F.lit(1), "high": F.col("size")})
    owners = minima.select(F.col("digest").alias("probe"), "owner")
    for _ in range(BLOCK.bit_length()):
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        asked = state.withColumns({"middle": middle, "probe": F.get("digests", F.least(middle, F.col("size") - 1))}).join(owners, "probe")
        open_, mine = F.col("low") < F.col("high"), F.col("owner") == F.col("c")
        state = asked.select("c", "s", "digests", "size", F.when(open_ & ~mine, F.col("middle") + 1).otherwise(F.col("low")).alias("low"), F.when(open_ & mine, F.col("middle")).otherwise(F.col("high")).alias("high"))
    place = F.struct((F.col("s") + F.col("low")).alias("f"), F.get("digests", F.col("low") - 1).alias("above"))
    found = state.groupBy("c").agg(F.min(F.when(F.col("low") < F.col("size"), place)).alias("owned"), F.max(place).alias("end"))
    return found.select("c", F.coalesce("owned", "end").alias("x")).select("c", "x.f", "x.above")


def subtree_sums(chains: DataFrame, values: list[str], scratch: Scratch) -> DataFrame:
    """(c, values): each chain's values with those of all chains below it. ``chains`` has (c, up, values); up is null at the top.

    After k rounds a chain has the sums of all that are fewer than 2**k steps below it, and points 2**k steps up.
    """
    now = scratch.keep(chains, "sums")
    while not (some := now.where("up is not null")).isEmpty():
        below = some.groupBy(F.col("up").alias("c")).agg(*[F.sum(v).alias(f"__{v}") for v in values])
        further = now.where("up is not null").select(F.col("c").alias("up"), F.col("up").alias("__up"))  # what points to a top has no further one
        out = now.join(below, "c", "left").join(further, "up", "left")
        now = scratch.keep(out.select("c", F.col("__up").alias("up"), *[(F.col(v) + F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values]), "sums")
    return now.drop("up")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(owner, depth, first, text) of rows (owner, depth, q) that come in this order: at most PIECE ids joined by commas."""
    def made(key: tuple[int, int], ids: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in (*key, ids[0])], pa.array([",".join(map(str, ids))])], ["owner", "depth", "first", "text"])

    now, ids = None, []
    for batch in batches:
        for owner, depth, q in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if ids and ((owner, depth) != now or len(ids) == PIECE):
                yield made(now, ids)
                ids = []
            now = owner, depth
            ids.append(q)
    if ids:
        yield made(now, ids)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(owner, depth, ends_sha256) of pieces that come sorted by owner, depth and first id: only the state of one hash is held."""
    now, state = None, None
    for batch in batches:
        done = []
        for owner, depth, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
            if (owner, depth) == now:
                state.update(b"," + text.encode())
                continue
            if now is not None:
                done.append((*now, state.hexdigest()))
            now, state = (owner, depth), hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["owner", "depth", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((*now, state.hexdigest()), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["owner", "depth", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256): the hash of the ascending ids q of each node, comma-joined."""
    ranges = ends.repartitionByRange(partitions_for(ends), "owner", "depth", "q").sortWithinPartitions("owner", "depth", "q")
    pieces = map_batches(ranges, _pieces, "owner long, depth long, first long, text string")
    return map_batches(pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first"), _hashes, "owner long, depth long, ends_sha256 string")


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row for each node."""
    scratch = Scratch(df.sparkSession, "trie")
    convs, turns = rebuilt(numbered_turns(df, scratch, conv_col, turn_col, role_col, text_col), scratch)
    paths = scratch.keep(prefixes(convs, turns), "paths")
    minima = paths.groupBy("digest").agg(F.min("c").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("d").alias("depth"), F.max("bytes").alias("bytes"))
    minima = scratch.keep(minima, "minima")
    found = scratch.keep(first_owned(paths.select("c", "d", "digest"), minima.select("digest", "owner")), "first-owned")
    hung = found.join(minima.select(F.col("digest").alias("above"), F.col("owner").alias("up")), "above").join(convs, "c")
    top = F.col("up") == F.col("c")  # only the root can stand before a chain of its own owner
    chains = hung.select("c", "m", F.when(top, 0).otherwise(F.col("f")).alias("f"), F.when(~top, F.col("up")).alias("up"), F.when(~top, F.col("f") - 1).alias("at"))
    chains = scratch.keep(chains, "chains")
    own = chains.where("f <= m")
    hang = own.where("up is not null").select(F.col("up").alias("c"), F.col("at").alias("m")).distinct()
    leaf = own.join(hang.withColumn("goes_on", F.lit(True)), ["c", "m"], "left").select("c", "up", F.when(F.col("goes_on"), 0).otherwise(1).cast("long").alias("leaves"))
    saved = minima.groupBy(F.col("owner").alias("c")).agg(F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    sums = subtree_sums(leaf.join(saved, "c"), ["leaves", "saved"], scratch)
    hung = own.where("up is not null").select("c", F.col("up").alias("owner"), F.col("at").alias("depth")).join(sums, "c").groupBy("owner", "depth").agg(F.count(F.lit(1)).alias("hung"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    nodes = minima.select("owner", "depth", "n_convs", "bytes").join(hung, ["owner", "depth"], "left").join(own.withColumnRenamed("c", "owner"), "owner")
    more, last = F.coalesce("hung", F.lit(0)), F.col("depth") == F.col("m")
    nodes = nodes.select(
        "owner", "depth", "f", "m", "up", "n_convs", (more + F.when(last, 0).otherwise(1)).alias("n_children"),
        (F.coalesce("n_leaves", F.lit(0)) + F.when(last & (more == 0), 1).otherwise(0)).alias("n_leaves"), (F.coalesce("saved_tokens", F.lit(0)) + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    )
    nodes = running_sums(nodes, "owner", F.col("m") - F.col("depth"), ["n_leaves", "saved_tokens"])
    ends = own.select(F.col("c").alias("owner"), F.col("m").alias("depth"), F.col("c").alias("q")).unionAll(chains.where("f > m").select("up", "at", "c"))
    nodes = nodes.join(ends_digest(ends), ["owner", "depth"], "left")
    parent = F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("f"), F.col("up")).otherwise(F.col("owner"))
    return nodes.select(
        F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"), "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


portable(__name__)
