"""Cutting a closed sub-graph: a deterministic sample of heads, then semi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplewright.storage import Scratch

#: Distinct rows that are put in order at the border of a sample; hash digits by which a border range is cut down.
BORDER_ROWS, DIGITS = 100_000, 4
#: Keys up to which they are broadcast themselves; with more, a bit filter of at most FILTER_WORDS longs (1 MB) is, of FILTER_BITS bits a key and FILTER_HASHES bits set for each.
#: The driver sends the filter with the plan, once for each hash and each branch of a union; keys that would crowd one of that size get none.
BROADCAST_KEYS, FILTER_WORDS, FILTER_BITS, FILTER_HASHES = 100_000, 1 << 17, 10, 3


def portable_hash(c: Column) -> Column:
    """The first 32 bits of md5 as a number: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("long")


def seeded_rank(cols: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("#", *cols, F.lit(str(seed))).cast("binary"))


def first_by_hash(df: DataFrame, cols: list[str], n: int, seed: int = 0) -> DataFrame:
    """Distinct ``cols`` of the n rows that are first by a seeded hash, then by ``cols``: a sample without replacement, repeatable.

    No task sorts them. Rows counted by ranges of the hash tell the range in which
    the n-th row lies; that one is cut into finer ranges until few rows are left, and
    only those are put in order. A range's counts, at most 16**DIGITS, reach the driver.
    """
    rows = df.select(*cols, seeded_rank(cols, seed).alias("__rank"))
    prefix, left = "", n
    while len(prefix) < 32:
        inside = rows.where(F.col("__rank").startswith(prefix)) if prefix else rows
        held = inside.groupBy(F.substring("__rank", len(prefix) + 1, DIGITS).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()
        at = 0
        while at < len(held) and left > held[at]["n"]:
            left -= held[at]["n"]
            at += 1
        if at == len(held):  # fewer rows than asked for
            return rows.select(*cols).distinct()
        prefix += held[at]["d"]
        if held[at]["n"] <= BORDER_ROWS:
            break
    whole = rows.where(F.substring("__rank", 1, len(prefix)) < prefix)
    border = rows.where(F.col("__rank").startswith(prefix)).groupBy("__rank", *cols).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__rank", *cols)) - F.col("__n")  # one task, few rows: see above
    border = border.withColumn("__before", before).where(F.col("__before") < left)
    return whole.select(*cols).unionAll(border.select(*cols)).distinct()


def sample_heads(triples: DataFrame, factor: float, seed: int = 0) -> DataFrame:
    """Distinct heads of n = max(1, int(rows * factor)) triples, those first by a seeded hash. Written, so that each use reads the same rows."""
    if not 0 < factor <= 1:
        raise ValueError("factor must be over 0 and at most 1")
    n = max(1, int(triples.count() * factor))
    return Scratch(triples.sparkSession, "heads").keep(first_by_hash(triples, ["h", "r", "t"], n, seed).select("h").distinct(), "heads")


def key_filter(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """One value, a Bloom filter of the first column as array<long>, and its number of longs. Built by one grouping; its size is bounded whatever n is."""
    words = 1
    while words < FILTER_WORDS and words * 64 < FILTER_BITS * n:
        words *= 2
    bits = keys.select(F.explode(F.array(*_positions(F.col(keys.columns[0]), words))).alias("p")).groupBy(F.floor(F.col("p") / 64).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    every = keys.sparkSession.range(words).join(bits, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    return every.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bits"]).alias("bits")), words


def _positions(key: Column, words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(words * 64)) for k in range(FILTER_HASHES)]


def maybe_in(df: DataFrame, column: str, keys: DataFrame, n: int) -> DataFrame:
    """The rows whose key passes the filter of ``keys``: all that are in it, and a few others. Nothing is exchanged but the filter."""
    held, words = key_filter(keys, n)
    # A scalar, not a joined row: a join after it would be taken below a joined one, before the filter.
    bits = held.scalar()
    for p in _positions(F.col(column), words):
        df = df.where(F.getbit(F.get(bits, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1)
    return df


def kept_by(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of a large table whose ``column`` is in a written table of distinct keys (of one column).

    Up to BROADCAST_KEYS the keys go to every task, and the table stays where it is. Beyond,
    a filter of bounded size goes there first, so that the exact join moves little more than what is kept.
    Keys too many for such a filter meet the whole table in the exact join.
    """
    n = keys.count()
    named = keys.select(F.col(keys.columns[0]).alias(column))
    if n <= BROADCAST_KEYS:
        return df.join(F.broadcast(named), column, "left_semi").select(*df.columns)
    rows = maybe_in(df, column, keys, n) if FILTER_BITS * n <= 64 * FILTER_WORDS else df
    return rows.join(named, column, "left_semi").select(*df.columns)


def minimize(triples: DataFrame, aliases: DataFrame, relations: DataFrame, descriptions: DataFrame, heads: DataFrame) -> dict[str, DataFrame]:
    """All triples of the heads; aliases of their heads and tails; their relations; descriptions of the heads. What is large stays where it is, but for little more than what is kept, up to the keys a filter tells apart."""
    scratch = Scratch(triples.sparkSession, "minimize")
    heads = scratch.keep(heads.select("h").distinct(), "heads")
    kept = scratch.keep(kept_by(triples, "h", heads), "kept")
    ends = scratch.keep(heads.select(F.col("h").alias("entity_id")).union(kept.select("t")).distinct(), "ends")
    return {
        "triples": kept,
        "aliases": kept_by(aliases, "entity_id", ends),
        "relations": relations.join(kept.select(F.col("r").alias("relation_id")).distinct(), "relation_id", "left_semi"),
        "descriptions": kept_by(descriptions, "entity_id", heads),
    }


def minimize_two_hops(triples: DataFrame, aliases: DataFrame, relations: DataFrame, descriptions: DataFrame, share: float, seed: int = 0) -> dict[str, DataFrame]:
    """Sampled described heads and their tails; triples and descriptions of both; aliases one hop further; relations of the first hop."""
    scratch = Scratch(triples.sparkSession, "hops")
    eligible = triples.select(F.col("h").alias("entity_id")).distinct().join(descriptions.select("entity_id"), "entity_id", "left_semi")
    eligible = scratch.keep(eligible, "eligible")
    n = -(-int(eligible.count() * share * 1_000_000) // 1_000_000)
    first = scratch.keep(first_by_hash(eligible, ["entity_id"], n, seed), "first")
    hop = scratch.keep(kept_by(triples, "h", first), "hop")
    wide = scratch.keep(first.union(hop.select("t")).distinct(), "wide")
    kept = scratch.keep(kept_by(triples, "h", wide), "kept")
    ends = scratch.keep(wide.union(kept.select("t")).distinct(), "ends")
    return {
        "triples": kept,
        "aliases": kept_by(aliases, "entity_id", ends),
        "relations": relations.join(hop.select(F.col("r").alias("relation_id")).distinct(), "relation_id", "left_semi"),
        "descriptions": kept_by(descriptions, "entity_id", wide),
    }


def size_report(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(name, n_before, n_after, percent) of each table. All are counted in one grouping: a plan of an aggregate and a product for each table was over the driver's memory."""
    spark = next(iter(before.values())).sparkSession
    rows = spark.range(1, numPartitions=1).select(F.explode(F.array(*map(F.lit, before))).alias("name"), F.lit(0).alias("old"), F.lit(0).alias("new"))  # an empty table counts 0
    for tables, old, new in ((before, 1, 0), (after, 0, 1)):
        for name in before:
            rows = rows.union(tables[name].select(F.lit(name), F.lit(old), F.lit(new)))
    counted = rows.groupBy("name").agg(F.sum("old").alias("n_before"), F.sum("new").alias("n_after"))
    return counted.withColumn("percent", F.round(100.0 * F.col("n_after") / F.greatest("n_before", F.lit(1)), 4))
