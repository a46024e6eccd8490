"""Near-duplicates: many universal hash minima with banding, checked on signatures
and then on whole shingle sets; components by alternating stars.

1. One pass writes, for each row, the number of its shingles, a digest of its
   words, its band keys and a byte of each minimum. Texts with equal words form
   a class, of which the least id stands for all.
2. Each bucket (rows with a band key in common) proposes its least id, the hub,
   against every other member: as many pairs as members, however large the bucket.
3. Proposed pairs pass if enough signature bytes agree, then if the Jaccard
   similarity of the whole sets reaches the threshold. Their components follow.
4. What a hub was proposed to, and isn't in its component after that, may still
   be linked with something else that the hub was proposed to. Those texts are
   held against each other by their rarest shingles: ordered by how often they
   occur, a quarter of each set (and one more) must overlap in linked texts, and
   by enough. Only pairs that pass are proposed; they take the way of step 3. No
   link between components that a bucket proposes is lost, and a passage that a
   hot bucket shares costs nothing: it is what no text begins its order with.

A bucket whose lists of rarest shingles fit in BLOCK_BYTES is held in one task. The lists
of a larger one are spread, a row for each shingle, and strays meet members on (hub,
shingle), where the lengths and the shingle's places in both orders must leave room for a link: what is
moved grows with the bucket, not with its square. Pairs just under the similarity
asked for, of more than 0.73 about, may pass and are then told apart on whole sets.

Null or empty texts, and texts without a word, have no shingle and no link. Rows
with a null id are not linked: their component is null and they are kept. Rows
that repeat an id and a text get the same component; an id that comes with
different texts is linked through each of them. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.llm.batches import map_batches, portable, row_steps, text_steps
from triplewright.llm.components import components
from triplewright.storage import Scratch

WORDS, PERCENT = 5, 75
#: A pair of similarity 0.75 shares none of the bands with probability (1 - 0.75**4)**32, about 5 in a million; more alike pairs less.
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
#: Signature bytes out of MINIMA that must agree: 4.5 standard deviations below what a similarity of 0.75 gives.
LEAST_BYTES = 74
#: Members that one copy of a hub's set is held against.
FAN = 64
#: Groups of one text that a row carries.
MOST_GROUPS = 256
#: Bytes of rarest shingles that one task holds; bits of the hash by which shingles are counted, so that the driver holds one count for each.
BLOCK_BYTES, COUNT_BITS = 4_000_000, 18
#: Pairs of a block that are counted at once, and hits of its shingles.
PAIRS_AT_ONCE, HITS_AT_ONCE = 1_000_000, 500_000
#: Characters hashed at once.
CHARS_AT_ONCE = 1_000_000

_random = np.random.default_rng(20240229)
LETTERS = _random.integers(0, 2**64 - 1, 256, dtype=np.uint64)
BASE = int(_random.integers(0, 2**63 - 1)) | 1
TIMES = _random.integers(0, 2**64 - 1, MINIMA, dtype=np.uint64) | np.uint64(1)
PLUS = _random.integers(0, 2**64 - 1, MINIMA, dtype=np.uint64)
MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)]
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        both = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            factors = np.full(n, b, np.uint64)
            factors[0] = 1
            both.append(np.multiply.accumulate(factors))
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> tuple[list[np.ndarray], list[bytes]]:
    """(ascending distinct 64-bit shingle hashes, normalised bytes) of each text."""
    plain = [b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split()) for t in texts]
    flat = np.frombuffer(b" ".join(plain) + b" ", np.uint8)
    power, inverse = powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(LETTERS[flat] * power[:-1], out=sums[1:])
    gaps = np.flatnonzero(flat == 32)
    out, at, gap = [], 0, 0
    for data in plain:
        words = data.count(b" ") + 1 if data else 0
        ends = gaps[gap : gap + words]
        gap += words or 1  # an empty text leaves one gap of its own
        if words:
            starts = np.concatenate([[at], ends[:-1] + 1])
            first, last = (starts[: 1 - WORDS], ends[WORDS - 1 :]) if words >= WORDS else (starts[:1], ends[-1:])
            value = (sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64) * MIX[2]
            value = np.sort(mixed(value))
            out.append(value[np.concatenate([[True], value[1:] != value[:-1]])])
        else:
            out.append(np.empty(0, np.uint64))
        at += len(data) + 1
    return out, plain


def minima(shingles: np.ndarray) -> np.ndarray:
    best = np.full(MINIMA, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(best, (shingles[at : at + 1024, None] * TIMES + PLUS).min(axis=0), out=best)
    return best >> np.uint64(32)


def band_keys(best: np.ndarray) -> np.ndarray:
    """(texts, MINIMA) to (texts, BANDS) keys; the band is part of the key."""
    parts = best.reshape(len(best), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + MIX[2], parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mixed(key * MIX[2] + parts[:, :, k])
    return key.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in text_steps(batches, most=CHARS_AT_ONCE):
        sets, plain = shingle_sets(texts)
        best = np.stack([minima(s) for s in sets])
        keys = band_keys(best)
        some = [len(s) > 0 for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                *rows.columns[:-1],
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(x, digest_size=16).digest() if k else None for x, k in zip(plain, some, strict=True)], pa.binary()),
                pa.array([x if k else None for x, k in zip(keys, some, strict=True)], pa.list_(pa.int64())),
                pa.array([x.astype(np.uint8).tobytes() if k else None for x, k in zip(best & np.uint64(255), some, strict=True)], pa.binary()),
            ],
            [*rows.schema.names[:-1], "n_shingles", "digest", "keys", "sig"],
        )


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sig_a, sig_b) whose signatures agree in enough bytes."""
    for batch in batches:
        one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, MINIMA) for k in (2, 3))
        enough = (one == two).sum(axis=1) >= LEAST_BYTES
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(enough))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n): how many shingles hash to each bucket, once for each task."""
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for batch in batches:
        flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
        counts += np.bincount(flat >> np.uint64(64 - COUNT_BITS), minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["bucket", "n"])


def rarest(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles by count, then hash: as many as a linked text can't miss all of."""
    order = np.lexsort((shingles, counts[shingles >> np.uint64(64 - COUNT_BITS)]))
    return shingles[order[: len(shingles) - -(-PERCENT * len(shingles) // 100) + 1]]


def possible(strays: list[dict], others: list[dict]) -> tuple[list[int], list[int]]:
    """Pairs of different components whose rarest shingles overlap by as much as a link asks for.

    Of what two texts share, all that stands before the end of the shorter order is
    counted here; past that end is no more than the rest of one of the texts.
    """
    sides = []
    for members in (strays, others):
        lists = [np.frombuffer(m["rare"], np.uint64) for m in members]
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        doc, comp, size = (np.array([m[k] for m in members], np.int64) for k in ("doc_id", "comp", "size"))
        sides.append((np.concatenate(lists), owner, doc, comp, size, size - np.array([len(x) for x in lists])))
    (flat, owner, doc, comp, size, rest), (flat2, owner2, doc2, comp2, size2, rest2) = sides
    # A shingle that one component alone has can't tell two apart.
    both, label = np.concatenate([flat, flat2]), np.concatenate([comp[owner], comp2[owner2]])
    order = np.argsort(both, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], both[order][1:] != both[order][:-1]]))
    mixed_ = np.minimum.reduceat(label[order], first) != np.maximum.reduceat(label[order], first)
    use = np.empty(len(both), bool)
    use[order] = np.repeat(mixed_, np.diff(first, append=len(both)))
    flat, owner, flat2, owner2 = flat[use[: len(flat)]], owner[use[: len(flat)]], flat2[use[len(flat) :]], owner2[use[len(flat) :]]
    order = np.argsort(flat2, kind="stable")
    flat2, owner2 = flat2[order], owner2[order]
    low, high = np.searchsorted(flat2, flat, "left"), np.searchsorted(flat2, flat, "right")
    u, v = [], []
    step = max(1, PAIRS_AT_ONCE // len(doc2))
    for begin in range(0, len(doc), step):
        a, b = np.searchsorted(owner, [begin, begin + step])
        n = high[a:b] - low[a:b]
        if not n.sum():
            continue
        shared = np.zeros((min(step, len(doc) - begin), len(doc2)), np.int32)
        past, c = np.cumsum(n), a
        while c < b:  # a bounded number of hits at a time, those of one shingle at least
            end = a + max(c - a + 1, int(np.searchsorted(past, past[c - a] - n[c - a] + HITS_AT_ONCE, "right")))
            k = n[c - a : end - a]
            at = np.cumsum(k) - k
            hit = owner2[np.repeat(low[c:end] - at, k) + np.arange(int(k.sum()))]
            np.add.at(shared.reshape(-1), (np.repeat(owner[c:end], k) - begin) * len(doc2) + hit, 1)
            c = end
        x, y = np.nonzero(shared)
        most = shared[x, y] + np.maximum(rest[begin + x], rest2[y])
        fits = (100 + PERCENT) * most >= PERCENT * (size[begin + x] + size2[y])
        fits &= (comp[begin + x] != comp2[y]) & (doc[begin + x] != doc2[y])
        u += doc[begin + x[fits]].tolist()
        v += doc2[y[fits]].tolist()
    return u, v


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, shingle, stray, doc_id, comp, size, place): a row for each rarest shingle of a text in each large bucket that it is in."""
    for batch in row_steps(batches):
        for at in range(batch.num_rows):
            groups, size = batch.column(1)[at].as_py(), batch.column(2)[at].as_py()
            mine = [g for g in groups["in"] if g["large"]]
            shingles = np.frombuffer(batch.column(3)[at].as_py(), np.uint64).view(np.int64)
            n = len(shingles)
            if not mine or not n:
                continue
            columns = [
                pa.array(np.repeat([g["a"] for g in mine], n), pa.int64()), pa.array(np.tile(shingles, len(mine))), pa.array(np.repeat([g["stray"] for g in mine], n)),
                *[pa.array(np.full(n * len(mine), v), pa.int64()) for v in (batch.column(0)[at].as_py(), groups["comp"], size)], pa.array(np.tile(np.arange(n), len(mine)), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["a", "shingle", "stray", "doc_id", "comp", "size", "place"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b), the lesser first, of each block of strays and other members."""
    for batch in batches:
        for at in range(batch.num_rows):
            members = batch.column(0)[at].as_py()
            strays, others = ([m for m in members if m["stray"] == k] for k in (True, False))
            u, v = possible(strays, others) if strays and others else ([], [])
            pairs = sorted({(min(x), max(x)) for x in zip(u, v, strict=True)})
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in text_steps(batches, most=CHARS_AT_ONCE):
        sets, _ = shingle_sets(texts)
        yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array([s.tobytes() for s in sets], pa.binary())], [*rows.schema.names[:-1], "shingles"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, lead, members): links between a's set and each member's, by exact counts."""
    for batch in batches:
        u, v = [], []
        for a, leads, members in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            for lead in leads:
                one = np.frombuffer(lead, np.uint64)
                for m in members:
                    two = np.frombuffer(m["shingles"], np.uint64)
                    less, more = sorted((len(one), len(two)))
                    if 100 * less < PERCENT * more:
                        continue
                    shared = len(np.intersect1d(one, two, assume_unique=True))
                    if 100 * shared >= PERCENT * (len(one) + len(two) - shared):
                        u.append(a)
                        v.append(m["doc_id"])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


class _Run:
    """Tables of one call."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()):
        self.scratch = Scratch(df.sparkSession, "minhash")
        self.source = df.select(F.col(id_col).cast("long").alias("doc_id"), *carry, F.col(text_col).cast("string").alias("text"))
        names = ", ".join(f"{c} {kind}" for c, kind in self.source.dtypes[:-1])
        self.rows = self.scratch.keep(map_batches(self.source, _signatures, f"{names}, n_shingles long, digest binary, keys array<long>, sig binary"), "rows")
        known = self.rows.where("doc_id is not null and digest is not null").select("doc_id", "n_shingles", "digest", "keys", "sig")
        self.classes = self.scratch.keep(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
        stands = known.join(self.classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi")
        self.signs = self.scratch.keep(stands.select("doc_id", "n_shingles", "keys", "sig").dropDuplicates(["doc_id", "n_shingles", "sig"]), "signs")

    def stars(self) -> DataFrame:
        """(a, b, n): the least id of each bucket, every other id in it, and the other's number of shingles."""
        bands = self.signs.select("doc_id", "n_shingles", F.explode("keys").alias("key"))
        full = bands.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last"))
        full = self.scratch.keep(full.where("a <> last").select("key", "a"), "full")
        return self.scratch.keep(bands.join(full, "key").where("doc_id <> a").select("a", F.col("doc_id").alias("b"), F.col("n_shingles").alias("n")).distinct(), "stars")

    def agreeing(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with their signatures fetched and compared. Both sides of each join are plain exchanges of 128 bytes a row, so that a hot ``a`` is split over tasks."""
        signs = self.signs.select("doc_id", "sig")
        with_b = pairs.select("a", "b").join(signs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
        both = with_b.join(signs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a").select("a", "b", "sig_a", "sig_b")
        return map_batches(both, _agreeing, "a long, b long")

    def confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (u, v) whose whole sets are similar enough. An ``a`` with many partners is copied, once for FAN of them."""
        pairs = self.scratch.keep(pairs, f"{name}-pairs")
        fans = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("fans"))
        fans = self.scratch.keep(fans, f"{name}-fans")
        salt = F.pmod(F.xxhash64("b"), F.col("fans")).cast("int")
        dealt = pairs.join(fans, "a").select(F.col("b").alias("doc_id"), F.struct("a", salt.alias("low"), salt.alias("high"), F.lit(False).alias("leads")).alias("group"))
        leads = fans.select(F.col("a").alias("doc_id"), F.struct("a", F.lit(0).alias("low"), (F.col("fans") - 1).alias("high"), F.lit(True).alias("leads")).alias("group"))
        # Each needed text moves once, with the groups that it is in (a range of salts for a leading text), or once for MOST_GROUPS of them; sets move to their groups after that.
        every = dealt.unionByName(leads)
        many = every.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / MOST_GROUPS).cast("int").alias("parts")).where("parts > 1")
        every = every.join(many, "doc_id", "left").withColumn("part", F.pmod(F.xxhash64("group.a"), F.coalesce("parts", F.lit(1))))
        wanted = every.groupBy("doc_id", "part").agg(F.collect_list("group").alias("groups")).drop("part")
        sets = self.sets(wanted, "array<struct<a:long,low:int,high:int,leads:boolean>>")
        dealt = sets.select("doc_id", F.explode("groups").alias("g"), "shingles")
        dealt = dealt.select("g.a", F.explode(F.sequence("g.low", "g.high")).alias("salt"), "g.leads", "doc_id", "shingles")
        groups = dealt.groupBy("a", "salt").agg(
            F.collect_list(F.when(F.col("leads"), F.col("shingles"))).alias("lead"),
            F.collect_list(F.when(~F.col("leads"), F.struct("doc_id", "shingles"))).alias("members"),
        )
        return self.scratch.keep(map_batches(groups.select("a", "lead", "members"), _linked, "u long, v long"), f"{name}-links")

    def across(self, stars: DataFrame, labels: DataFrame) -> DataFrame | None:
        """Links (u, v) among what one hub was proposed to, between strays (not in the hub's component) and all others; None if there is no stray."""

        def comp(name: str) -> DataFrame:
            return labels.select(F.col("u").alias(name), F.col("v").alias(f"{name}_comp"))

        named = stars.join(comp("b"), "b", "left").join(comp("a"), "a", "left")
        named = named.select("a", F.col("b").alias("doc_id"), (64 + 2 * F.col("n")).alias("bytes"), F.coalesce("b_comp", "b").alias("comp"), F.coalesce("a_comp", "a").alias("hub_comp"))
        named = self.scratch.keep(named.withColumn("stray", F.col("comp") != F.col("hub_comp")), "named")
        hubs = named.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("all"), F.sum(F.when(F.col("stray"), F.col("bytes"))).alias("out"))
        hubs = hubs.where("out > 0 and n > 1").select("a", (F.col("all") > BLOCK_BYTES).alias("large"))
        hubs = self.scratch.keep(hubs, "hubs")
        if hubs.isEmpty():
            return None
        open_ = named.join(hubs, "a")

        def role(df: DataFrame, stray: bool) -> DataFrame:
            return df.select("doc_id", "comp", F.struct("a", F.lit(stray).alias("stray"), "large").alias("group"))

        roles = role(open_, False).unionAll(role(open_.where("stray"), True))
        # A text is in as many buckets as there are bands at most.
        wanted = roles.groupBy("doc_id").agg(F.struct(F.first("comp").alias("comp"), F.collect_list("group").alias("in")).alias("groups"))
        kind = "struct<comp:long,in:array<struct<a:long,stray:boolean,large:boolean>>>"
        sets = self.scratch.keep(self.sets(wanted, kind), "open-sets")
        found = map_batches(sets.select("shingles"), _frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
        held = self.scratch.spark.sparkContext.broadcast(counts)  # one number for each bucket

        def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in row_steps(batches):
                lists = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
                sizes, rare = pa.array([len(x) for x in lists], pa.int64()), pa.array([rarest(x, held.value).tobytes() for x in lists], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, rare], ["doc_id", "groups", "size", "rare"])

        rare = self.scratch.keep(map_batches(sets, ordered, f"doc_id long, groups {kind}, size long, rare binary"), "rarest")
        dealt = rare.select("doc_id", F.col("groups.comp").alias("comp"), "size", "rare", F.explode(F.filter("groups.in", lambda g: ~g["large"])).alias("g"))
        blocks = dealt.groupBy("g.a").agg(F.collect_list(F.struct("g.stray", "doc_id", "comp", "size", "rare")).alias("members"))  # BLOCK_BYTES of lists at most
        pairs = map_batches(blocks.select("members"), _possible, "a long, b long")
        if not hubs.where("large").isEmpty():
            pairs = pairs.unionAll(self.met(map_batches(rare, _spread, "a long, shingle long, stray boolean, doc_id long, comp long, size long, place long")))
        pairs = self.scratch.keep(pairs.distinct(), "possible")
        return self.confirmed(self.agreeing(pairs), "second")

    def met(self, spread: DataFrame) -> DataFrame:
        """(a, b), the lesser first: strays and members of large buckets with a rarest shingle in common, of different components, if a link may be.

        At the first shingle that two orders share, all that they share is still to come in
        both, so one of the shingles that bring a linked pair together lets it pass. Both sides are plain exchanges, so that a
        common shingle is split over tasks.
        """
        held = self.scratch.keep(spread, "spread")
        x = held.where("stray").select("a", "shingle", *[F.col(c).alias(f"x_{c}") for c in ("doc_id", "comp", "size", "place")])
        y = held.where("not stray").select("a", "shingle", *[F.col(c).alias(f"y_{c}") for c in ("doc_id", "comp", "size", "place")])
        both = F.col("x_size") + F.col("y_size")
        room = (100 + PERCENT) * F.least(F.col("x_size") - F.col("x_place"), F.col("y_size") - F.col("y_place")) >= PERCENT * both
        alike = 100 * F.least("x_size", "y_size") >= PERCENT * F.greatest("x_size", "y_size")
        found = x.join(y, ["a", "shingle"]).where((F.col("x_comp") != F.col("y_comp")) & (F.col("x_doc_id") != F.col("y_doc_id")) & alike & room)
        return found.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct()

    def sets(self, wanted: DataFrame, kind: str) -> DataFrame:
        """doc_id, groups and shingle sets of the wanted documents: each text moves once."""
        texts = self.source.where("doc_id is not null").join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "groups", "text")
        return map_batches(texts, _sets, f"doc_id long, groups {kind}, shingles binary")

    def links(self) -> DataFrame:
        """(u, v): nodes other than the least of their component, with that least node."""
        stars = self.stars()
        labels = components(self.confirmed(self.agreeing(stars), "first"), self.scratch)
        more = self.across(stars, labels)
        return labels if more is None or more.isEmpty() else components(labels.unionByName(more), self.scratch)

    def labelled(self) -> DataFrame:
        """The rows, with the component of their text as ``comp``: null where no row with an id has a word of it."""
        named = self.classes.join(self.links().select(F.col("u").alias("rep"), F.col("v").alias("comp")), "rep", "left").select("digest", F.coalesce("comp", "rep").alias("comp"))
        named = self.scratch.keep(named, "named-classes").withColumnRenamed("digest", "key")
        # Texts without a word have no digest; a hash of the id, shorter than any digest, spreads them and meets nothing.
        key = F.coalesce("digest", F.unhex(F.hex(F.xxhash64("doc_id"))))
        return self.rows.drop("keys", "sig").withColumn("key", key).join(named, "key", "left").drop("key")


def clusters(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """doc_id, the carried columns and comp, for each input row; a row with a null id has the component of the others with its text."""
    return _Run(df, id_col, text_col, carry).labelled().select("doc_id", *carry, "comp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each input row."""
    out = _Run(df, id_col, text_col).labelled().withColumn("comp", F.when(F.col("doc_id").isNotNull(), F.col("comp")))
    component = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, one for each component: that of its least id.

    Rows go by id and text. Of rows that repeat both, one stays, whatever their
    other columns hold. An id that comes with different texts keeps each text that
    isn't linked with a smaller id; of those with the same words one stays. Rows
    with a null id all stay, and so does one row of each id without a word.
    """
    tie, words = F.xxhash64(F.col(f"`{text_col}`").cast("string")), F.coalesce("digest", F.lit(b""))
    narrow = df.select(F.col(f"`{id_col}`").alias("doc_id"), tie.alias("tie"), F.col(f"`{text_col}`").alias("text"))
    run = _Run(narrow, "doc_id", "text", ("tie",))
    rows = run.labelled().where("doc_id is not null").groupBy("doc_id", words.alias("words"), "tie").agg(F.first("comp").alias("comp"), F.count(F.lit(1)).alias("n"))
    rows = run.scratch.keep(rows, "by-text")
    stay = rows.where(F.coalesce("comp", "doc_id") == F.col("doc_id"))
    best = stay.groupBy("doc_id", "words").agg(F.min("tie").alias("best"))
    worse = stay.join(best, ["doc_id", "words"]).where(F.col("tie") != F.col("best"))
    gone = rows.where(F.coalesce("comp", "doc_id") != F.col("doc_id")).select("doc_id", "tie").unionAll(worse.select("doc_id", "tie"))
    name = "__tie"
    while name in df.columns:
        name += "_"
    gone = run.scratch.keep(gone, "gone").select(F.col("doc_id").alias("__gone_id"), F.col("tie").alias("__gone_tie"))
    marked = df.withColumn(name, tie)
    kept = marked.join(gone, (F.col(f"`{id_col}`") == F.col("__gone_id")) & (F.col(name) == F.col("__gone_tie")), "left_anti")
    if not stay.where("n > 1").isEmpty():  # repeated rows: only those with an id are looked at
        kept = kept.where(F.col(f"`{id_col}`").isNotNull()).dropDuplicates([id_col, name]).unionByName(kept.where(F.col(f"`{id_col}`").isNull()))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


portable(__name__)
