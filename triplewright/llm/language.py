"""Language identification of words, spans and texts.

The script of a word narrows its candidate languages; hashed character n-grams
score it under each of them; Viterbi with a penalty for each switch labels the
words, so that runs of one language come out as spans. A text's language is the
one whose spans hold most letters. Its score is their share, each span weighed by
how sure its words make its label against the other languages: a text in a script
that no learned language writes scores one over the number of languages.

Letters are characters of the Unicode categories L; numbers and marks are none.
Null texts and texts without a letter are ``und`` with score 0 and no spans. Of
equal languages the first by name wins. Every lang value but null is learned, the
empty string too. Repeated rows give equal results; without any teaching row, and
for an empty table, nothing is learned and all is ``und``.

The model has BUCKETS floats for each language (256 kB). Word scores held at once
are bounded by ``CELLS``, words times languages: texts too long for that are
scored in segments, twice, with the exact same result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.llm.batches import CHARS_PER_STEP, map_batches, portable, text_steps
from triplewright.llm.chunks import ChunkTable, worker_cache

#: Teaching rows for each language, about, chosen by hashed id; the model is fitted on them alone.
SAMPLE = 1500
#: Buckets of hashed character n-grams, and the lengths of the n-grams.
BUCKETS, LENGTHS = 1 << 16, (1, 2, 3, 4)
SMOOTH = 0.5
#: Log-odds that a switch costs, and the most that one word may count against a language.
SWITCH, MOST = 12.0, 6.0
#: A language is a candidate for a script that at least this share of its words is written in.
LEAST_SHARE = 0.02
FOLDS = 5
UNKNOWN = "und"
#: Word scores (words times languages) that a worker holds, words of a table, words of a segment of a long text, and characters taught at once.
CELLS, MOST_WORDS, SEGMENT, TEACH_CHARS = 16_000_000, 1_000_000, 50_000, 1_000_000

WORD = re.compile(r"[^\W\d_]+")

# First code points of script ranges, in ascending order; 0 is Latin, as is everything not listed.
SCRIPTS = [
    (0x0000, 0), (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0700, 0), (0x0900, 6), (0x0980, 7),
    (0x0A00, 8), (0x0A80, 9), (0x0B80, 10), (0x0C00, 11), (0x0C80, 12), (0x0D00, 13), (0x0E00, 14), (0x0E80, 15), (0x0F00, 16),
    (0x1000, 17), (0x10A0, 18), (0x1100, 19), (0x1200, 20), (0x1400, 0), (0x1780, 21), (0x1800, 0), (0x1F00, 1), (0x2000, 0),
    (0x3040, 22), (0x3100, 23), (0x3130, 19), (0x3190, 23), (0x31F0, 22), (0x3200, 0), (0x3400, 23), (0xA000, 0), (0xAC00, 19),
    (0xD800, 0), (0xF900, 23), (0xFB00, 0), (0xFB1D, 4), (0xFB50, 5), (0xFE00, 0), (0x20000, 23), (0x323B0, 0),
]
N_SCRIPTS = 24
_FROM, _IS = [a for a, _ in SCRIPTS], [b for _, b in SCRIPTS]


def words_of(text: str) -> list[str]:
    """Runs of letters of the lower-cased text."""
    found = WORD.findall(text.lower())
    if "".join(found).isalpha():
        return found
    return ["".join(run) for w in found for letters, run in groupby(w, str.isalpha) if letters]


def script_of(word: str) -> int:
    return _IS[bisect_right(_FROM, ord(word[0])) - 1]


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word of each n-gram, bucket): rolling hashes over the code points of all lower-cased words, ends marked."""
    marked = ["\x02" + w + "\x03" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(m) for m in marked], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    owners, buckets, rolling = [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        if len(codes) < n:
            break
        rolling = rolling[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        if n in LENGTHS:
            mixed = rolling * np.uint64(0x9E3779B97F4A7C15)
            inside = owner[: len(rolling)] == owner[n - 1 :]
            owners.append(owner[: len(rolling)][inside])
            buckets.append((mixed >> np.uint64(48)).astype(np.int64)[inside])
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(owners), np.concatenate(buckets)


@dataclass
class Model:
    langs: list[str]
    #: (BUCKETS, langs): log shares of n-grams.
    logs: np.ndarray
    #: (N_SCRIPTS, langs): whether the script admits the language.
    admits: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, langs): log odds against the best candidate, from -MOST to 0."""
        owner, bucket = word_grams(words)
        total = np.stack([np.bincount(owner, self.logs[bucket, k], len(words)) for k in range(len(self.langs))], axis=1)
        admitted = self.admits[[script_of(w) for w in words]]
        total = np.where(admitted, total, -np.inf)
        none = ~admitted.any(axis=1)
        total[none] = 0
        return np.maximum(total - total.max(axis=1, keepdims=True), -MOST).astype(np.float32)


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best language of each word of each text; ties go to staying, then to the first language."""
    out: list[np.ndarray | None] = [None] * len(scores)
    hard = []
    for k, s in enumerate(scores):
        best = int(s.sum(axis=0, dtype=np.float64).argmax())
        if stays(s, best, switch):
            out[k] = np.full(len(s), best, np.int16)
        else:
            hard.append(k)
    hard.sort(key=lambda k: -len(scores[k]))
    begin = 0
    while begin < len(hard):  # texts of like length go step by step together
        longest = len(scores[hard[begin]])
        end = begin + max(1, min(64, CELLS // max(longest * scores[hard[begin]].shape[1], 1)))
        group = hard[begin:end]
        for k, path in zip(group, lockstep([scores[k] for k in group], switch), strict=True):
            out[k] = path
        begin = end
    return out  # type: ignore[return-value]


def stays(s: np.ndarray, best: int, switch: float) -> bool:
    """True only if no path with a switch beats staying: no stretch gains what leaving and coming back cost."""
    if s.shape[1] == 1:
        return True
    gain = s - s[:, best : best + 1]
    gain[:, best] = -np.inf
    run = np.concatenate([[0.0], np.cumsum(gain.max(axis=1), dtype=np.float64)])
    low = np.minimum.accumulate(run)
    return bool((run - low).max() <= 2 * switch and run.max() <= switch and run[-1] - low[-1] <= switch)


def lockstep(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """Exact Viterbi of several texts, longest first, one numpy step for each position."""
    sizes = np.array([len(s) for s in scores])
    n, langs = len(scores), scores[0].shape[1]
    total = np.stack([s[0] for s in scores]).astype(np.float64)
    back = np.zeros((sizes[0], n, langs), np.int16)
    here = np.arange(langs, dtype=np.int16)
    flat = np.zeros((sizes[0], n, langs), np.float32)
    for k, s in enumerate(scores):
        flat[: len(s), k] = s
    alive_at = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # texts longer than the position
    for t in range(1, sizes[0]):
        m = alive_at[t]
        held = total[:m]
        top = held.argmax(axis=1)
        come = held[np.arange(m), top][:, None] - switch
        moved = come > held
        back[t, :m] = np.where(moved, top[:, None], here)
        total[:m] = np.where(moved, come, held) + flat[t, :m]
    out = []
    for k, size in enumerate(sizes.tolist()):
        path = np.empty(size, np.int16)
        path[-1] = total[k].argmax()
        for t in range(size - 1, 0, -1):
            path[t - 1] = back[t, k, path[t]]
        out.append(path)
    return out


def walk(total: np.ndarray, s: np.ndarray, switch: float, back: np.ndarray | None = None) -> np.ndarray:
    """Carry the best totals of each language over the words of ``s``; ``back`` takes the language that each step came from."""
    here = np.arange(len(total), dtype=np.int16)
    for t in range(len(s)):
        top = total.argmax()
        come = total[top] - switch
        moved = come > total
        if back is not None:
            back[t] = np.where(moved, top, here)
        total = np.where(moved, come, total) + s[t]
    return total


def long_viterbi(segment: Callable[[int], np.ndarray], n: int, langs: int, switch: float = SWITCH) -> np.ndarray:
    """The best path over n segments, of which one is in memory at a time: totals are kept where segments begin, and each is walked again from there."""
    starts, now = [], np.zeros(langs)
    for k in range(n):
        starts.append(now)
        now = walk(now, segment(k), switch)
    parts, label = [], int(now.argmax())
    for k in range(n - 1, -1, -1):
        s = segment(k)
        back = np.empty(s.shape, np.int16)
        walk(starts[k], s, switch, back)
        path = np.empty(len(s), np.int16)
        for t in range(len(s) - 1, -1, -1):
            path[t] = label
            label = back[t, label]
        parts.append(path)
    return np.concatenate(parts[::-1])


@dataclass
class Runs:
    """Runs of words of one language: the language, words and letters of each, and how sure its words make the language."""

    lang: np.ndarray
    words: np.ndarray
    letters: np.ndarray
    sure: np.ndarray


NO_RUNS = Runs(*[np.empty(0, np.int64)] * 3, np.empty(0))


def runs_of(path: np.ndarray, sizes: np.ndarray, segments: Iterable[np.ndarray]) -> Runs:
    """The runs of a path; ``segments`` are the scores of its words, in order."""
    first = np.flatnonzero(np.diff(path, prepend=-1))
    number = np.cumsum(np.diff(path, prepend=-1) != 0) - 1
    sure, at, rest, open_ = np.empty(len(first)), 0, 0.0, 0
    for s in segments:
        mine = number[at : at + len(s)]
        sums = np.add.reduceat(s, np.flatnonzero(np.diff(mine, prepend=-1)), axis=0, dtype=np.float64)
        if mine[0] == open_:
            sums[0] += rest
        odds = np.exp(sums - sums.max(axis=1, keepdims=True))
        runs = np.arange(mine[0], mine[-1] + 1)
        sure[runs] = odds[np.arange(len(runs)), path[first[runs]]] / odds.sum(axis=1)  # the last one again if it goes on
        rest, open_, at = sums[-1], mine[-1], at + len(s)
    return Runs(path[first].astype(np.int64), np.diff(first, append=len(path)), np.add.reduceat(sizes, first, dtype=np.int64), sure)


class Labeller:
    """Words of texts, with their scores held between texts."""

    def __init__(self, model: Model):
        self.model = model
        self.langs = max(len(model.langs), 1)
        self.most_words = max(1, min(MOST_WORDS, CELLS // self.langs))
        #: Characters of the texts that are labelled at once: their words fit into CELLS.
        self.step = max(1, min(CHARS_PER_STEP, CELLS // self.langs))
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.empty((0, len(self.model.langs)), np.float32)
        self.sizes = np.empty(0, np.int32)
        self.table = ChunkTable(self.learn)

    def learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [words_of(c) for c in chunks]
        new = list({w: None for f in found for w in f if w not in self.number})
        if new:
            have = len(self.number)
            self.number.update(zip(new, range(have, have + len(new)), strict=True))
            if have + len(new) > len(self.scores):
                room = have + len(new)
                self.scores = np.concatenate([self.scores[:have], np.empty((room, self.scores.shape[1]), np.float32)])
                self.sizes = np.concatenate([self.sizes[:have], np.empty(room, np.int32)])
            self.scores[have : have + len(new)] = self.model.word_scores(new)
            self.sizes[have : have + len(new)] = [len(w) for w in new]
        ids = [self.number[w] for f in found for w in f]
        return np.array(ids, np.uint32), np.array([len(f) for f in found], np.int64)

    def label(self, texts: list[str | None]) -> list[Runs]:
        """The runs of each text; texts in one call have at most ``step`` characters together, or are one text."""
        if not self.model.langs:
            return [NO_RUNS] * len(texts)
        if len(texts) == 1 and len(texts[0] or "") > self.step:
            return [self.label_long(texts[0])]
        if len(self.number) > self.most_words:
            self.reset()
        ids, lengths, _ = self.table.encode([(t or "").replace("\n", " ").split(" ") for t in texts])
        each = np.split(ids, np.cumsum(lengths)[:-1])
        some = [k for k, x in enumerate(each) if len(x)]
        paths = iter(viterbi([self.scores[each[k]] for k in some]))
        return [runs_of(next(paths), self.sizes[x], [self.scores[x]]) if len(x) else NO_RUNS for x in each]

    def label_long(self, text: str, size: int = SEGMENT) -> Runs:
        words = words_of(text)
        if not words:
            return NO_RUNS
        size = max(1, min(size, CELLS // self.langs))
        n = -(-len(words) // size)

        def segment(k: int) -> np.ndarray:
            mine = words[k * size : (k + 1) * size]
            number = {w: i for i, w in enumerate(dict.fromkeys(mine))}
            return self.model.word_scores(list(number))[[number[w] for w in mine]]

        path = long_viterbi(segment, n, len(self.model.langs))
        return runs_of(path, np.array([len(w) for w in words]), map(segment, range(n)))

    def language(self, runs: Runs) -> tuple[str, float]:
        if not len(runs.lang):
            return UNKNOWN, 0.0
        letters = np.bincount(runs.lang, runs.letters, len(self.model.langs))
        best = int(letters.argmax())
        mine = runs.lang == best
        return self.model.langs[best], float((runs.letters[mine] * runs.sure[mine]).sum() / runs.letters.sum())


def worker_labeller(model: Model) -> Labeller:
    held = worker_cache()
    key = "language", zlib.crc32(model.logs.tobytes()), tuple(model.langs)
    if held.get("language", (None,))[0] != key:
        held["language"] = key, Labeller(model)
    return held["language"][1]


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Counts of n-grams and scripts by language, over a bounded sample of rows outside the held-out fold."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id"))
    there = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each language
    langs = [lang for lang, _ in there]
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool))
    shares = F.create_map(*[x for lang, n in there for x in (F.lit(lang), F.lit(min(1 << 30, (sample << 30) // n)))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(shares, F.col("lang")))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_steps(batches, most=TEACH_CHARS):
            names = batch.column(2).to_pylist()
            for lang in sorted(set(names)):
                words = [w for t, x in zip(texts, names, strict=True) if x == lang for w in words_of(t)]
                if words:
                    _, bucket = word_grams(words)
                    count = np.bincount(bucket, minlength=BUCKETS + N_SCRIPTS)
                    count[BUCKETS:] = np.bincount([script_of(w) for w in words], minlength=N_SCRIPTS)
                    at = np.flatnonzero(count)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(count[at])], ["lang", "bucket", "n"])

    counted = map_batches(chosen.select("doc_id", "text", "lang"), kernel, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS + N_SCRIPTS, len(langs)))
    counts[counted["bucket"].to_numpy(), counted["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy()] = counted["n"].to_numpy()
    grams, scripts = counts[:BUCKETS] + SMOOTH, counts[BUCKETS:]
    return Model(langs, np.log(grams / grams.sum(axis=0)).astype(np.float32), scripts >= np.maximum(scripts.sum(axis=0) * LEAST_SHARE, 1))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans (runs of words of one language, as lang:words): one row for each input row."""
    model = df.sparkSession.sparkContext.broadcast(train(df, id_col, text_col, lang_col, sample))  # BUCKETS floats a language

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = worker_labeller(model.value)
        for batch, texts in text_steps(batches, most=labeller.step):
            labels = labeller.label(texts)
            found = [labeller.language(x) for x in labels]
            spans = [" ".join(f"{labeller.model.langs[k]}:{n}" for k, n in zip(x.lang.tolist(), x.words.tolist(), strict=True)) for x in labels]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found]), pa.array([x[1] for x in found]), pa.array(spans)], ["doc_id", "lang_pred", "score", "spans"])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(source, kernel, "doc_id long, lang_pred string, score double, spans string").select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "spans")


portable(__name__)
