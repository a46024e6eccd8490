"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio.

One- and two-word grams hash into a fixed number of buckets. The buckets of the
trusted rows make one multinomial, those of all rows another; a text's verdict
is the mean over its grams of log(trusted / raw), held against one threshold.
Bucket weights are whole numbers, so that sums, and verdicts, don't depend on
the order of anything. All column expressions: no Python touches the rows.

Null text counts as empty: no words, so the base rules reject it. Null or
repeated labels of a row: the highest counts, none is untrusted. Repeated rows
give equal results and count as often as they occur. Without any trusted row all
weights are 0 and the base rules alone decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the two multinomials: what reaches the driver is two counts for each.
BUCKETS = 16384
#: Weights are log ratios times this, rounded.
UNIT = 10_000
#: A text is rejected where the sum of its weights is less than this times its grams (a mean log ratio of -0.08).
THRESHOLD = -800
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Trusted ids up to which their table (some 16 MB) is broadcast; with more, texts are shuffled to them.
MOST_BROADCAST = 250_000
WORD = r"[^\x20\x09-\x0D]+"
SIGN = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def grams_of(words: Column) -> Column:
    """Buckets of all one- and two-word grams, repeats included. ``words`` is a column, not an expression: it is read at each place."""

    def grams(low: Column) -> Column:
        ones = F.transform(low, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
        twos = F.transform(low, lambda w, i: F.pmod(F.xxhash64(w, F.get(low, i + 1)), F.lit(BUCKETS)).cast("int"))
        return F.concat(ones, F.slice(twos, 1, F.greatest(F.size(low) - 1, F.lit(0))))

    return F.transform(F.array(F.transform(words, F.lower)), grams)[0]


def repeat_words(windows: Column) -> Column:
    """Words covered by three-word windows (given by hash) that occur twice or more."""
    keyed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    # Bound once as the only element of an outer list, so that the sorting isn't repeated for each element.
    def covered(held: Column) -> Column:
        def twice(x: Column, at: Column) -> Column:
            beside = [F.coalesce(F.get(held, at + step)["h"] == x["h"], F.lit(False)) for step in (-1, 1)]
            return beside[0] | beside[1]

        return F.size(F.array_distinct(F.flatten(F.transform(F.filter(held, twice), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    counted = F.transform(F.array(keyed), covered)[0]
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(counted)


def _counted(source: DataFrame) -> DataFrame:
    """Columns doc_id, text and held, with the counts of the base rules and the grams."""
    source = source.select("doc_id", "held", "text", words_of(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("mark"))
    text, words = F.col("text"), F.col("words")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    size = F.size(words)
    # Windows of three words are compared by a 64-bit hash of all three.
    windows = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    windows = F.slice(windows, 1, F.greatest(size - 2, F.lit(0)))
    source = source.withColumns({"lines": lines, "windows": windows})
    return source.select(
        "doc_id",
        "held",
        "mark",
        grams_of(words).alias("grams"),
        size.cast("long").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)).alias("word_chars"),
        F.regexp_count(text, F.lit(SIGN)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("windows")).cast("long").alias("n_repeat_words"),
    )


def kept_here(condition: Column, mark: str = "mark") -> Column:
    """``condition`` itself, tied to a column that isn't deterministic, so that no filter on it moves below that column.

    Pushed further down, a filter on the verdict would split the text anew at each
    place that mentions the words, inside lambdas at each element. ``mark`` is
    never negative.
    """
    return condition | (F.col(mark) < 0)


def bucket_counts(df: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> list[tuple[int, int, int]]:
    """(bucket, grams in trusted rows, grams in all rows): at most BUCKETS rows reach the driver."""
    labels = trusted.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.lit(1).alias("is_trusted"))
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if labels.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        rows = rows.join(F.broadcast(labels), "doc_id", "left")
    else:  # rows without an id match nothing and are spread by their text
        rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0))
        rows = rows.join(labels.withColumn("salt", F.lit(0).cast("long")).hint("shuffle_hash"), ["doc_id", "salt"], "left")
    rows = rows.select("is_trusted", words_of(F.col("text")).alias("words"))
    grams = rows.select("is_trusted", F.explode(grams_of(F.col("words"))).alias("bucket"))
    counted = grams.groupBy("bucket").agg(F.count("is_trusted").alias("t"), F.count(F.lit(1)).alias("n"))
    return [(r["bucket"], r["t"], r["n"]) for r in counted.collect()]


def weights(counts: list[tuple[int, int, int]], buckets: int = BUCKETS) -> list[int]:
    """Whole-number log ratios of the two multinomials, one added to each count."""
    trusted, raw = [0] * buckets, [0] * buckets
    for bucket, t, n in counts:
        trusted[bucket], raw[bucket] = t, n
    if not sum(trusted):
        return [0] * buckets
    shift = math.log(sum(raw) + buckets) - math.log(sum(trusted) + buckets)
    return [round(UNIT * (math.log(t + 1) - math.log(n + 1) + shift)) for t, n in zip(trusted, raw, strict=True)]


def _judged(df: DataFrame, held: Column, trusted: DataFrame, id_col: str, text_col: str, threshold: int) -> DataFrame:
    model = weights(bucket_counts(df, trusted, id_col, text_col))
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")  # folded into one constant by the optimizer
    out = _counted(df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held.alias("held")))
    out = out.withColumn("weight", F.aggregate("grams", F.lit(0).cast("long"), lambda acc, b: acc + F.get(table, b)))
    out = out.withColumn("base_failed", kept_here((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))))
    return out.select(
        "doc_id", "held", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (F.col("weight") / (UNIT * F.nullif(F.size("grams").cast("long"), F.lit(0).cast("long")))).alias("llr"),
        (~F.col("base_failed") & (F.col("weight") >= threshold * F.size("grams").cast("long"))).alias("kept"),
    )


def judge(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, llr (mean log ratio; null without words) and kept, for each input row.

    ``trusted`` has the ids of the target rows in ``id_col``.
    """
    return _judged(df, F.lit(None).cast("int"), trusted, id_col, text_col, threshold).drop("held")


def keep_good(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``df``, all columns, that ``judge`` keeps; no join: the row travels with its verdict."""
    held = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return _judged(df, held, trusted, id_col, text_col, threshold).where("kept").select("held.*")
