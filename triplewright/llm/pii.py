"""Personal data in texts: patterns propose, checksums confirm, context words score.

Everything is a column expression: no Python touches the rows. Positions are
code points, ends are exclusive. Patterns are rewritten so that the regex engine
neither recurses nor retries: possessive loops, and look-behinds that start a
match only where the leftmost match of the plain pattern could start.

Time grows with a text's length plus its matches: positions come from the lengths
of matches and of the pieces between them, context from the ends of those pieces,
and lists that grow by one item a step do so in chunks.

Null text counts as empty and has no spans. Repeated rows give equal results, an
empty table an empty one.
Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters before and after a span in which context words are looked for, up to the next match of its kind.
NEAR = 40
#: Items of a chunk of a list, and characters of a block of text.
CHUNK, BLOCK = 256, 4096
#: Proposals of kinds outside the base that score less are no spans.
LEAST_SCORE = 60


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap test that a text with a match passes.
    hint: str
    score: int
    context: str
    base: bool = True


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 80, "mail|contact|write|reach"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 70, "ip|host|server|address|ping"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", r"[0-9](?:[ -]?[0-9]){13}", 70, "card|visa|master|amex|credit|debit|pay"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 70, "phone|tel|call|mobile|fax|ring"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", 80, "iban|bank|account|transfer", False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 50, "ssn|social|security|tax", False),
)
RANK = {k.name: n for n, k in enumerate(KINDS)}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
SPAN = "struct<start:int,rank:int,kind:string,end:int,score:int>"


def mod97(number: Column) -> Column:
    """ISO 7064 remainder of an account number: its first four characters go last, letters count from 10 up."""
    bare = F.replace(number, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    return F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc).when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )


def confirmed(kind: Kind, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind.name == "ip":
        return match.rlike(OCTETS)
    if kind.name == "card":
        return F.call_function("luhn_check", digits)
    if kind.name == "phone":
        return F.length(digits).between(10, 15)
    if kind.name == "iban":
        return mod97(match) == 1
    return F.lit(True)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: lambdas compute what they mention at each element, but not their own variable."""
    return F.transform(F.array(value), use)[0]


def in_chunks(items: Column) -> Column:
    """The list in pieces of CHUNK items."""
    return bound(items, lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(CHUNK)), lambda i: F.slice(x, i + 1, CHUNK)))


def carried(chunks: Column, after: Callable[[Column, Column], Column]) -> Column:
    """The number that each chunk begins with: 0, then ``after`` it and the chunk, and so on."""
    begin = F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("list"))
    return F.aggregate(chunks, begin, lambda acc, c: F.struct(after(acc["now"], c).alias("now"), F.concat(acc["list"], F.array(acc["now"])).alias("list")))["list"]


def spans_of(kind: Kind, text: Column) -> Column:
    """array<SPAN> of one kind. Matches and the pieces between them alternate, so their lengths give the positions."""
    none = F.array().cast(f"array<{SPAN}>")
    context = rf"(?i)\b(?:{kind.context})"

    def end_of(at: Column, x: Column) -> Column:
        return at + F.length(x["gap"]) + F.length(x["match"])

    def step(acc: Column, x: Column) -> Column:
        end = end_of(acc["at"], x)
        near = F.concat(F.right(x["gap"], F.lit(NEAR)), x["match"], F.left(x["rest"], F.lit(NEAR)))
        score = F.lit(kind.score) + F.when(near.rlike(context), 20).otherwise(0)
        fits = confirmed(kind, x["match"]) & (F.lit(kind.base) | (score >= LEAST_SCORE))
        span = F.struct((acc["at"] + F.length(x["gap"])).alias("start"), F.lit(RANK[kind.name]).alias("rank"), F.lit(kind.name).alias("kind"), end.alias("end"), score.alias("score")).cast(SPAN)
        return F.struct(end.alias("at"), F.when(fits, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    def folded(chunks: Column) -> Column:
        starts = carried(chunks, lambda now, c: F.aggregate(c, now, end_of))
        return F.flatten(F.zip_with(chunks, starts, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("found")), step)["found"]))

    def triples(pieces: Column, matches: Column) -> Column:
        return F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("gap"), matches.alias("match"), F.slice(pieces, 2, F.size(matches)).alias("rest"))

    found = bound(F.regexp_extract_all(text, F.lit(kind.pattern), 0), lambda matches: bound(F.split(text, kind.pattern, -1), lambda pieces: bound(in_chunks(triples(pieces, matches)), folded)))
    hit = F.contains(text, F.lit("@")) if kind.hint == "@" else text.rlike(kind.hint)
    return F.when(hit, found).otherwise(none)


def with_spans(df: DataFrame, text_col: str, into: str) -> DataFrame:
    """Add the sorted spans of all kinds."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return df.withColumn(into, F.array_sort(F.concat(*[spans_of(k, text) for k in KINDS])))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: array of (start, rank, kind, end, score) by start, then kind as listed."""
    return with_spans(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "spans").select("doc_id", "spans")


def pii_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans: one row for each input row."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    base = [k.name for k in KINDS if k.base]
    return find_pii(df, id_col, text_col).select(
        "doc_id",
        *[count(name) for name in base],
        F.sha2(listed(F.filter("spans", lambda s: s["rank"] < len(base))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same columns; each span in the text becomes ``<KIND>``, overlapping spans one mark. Null texts stay null."""
    name = "__pii_spans"
    while name in df.columns:
        name += "_"
    text, spans = F.col(f"`{text_col}`"), F.col(name)

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        """The characters from start to end, from the blocks that hold them."""
        first = F.floor(start / BLOCK).cast("int")
        held = F.slice(blocks, first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1)
        return F.when(end > start, F.array_join(held, "").substr(start % BLOCK + 1, end - start)).otherwise("")

    def marked(blocks: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            mark = F.concat(piece(blocks, acc["at"], s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
            parts = F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(mark))).otherwise(acc["parts"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

        def folded(chunks: Column) -> Column:
            starts = carried(chunks, lambda now, c: F.greatest(now, F.array_max(F.transform(c, lambda s: s["end"]))))
            return F.flatten(F.zip_with(chunks, starts, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), F.array().cast("array<string>").alias("parts")), step)["parts"]))

        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(bound(in_chunks(spans), folded), ""), bound(last, lambda at: piece(blocks, at, F.length(text))))

    done = bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}+"), F.lit(0)), marked)
    out = with_spans(df, text_col, name)
    return out.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(text)).select(*[F.col(f"`{c}`") for c in df.columns])
