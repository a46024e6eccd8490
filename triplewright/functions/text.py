"""Text normalisation and tokens as column expressions."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that become a plain letter, whatever their case.
PLAIN_LETTERS = {
    "a": "áăắặằẳẵǎâấậầẩẫäǟȧǡạȁàảȃāąåǻḁãǽǣ",
    "b": "ḃḅḇ",
    "c": "ćčçḉĉċ",
    "d": "ďḑḓḋḍḏ",
    "e": "éĕěȩḝêếệềểễḙëėẹȅèẻȇēḗḕęẽḛ",
    "f": "ḟ",
    "g": "ǵğǧģĝġḡ",
    "h": "ḫȟḩĥḧḣḥẖ",
    "i": "íĭǐîïḯi̇ịȉìỉȋīįĩḭı",
    "j": "ǰĵ",
    "k": "ḱǩķḳḵ",
    "l": "ĺľļḽḷḹḻ",
    "m": "ḿṁṃ",
    "n": "ńňņṋṅṇǹṉñ",
    "o": "óŏǒôốộồổỗöȫȯȱọőȍòỏơớợờởỡȏōṓṑǫǭõṍṏȭǿøɔ",
    "p": "ṕṗ",
    "r": "ŕřŗṙṛṝȑȓṟ",
    "s": "śṥšṧşŝșṡẛṣṩ",
    "t": "ťţṱțẗṫṭṯ",
    "u": "úŭǔûṷüǘǚǜǖṳụűȕùủưứựừửữȗūṻųůũṹṵ",
    "v": "ṿṽ",
    "w": "ẃŵẅẇẉẁẘ",
    "x": "ẍẋ",
    "y": "ýŷÿẏỵỳỷȳẙỹy",
    "z": "źžẑżẓẕʐ",
}
DELETED = '€"©'
DELETED_LEGACY = "€“©"
#: White space that Python's str.split knows, as a class body for Java's and RE2's regular expressions.
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD_OK = r"^[A-Za-z0-9.,!?;:'\"()-]+$"
TOKEN = r"\w+|[^\w\s]"
MAX_TOKENS = 128


@cache
def substitution(legacy: bool = False) -> tuple[str, str]:
    """(source, target) for translate; letters beyond the target's end are deleted. Letter cases follow Python's IGNORECASE."""
    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x10000)]))
    source: dict[str, str] = {}
    for plain, letters in PLAIN_LETTERS.items():
        for c in re.findall(f"[{letters}]", every, re.IGNORECASE):
            source.setdefault(c, plain)
    gone = DELETED_LEGACY if legacy else DELETED
    kept = {c: t for c, t in source.items() if c not in gone and c != t}
    return "".join(kept) + gone, "".join(kept.values())


def substitute(c: Column, legacy: bool = False) -> Column:
    source, target = substitution(legacy)
    return F.replace(F.translate(c, source, target), F.lit("&"), F.lit("and"))


def words(c: Column) -> Column:
    """Non-empty stretches between white space of any kind."""
    return F.filter(F.split(c, f"[{SPACE}]+", -1), lambda w: w != "")


def normalize(c: Column, lower: bool = False, legacy: bool = False) -> Column:
    """Plain letters; only words of plain signs stay, single-spaced. What is left is ASCII, so Unicode composition changes nothing."""
    out = F.array_join(F.filter(words(substitute(c, legacy)), lambda w: w.rlike(WORD_OK)), " ")
    return F.lower(out) if lower else out


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def normalize_aliases(aliases: Column) -> Column:
    """Lower-cased distinct aliases in order; an empty one may stay."""
    return F.array_sort(F.array_distinct(F.transform(aliases, lambda a: normalize(a, lower=True))))


def normalize_aliases_legacy(aliases: Column, stop_words: list[str]) -> Column:
    """Also without empty aliases and those whose raw string is a stop word."""
    kept = F.filter(aliases, lambda a: ~a.isin(stop_words))
    return F.array_sort(F.array_distinct(F.filter(F.transform(kept, lambda a: normalize(a, lower=True, legacy=True)), lambda a: a != "")))


def tokens(c: Column, most: int = MAX_TOKENS) -> Column:
    return F.slice(F.regexp_extract_all(c, F.lit(TOKEN), 0), 1, most)


def token_at(c: Column, char: Column, most: int = MAX_TOKENS) -> Column:
    """The token that holds the character at a 0-based position; null past the last token. Splitting a prefix splits like the whole."""
    index = F.size(F.regexp_extract_all(F.substring(c, 1, char + 1), F.lit(TOKEN), 0)) - 1
    return F.when((index >= 0) & (index < most), index)


def alias_pattern(alias: Column) -> Column:
    """Whole-word, case-blind pattern of an alias; a space stands for any white space."""
    return F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.replace(alias, F.lit(" "), F.lit(r"\E\s+\Q")), F.lit(r"\E(?!\w)"))


def alias_pattern_legacy(alias: Column) -> Column:
    return F.concat(F.lit(r"(?iU)\b\Q"), F.replace(alias, F.lit(" "), F.lit(r"\E\s*\Q")), F.lit(r"\E\b"))


def literal_spans(text: Column, alias: Column) -> Column:
    """array<struct<start, end>>: non-overlapping whole-word occurrences of a literal in single-spaced text, left to right.

    Pieces between matches alternate with matches of one length, so their lengths give the positions.
    """
    pieces = F.split(text, F.concat(F.lit(r"(?<!\w)\Q"), alias, F.lit(r"\E(?!\w)")), -1)
    size = F.length(alias)

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.length(piece)
        return F.struct((start + size).alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), (start + size).alias("end")))).alias("found"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))
    found = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), begin, step)["found"]
    return F.when((alias != "") & F.contains(text, alias), found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
