"""Licence recognition by sentences: normalised sentences are looked up among known licence
sentences, and the sequence of identifiers of a text is matched against ordered rules,
each of which consumes what it matches.

1. Texts without a word that any known sentence holds have no licence; the rest goes on.
2. Comment signs go, wrapped lines are joined, and paragraphs, list items, copyright lines
   and SPDX tags become sentences of their own; other sentences end at a full stop that
   isn't an abbreviation's.
3. What varies is taken out: years, addresses, the holder's name, articles, the words
   "version" and "license". What then follows "under", "subject to", "governed by" or
   a tag is a list of names; each is looked up, by hash, among the licences' names. Other
   sentences are looked up by their opening words. Tables are built from the values below.
4. Rules go over identifiers. A name of a licence is an identifier that stands for itself.

All column expressions; ``oracle`` states the same as DuckDB SQL. Null text counts as empty: no
sentence, no licence. Of several openings the longest counts. A tag that isn't known
stays unmatched, and so does a known sentence that no rule takes; unknown names in running
text are no licences. Repeated rows give equal results, an empty table an empty one. Only
the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licences and the names that they go by, without articles and the words version and license.
NAMES = {
    "MIT": "mit, expat, mit x11, x11 mit, mit expat",
    "MIT-0": "mit 0, mit no attribution",
    "X11": "x11",
    "Apache-1.1": "apache 1.1, apache software 1.1, asl 1.1",
    "Apache-2.0": "apache 2.0, apache 2, asl 2.0, apache software 2.0, apache software 2, asf 2.0",
    "Apache": "apache, apache software",
    "BSD-3-Clause": "bsd 3 clause, 3 clause bsd, bsd 3, bsd3, new bsd, modified bsd, revised bsd, bsd new, bsd 3 clause new, bsd 3 clause new or revised",
    "BSD-2-Clause": "bsd 2 clause, 2 clause bsd, bsd 2, bsd2, simplified bsd, freebsd, bsd 2 clause simplified",
    "BSD-4-Clause": "bsd 4 clause, 4 clause bsd, original bsd, old bsd",
    "BSD-1-Clause": "bsd 1 clause, 1 clause bsd",
    "0BSD": "0bsd, bsd 0 clause, 0 clause bsd, zero clause bsd, bsd zero clause",
    "BSD": "bsd, bsd style, berkeley software distribution",
    "MPL-1.0": "mpl 1.0, mozilla public 1.0",
    "MPL-1.1": "mpl 1.1, mozilla public 1.1",
    "MPL-2.0": "mpl 2.0, mpl 2, mozilla public 2.0, mozilla public 2",
    "MPL": "mpl, mozilla public",
    "EPL-1.0": "epl 1.0, eclipse public 1.0",
    "EPL-2.0": "epl 2.0, epl 2, eclipse public 2.0, eclipse public 2",
    "EPL": "epl, eclipse public",
    "CDDL-1.0": "cddl 1.0, cddl 1",
    "CDDL-1.1": "cddl 1.1",
    "CDDL": "cddl",
    "EUPL-1.1": "eupl 1.1, european union public 1.1",
    "EUPL-1.2": "eupl 1.2, european union public 1.2",
    "EUPL": "eupl, european union public",
    "BSL-1.0": "bsl 1.0, boost software 1.0, boost 1.0, boost software, boost",
    "BUSL-1.1": "busl 1.1, business source 1.1",
    "WTFPL": "wtfpl, wtfpl 2, wtfpl 2.0",
    "ISC": "isc",
    "Zlib": "zlib, zlib libpng",
    "Unlicense": "unlicense",
    "CC0-1.0": "cc0 1.0, cc0, cc zero 1.0, cc zero, cc cc0 1.0, cc cc0",
    "Artistic-1.0": "artistic 1.0, artistic 1.0 perl",
    "Artistic-2.0": "artistic 2.0, artistic 2",
    "Artistic": "artistic",
    "Perl": "perl",
    "PostgreSQL": "postgresql",
    "Python-2.0": "python 2.0, psf 2.0, python software foundation, psf, python software foundation 2",
    "NCSA": "ncsa, university illinois ncsa open source",
    "OFL-1.1": "ofl 1.1, sil open font 1.1, sil ofl 1.1, ofl, sil open font",
    "AFL-3.0": "afl 3.0, academic free 3.0",
    "MS-PL": "ms pl, microsoft public",
    "MS-RL": "ms rl, microsoft reciprocal",
    "OSL-3.0": "osl 3.0, open software 3.0",
    "PHP-3.01": "php 3.01",
    "Ruby": "ruby",
    "Vim": "vim",
    "W3C": "w3c",
    "curl": "curl",
    "ODbL-1.0": "odbl 1.0, open database 1.0, open data commons open database 1.0",
}
GNU = {
    "GPL": "gpl, gnu gpl, gnu general public, general public",
    "LGPL": "lgpl, gnu lgpl, gnu lesser general public, lesser general public, gnu library general public, library general public",
    "AGPL": "agpl, gnu agpl, gnu affero general public, affero general public",
}
GNU_VERSIONS, CC_VERSIONS = ("1.0", "2.0", "2.1", "3.0"), ("1.0", "2.0", "2.5", "3.0", "4.0")
CC_KINDS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")

# Opening words of licence sentences, normalised. The longest that a sentence begins with counts.
OPENINGS = {
    "MITGRANT": "permission is hereby granted free of charge to any",
    "NOTICE": "above copyright notice and this permission notice",
    "ASIS": "software is provided as is without warranty; software is provided as is",
    "LIABLE": "in no event shall",
    "LIABLE2": "in no event will",
    "BSDGRANT": "redistribution and use in source and binary forms",
    "BSDSOURCE": "redistributions of source code must retain",
    "BSDBINARY": "redistributions in binary form must reproduce",
    "BSDENDORSE": "neither name of; names of",
    "BSDADVERT": "all advertising materials mentioning features or use",
    "BSDASIS": "this software is provided by",
    "INCOMPLIANCE": "you may not use this file except in; you may not use this work except in",
    "APACHECOPY": "you may obtain copy of",
    "APACHEASIS": "unless required by applicable law or agreed to",
    "MPLCOPY": "if copy of mpl was not distributed",
    "NOWARRANTY": "this program is distributed in hope that it",
    "NOWARRANTY2": "this library is distributed in hope that it",
    "RECEIVED": "you should have received copy of",
    "ISCGRANT": "permission to use copy modify and or distribute; permission to use copy modify and distribute",
    "BOOSTGRANT": "permission is hereby granted free of charge to any person or organization",
    "ZLIBASIS": "this software is provided as is without any",
    "ZLIBGRANT": "permission is granted to anyone to use this",
    "UNLICENSE": "this is free and unencumbered software released into",
    "CC0": "dedicated to public domain; released to public domain; released into public domain; released under public domain; placed in public domain",
    "WTFPLTEXT": "do what fuck you want to public",
    "APACHETITLE": "apache 2.0 january 2004",
    "GPL2TITLE": "gnu general public 2 june 1991",
    "GPL3TITLE": "gnu general public 3 29 june 2007",
    "LGPL21TITLE": "gnu lesser general public 2.1 february 1999",
    "LGPL3TITLE": "gnu lesser general public 3 29 june 2007",
    "AGPL3TITLE": "gnu affero general public 3 19 november 2007",
    "MPL2TITLE": "mozilla public 2.0 1; mozilla public 2.0 definitions",
    "BOOSTTITLE": "boost software 1.0 august 17th 2003",
    "RIGHTS": "all rights reserved",
    "COPYRIGHT": "copyright",
}
# Licence rules over identifiers, tried in this order; <=X> is a licence's name. What stands in a licence's heading belongs to it.
HEAD = "(?:<COPYRIGHT>)*(?:<RIGHTS>)?"
RULES = [
    ("BSL-1.0", f"(?:<BOOSTTITLE>)?{HEAD}<BOOSTGRANT>(?:<NOTICE>)?(?:<ASIS>)?(?:<LIABLE>)?"),
    ("MIT", f"{HEAD}<MITGRANT>(?:<NOTICE>)?(?:<ASIS>)?(?:<LIABLE>)?"),
    ("BSD-4-Clause", f"{HEAD}<BSDGRANT><BSDSOURCE><BSDBINARY><BSDADVERT>(?:<BSDENDORSE>)?(?:<BSDASIS>)?(?:<LIABLE>)?"),
    ("BSD-3-Clause", f"{HEAD}<BSDGRANT><BSDSOURCE><BSDBINARY><BSDENDORSE>(?:<BSDASIS>)?(?:<LIABLE>)?"),
    ("BSD-2-Clause", f"{HEAD}<BSDGRANT><BSDSOURCE><BSDBINARY>(?:<BSDASIS>)?(?:<LIABLE>)?"),
    ("BSD", f"{HEAD}<BSDGRANT>(?:<BSDSOURCE>)?(?:<BSDASIS>)?(?:<LIABLE>)?"),
    ("ISC", f"{HEAD}<ISCGRANT>(?:<ASIS>)?(?:<LIABLE>)?"),
    ("Zlib", f"{HEAD}(?:<ZLIBASIS>)?(?:<LIABLE2>)?<ZLIBGRANT>"),
    ("Apache-2.0", "<=Apache-2.0>(?:<INCOMPLIANCE>)?(?:<APACHECOPY>)?(?:<APACHEASIS>)?"),
    ("Apache-2.0", "<APACHETITLE>"),
    ("GPL-2.0", "<GPL2TITLE>(?:<COPYRIGHT>)?"),
    ("GPL-3.0", "<GPL3TITLE>(?:<COPYRIGHT>)?"),
    ("LGPL-2.1", "<LGPL21TITLE>(?:<COPYRIGHT>)?"),
    ("LGPL-3.0", "<LGPL3TITLE>(?:<COPYRIGHT>)?"),
    ("AGPL-3.0", "<AGPL3TITLE>(?:<COPYRIGHT>)?"),
    ("MPL-2.0", "<MPL2TITLE>"),
    ("MPL-2.0", "<=MPL-2.0>(?:<MPLCOPY>)?"),
    ("Unlicense", "<UNLICENSE>"),
    ("WTFPL", "<WTFPLTEXT>"),
    ("CC0-1.0", "<CC0>"),
    *[(name, f"<={name}>(?:<INCOMPLIANCE>)?(?:<APACHECOPY>)?") for name in ("MPL-1.1", "CDDL", "CDDL-1.0", "CDDL-1.1", "EUPL", "EUPL-1.1", "EUPL-1.2")],
    *[(f"{f}-{v}{more}", f"<={f}-{v}{more}>(?:<NOWARRANTY2?>)?(?:<RECEIVED>)?") for f in GNU for v in GNU_VERSIONS for more in ("", "-or-later")],
    ("Proprietary", "(?:<COPYRIGHT>)?<RIGHTS>"),
]

#: Every known sentence and name has one of these words. Between two words stands anything that isn't a letter or digit.
CLUE = "(?i)licen[cs]e|spdx|gpl|apache|mozilla|bsd|creative[^a-z0-9]+commons|(?:released|distributed|available|published)[^a-z0-9]+under|copyright|permission|redistribut|all[^a-z0-9]+rights[^a-z0-9]+reserved|public[^a-z0-9]+domain|unencumbered|governed[^a-z0-9]+by|as[^a-z0-9]+perl|creativecommons|opensource[.]org|provided[^a-z0-9]+by|provided[^a-z0-9]+.as[^a-z0-9]+is|in[^a-z0-9]+no[^a-z0-9]+event|fuck[^a-z0-9]+you[^a-z0-9]+want"
CUT = "\x01"
#: What CLUE needs, in lower case: plain words are cheaper to look for.
HINTS = "licen spdx gpl apache mozilla bsd creative under copyright permission redistribut rights domain unencumbered governed perl opensource.org provided event fuck".split()
#: Steps that make sentences of a text between two line ends, in this order: pattern, what takes its place. $1 is the first group.
CUTS = [
    ("\r", ""),
    (r"(?i)spdx-license-identifier:?[ \t]*([^\n]*)", f"{CUT}spdx $1{CUT}"),
    (r"(?i)https?://(?:www[.])?creativecommons[.]org/(?:licenses|publicdomain)/(by[a-z-]*|zero)/([0-9.]+)[^ \t\n]*", f"{CUT}under cc $1 $2{CUT}"),
    (r"(?i)https?://(?:www[.])?opensource[.]org/licenses?/([a-z0-9.+-]*[a-z0-9+])[^ \t\n]*", f"{CUT}under $1{CUT}"),
    (r"(?i)https?://[^ \t\n]+|<[^<>@ \n]+@[^<>@ \n]+>", " "),
    (r"\n[^A-Za-z0-9\x01\n]+", "\n"),
    (r"\n((?i:copyright)[ \t]+(?:[(][cC][)]|©|[0-9]|by )[^\n]*)", f"{CUT}$1{CUT}"),
    (r"\n\n+", CUT),
    (r":\n", CUT),
    (r"\n(?:[0-9]{1,2}|[a-z])[.)][ \t]+", CUT),
    (r"(?i)all[ \t\n]+rights[ \t\n]+reserved", f"{CUT}all rights reserved{CUT}"),
    (r"[ \t\n]+", " "),
    (r"(?i)\b(v|vs|inc|ltd|corp|co|llc|no|st|dr|mr|mrs|ms|[a-z])[.] ", "$1 "),
    (r"[.!?][\"')\]]* ", CUT),
]
#: Steps that take out of a sentence what varies; they see lower-case letters, digits, dots and plus signs between single spaces.
VARIES = [
    (r"\b(?:the|a|an|licen[cs]es?|version|ver|v)\b(?: +|$)", ""),
    (r"\bv([0-9])", "$1"),
    (r"(gpl)v?([0-9])", "$1 $2"),
    (r"^(?:[0-9]{1,2}|[a-z])[.]? (redistribut|neither|all adv)", "$1"),
    (r"^(?:this )?(?:work|file|project|program|package|code|text|module|document|repository|library|software) is (?:hereby )?(dedicated|released|placed)", "$1"),
    (r"^([a-z ]*)copyright (?:c |[0-9, ]+).*$", "$1copyright"),
    (r"in no event shall .*$", "in no event shall"),
]
#: Steps that make a plain name of what follows "under" and the like.
PLAIN = [
    (r" as published by (?:free software foundation|sam hocevar)(?: either)?", ""),
    (r"do what f[a-z]* you want to public", "wtfpl"),
    (r"common development and distribution", "cddl"),
    (r"same terms as perl.*", "perl"),
    (r" with (?:[a-z0-9.]+ )+?exception(?: [0-9.]+)?", ""),
    (r"new or revised", "new"),
    (r"creative commons", "cc"),
    (r"\bcc attribution\b", "cc by"),
    (r"\bnon ?commercial\b", "nc"),
    (r"\bshare ?alike\b", "sa"),
    (r"\bno ?deriv(?:ative)?s?(?: works)?\b", "nd"),
    (r"\bthree clause\b", "3 clause"),
    (r"\btwo clause\b", "2 clause"),
    (r"\b(?:terms|conditions|of|either|international|unported|generic|universal|itself)\b(?: +|$)", ""),
    (r"^(?:and )+", ""),
    (r" or (?:at your option )?(?:any )?(?:later|newer)", "+"),
    (r" +([+])", "$1"),
    (r" (?:you|see|which|that|can|for|found|in|is|are|whose|unless|please|included|with|at|available|copyright|text|file|as)(?: .*)?$", ""),
    (r" (?:or|and)$", ""),
]
UNDER, EITHER = "(?:^| )(?:under|governed by|subject to|spdx) ", " (?:or|and) "


def names() -> dict[str, str]:
    """Every plain name, with its licence."""
    out = {name.strip(): licence for licence, listed in NAMES.items() for name in listed.split(",")}
    for family, listed in GNU.items():
        for name in listed.split(", "):
            out[name] = family
            for version in GNU_VERSIONS:
                for form in {version, version.removesuffix(".0")}:
                    out |= {f"{name} {form}{more}": f"{family}-{version}{kind}" for more, kind in (("", ""), (" only", ""), ("+", "-or-later"))}
    for kind in CC_KINDS:
        for version in CC_VERSIONS:
            out[f"cc {kind} {version}"] = f"CC-{kind.replace(' ', '-').upper()}-{version}"
    return out


def openings() -> dict[str, str]:
    return {" ".join(x.split()): name for name, listed in OPENINGS.items() for x in listed.split(";")}


def by_length() -> dict[int, dict[str, str]]:
    """Openings by their number of words."""
    out: dict[int, dict[str, str]] = {}
    for words, name in openings().items():
        out.setdefault(len(words.split()), {})[words] = name
    return out


#: Licences in the order in which they are reported.
LICENCES = [*NAMES, *dict.fromkeys(names().values()), "Proprietary"]
LICENCES = list(dict.fromkeys(LICENCES))


def replaced(c: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, step: F.regexp_replace(x, step[0], step[1]), steps, c)


def sentences(text: Column) -> Column:
    """Normalised sentences that hold a letter or digit."""
    cut = F.split(replaced(F.concat(F.lit("\n"), text, F.lit("\n")), CUTS), CUT)
    plain = F.transform(cut, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9.+]+", " ")))
    plain = F.transform(plain, lambda s: F.regexp_replace(replaced(F.regexp_replace(s, "[.]+( |$)", "$1"), VARIES), "^[. ]+|[. ]+$", ""))
    return F.filter(plain, lambda s: s.rlike("[a-z0-9]"))


def _known(table: dict[str, str], key: Column) -> Column:
    """The table's value. Keys are met by hash first, so that what isn't known costs one look."""
    listed = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.when(key.isin(list(table)), F.element_at(listed, key))


def identifiers(sentence: Column) -> Column:
    """array<string>: licences that a sentence names (<=X>), or else what its opening words say. An unknown tag is <SPDX>."""
    pieces = F.slice(F.split(sentence, UNDER), 2, 1000)
    plain = F.flatten(F.transform(pieces, lambda p: F.split(F.trim(replaced(p, PLAIN)), EITHER)))
    tag = sentence.rlike("^spdx ")
    found = F.transform(plain, lambda n: F.coalesce(F.concat(F.lit("="), _known(names(), n)), F.when(tag, "SPDX")))
    found = F.filter(found, lambda x: x.isNotNull())
    words, tables = F.split(sentence, " "), by_length()
    opening = F.coalesce(*[_known(tables[n], F.array_join(F.slice(words, 1, n), " ")) for n in sorted(tables, reverse=True)])
    return F.when(F.size(found) > 0, found).otherwise(F.array_compact(F.array(opening)))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_known, sentence_ids, licenses (in the order of LICENCES, comma-joined), n_unmatched: one row for each input row."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.lower("text").alias("low"))
    hint = reduce(Column.__or__, [F.contains("low", F.lit(x)) for x in HINTS])
    rows = rows.select("doc_id", F.when(hint & F.col("text").rlike(CLUE), sentences(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("s"))
    rows = rows.select("doc_id", F.flatten(F.transform("s", identifiers)).alias("ids"))
    rows = rows.withColumn("left", F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""))
    for k, (_, rule) in enumerate(RULES):
        rows = rows.withColumn(f"hit{k}", F.col("left").rlike(rule)).withColumn("left", F.regexp_replace("left", rule, "|"))
    by_rule = F.array_compact(F.array(*[F.when(F.col(f"hit{k}"), name) for k, (name, _) in enumerate(RULES)]))
    named = F.regexp_extract_all("left", F.lit("<=([^>]+)>"), 1)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_known"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.array_intersect(F.array(*[F.lit(x) for x in LICENCES]), F.concat(by_rule, named)), ",").alias("licenses"),
        F.length(F.regexp_replace(F.regexp_replace("left", "<=[^>]+>", ""), "[^<]", "")).cast("long").alias("n_unmatched"),
    )


def oracle(table: str = "documents") -> str:
    """The same as DuckDB SQL."""

    def lit(x: str) -> str:
        return "'" + x.replace("'", "''").replace(CUT, "' || chr(1) || '") + "'"

    def steps(x: str, listed: list[tuple[str, str]]) -> str:
        return reduce(lambda held, step: f"regexp_replace({held}, {lit(step[0])}, {lit(re.sub(r'[$]([0-9])', chr(92) + r'\\1', step[1]))}, 'g')", listed, x)

    def known(pairs: dict[str, str], key: str) -> str:
        return f"MAP {{{', '.join(f'{lit(k)}: {lit(v)}' for k, v in pairs.items())}}}[{key}]"

    cut = f"string_split({steps("chr(10) || text || chr(10)", CUTS)}, chr(1))"
    plain = f"list_transform({cut}, lambda s: trim(regexp_replace(lower(s), '[^a-z0-9.+]+', ' ', 'g')))"
    plain = f"list_transform({plain}, lambda s: regexp_replace({steps("regexp_replace(s, '[.]+( |$)', " + lit(chr(92) + '1') + ", 'g')", VARIES)}, '^[. ]+|[. ]+$', '', 'g'))"
    pieces = f"flatten(list_transform(string_split_regex(s, {lit(UNDER)})[2:], lambda p: string_split_regex(trim({steps('p', PLAIN)}), {lit(EITHER)})))"
    found = f"list_filter(list_transform({pieces}, lambda n: coalesce('=' || {known(names(), 'n')}, CASE WHEN starts_with(s, 'spdx ') THEN 'SPDX' END)), lambda x: x IS NOT NULL)"
    opening = "coalesce(" + ", ".join(known(t, f"array_to_string(string_split(s, ' ')[1:{n}], ' ')") for n, t in sorted(by_length().items(), reverse=True)) + ")"
    rules, columns = [], ""
    for k, (_, rule) in enumerate(RULES):
        columns += f", hit{k - 1}" if k else ""
        rules.append(f"step{k} AS (SELECT doc_id, ids{columns}, regexp_matches(rest, {lit(rule)}) AS hit{k}, regexp_replace(rest, {lit(rule)}, '|', 'g') AS rest FROM {f'step{k - 1}' if k else 'joined'})")
    by_rule = ", ".join(f"CASE WHEN hit{k} THEN {lit(name)} END" for k, (name, _) in enumerate(RULES))
    return f"""
WITH source AS (SELECT doc_id, coalesce(text, '') AS text FROM {table}),
plain AS (SELECT doc_id, list_filter(CASE WHEN regexp_matches(text, {lit(CLUE)}) THEN {plain} ELSE [] END, lambda s: regexp_matches(s, '[a-z0-9]')) AS s FROM source),
one AS (SELECT row_number() OVER () AS row, doc_id, s AS list FROM plain), each AS (SELECT row, unnest(list) AS s, generate_subscripts(list, 1) AS k FROM one),
looked AS (SELECT row, k, {found} AS found, {opening} AS opening FROM each),
held AS (SELECT row, flatten(list(CASE WHEN len(found) > 0 THEN found WHEN opening IS NOT NULL THEN [opening] ELSE [] END ORDER BY k)) AS ids FROM looked GROUP BY row),
named AS (SELECT doc_id, coalesce(ids, []) AS ids FROM one LEFT JOIN held ON held.row = one.row),
joined AS (SELECT doc_id, ids, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS rest FROM named),
{", ".join(rules)},
got AS (SELECT doc_id, ids, rest, list_concat([{by_rule}], regexp_extract_all(rest, '<=([^>]+)>', 1)) AS l FROM step{len(RULES) - 1})
SELECT doc_id, len(ids)::BIGINT AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(list_filter({LICENCES}, lambda x: list_contains(l, x)), ','), '') AS licenses,
  length(regexp_replace(regexp_replace(rest, '<=[^>]+>', '', 'g'), '[^<]', '', 'g'))::BIGINT AS n_unmatched FROM got"""
