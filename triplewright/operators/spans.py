"""Entity spans in descriptions by alias match, gold triples and silver labels.

Spans are found once for each distinct (description, entity), whatever the
number of triples; triples join back by key, as a bag. Texts are normalised and
lower-cased before, so aliases are literals.

A whole-word match begins and ends with a token, so an alias of a description's
entities is looked for where its tokens begin, of which there are at most a model's
length. A description is exchanged once, as one row of its clipped text and those places;
a head with very many tails moves aliases, not texts, and a common alias is no hot key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplewright.functions import vectors as V
from triplewright.functions.text import MAX_TOKENS, TOKEN, normalize, tokens
from triplewright.sources.lines import write_lines

#: Letters of a text that are normalised first, when its first tokens are asked for.
OPENING = 2048
KINDS = ("h_s", "h_e", "t_s", "t_e")


def clipped(text: Column, most: int = MAX_TOKENS) -> Column:
    """The text up to its last counted token and one character more, which keeps look-aheads right."""
    kept = F.regexp_extract(text, rf"(?s)^(?:\s*(?:\w+|[^\w\s])){{0,{most}}}\s?.?", 0)
    return F.when(F.length(text) > most, kept).otherwise(text)


def opening(text: Column, most: int = MAX_TOKENS) -> Column:
    """``clipped`` of the normalised, lower-cased text, of which a first part alone is normalised where that is enough: words are normalised one by one."""
    part = normalize(F.regexp_extract(F.substring(text, 1, OPENING), "(?s)^(.*) ", 1), lower=True)
    cut = F.when(F.length(text) > OPENING, V.bound(part, lambda t: V.bound(clipped(t, most), lambda c: F.when(F.length(c) < F.length(t), c))))
    return F.coalesce(cut, V.bound(normalize(text, lower=True), lambda t: clipped(t, most)))  # normalised once


def placed_tokens(text: Column, most: int = MAX_TOKENS) -> Column:
    """array<struct<tok, start>>: the first tokens with the characters they begin at, found once for a text.

    Tokens and the pieces between them alternate, so lengths give the places.
    """
    toks = tokens(text, most)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<tok:string,start:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        return F.struct((start + F.length(x["tok"])).alias("at"), F.concat(acc["out"], F.array(F.struct(x["tok"].alias("tok"), start.alias("start")))).alias("out"))

    both = F.arrays_zip(F.slice(F.split(text, TOKEN, -1), 1, F.size(toks)).alias("gap"), toks.alias("tok"))
    return F.aggregate(both, begin, step)["out"]


def alias_spans(pairs: DataFrame, descriptions: DataFrame, aliases: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """(h, entity, alias, pos, start, end, s, e): every match of every alias of ``entity`` in the description of ``h``.

    ``pairs`` has distinct (h, entity); start and end are characters, s and e inclusive
    tokens. Matches past the last token fall away, and so do matches that begin before
    the one before them ends. Empty aliases match nothing.
    """
    names = aliases.select(F.col("entity_id").alias("entity"), F.posexplode("aliases").alias("pos", "alias")).where("alias <> ''")
    names = names.withColumn("toks", F.regexp_extract_all("alias", F.lit(TOKEN), 0))
    # A text can overlap itself only where it begins as it ends.
    again = F.exists(F.sequence(F.lit(1), F.greatest(F.size("toks") - 1, F.lit(1))), lambda k: (k < F.size("toks")) & (F.slice("toks", 1, k) == F.slice("toks", F.size("toks") - k + 1, k)))
    names = names.select("entity", "pos", "alias", F.size("toks").alias("n"), again.alias("again")).where(F.col("n").between(1, most))
    texts = descriptions.select(F.col("entity_id").alias("h"), clipped(F.col("text"), most).alias("text"))
    texts = texts.select("h", "text", F.transform(placed_tokens(F.col("text"), most), lambda x: x["start"]).alias("starts"))
    found = pairs.join(names, "entity").join(texts, "h").where(F.contains("text", F.col("alias")))
    here = F.transform("starts", lambda x, i: F.when((i + F.col("n") <= most) & (F.substring("text", x + 1, F.length("alias")) == F.col("alias")), F.struct(i.alias("s"), x.alias("start"))))
    found = found.withColumn("x", F.explode(F.filter(here, lambda x: x.isNotNull()))).select("h", "entity", "alias", "pos", "n", "again", "text", "x.s", "x.start")
    found = found.withColumn("end", F.col("start") + F.length("alias"))
    sides = F.concat(F.substring("text", F.col("start"), F.when(F.col("start") > 0, 1).otherwise(0)), F.lit(" "), F.substring("text", F.col("end") + 1, F.lit(1)))
    found = found.where(~sides.rlike(r"\w")).withColumn("e", F.col("s") + F.col("n") - 1)
    columns = ["h", "entity", "alias", "pos", "start", "end", "s", "e"]
    once = found.where(~F.col("again")).select(*columns)
    held = found.where("again").groupBy("h", "entity", "alias", "pos").agg(F.array_sort(F.collect_list(F.struct("start", "end", "s", "e"))).alias("x"))  # a text's tokens at most

    def step(acc: Column, x: Column) -> Column:
        free = (F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["end"] <= x["start"])
        return F.when(free, F.concat(acc, F.array(x))).otherwise(acc)

    kept = F.aggregate("x", F.array().cast("array<struct<start:int,end:int,s:int,e:int>>"), step)
    return once.unionByName(held.select("h", "entity", "alias", "pos", F.explode(kept).alias("y")).select("h", "entity", "alias", "pos", "y.*"))


def entity_pairs(triples: DataFrame) -> DataFrame:
    """Distinct (h, entity): every head with itself and its tails."""
    return triples.select("h", F.col("h").alias("entity")).union(triples.select("h", F.col("t").alias("entity"))).distinct()


def entity_spans(triples: DataFrame, descriptions: DataFrame, aliases: DataFrame, most: int = MAX_TOKENS, find: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Distinct (h, entity, s, e) for the head and the tails of every described head. ``find`` takes the place of ``alias_spans``, for texts that aren't normalised or other tokens."""
    pairs = entity_pairs(triples)
    found = find(pairs, descriptions, aliases) if find else alias_spans(pairs, descriptions, aliases, most)
    return found.select("h", "entity", "s", "e").distinct()


def gold_triples(triples: DataFrame, descriptions: DataFrame, aliases: DataFrame, most: int = MAX_TOKENS, find: Callable[..., DataFrame] | None = None) -> DataFrame:
    """(h, r, t, hs, he, ts, te): head spans times tail spans of each triple; repeated triples repeat their rows."""
    spans = entity_spans(triples, descriptions, aliases, most, find)
    heads = spans.where("h = entity").select("h", F.col("s").alias("hs"), F.col("e").alias("he"))
    tails = spans.select("h", F.col("entity").alias("t"), F.col("s").alias("ts"), F.col("e").alias("te"))
    return triples.join(tails, ["h", "t"]).join(heads, "h").select("h", "r", "t", "hs", "he", "ts", "te")


def gold_by_head(gold: DataFrame) -> DataFrame:
    """(h, triples): one sorted list for each head."""
    return gold.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("r", "t", "hs", "he", "ts", "te"))).alias("triples"))


def strict_gold_triples(triples: DataFrame, descriptions: DataFrame, aliases: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """``gold_triples``; the query fails, and names the entity, where an end of a triple with a described head has no aliases."""
    described = triples.join(descriptions.select(F.col("entity_id").alias("h")), "h", "left_semi")
    bad = without_aliases(described, aliases).agg(F.min("entity_id").alias("bad"))  # one row
    checked = triples.crossJoin(F.broadcast(bad))
    h = F.when(F.col("bad").isNotNull(), F.raise_error(F.concat(F.lit("no aliases: "), F.col("bad")))).otherwise(F.col("h"))
    return gold_triples(checked.select(h.cast("string").alias("h"), "r", "t"), descriptions, aliases, most)


def without_aliases(triples: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities of triples that have no aliases: what a strict run would stop at."""
    ends = triples.select(F.col("h").alias("entity_id")).union(triples.select("t")).distinct()
    return ends.join(aliases, "entity_id", "left_anti")


def first_match(pairs: DataFrame, descriptions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(h, entity, alias, start, end): the first occurrence of each alias."""
    spans = alias_spans(pairs, descriptions, aliases)
    return spans.groupBy("h", "entity", "alias").agg(F.min_by(F.struct("start", "end"), "start").alias("f")).select("h", "entity", "alias", "f.start", "f.end")


def overlapping_tokens(offsets: Column, start: Column, end: Column) -> Column:
    """struct<first, last>: the tokens (array of struct<i, s, e>) that share a character with [start, end)."""
    hit = F.filter(offsets, lambda t: (t["s"] < end) & (t["e"] > start))
    return F.struct(F.get(hit, F.lit(0))["i"].alias("first"), F.try_element_at(hit, F.lit(-1))["i"].alias("last"))


def ends_aliases(descriptions: DataFrame, triples: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, head_aliases, tail_aliases) of descriptions that head a triple and have aliases; tail lists joined, repeats kept."""
    tails = triples.join(aliases.select(F.col("entity_id").alias("t"), F.col("aliases").alias("names")), "t")
    tails = tails.groupBy(F.col("h").alias("entity_id")).agg(F.flatten(F.array_sort(F.collect_list("names"))).alias("tail_aliases"))
    heads = triples.select(F.col("h").alias("entity_id")).distinct()
    rows = descriptions.select("entity_id").join(heads, "entity_id", "left_semi").join(aliases.select("entity_id", F.col("aliases").alias("head_aliases")), "entity_id")
    return rows.join(tails, "entity_id", "left").select("entity_id", "head_aliases", F.coalesce("tail_aliases", F.array().cast("array<string>")).alias("tail_aliases"))


def ends_alias_lists(descriptions: DataFrame, triples: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, head_lists, tail_lists) of every description, as an older model keeps them: lists of lists, empty where there are no aliases or triples."""
    own = aliases.select("entity_id", F.array("aliases").alias("head_lists"))
    tails = triples.join(aliases.select(F.col("entity_id").alias("t"), F.col("aliases").alias("names")), "t")
    tails = tails.groupBy(F.col("h").alias("entity_id")).agg(F.array_sort(F.collect_list("names")).alias("tail_lists"))
    none = F.array().cast("array<array<string>>")
    rows = descriptions.select("entity_id").join(own, "entity_id", "left").join(tails, "entity_id", "left")
    return rows.select("entity_id", F.coalesce("head_lists", none).alias("head_lists"), F.coalesce("tail_lists", none).alias("tail_lists"))


def silver_labels(triples: DataFrame, descriptions: DataFrame, aliases: DataFrame, find: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Distinct (entity_id, kind, pos): first and last tokens of head and tail matches; sparse, a missing row is a 0."""
    spans = entity_spans(triples, descriptions, aliases, find=find)
    return _labels(spans.join(triples.select("h", F.col("t").alias("entity")).distinct().withColumn("is_tail", F.lit(True)), ["h", "entity"], "left"))


def _labels(spans: DataFrame) -> DataFrame:
    rows = spans.select("h", F.explode(F.filter(F.array(
        F.when(F.col("entity") == F.col("h"), F.struct(F.lit("h_s").alias("kind"), F.col("s").alias("pos"))),
        F.when(F.col("entity") == F.col("h"), F.struct(F.lit("h_e").alias("kind"), F.col("e").alias("pos"))),
        F.when(F.col("is_tail"), F.struct(F.lit("t_s").alias("kind"), F.col("s").alias("pos"))),
        F.when(F.col("is_tail"), F.struct(F.lit("t_e").alias("kind"), F.col("e").alias("pos"))),
    ), lambda x: x.isNotNull())).alias("x"))
    return rows.select(F.col("h").alias("entity_id"), "x.kind", "x.pos").distinct()


def first_alias_labels(triples: DataFrame, descriptions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Silver labels from the first match of the first alias that matches, for each entity."""
    pairs = triples.select("h", F.col("h").alias("entity")).union(triples.select("h", F.col("t").alias("entity"))).distinct()
    spans = alias_spans(pairs, descriptions, aliases)
    best = spans.groupBy("h", "entity").agg(F.min_by(F.struct("s", "e"), F.struct("pos", "start")).alias("f")).select("h", "entity", "f.s", "f.e")
    return _labels(best.join(triples.select("h", F.col("t").alias("entity")).distinct().withColumn("is_tail", F.lit(True)), ["h", "entity"], "left"))


def dense_labels(labels: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """(entity_id, kind, label): arrays of 0 and 1 for export."""
    held = labels.groupBy("entity_id", "kind").agg(F.collect_set("pos").alias("at"))
    return held.select("entity_id", "kind", F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.array_contains("at", i).cast("int")).alias("label"))


def labelled(descriptions: DataFrame, labels: DataFrame, every_kind: bool = False) -> DataFrame:
    """Descriptions with a label of any kind, or of every kind."""
    if not every_kind:
        return descriptions.join(labels.select("entity_id"), "entity_id", "left_semi")
    full = labels.groupBy("entity_id").agg(F.countDistinct("kind").alias("n")).where(F.col("n") == len(KINDS))
    return descriptions.join(full, "entity_id", "left_semi")


def gold_log(descriptions: DataFrame, triples: DataFrame, gold: DataFrame) -> DataFrame:
    """(entity_id, line_no, line): a readable report of each description, its triples and its gold triples."""
    originals = triples.groupBy(F.col("h").alias("entity_id")).agg(F.array_sort(F.collect_list(F.struct("r", "t"))).alias("o"))
    golds = gold.groupBy(F.col("h").alias("entity_id")).agg(F.array_sort(F.collect_list(F.struct("r", "t", "hs", "he", "ts", "te"))).alias("g"))
    rows = descriptions.join(originals, "entity_id", "left").join(golds, "entity_id", "left")
    toks = tokens(F.col("text"))

    def cut(s: Column, e: Column) -> Column:
        return F.array_join(F.slice("toks", s + 1, e - s + 1), " ")

    rows = rows.withColumn("toks", toks)
    none = F.array().cast("array<string>")
    lines = F.concat(
        F.array(F.concat(F.lit("description: "), F.col("text")), F.concat(F.lit("tokens: "), F.array_join("toks", " "))),
        F.array(F.concat(F.lit("triples: "), F.greatest(F.size(F.coalesce("o", F.array().cast("array<struct<r:string,t:string>>"))), F.lit(0)).cast("string"))),
        F.coalesce(F.transform("o", lambda x: F.concat_ws(" ", F.lit("triple:"), x["r"], x["t"])), none),
        F.coalesce(F.transform("g", lambda x: F.concat_ws(" | ", F.concat(F.lit("gold: "), cut(x["hs"], x["he"])), x["r"], cut(x["ts"], x["te"]))), F.array(F.lit("no gold triples"))),
    )
    return rows.select("entity_id", F.posexplode(lines).alias("line_no", "line"))


def write_gold_log(descriptions: DataFrame, triples: DataFrame, gold: DataFrame, path: str) -> None:
    """The report as text files, the lines of a description together and in order."""
    write_lines(gold_log(descriptions, triples, gold), path, "line", "entity_id", "line_no")


def paired_ends(labels: DataFrame, start: str, end: str) -> DataFrame:
    """(entity_id, s, e): each labelled start with its next unused end, from left to right."""
    from triplewright.operators.extract import greedy_pairs

    held = labels.groupBy("entity_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == start, F.col("pos")))).alias("starts"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == end, F.col("pos")))).alias("ends"),
    )
    return held.select("entity_id", F.explode(greedy_pairs(F.col("starts"), F.col("ends"), None)).alias("x")).select("entity_id", "x.s", "x.e")
