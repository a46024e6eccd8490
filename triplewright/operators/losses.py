"""Losses and evaluation measures over long-form logits and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplewright.functions import vectors as V


def bce(z: Column, y: Column, weight: Column | float = 1.0) -> Column:
    """Binary cross-entropy of a logit, without overflow; ``weight`` multiplies the positive term."""
    soft = F.log1p(F.exp(-F.abs(z)))
    return (1 - y) * (F.greatest(z, F.lit(0.0)) + soft) + y * weight * (F.greatest(-z, F.lit(0.0)) + soft)


def positive_weights(labels: DataFrame) -> DataFrame:
    """(kind, weight): negatives over positives of (kind, y) rows; 1 where there is no positive."""
    n, p = F.count(F.lit(1)), F.sum(F.col("y").cast("long"))
    return labels.groupBy("kind").agg(F.when(p > 0, (n - p) / p).otherwise(F.lit(1.0)).alias("weight"))


def triple_loss(logits: DataFrame, gold: DataFrame) -> DataFrame:
    """(loss): for each gold triple, the mean over tokens of head-start, head-end, tail-start and tail-end terms, averaged over triples.

    ``logits``: (entity_id, pos, hs_logit, he_logit, ts_logit, te_logit), a row for each real token. ``gold``: (h, r, t, hs, he, ts, te), a bag.
    Positives are single tokens, so each triple's sum is the description's sum for label 0 less its logits at the gold tokens.
    """
    kinds = ("hs", "he", "ts", "te")
    zero = logits.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), sum((F.sum(bce(F.col(f"{k}_logit"), F.lit(0.0))) for k in kinds), F.lit(0.0)).alias("base"))
    rows = gold.select(F.col("h").alias("entity_id"), *kinds).join(zero, "entity_id")
    for k in kinds:
        rows = rows.join(logits.select("entity_id", F.col("pos").alias(k), F.col(f"{k}_logit").alias(f"z_{k}")), ["entity_id", k], "left")
    at = sum((F.coalesce(F.col(f"z_{k}"), F.lit(0.0)) for k in kinds), F.lit(0.0))
    return rows.agg((F.sum((F.col("base") - at) / (F.col("n") + 1e-8)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("loss"))


def slot_triple_loss(heads: DataFrame, tails: DataFrame, slots: DataFrame, gold: DataFrame) -> DataFrame:
    """(loss): the draft loss for each gold triple: head terms, and tail terms under its relation and the slot of its head span, if there is one.

    ``heads``: (entity_id, pos, start_logit, end_logit). ``tails``: the same under (relation_id, slot). ``slots``: (entity_id, slot, s, e).
    Rows of a description each, without pos, hold their logits as lists over tokens; these are exchanged once, and looked up in the row.
    """
    if "pos" not in heads.columns:
        return _held_slot_loss(heads, tails, slots, gold)

    def base(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        terms = F.sum(bce(F.col("start_logit"), F.lit(0.0)) + bce(F.col("end_logit"), F.lit(0.0)))
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_n"), terms.alias(f"{name}_base"))

    def at(rows: DataFrame, df: DataFrame, keys: list[str], pos: str, logit: str, into: str) -> DataFrame:
        return rows.join(df.select(*keys, F.col("pos").alias(pos), F.col(logit).alias(into)), [*keys, pos], "left")

    under = ["entity_id", "relation_id", "slot"]
    rows = gold.select(F.col("h").alias("entity_id"), F.col("r").alias("relation_id"), "hs", "he", "ts", "te").join(base(heads, ["entity_id"], "h"), "entity_id")
    first = slots.groupBy("entity_id", F.col("s").alias("hs"), F.col("e").alias("he")).agg(F.min("slot").alias("slot"))
    rows = rows.join(first, ["entity_id", "hs", "he"], "left").join(base(tails, under, "t"), under, "left")
    for pos, logit, into in (("hs", "start_logit", "z1"), ("he", "end_logit", "z2")):
        rows = at(rows, heads, ["entity_id"], pos, logit, into)
    for pos, logit, into in (("ts", "start_logit", "z3"), ("te", "end_logit", "z4")):
        rows = at(rows, tails, under, pos, logit, into)
    zero = F.lit(0.0)
    head = (F.col("h_base") - F.coalesce("z1", zero) - F.coalesce("z2", zero)) / (F.col("h_n") + 1e-8)
    tail = F.coalesce((F.col("t_base") - F.coalesce("z3", zero) - F.coalesce("z4", zero)) / (F.col("t_n") + 1e-8), zero)
    return rows.agg((F.coalesce(F.sum(head + tail), zero) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("loss"))


def _held_slot_loss(heads: DataFrame, tails: DataFrame, slots: DataFrame, gold: DataFrame) -> DataFrame:
    """``slot_triple_loss`` of logits in lists."""
    zero, under = F.lit(0.0), ["entity_id", "relation_id", "slot"]

    def summed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        terms = sum((V.total(F.transform(c, lambda z: bce(z, zero))) for c in ("start_logit", "end_logit")), zero)
        return df.where(F.size("start_logit") > 0).select(*keys, F.size("start_logit").alias(f"{name}_n"), terms.alias(f"{name}_base"), F.col("start_logit").alias(f"{name}_s"), F.col("end_logit").alias(f"{name}_e"))

    def at(logits: str, pos: str) -> Column:
        return F.coalesce(F.get(logits, F.when(F.col(pos).between(0, F.size(logits) - 1), F.col(pos)).cast("int")), zero)

    rows = gold.select(F.col("h").alias("entity_id"), F.col("r").alias("relation_id"), "hs", "he", "ts", "te").join(summed(heads, ["entity_id"], "h"), "entity_id")
    rows = rows.select("entity_id", "relation_id", "hs", "he", "ts", "te", ((F.col("h_base") - at("h_s", "hs") - at("h_e", "he")) / (F.col("h_n") + 1e-8)).alias("head"))
    first = slots.groupBy("entity_id", F.col("s").alias("hs"), F.col("e").alias("he")).agg(F.min("slot").alias("slot"))
    rows = rows.join(first, ["entity_id", "hs", "he"], "left").join(summed(tails, under, "t"), under, "left")
    tail = F.coalesce((F.col("t_base") - at("t_s", "ts") - at("t_e", "te")) / (F.col("t_n") + 1e-8), zero)
    return rows.agg((F.coalesce(F.sum(F.col("head") + tail), zero) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("loss"))


def entity_loss(rows: DataFrame, name: str) -> DataFrame:
    """(name): mean cross-entropy of start plus that of end probabilities; rows (start_prob, end_prob, start, end) exist for real tokens only."""

    def term(p: str, y: str) -> Column:
        return F.sum(-(F.col(y) * F.log(F.col(p) + 1e-8) + (1 - F.col(y)) * F.log(1 - F.col(p) + 1e-8)))

    return rows.agg(F.coalesce((term("start_prob", "start") + term("end_prob", "end")) / (F.count(F.lit(1)) + 1e-8), F.lit(0.0)).alias(name))


def total_loss(forward: tuple[DataFrame, DataFrame], backward: tuple[DataFrame, DataFrame], alpha: float = 1.0) -> DataFrame:
    """(subject, object, object_back, subject_back, loss): forward subject and object losses plus ``alpha`` times the backward ones."""
    names = ("subject", "object", "object_back", "subject_back")
    out = None
    for df, name in zip((*forward, *backward), names, strict=True):
        one = entity_loss(df, name)
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.withColumn("loss", F.col("subject") + F.col("object") + alpha * (F.col("object_back") + F.col("subject_back")))


def weighted_loss(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(loss): (kind, direction, z, y) rows; the mean weighted BCE of each kind and direction, averaged over all of them."""
    held = rows.join(F.broadcast(weights), "kind")  # a row for each label kind
    means = held.groupBy("kind", "direction").agg(F.avg(bce(F.col("z"), F.col("y").cast("double"), F.col("weight"))).alias("loss"))
    return means.agg(F.avg("loss").alias("loss"))


def strongest(logits: DataFrame) -> DataFrame:
    """(entity_id, kind, pos, z): the largest logit over relations."""
    return logits.groupBy("entity_id", "kind", "pos").agg(F.max("z").alias("z"))


def binarized(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    return rows.withColumn("pred", (V.sigmoid(F.col("z")) > threshold).cast("int"))


def accuracy(rows: DataFrame) -> DataFrame:
    """(kind, accuracy) of (kind, y, pred) rows."""
    return rows.groupBy("kind").agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"))


def report(rows: DataFrame) -> DataFrame:
    """(kind, label, precision, recall, f1, support) for labels 0 and 1, with macro and weighted means."""
    each = rows.select("kind", "y", "pred", F.explode(F.array(F.lit(0), F.lit(1))).alias("c"))
    hit = F.sum(((F.col("y") == F.col("c")) & (F.col("pred") == F.col("c"))).cast("double"))
    said, there = F.sum((F.col("pred") == F.col("c")).cast("double")), F.sum((F.col("y") == F.col("c")).cast("long"))
    rows = each.groupBy("kind", "c").agg(F.coalesce(hit / F.nullif(said, F.lit(0.0)), F.lit(0.0)).alias("precision"), F.coalesce(hit / F.nullif(there, F.lit(0)), F.lit(0.0)).alias("recall"), there.alias("support"))
    both = F.col("precision") + F.col("recall")
    rows = rows.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0)), F.lit(0.0)))
    names = ("precision", "recall", "f1")
    single = rows.select("kind", F.col("c").cast("string").alias("label"), *names, "support")
    macro = rows.groupBy("kind").agg(F.lit("macro avg").alias("label"), *[F.avg(n).alias(n) for n in names], F.sum("support").alias("support"))
    weighted = rows.groupBy("kind").agg(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(n) * F.col("support")) / F.sum("support")).alias(n) for n in names], F.sum("support").alias("support"))
    return single.unionByName(macro).unionByName(weighted)
