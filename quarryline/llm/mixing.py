"""Mixing sources to target weights by iterative proportional fitting (DataFrame functions only).

Token counts of the cells (source, language, topic) are raked until their shares by source, by language and by topic
all meet the targets. A cell's weight is its fitted share over its observed share. Documents are then sampled with a
probability in proportion to their cell's weight, calibrated so that the expected sample is a given share of all tokens.
Where that would need a probability above 1, all documents of the cell are taken and the others make up for it; so a
small cell with a large weight doesn't set the rate of all. With a number of tokens asked for, a rate above 1 gives
whole copies and a drawn one for the rest instead.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import keeping, written

DIMENSIONS = ("source", "lang", "topic")
#: Share of the targets: observed share to this power, normalised. Below 1 it evens out; 1 holds the margin as it is.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.7}
#: The expected tokens of the sample, as a share of all.
KEEP = 0.7
#: Raking ends when a round changes no weight by more than this, relatively, or after ROUNDS.
SETTLED = 1e-4
ROUNDS = 30
#: A margin further than this from its target, relatively, is warned of.
TOLERANCE = 0.02

#: Topics by what their texts say: the one of which most terms occur, the first of those that tie; 'general' without any.
TOPICS = {
    "legal": ("license", "licence", "copyright", "warranty", "liability", "all rights reserved"),
    "contact": ("@", "phone", "e-mail", "address", "contact", "www."),
    "code": ("import ", "return ", "class ", "function", "();", "#include"),
    "commerce": ("price", "order ", "shipping", "discount", "buy ", "payment"),
    "data": (" | ", "\t", "total", "average", "table ", ";;"),
}
_SPACE = "\t\n\x0b\x0c\r "


def topic_of(text: Column, topics: Mapping[str, tuple[str, ...]] = TOPICS) -> Column:
    """The topic of lower-cased text; null is empty."""
    text = F.lower(F.coalesce(text, F.lit("")))
    hits = [sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0)) for terms in topics.values()]
    scored = F.array(*[F.struct(h.alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("topic")) for i, (h, name) in enumerate(zip(hits, topics, strict=True))])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["topic"]).otherwise("general")


def n_tokens(text: Column) -> Column:
    """Words: runs without ASCII white space; null and blank texts have none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{_SPACE}]+")).cast("long")


def _row_marks(topics: Mapping[str, tuple[str, ...]] = TOPICS) -> dict[str, Column]:
    u = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return {f"_{c}": F.coalesce(F.col(c), F.lit("(null)")) for c in ("source", "lang")} | {"_topic": topic_of(F.col("text"), topics), "_n_tokens": n_tokens(F.col("text")), "_u": u}


def marks(docs: DataFrame, topics: Mapping[str, tuple[str, ...]] = TOPICS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, u: null source or lang is the category '(null)'; u is the row's draw in [0, 1)."""
    return docs.select("doc_id", *[c.alias(name[1:]) for name, c in _row_marks(topics).items()])


def tempered(cells: DataFrame, powers: Mapping[str, float] = TEMPER) -> DataFrame:
    """Targets (dim, value, share) from the observed shares, each to its dimension's power, normalised."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value"), F.lit(float(p)).alias("power")) for d, p in powers.items()]))
    sums = cells.select(each.alias("v"), "n").groupBy("v.dim", "v.value", "v.power").agg(F.sum("n").cast("double").alias("n"))
    sums = sums.select("dim", "value", F.pow("n", "power").alias("p"))
    return sums.join(sums.groupBy("dim").agg(F.sum("p").alias("all")), "dim").select("dim", "value", (F.col("p") / F.col("all")).alias("share"))


def target_table(cells: DataFrame, given: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Targets (dim, value, share), written: those given by dimension as (value, share), and of TEMPER for the others."""
    given = given or {}
    out = tempered(cells, {d: p for d, p in TEMPER.items() if d not in given}) if len(given) < len(DIMENSIONS) else None
    for d, t in given.items():
        own = t.select(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value"), F.col("share").cast("double").alias("share"))
        out = own if out is None else out.unionByName(own)
    return written(out, "targets")


def rake(cells: DataFrame, targets: DataFrame, rounds: int = ROUNDS, settled: float = SETTLED) -> tuple[DataFrame, bool]:
    """cells (source, lang, topic, n) with the fitted share w; and whether a round moved no weight by more than ``settled``.

    A round meets the three margins one after the other; each sum is a partial aggregate, each join is left to Spark,
    which broadcasts a margin only if it is small. A value without target keeps none of its weight.
    """
    total = cells.agg(F.sum("n")).first()[0] or 1
    fitted = cells.select(*DIMENSIONS, "n", (F.col("n") / F.lit(float(total))).alias("w"))
    for _ in range(rounds):
        new = fitted.withColumn("moved", F.lit(0.0))
        for d in DIMENSIONS:
            share = targets.where(F.col("dim") == d).select(F.col("value").alias(d), "share")
            margin = new.groupBy(d).agg(F.sum("w").alias("m")).join(share, d).select(d, F.when(F.col("m") > 0, F.col("share") / F.col("m")).otherwise(0.0).alias("f"))
            new = new.join(margin, d).select(*DIMENSIONS, "n", (F.col("w") * F.col("f")).alias("w"), F.greatest("moved", F.when(F.col("w") > 0, F.abs(F.col("f") - 1)).otherwise(0.0)).alias("moved"))
        # A table for each round: the plan of a round reads its predecessor eight times.
        seen = Observation()
        fitted = written(new.observe(seen, F.max("moved").alias("moved")).drop("moved"), "rake")
        if (seen.get["moved"] or 0.0) <= settled:
            return fitted, True
    return fitted, False


def margin_gap(fitted: DataFrame, targets: DataFrame) -> float:
    """The largest relative distance of a margin of the shares w in fitted from its target; 1 where a target has no cell."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in DIMENSIONS]))
    sums = fitted.select(each.alias("v"), "w").groupBy("v.dim", "v.value").agg(F.sum("w").alias("m"))
    gaps = targets.where("share > 0").join(sums, ["dim", "value"], "left").select(F.abs(F.coalesce("m", F.lit(0.0)) / F.col("share") - 1).alias("g"))
    return gaps.agg(F.max("g")).first()[0] or 0.0


def calibrated(ratio: DataFrame, keep: float) -> float:
    """The factor c for which the sum of n * min(1, c * weight) is ``keep`` of the sum of n; infinite where no factor is
    large enough. The cells taken whole only grow from step to step, so it ends."""
    total, mass = ratio.agg(F.sum(F.col("n").cast("double")), F.sum(F.col("n") * F.col("weight"))).first()
    if not mass:
        return float("inf")
    c, whole = keep * total / mass, -1
    while True:
        full = F.col("weight") * F.lit(c) >= 1
        r = ratio.agg(
            F.count_if(full).alias("k"), F.coalesce(F.sum(F.when(full, F.col("n").cast("double"))), F.lit(0.0)).alias("s"),
            F.coalesce(F.sum(F.when(~full, F.col("n") * F.col("weight"))), F.lit(0.0)).alias("r"),
        ).first()
        if r["k"] == whole:
            return c
        if r["r"] <= 0:
            return float("inf")
        c, whole = (keep * total - r["s"]) / r["r"], r["k"]


def rates(rows: DataFrame, targets: Mapping[str, DataFrame] | None = None, rounds: int = ROUNDS, keep: float = KEEP, tokens: int | None = None) -> DataFrame:
    """(source, lang, topic, weight, prob) of the cells in rows (as from marks). prob is at most 1, or, with tokens, the
    mean number of copies that gives so many tokens. A dimension without targets has those of TEMPER. Targets that the
    rounds don't meet are warned of."""
    cells = written(rows.where("n_tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n")), "mix-cells")
    shares = target_table(cells, targets)
    fitted, settled = rake(cells, shares, rounds)
    if (not settled or targets) and (gap := margin_gap(fitted, shares)) > TOLERANCE:
        warnings.warn(f"mixing: after raking, a margin is {gap:.1%} off its target", stacklevel=2)
    total = fitted.agg(F.sum("n")).first()[0] or 1
    ratio = fitted.select(*DIMENSIONS, "n", (F.col("w") / (F.col("n") / F.lit(float(total)))).alias("weight"))
    if tokens is not None:
        prob = F.col("weight") * F.lit(tokens / total)
    else:
        c = calibrated(ratio, keep)
        prob = F.when(F.col("weight") <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("weight") * F.lit(c)))
    return written(ratio.select(*DIMENSIONS, "weight", prob.alias("prob")), "mix-rates")


def mix(docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, keep: float = KEEP, topics: Mapping[str, tuple[str, ...]] = TOPICS) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, weight, prob, kept.

    weight is the fitted share of the row's cell over its observed share, prob the calibrated sampling probability, kept
    the draw. Documents without words carry no weight to be mixed; they get prob 1 and are kept. A cell whose source,
    language or topic has no target has prob 0. The draw depends on doc_id alone, so repeated ids are drawn alike, and null
    ids as the empty id. Texts of any length count whole. An empty table gives no rows. Other columns are not read.
    """
    rows = written(marks(docs, topics), "mix-marks")
    out = rows.join(rates(rows, targets, keep=keep), list(DIMENSIONS), "left")
    out = out.withColumn("prob", F.when(F.col("n_tokens") == 0, F.lit(1.0)).otherwise(F.coalesce("prob", F.lit(0.0))))
    return out.select(
        "doc_id", *DIMENSIONS, "n_tokens", F.round(F.when(F.col("n_tokens") > 0, F.coalesce("weight", F.lit(0.0))), 6).alias("weight"),
        F.round("prob", 6).alias("prob"), (F.col("u") < F.col("prob")).alias("kept"),
    )


def mixed(docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, keep: float = KEEP, tokens: int | None = None, topics: Mapping[str, tuple[str, ...]] = TOPICS) -> DataFrame:
    """The documents that the draw of :func:`mix` keeps, with all their columns. Nulls, repeated rows, empty tables: as there.

    Documents are written once beside their marks, so a text is read for them once only, and never shuffled. With tokens,
    a sample of about so many: a document comes as often as the whole part of its rate says, and once more if its draw is
    below the rest. Documents without words come once.
    """

    def draw(d: DataFrame, own: list[str]) -> DataFrame:
        rows = written(d.withColumns(_row_marks(topics)), "marked-docs")
        small = rows.select(*[F.col(f"_{x}").alias(x) for x in (*DIMENSIONS, "n_tokens")])
        cells = rates(small, targets, keep=keep, tokens=tokens).select(*[F.col(x).alias(f"_{x}") for x in DIMENSIONS], F.col("prob").alias("_prob"))
        out = rows.join(cells, [f"_{x}" for x in DIMENSIONS], "left")
        rate = F.when(F.col("_n_tokens") == 0, F.lit(1.0)).otherwise(F.coalesce("_prob", F.lit(0.0)))
        if tokens is None:
            return out.where(F.col("_u") < rate).select(*own)
        copies = (F.floor(rate) + (F.col("_u") < rate - F.floor(rate)).cast("int")).cast("int")
        return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*own)

    return keeping(docs, ("doc_id", "text", "source", "lang"), draw)
