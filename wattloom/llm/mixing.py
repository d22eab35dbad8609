"""Mixing sources to target weights by Pareto order sampling.

A document's multiplicity m = target / size of its source splits into whole copies, which are certain, and
an inclusion probability p, the rest. Documents of a source are ranked by their random odds u / (1 - u)
divided by their inclusion odds p / (1 - p), and in the order of rank each is selected that still fits into
the words that are left of the target. u is a hash of the id and text, so reruns agree.

The cut in the order is found without sorting a source: sums of words over narrow intervals of the
rank show in which interval the target is met; that is divided again, and only the few thousand
documents of its part are ordered in one group, where each is selected that still fits. Of the documents
that come later, those that may still fit go through the same again, until there are none.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.stats import ranked
from ._tasks import settled

CAP = 3
WEIGHTS = (1.0, 2.0, 3.0)
#: Intervals of the rank at the first level, at most; documents that one group may order, about.
FIRST, GROUP = 4096, 2000
_WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters outside space and \\t\\n\\v\\f\\r; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources by code point, null last, take the weights in turn and share the sum of all sizes; no target
    exceeds ``cap`` times its source's size, what is over is shared again by weight among the others.
    Only three sums at a time reach the driver, however many sources there are.
    """
    turn = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("turn") - 1) % len(weights) + 1).cast("int"))
    numbered = ranked(sizes, [F.col("source").asc_nulls_last()], "turn").withColumn("weight", turn).drop("turn")
    s = settled(numbered.withColumn("most", F.col("source_size") * float(cap)))
    level = float("inf")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    while True:
        over = F.col("most") <= F.col("weight") * level
        if level == float("inf"):
            over = F.lit(False)
        row = s.agg(F.sum(F.when(over, F.col("most"))).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        if not row["w"]:
            break
        new = (total - (row["full"] or 0.0)) / row["w"]
        if new == level:
            break
        level = new
        if level <= 0:
            break
    target = F.least("most", F.col("weight") * level) if level != float("inf") else F.col("most")
    return s.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, cap: int = CAP, seed: int = 0, chance_col: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, source, size, source_size, target, taken, copies), taken = size * copies.

    ``chance_col``: numbers above 0 that make some documents likelier than others of their source
    (null: 1); without it all are equally likely, with inclusion probabilities that differ by source. A
    null text has size 0; rows of size 0 take part with their copies and, up to the cut, their chance. A null source is a source,
    the last. Repeated rows are drawn alike (they share u and are told apart by their order only). Null
    ids are ids. An empty table gives no rows.
    """
    chance = F.coalesce(docs[chance_col].cast("double"), F.lit(1.0)) if chance_col else F.lit(1.0)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), F.xxhash64(docs[id_col], docs[text_col], F.lit(seed)).alias("h"), chance.alias("chance"))
    rows = settled(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("chance")).alias("weighed"))
    goal = targets(sizes.select("source", "source_size"), weights, cap)
    per = goal.withColumn("m", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    per = per.withColumn("whole", F.least(F.floor("m"), F.lit(cap)).cast("int"))
    per = per.withColumn("part", F.col("m") - F.col("whole")).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    weighed = sizes.select(F.col("source").alias("src"), "weighed")
    per = settled(per.join(weighed, per.source.eqNullSafe(weighed.src)).drop("src"))
    x = _beside(rows, per)
    u = (F.shiftrightunsigned("h", 11).cast("double") + 0.5) / float(1 << 53)
    p = F.least(F.col("part") * F.col("chance") * F.when(F.col("weighed") > 0, F.col("source_size") / F.col("weighed")).otherwise(1.0), F.lit(1 - 1e-9))
    rank = F.when(p <= 0, F.lit(float("inf"))).otherwise((u / (1 - u)) / (p / (1 - p)))
    x = x.withColumn("rank", rank).withColumn("place", F.col("rank") / (1 + F.col("rank"))).withColumn("row", F.monotonically_increasing_id())
    keep = ["row", "doc_id", "source", "size", "source_size", "target", "whole", "rank", "h"]
    x = settled(x.select(*keep, "place", "left"))
    drawn = F.col("rank") < float("inf")
    parts = [x.where(~drawn).select(*keep, "left", F.lit(False).alias("chosen"))]
    pending = x.where(drawn)
    while True:
        y, near = _round(pending, keep)
        parts += [y.where("sure").select(*keep, "first_left", F.lit(True)), near.select(*keep, "first_left", "chosen")]
        rests = settled(near.groupBy("source").agg(F.first("rest").alias("rest")))
        later = settled(_beside(y.where("not sure and not at").drop("left"), rests).withColumn("fits", (F.col("size") > 0) & (F.col("size") <= F.col("rest"))))
        parts.append(later.where("not fits").select(*keep, "first_left", F.lit(False)))
        pending = later.where("fits").select(*keep, "place", F.col("rest").alias("left"), "first_left")
        if pending.isEmpty():
            break
    x = reduce(DataFrame.union, parts)
    # at last, for each source, the one document that brings the sum nearer, if any: the smallest of those that don't fit
    out = F.when(~F.col("chosen") & drawn & (F.col("size") > 0), F.struct("size", "rank", "h", "doc_id", "row"))
    rest = F.first("left") - F.coalesce(F.sum(F.when(F.col("chosen") & drawn, F.col("size"))), F.lit(0))
    nearer = x.groupBy("source").agg(rest.alias("rest"), F.min(out).alias("least")).where("least.size - rest < rest")
    x = _beside(x, settled(nearer.select("source", F.col("least.row").alias("extra"))), "left")
    copies = F.col("whole") + (F.col("chosen") | F.coalesce(F.col("row") == F.col("extra"), F.lit(False))).cast("int")
    return x.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def _beside(x: DataFrame, per: DataFrame, how: str = "inner") -> DataFrame:
    """``x`` with the columns of its source's row in ``per``, a settled table."""
    per = per.withColumnRenamed("source", "src")
    return x.join(F.broadcast(per) if per.count() <= 10_000 else per, x.source.eqNullSafe(per.src), how).drop("src")


def _round(pending: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """``pending`` with what lies before its source's cut (sure) and in the group at the cut (at), and that group filled; both settled.

    Where all of a source's documents fit there is no cut, and all are sure.
    """
    if "first_left" not in pending.columns:
        pending = pending.withColumn("first_left", F.col("left"))
    many = settled(pending.groupBy("source").agg(F.greatest(F.lit(1), F.least(F.lit(FIRST), F.ceil(F.count("*") / GROUP))).alias("first")))
    x = _beside(pending, many)
    x = x.withColumn("i", F.least(F.floor(F.col("place") * F.col("first")), F.col("first") - 1).cast("long"))
    y = _named(x, _cut(x, ["source"], "i", F.col("left")), "i", "i0", "left0", "docs0")
    inner = F.greatest(F.ceil(F.col("docs0") / GROUP), F.lit(1))
    y = y.withColumn("j", F.least(F.floor((F.col("place") * F.col("first") - F.col("i")) * inner), inner - 1).cast("long"))
    y = _named(y, _cut(y.where("i = i0"), ["source"], "j", F.col("left0")), "j", "j0", "left1", "docs1")
    sure = (F.col("i") < F.col("i0")) | ((F.col("i") == F.col("i0")) & (F.col("j") < F.col("j0"))) | F.col("i0").isNull()
    at = (F.col("i") == F.col("i0")) & (F.col("j") == F.col("j0"))
    y = settled(y.select(*keep, "place", "left", "first_left", "left1", sure.alias("sure"), F.coalesce(at, F.lit(False)).alias("at")))
    group = y.where("at").select(*keep, "first_left", "left1")
    types = {f.name: f.dataType.simpleString() for f in group.schema.fields}
    near = group.groupBy("source").applyInPandas(_fill, ", ".join(f"{c} {types[c]}" for c in [*keep, "first_left"]) + ", chosen boolean, rest double")
    return y, settled(near)


def _cut(x: DataFrame, by: list[str], interval: str, left: Column) -> DataFrame:
    """For each source the first interval whose words reach what is left, with what is left for it and its documents; none where all fits."""
    sums = x.groupBy(*by, interval).agg(F.sum("size").alias("words"), F.count("*").alias("docs"), F.first(left).alias("left"))
    run = F.coalesce(F.sum("words").over(W.partitionBy(*by).orderBy(interval).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    met = sums.withColumn("before", run).where("before + words > left")
    return met.groupBy(*by).agg(F.min(F.struct(interval, (F.col("left") - F.col("before")).alias("rest"), "docs")).alias("c"))


def _named(x: DataFrame, cuts: DataFrame, interval: str, at: str, left: str, docs: str) -> DataFrame:
    c = settled(cuts.select(F.col("source").alias("src"), F.col(f"c.{interval}").alias(at), F.col("c.rest").alias(left), F.col("c.docs").alias(docs)))
    return x.join(F.broadcast(c) if c.count() <= 10_000 else c, x.source.eqNullSafe(c.src), "left").drop("src")


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """In the order of rank, whatever still fits, and what is then left (rest)."""
    pdf = pdf.sort_values(["rank", "h", "doc_id"], kind="stable")
    left, size = float(pdf["left1"].iloc[0]), pdf["size"].to_numpy()
    chosen = np.zeros(len(size), bool)
    for i, n in enumerate(size):
        if n <= left:
            chosen[i] = True
            left -= n
    return pdf.drop(columns="left1").assign(chosen=chosen, rest=left)
