"""Problem 8: mixing sources to target shares of the total size, small sources being repeated up to a cap.

Each source gets a number of whole repeats of all its documents, and a part of them once more. That part is drawn by the cube
method: all documents start with the same fractional probability, and the probabilities move through the null space of two
balancing constraints, tokens and documents, until one after another arrives at 0 or 1; the totals stay what they are all
the while. A source is split into blocks by a hash of the ids, which move at the same time and leave at most two documents
undecided each. These move on among themselves, in blocks again while there are too many for one task, and the few that remain in the end land by giving up the constraint on
tokens, then chance.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import BROADCAST_ROWS, cut

#: Documents of a block that moves at once.
BLOCK = 20_000
_EPS = 1e-9


def _move(p: list[float], u: list[float], draw: Callable[[], float]) -> list[float]:
    """From p along u or against it to where a probability arrives at 0 or 1, so that each keeps its expectation."""
    up = min((1 - a) / b if b > 0 else a / -b for a, b in zip(p, u) if abs(b) > 0)
    down = min(a / b if b > 0 else (1 - a) / -b for a, b in zip(p, u) if abs(b) > 0)
    step = up if draw() * (up + down) < down else -down
    out = [a + step * b for a, b in zip(p, u)]
    return [0.0 if a < _EPS else 1.0 if a > 1 - _EPS else a for a in out]


def flight(sizes: list[float], p: list[float], draw: Callable[[], float]) -> list[float]:
    """The flight phase: probabilities after it, at most two of which lie between 0 and 1; keeps sum(p) and sum(p * size)."""
    p = list(p)
    active: list[int] = []
    for k in range(len(p)):
        if not _EPS < p[k] < 1 - _EPS:
            p[k] = float(round(p[k]))
            continue
        active.append(k)
        if len(active) < 3:
            continue
        a, b, c = (sizes[i] for i in active)
        u = [b - c, c - a, a - b]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        for i, v in zip(active, _move([p[i] for i in active], u, draw)):
            p[i] = v
        active = [i for i in active if 0 < p[i] < 1]
    # Two left whose sizes are equal can still move.
    if len(active) == 2 and sizes[active[0]] == sizes[active[1]]:
        for i, v in zip(active, _move([p[i] for i in active], [1.0, -1.0], draw)):
            p[i] = v
    return p


def landing(p: list[float], draw: Callable[[], float]) -> list[float]:
    """The rest decided: pairs keep their number of documents, a last one is left to chance."""
    p = list(p)
    left = [k for k, v in enumerate(p) if 0 < v < 1]
    while len(left) > 1:
        i, j = left[0], left[1]
        p[i], p[j] = _move([p[i], p[j]], [1.0, -1.0], draw)
        left = [k for k in left if 0 < p[k] < 1]
    if left:
        p[left[0]] = float(draw() < p[left[0]])
    return p


def _fly(seed: int, land: bool, level: int = 0):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "id"], kind="stable")
        draw = random.Random(f"{seed}/{land}/{key}" + (f"/{level}" if level else "")).random
        p = flight(pdf["tokens"].tolist(), pdf["p"].tolist(), draw)
        if land:
            p = landing(p, draw)
        return pdf.assign(p=p)

    return run


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """What each source gets: source, target_share, max_repeats, documents, available, wanted (tokens), whole (repeats of all documents) and part.

    ``sizes`` has id, source, tokens; ``targets`` source, target_share, max_repeats. ``total`` is the size of the mix in tokens; by
    default the largest that lets every source that has tokens reach its share. Sources without a target get nothing; a source
    whose cap is too low for ``total`` gives all that it may.
    """
    targets = targets.select("source", "target_share", "max_repeats").filter("source is not null")
    per = sizes.select("source", "tokens").groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available"))
    held = targets.join(per, "source", "left").select("source", "target_share", F.greatest("max_repeats", F.lit(0)).alias("max_repeats"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("available", F.lit(0)).alias("available"))
    if total is None:
        reach = F.when((F.col("target_share") > 0) & (F.col("available") > 0), F.col("available") * F.col("max_repeats") / F.col("target_share"))
        held = held.withColumn("total", F.min(reach).over(Window.partitionBy(F.lit(0))))
    else:
        held = held.withColumn("total", F.lit(float(total)))
    wanted = F.coalesce(F.least(F.col("target_share") * F.col("total"), F.col("available") * F.col("max_repeats").cast("double")), F.lit(0.0))
    ratio = F.when(F.col("available") > 0, F.col("wanted") / F.col("available")).otherwise(0.0)
    held = held.withColumn("wanted", wanted).withColumn("ratio", ratio)
    whole = F.floor(F.col("ratio") + 1e-9)
    return held.withColumn("whole", whole).withColumn("part", F.greatest(F.lit(0.0), F.col("ratio") - whole)).drop("ratio", "total")


def mix(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """How often each document stands in the mix: id, source, tokens, repeats; documents that stand in it not at all are left out.

    See plan() for the arguments; ids must be unique. Null sources, sources without a target and an empty table give nothing;
    documents of no tokens take part in the draw of documents. The same seed gives the same mix whatever the partitions.
    """
    sizes = cut(sizes.select("id", "source", "tokens"))  # texts are tokenised once
    what = plan(sizes, targets, total).filter("documents > 0")
    what = what.select("source", "documents", "whole", "part")
    if targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        what = F.broadcast(what)
    docs = cut(sizes.join(what, "source").withColumn("turn", F.xxhash64(F.lit(seed), "id")))
    asked = docs.filter(F.col("part") > _EPS).withColumn("block", F.pmod(F.col("turn"), F.ceil(F.col("documents") / block))).withColumn("p", F.col("part"))
    schema = "id long, source string, tokens long, turn long, block long, p double"
    flown = cut(asked.select("id", "source", "tokens", "turn", "block", "p").groupBy("source", "block").applyInPandas(_fly(seed, False), schema))
    drawn, rest = flown.filter("p = 1").select("id"), flown.filter("p > 0 and p < 1")
    # Each block leaves two documents or fewer. Where a source has too many blocks for one task, what they leave flies again, in fewer blocks.
    blocks, wide, level = math.ceil((what.agg(F.max("documents")).first()[0] or 0) / block), max(2, block // 2), 0
    while blocks > wide:
        blocks, level = math.ceil(blocks / wide), level + 1
        again = cut(rest.withColumn("block", F.floor(F.col("block") / wide)).groupBy("source", "block").applyInPandas(_fly(seed, False, level), schema))
        drawn, rest = drawn.unionByName(again.filter("p = 1").select("id")), again.filter("p > 0 and p < 1")
    rest = rest.groupBy("source").applyInPandas(_fly(seed, True), schema)
    drawn = drawn.unionByName(rest.filter("p = 1").select("id")).withColumn("once", F.lit(1))
    repeats = (F.col("whole") + F.coalesce("once", F.lit(0))).cast("int")
    return docs.join(drawn, "id", "left").select("id", "source", "tokens", repeats.alias("repeats")).filter("repeats > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """The shares reached: source, target_share, max_repeats, documents, most (repeats of one document), tokens, share."""
    targets = targets.select("source", "target_share", "max_repeats").filter("source is not null")
    per = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.max("repeats").alias("most"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    per = targets.join(per, "source", "left").select("source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "most", "tokens")))
    return per.withColumn("total", F.sum("tokens").over(Window.partitionBy(F.lit(0)))).select("source", "target_share", "max_repeats", "documents", "most", "tokens", F.round(F.try_divide("tokens", "total"), 6).alias("share"))
