"""Mixing sources to target weights by capped water-filling.

Every source gets words in proportion to its weight, but at most ``max_epochs`` times what it has; the
excess of clamped sources is dealt again, by weight, until no source is above its cap. A source's
documents are taken whole as often as its target says, and the remaining fraction of an epoch is a
seeded sample of its documents.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.common import WORD, shared_table, ship

DIGIT_BITS, HASH_BITS = 10, 60


def repeating(n: int = 3) -> Callable[[Column], Column]:
    """Weights 1, 2, ..., n, 1, ... by the place of the source (from 0)."""
    return lambda place: (place % n + 1).cast("double")


def with_place(sources: DataFrame) -> DataFrame:
    """Number the sources by code point, null last, from 0.

    The sort is a range exchange; only the number of rows per partition meets in one place.
    """
    ordered = sources.orderBy(F.col("source").asc_nulls_last())
    numbered = shared_table(ordered.withColumn("_id", F.monotonically_increasing_id()), "sources")
    numbered = numbered.withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id") % (1 << 33))
    before = numbered.groupBy("_part").count().withColumn(
        "_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.join(before, "_part").withColumn("place", F.col("_before") + F.col("_row")).drop("_id", "_part", "_row", "_before", "count")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to (source, source_size, weight).

    Each round clamps the sources whose share is above their cap and deals the rest by weight. Only sums
    reach the driver; the share per weight rises with every round that clamps more, so it ends.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    share = 0.0
    while True:
        over = F.col("weight") * F.lit(share) >= cap
        clamped, weight = sources.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not weight:
            break  # all at their caps
        if (level := max(0.0, total - clamped) / weight) <= share:
            break
        share = level
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(share)) if weight else cap)


def nearest(sizes: np.ndarray, target: float) -> np.ndarray:
    """Which of ``sizes`` to take so that their sum comes near ``target``.

    First fit in the given order; then, as long as it brings the sum nearer, the best of: one more, one
    less, or one exchanged.

    >>> nearest(np.array([5, 4, 7]), 11.0).tolist()
    [False, True, True]
    """
    taken, left = np.zeros(len(sizes), bool), target
    for i, size in enumerate(sizes.tolist()):
        if size <= left:
            left -= size
            taken[i] = True
    while True:
        inside, outside = (np.concatenate([[-1], np.nonzero(t)[0]]) for t in (taken, ~taken))
        give, get = (np.where(x < 0, 0, sizes[x]) for x in (inside, outside))  # -1 stands for none
        order = np.argsort(give, kind="stable")
        at = np.searchsorted(give[order], get - left)
        near = np.stack([order[np.clip(at - 1, 0, len(order) - 1)], order[np.clip(at, 0, len(order) - 1)]])
        miss = np.abs(left - (get - give[near]))
        side, k = np.unravel_index(np.argmin(miss), miss.shape)
        if miss[side, k] >= abs(left) - 1e-9:
            return taken
        old, new = inside[near[side, k]], outside[k]
        if old >= 0:
            taken[old] = False
        if new >= 0:
            taken[new] = True
        left = target - float(sizes[taken].sum())


def fill(units: pd.DataFrame) -> pd.DataFrame:
    """The units around the point where a source reaches its target, in hash order: those to take."""
    units = units.sort_values("_hash")
    taken = nearest(units["_size"].to_numpy(np.int64), float(units["_left"].iloc[0]))
    chosen = units["_hash"].to_numpy(np.int64)[taken]
    return pd.DataFrame({"source": pd.Series([units["source"].iloc[0]] * len(chosen), dtype=object), "_hash": chosen})


def mix_plan(docs: DataFrame, weights: Callable[[Column], Column] = repeating(), max_epochs: int = 3, seed: int = 0,
             group_rows: int = 4096) -> DataFrame:
    """``docs`` with the plan's columns: size, source_size, target, copies, taken.

    docs: doc_id, text, source; other columns stay, one that has a plan column's name is replaced.
    The sum of targets is the sum of all sizes (words); a null text has size 0; a null source is a
    source of its own, last in order. ``copies`` is the whole number of times that the mix takes the
    document, ``taken`` is copies * size. An empty table gives an empty result. Rows equal in doc_id and
    text are taken or left together.

    A source misses its target by less than its largest document, usually by a few words (by more only if all
    its documents together are too few to choose from).

    Documents without words cannot change a sum: they have no part in the draw and come ``whole`` times (not at
    all if their source has no words).

    The fraction of an epoch is taken in the order of a seeded hash. Digits of the hash narrow down where
    the target is reached: each level sums sizes by (source, digit) over all documents, at most 1024
    digits, until about ``group_rows`` documents are left around that point. Of those, the ones are chosen
    whose sum comes nearest. So a source of any size never meets in one task, and reruns agree.
    """
    ship(docs.sparkSession)
    plan = ("size", "source_size", "target", "copies", "taken")
    docs = docs.drop(*plan)
    packed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row"))  # no clash of names
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 64 - HASH_BITS)
    sized = packed.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("_hash", hashed)
    slim = shared_table(sized.select("source", "size", "_hash"), "sizes")
    sources = with_place(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = shared_table(sources.withColumn("weight", weights(F.col("place"))), "weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    state = water_fill(sources, float(total), max_epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    # documents with a hash below _low are in, those from _high on are out
    state = shared_table(state.select(
        "source", "source_size", "target", "whole", F.lit(0).cast("long").alias("_low"), F.lit(1 << HASH_BITS).cast("long").alias("_high"),
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("_left")), "targets")
    # only documents with words, of sources that are not done, are drawn from
    drawn = slim.where("size > 0")

    width = HASH_BITS
    while width >= DIGIT_BITS:
        inside = drawn.join(state.where("_left > 0").withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")) &
                           (F.col("_hash") >= F.col("_low")) & (F.col("_hash") < F.col("_high")))
        crowded = inside.groupBy("_source").count().agg(F.max("count")).first()[0] or 0
        if crowded <= group_rows:
            break
        width -= DIGIT_BITS
        digits = inside.groupBy("_source", "_low", F.shiftright(F.col("_hash") - F.col("_low"), width).alias("digit")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("_source").orderBy("digit")
        upto = digits.withColumn("upto", F.sum("words").over(run)).select(
            F.col("_source").alias("_from"), "digit", "words", "upto")
        # the first digit at which the sum passes what is left; none if all of it fits
        crossing = (upto.join(state, F.col("_from").eqNullSafe(F.col("source"))).where(F.col("upto") > F.col("_left"))
                    .groupBy("_from").agg(F.min(F.struct("digit", (F.col("upto") - F.col("words")).alias("before"))).alias("at")))
        state = shared_table(state.join(crossing, F.col("source").eqNullSafe(F.col("_from")), "left").select(
            "source", "source_size", "target", "whole",
            F.when(F.col("_left") <= 0, F.col("_low")).when(F.col("at").isNull(), F.col("_high"))
            .otherwise(F.col("_low") + F.shiftleft(F.col("at.digit"), width)).alias("_low"),
            F.when((F.col("_left") <= 0) | F.col("at").isNull(), F.col("_high")).otherwise(F.col("_low") + F.shiftleft(F.col("at.digit") + 1, width)).alias("_high"),
            (F.col("_left") - F.coalesce(F.col("at.before"), F.lit(0))).alias("_left")), "targets")

    inside = drawn.join(state.where("_left > 0").withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")) &
                       (F.col("_hash") >= F.col("_low")) & (F.col("_hash") < F.col("_high")))
    units = inside.groupBy("source", "_hash").agg(F.sum("size").alias("_size"), F.first("_left").alias("_left"))
    chosen = shared_table(units.groupBy("source").applyInPandas(fill, "source string, _hash long"), "chosen")
    chosen = chosen.select(F.col("source").alias("_cs"), F.col("_hash").alias("_ch"))
    at = state.select(F.col("source").alias("_ss"), "source_size", "target", "whole", "_low")
    part = (F.col("size") > 0) & (F.col("_ch").isNotNull() | (F.col("_hash") < F.col("_low")))
    copies = F.col("whole") + part.cast("long")
    out = (sized.join(at, F.col("source").eqNullSafe(F.col("_ss")))
           .join(chosen, F.col("source").eqNullSafe(F.col("_cs")) & (F.col("_hash") == F.col("_ch")), "left")
           .withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")))
    return out.select("_row.*", *plan)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as often as the plan takes it.

    Columns named like those of the plan keep the caller's values. Nulls, repeated rows, documents without words and empty
    tables as in ``mix_plan``.
    """
    keep = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_whole_row"))
    plan = mix_plan(keep, **options).where("copies > 0")
    return plan.select("_whole_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_whole_row.*")
