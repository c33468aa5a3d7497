"""Bootstrap confidence intervals (E9) without multiplying item rows.

F1 and subgroup accuracy depend only on the counts of (gold, pred, implicit) cells, so a bootstrap
replicate is a multinomial draw of N items over <= 8 cells. Rows are reduced to cell counts per run
(one aggregation); each run's single row of cell counts becomes ``n`` replicates in one vectorised
``multinomial(size=n)`` call (``applyInPandas`` per run, seeded by a hash of the run key, so results do
not depend on partitioning). Means and percentile intervals are one more aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.common import md5_uniform, safe_div
from threadlens.operators.metrics import _ce_terms

CELL_NAMES = [f"c{g}{p}{i}" for g in (0, 1) for p in (0, 1) for i in (0, 1)]  # gold, pred, implicit


def _draw_for(n: int, frac: float = 1.0):
    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        """One run (one row of cell counts) -> ``n`` multinomial replicates, seeded by the run key."""
        row = pdf.iloc[0]
        counts = row[CELL_NAMES].to_numpy(dtype=np.int64)
        total = int(counts.sum())
        size = round(frac * total)
        rng = np.random.default_rng(int(row["_seed"]) & 0x7FFFFFFFFFFFFFFF)
        draws = rng.multinomial(size, counts / total, size=n) if total > 0 else np.zeros((n, len(CELL_NAMES)), np.int64)
        out = pd.DataFrame(draws, columns=CELL_NAMES)
        for c in pdf.columns:
            if c not in CELL_NAMES and c != "_seed":
                out.insert(0, c, row[c])
        out["replicate"] = np.arange(1, n + 1, dtype=np.int32)
        return out

    return draw


def bootstrap_ci(df: DataFrame, by: Sequence[str], target: str = "stereo", pred: str | None = None,
                 n: int = 1000, seed: int = 42, frac: float = 1.0) -> DataFrame:
    """Mean and 2.5 / 97.5 percentiles over ``n`` replicates of f1_neg, f1_pos and the
    explicit / implicit accuracy (gold = 1), rounded to 3 decimals like the reference. A replicate draws ``frac`` times
    the items of its run, with replacement; soft metrics are in ``bootstrap_poisson``."""
    pred = pred or target + "_pred"
    by = list(by)
    t, p, imp = F.col(target), F.col(pred), (F.col("implicit") >= 0.5).cast("int")
    cells = df.groupBy(*by).agg(*[
        F.count_if((t == int(c[1])) & (p == int(c[2])) & (imp == int(c[3]))).alias(c) for c in CELL_NAMES])
    keyed = cells.withColumn("_seed", F.xxhash64(*[F.col(c) for c in by], F.lit(seed)))
    schema = ", ".join([f"`{c}` {t}" for c, t in cells.select(*by).dtypes] + [f"{c} bigint" for c in CELL_NAMES]
                       + ["replicate int"])
    # each group is one run's single cell-count row; its output is n rows (n is a parameter, not data)
    drawn = keyed.groupBy(*by).applyInPandas(_draw_for(n, frac), schema)

    def s(*names: str):
        return sum((F.col(x) for x in names[1:]), F.col(names[0])).cast("double")

    tn, fp = s("c000", "c001"), s("c010", "c011")
    fn, tp = s("c100", "c101"), s("c110", "c111")
    exp_n, exp_ok = s("c100", "c110"), s("c110")
    imp_n, imp_ok = s("c101", "c111"), s("c111")

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    metrics = drawn.select(*by, "replicate",
                           ratio(2 * tn, 2 * tn + fp + fn).alias("f1_neg"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1_pos"),
                           ratio(exp_ok, exp_n).alias("accuracy_explicit"), ratio(imp_ok, imp_n).alias("accuracy_implicit"))
    aggs = []
    for m in ("f1_neg", "f1_pos", "accuracy_explicit", "accuracy_implicit"):
        aggs += [F.round(F.avg(m), 3).alias(m), F.round(F.percentile(m, 0.025), 3).alias(m + "_min"),
                 F.round(F.percentile(m, 0.975), 3).alias(m + "_max")]
    return metrics.groupBy(*by).agg(*aggs)


def poisson_weight(u: Column, longest: int = 12, rate: float = 1.0) -> Column:
    """Poisson(``rate``) by inversion: how many steps of its distribution function lie at or below ``u``."""
    total, term, steps = 0.0, math.exp(-rate), []
    for k in range(longest):
        total += term
        term *= rate / (k + 1)
        steps.append((u >= total).cast("int"))
    return sum(steps[1:], steps[0])


def bootstrap_poisson(df: DataFrame, by: Sequence[str], key: Sequence[str], target: str = "stereo", pred: str | None = None,
                      n: int = 20, seed: int = 42, frac: float = 1.0, soft: bool = False) -> DataFrame:
    """E9 in the reproducible form: every item gets a Poisson(``frac``) weight per replicate from an md5 of its key.

    The weight depends on (key, run, replicate, seed) only, so any engine can recompute it; ``frac`` below 1 draws that share of the
    items. An item stays one row: its ``n`` weights are one vector, and vectors are added element by element for each (run,
    confusion cell), with partial sums per task. Returns the mean and the 2.5 / 97.5 percentiles of f1_neg and f1_pos; with
    ``soft`` also of the cross-entropy and the RMSE (named MSE) of the soft labels, overall and by cell, from the same draws.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    pred = pred or target + "_pred"
    by = list(by)
    t, p = F.col(target), F.col(pred)
    cell = F.when((t == 0) & (p == 0), "TN").when((t == 0) & (p == 1), "FP").when((t == 1) & (p == 0), "FN").when((t == 1) & (p == 1), "TP")
    uniform = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda r: md5_uniform(*key, *by, r, F.lit(seed)))
    weights = F.transform(uniform, lambda u: poisson_weight(u, rate=frac).cast("double"))
    terms = {"w": F.col("_w")}
    x = df.select(*by, cell.alias("_cell"), weights.alias("_w"), *(soft_terms(target, pred) if soft else []))
    if soft:
        terms |= {"_ce": F.transform("_w", lambda w: w * F.col("_ce")), "_se": F.transform("_w", lambda w: w * F.col("_se"))}
    vector = array_to_vector(F.concat(*terms.values()) if soft else F.col("_w"))
    sums = x.where("_cell IS NOT NULL").groupBy(*by, "_cell").agg(Summarizer.sum(vector).alias("_s"))  # four rows a run
    part = {c: F.slice(vector_to_array("_s"), i * n + 1, n).alias(c) for i, c in enumerate(terms)}
    per = sums.select(*by, "_cell", *part.values()).select(*by, "_cell", F.posexplode(F.arrays_zip(*part)).alias("replicate", "z"))
    cells = {c: F.coalesce(F.max(F.when(F.col("_cell") == c, F.round("z.w"))), F.lit(0.0)).alias(c) for c in ("TN", "FP", "FN", "TP")}
    more = [F.coalesce(F.max(F.when(F.col("_cell") == c, F.col(f"z.{v}"))), F.lit(0.0)).alias(c + v) for c in cells for v in list(terms)[1:]]
    drawn = per.groupBy(*by, "replicate").agg(*cells.values(), *more)
    wrong = F.col("FP") + F.col("FN")
    metrics = {"f1_neg": safe_div(2 * F.col("TN"), 2 * F.col("TN") + wrong), "f1_pos": safe_div(2 * F.col("TP"), 2 * F.col("TP") + wrong)}
    if soft:
        for prefix, names in (("", list(cells)), *((c + "_", [c]) for c in cells)):
            total = [sum((F.col(c + v) for c in names[1:]), F.col(names[0] + v)) for v in ("", "_ce", "_se")]
            metrics[prefix + "cross_entropy"] = safe_div(-total[1], total[0])
            metrics[prefix + "MSE"] = F.sqrt(safe_div(total[2], total[0]))
    scored = drawn.select(*by, *[v.alias(m) for m, v in metrics.items()])
    aggs = [a for m in metrics for a in (F.avg(m).alias(m), F.percentile(m, 0.025).alias(m + "_min"), F.percentile(m, 0.975).alias(m + "_max"))]
    return scored.groupBy(*by).agg(*aggs)


def soft_terms(target: str, pred: str) -> list[Column]:
    """An item's part of the cross-entropy and of the squared error of its soft label."""
    gold, guess = F.col(target + "_soft"), F.col(pred + "_soft")
    return [F.coalesce(_ce_terms(gold, guess), F.lit(0.0)).alias("_ce"), F.coalesce(F.pow(gold - guess, 2), F.lit(0.0)).alias("_se")]
