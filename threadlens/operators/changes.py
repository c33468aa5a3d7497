"""Context-effect analysis (C1-C7, U1, F17): which items a context makes better or worse.

Works on the seed-averaged predictions of every model and context at once (A6), pivoted to one row
per (model, item); no re-reading per model or class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.config import BETTER_TN, BETTER_TP, NO_CONTEXT, WORSE_FN, WORSE_FP
from threadlens.operators.seeds import run_identity
from threadlens.functions.common import safe_div

KINDS = [(0, WORSE_FP), (0, BETTER_TN), (1, WORSE_FN), (1, BETTER_TP)]


def _change(gold: Column, p0: Column, pc: Column, t: float) -> Column:
    lo, hi = F.lit(t), F.lit(1 - t)
    return (F.when((gold == 1) & (p0 >= hi) & (pc <= lo), F.lit(WORSE_FN))
            .when((gold == 1) & (p0 <= lo) & (pc >= hi), F.lit(BETTER_TP))
            .when((gold == 0) & (p0 <= lo) & (pc >= hi), F.lit(WORSE_FP))
            .when((gold == 0) & (p0 >= hi) & (pc <= lo), F.lit(BETTER_TN))
            .otherwise(F.lit("")))


def context_changes(avg: DataFrame, keys: Sequence[str], contexts: Sequence[str], thres: float = 0.3,
                    target: str = "stereo", model_col: str = "model", context_col: str = "context",
                    baseline: str = NO_CONTEXT) -> DataFrame:
    """hit/miss without context vs with each context; keep items changed in any context.

    ``avg`` is A6 output (one row per item x model x context); the pivot uses the explicit context
    list, so Spark plans a single aggregation without a distinct-values job.
    """
    pred = target + "_pred"
    run = run_identity(avg, [model_col])
    wide = avg.groupBy(*run, *keys).pivot(context_col, [baseline, *contexts]).agg(F.first(pred))
    gold = avg.filter(F.col(context_col) == baseline).select(*run, *keys, target)
    j = wide.join(gold, [*run, *keys], "inner")
    labels = [_change(F.col(target), F.col(baseline), F.col(c), thres).alias(c) for c in contexts]
    out = j.select(*run, *keys, target, *labels)
    return out.filter(F.greatest(*[F.col(c) != "" for c in contexts]) if len(contexts) > 1 else F.col(contexts[0]) != "")


def context_changes_from_runs(preds: DataFrame, keys: Sequence[str], contexts: Sequence[str], thres: float = 0.3,
                              target: str = "stereo", model_col: str = "model", context_col: str = "context",
                              baseline: str = NO_CONTEXT) -> DataFrame:
    """C1 fused with A6: ONE aggregation per (model, item) straight from the run rows.

    Each context's seed-mean prediction is a conditional ``avg``, and the gold label is the
    no-context run's label of the highest seed; Spark aggregates partially before the only shuffle.
    """
    ctx, pred = F.col(context_col), F.col(target + "_pred").cast("double")
    base = ctx == baseline
    aggs = [F.max_by(F.when(base, F.col(target)), F.when(base, F.col("seed"))).alias(target),
            F.avg(F.when(base, pred)).alias("_p0"), F.count_if(base).alias("_n0")]
    aggs += [F.avg(F.when(ctx == c, pred)).alias("_p_" + c) for c in contexts]
    run = run_identity(preds, [model_col])
    g = preds.groupBy(*run, *keys).agg(*aggs).filter(F.col("_n0") > 0)
    labels = [_change(F.col(target), F.col("_p0"), F.col("_p_" + c), thres).alias(c) for c in contexts]
    out = g.select(*run, *keys, target, *labels)
    return out.filter(F.greatest(*[F.col(c) != "" for c in contexts]) if len(contexts) > 1 else F.col(contexts[0]) != "")


def no_context_counts(avg: DataFrame, thres: float = 0.3, target: str = "stereo", model_col: str = "model",
                      context_col: str = "context", baseline: str = NO_CONTEXT, legacy_bases: bool = False) -> DataFrame:
    """Per model, hit/miss counts of the no-context run with their share of the class.

    Default names follow the confusion cells (FP = missed negatives, FN = missed positives). With
    ``legacy_bases=True`` the published (swapped) naming and bases are reproduced.
    """
    g, p = F.col(target), F.col(target + "_pred")
    lo, hi = thres, 1 - thres
    base = avg.filter(F.col(context_col) == baseline)
    agg = base.groupBy(model_col).agg(
        F.count_if((g == 1) & (p >= hi)).alias("TP"),
        F.count_if((g == 1) & (p <= lo)).alias("missed_pos"),
        F.count_if((g == 0) & (p >= hi)).alias("missed_neg"),
        F.count_if((g == 0) & (p <= lo)).alias("TN"),
        F.count_if(g == 0).alias("n_neg"),
        F.count_if(g == 1).alias("n_pos"),
    )
    if legacy_bases:
        fp, fn = F.col("missed_pos"), F.col("missed_neg")
    else:
        fp, fn = F.col("missed_neg"), F.col("missed_pos")
    neg, pos = F.col("n_neg"), F.col("n_pos")
    return agg.select(
        model_col, fp.alias("FP"), F.col("TN"), fn.alias("FN"), F.col("TP"),
        (safe_div(fp, neg, None) * 100).alias("FP_pct"), (safe_div(F.col("TN"), neg, None) * 100).alias("TN_pct"),
        (safe_div(fn, pos, None) * 100).alias("FN_pct"), (safe_div(F.col("TP"), pos, None) * 100).alias("TP_pct"),
    )


def change_summary(changes: DataFrame, contexts: Sequence[str], target: str = "stereo",
                   model_col: str = "model") -> DataFrame:
    """C4: rows model x class x (empeora, mejora), one count per context; missing kinds -> 0 rows.

    The skeleton of (model, class, kind) rows comes from the models present, expanded by a fixed
    4-entry literal with ``explode`` (no cross join); counts come from one unpivot + pivot.
    """
    long = changes.unpivot([model_col, target], list(contexts), "context", "index").filter(F.col("index") != "")
    counts = long.groupBy(model_col, target, "index").pivot("context", list(contexts)).count()
    kinds = F.array(*[F.struct(F.lit(c).alias(target), F.lit(k).alias("index")) for c, k in KINDS])
    skeleton = changes.select(model_col).distinct().select(model_col, F.explode(kinds).alias("k")).select(
        model_col, "k.*")
    out = skeleton.join(counts, [model_col, target, "index"], "left").fillna(0, subset=list(contexts))
    arrows = F.when(F.col("index").contains("mejora"), F.lit("↑")).otherwise(F.lit("↓"))
    return out.select(model_col, target, "index", *[F.col(c).cast("long").alias(c) for c in contexts],
                      arrows.alias("arrows"))


def pct_change_label(n: Column, base: Column, arrow: Column) -> Column:
    """``"(" + round(100 n / base) + "% " + arrow + ")"`` when n > 0, else ``""`` (half-even)."""
    pct = F.bround(safe_div(n, base, None) * 100, 0).cast("long").cast("string")
    return F.when(n > 0, F.concat(F.lit("("), pct, F.lit("% "), arrow, F.lit(")"))).otherwise(F.lit(""))


def add_change_pct(summary: DataFrame, counts: DataFrame, contexts: Sequence[str], model_col: str = "model") -> DataFrame:
    """F17 labels for each context against the no-context bucket of (model, cell); ``total`` = bucket."""
    cell = F.expr("substring(`index`, -3, 2)")
    bases = counts.select(model_col, F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in ("FP", "TN", "FN", "TP")]),
        F.array(*[F.col(c) for c in ("FP", "TN", "FN", "TP")]))).alias("cell", "total"))
    j = summary.withColumn("cell", cell).join(bases, [model_col, "cell"], "left")
    pcts = [pct_change_label(F.col(c), F.col("total"), F.col("arrows")).alias(c[0] + " %") for c in contexts]
    return j.select(*summary.columns, *pcts, "total")


def change_attribute_sums(changes_long: DataFrame, cols: Sequence[str], model_col: str = "model") -> DataFrame:
    """Sums of attribute columns over changed rows, by model, context and change kind."""
    return changes_long.filter(F.col("index") != "").groupBy(model_col, "context", "index").agg(
        *[F.sum(F.col(c)).cast("long").alias(c) for c in cols])


def changes_long(changes: DataFrame, contexts: Sequence[str], id_cols: Sequence[str]) -> DataFrame:
    """C1 output unpivoted to (ids..., context, index) rows."""
    return changes.unpivot(list(id_cols), list(contexts), "context", "index")


def common_changed_items(changes_long_df: DataFrame, keys: Sequence[str], m1: str, m2: str,
                         target: str = "stereo", model_col: str = "model") -> DataFrame:
    """Per context and class, items changed by both models (set intersection)."""
    cols = ["context", target, *keys]
    changed = changes_long_df.filter(F.col("index") != "")
    a = changed.filter(F.col(model_col) == m1).select(*cols)
    b = changed.filter(F.col(model_col) == m2).select(*cols)
    return a.intersect(b)


def seed_convergence(preds: DataFrame, ns: Sequence[int], keys: Sequence[str], contexts: Sequence[str],
                     thres: float = 0.3, target: str = "stereo") -> DataFrame:
    """C4 for several seed budgets n at once: each run row joins every budget with seed < 42 + n."""
    from threadlens.operators.seeds import seed_average_hard

    budgets = F.filter(F.array(*[F.lit(n) for n in ns]), lambda n: F.col("seed") < n + 42)
    expanded = preds.withColumn("n_seeds", F.explode(budgets))
    avg = seed_average_hard(expanded, keys, run=("n_seeds", "model", "context"), target=target)
    pred = target + "_pred"
    wide = avg.groupBy("n_seeds", "model", *keys).pivot("context", [NO_CONTEXT, *contexts]).agg(F.first(pred))
    gold = avg.filter(F.col("context") == NO_CONTEXT).select("n_seeds", "model", *keys, target)
    j = wide.join(gold, ["n_seeds", "model", *keys], "inner")
    labels = [_change(F.col(target), F.col(NO_CONTEXT), F.col(c), thres).alias(c) for c in contexts]
    long = j.select("n_seeds", "model", target, *labels).unpivot(
        ["n_seeds", "model", target], list(contexts), "context", "index").filter(F.col("index") != "")
    return long.groupBy("n_seeds", "model", target, "index").pivot("context", list(contexts)).count().fillna(0)


def context_analysis(changes: DataFrame, attributes: DataFrame, keys: Sequence[str], mark=None) -> DataFrame:
    """C1 rows of every model and class joined with the item attributes (1:1 by key), then P12 marks."""
    extra = [c for c in attributes.columns if c not in changes.columns or c in keys]
    out = changes.join(attributes.select(*extra), list(keys), "left")
    return mark(out) if mark is not None else out
