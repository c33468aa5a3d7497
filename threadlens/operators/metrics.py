"""Task-1 evaluation metrics (E1-E8, E14, X1) as grouped aggregates.

All runs are scored in ONE ``groupBy(run columns)``: every metric is a conditional aggregate, so
Spark does a map-side partial aggregation and shuffles only a few numbers per run and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.common import safe_div, zero_if_null

CELLS = ("TN", "FP", "FN", "TP")


def _cell(target: Column, pred: Column, name: str) -> Column:
    gold, guess = {"TN": (0, 0), "FP": (0, 1), "FN": (1, 0), "TP": (1, 1)}[name]
    return (target == gold) & (pred == guess)


def metrics_by(df: DataFrame, by: Sequence[str], metric_exprs: Sequence[Column]) -> DataFrame:
    """User metrics as Spark aggregate Columns, evaluated for every group at once."""
    return df.groupBy(*by).agg(*metric_exprs)


def confusion(df: DataFrame, by: Sequence[str], target: str = "stereo", pred: str | None = None) -> DataFrame:
    """TN, FP, FN, TP per group."""
    t, p = F.col(target), F.col(pred or target + "_pred")
    return df.groupBy(*by).agg(*[F.count_if(_cell(t, p, c)).alias(c) for c in CELLS])


def metrics_from_confusion(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """E2 on a confusion table: per-class precision/recall/F1, accuracy, MCC, hard-prediction AUC."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in CELLS)
    n = tn + fp + fn + tp
    recall_pos, recall_neg = safe_div(tp, tp + fn), safe_div(tn, tn + fp)
    mcc_den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    metrics = [
        safe_div(2 * tn, 2 * tn + fp + fn).alias("f1_neg"),
        safe_div(2 * tp, 2 * tp + fp + fn).alias("f1_pos"),
        ((recall_pos + recall_neg) / 2).alias("roc_auc"),
        safe_div(tp * tn - fp * fn, mcc_den).alias("mcc"),
        safe_div(tn, tn + fn).alias("precision_neg"),
        safe_div(tp, tp + fp).alias("precision_pos"),
        recall_neg.alias("recall_neg"),
        recall_pos.alias("recall_pos"),
        safe_div(tp + tn, n).alias("accuracy"),
    ]
    return df.select(*keep, *metrics)


def metrics1(df: DataFrame, by: Sequence[str], target: str = "stereo", pred: str | None = None) -> DataFrame:
    """Confusion-derived metrics for every group in one aggregation."""
    return metrics_from_confusion(confusion(df, by, target, pred), keep=[*by, *CELLS])


def _accuracy_by_exprs(target: Column, pred: Column, column: str, suffixes: tuple[str, str]) -> list[Column]:
    """Accuracy over gold=1 rows split at ``column < 0.5`` / ``>= 0.5``; empty subset -> 0."""
    c = F.col(column)
    out = []
    for cond, suffix in ((c < 0.5, suffixes[0]), (c >= 0.5, suffixes[1])):
        rows = (target == 1) & cond
        out.append(zero_if_null(F.avg(F.when(rows, (pred == target).cast("double")))).alias("accuracy" + suffix))
    return out


def _confidence_exprs(target: Column, pred: Column, conf: str, soft: str | None, iaa: bool) -> list[Column]:
    """E5: mean and sd (n-1) of a confidence column, overall and per confusion cell; empty -> 0."""
    c = F.col(conf)
    out = [zero_if_null(F.avg(c)).alias(conf), zero_if_null(F.stddev_samp(c)).alias(conf + "_std")]
    agree = None
    if iaa and soft:
        agree = F.when((F.col(soft) > 0.2) & (F.col(soft) < 0.8), F.lit(0.67)).otherwise(F.lit(1.0))
    for name in CELLS:
        cell = _cell(target, pred, name)
        v = F.when(cell, c)
        out += [zero_if_null(F.avg(v)).alias(f"{name}_{conf}"), zero_if_null(F.stddev_samp(v)).alias(f"{name}_{conf}_std")]
        if agree is not None:
            for tag, cond in (("agree", agree == 1), ("disagree", agree < 1)):
                w = F.when(cell & cond, c)
                out += [zero_if_null(F.avg(w)).alias(f"{name}_{conf}_{tag}_mean"),
                        zero_if_null(F.stddev_samp(w)).alias(f"{name}_{conf}_{tag}_std")]
    return out


def _ce_terms(p: Column, q: Column) -> Column:
    clipped = F.least(F.greatest(q, F.lit(1e-12)), F.lit(1.0 - 1e-12))
    return p * F.log(clipped + F.lit(1e-9))


def _soft_exprs(target: Column, pred: Column, soft: str, pred_soft: str) -> list[Column]:
    """Cross-entropy (positive term) and RMSE (named MSE), overall and per cell; empty -> 0."""
    p, q = F.col(soft), F.col(pred_soft)
    out = [(-F.sum(_ce_terms(p, q)) / F.count(F.lit(1))).alias("cross_entropy"),
           F.sqrt(F.avg(F.pow(p - q, 2))).alias("MSE")]
    for name in CELLS:
        cell = _cell(target, pred, name)
        out += [zero_if_null(-F.sum(F.when(cell, _ce_terms(p, q))) / F.count_if(cell)).alias(f"{name}_cross_entropy"),
                zero_if_null(F.sqrt(F.avg(F.when(cell, F.pow(p - q, 2))))).alias(f"{name}_MSE")]
    return out


def task1_metrics(
    df: DataFrame,
    by: Sequence[str],
    target: str = "stereo",
    pred: str | None = None,
    confidence: Sequence[str] = ("softmax_confidence",),
    soft: bool = False,
    contextual: bool = False,
    iaa: bool = False,
) -> DataFrame:
    """E2+E3+E5+E6 for every run in one aggregation (the reference's `compute_metrics1`)."""
    pred = pred or target + "_pred"
    t, p = F.col(target), F.col(pred)
    names = set(df.columns)
    aggs = [F.count_if(_cell(t, p, c)).alias(c) for c in CELLS]
    aggs += _accuracy_by_exprs(t, p, "implicit", ("_explicit", "_implicit"))
    if contextual:
        aggs += _accuracy_by_exprs(t, p, "contextual", ("_no_contextual", "_contextual"))
    for conf in confidence:
        if conf in names:
            aggs += _confidence_exprs(t, p, conf, target + "_soft", iaa)
    if soft:
        aggs += _soft_exprs(t, p, target + "_soft", pred + "_soft")
    grouped = df.groupBy(*by).agg(*aggs)
    rest = [c for c in grouped.columns if c not in by and c not in CELLS]
    return metrics_from_confusion(grouped, keep=[*by, *CELLS, *rest])


def symmetric_kl(df: DataFrame, by: Sequence[str], p: str, q: str) -> DataFrame:
    """(KL(p||q) + KL(q||p)) / 2 after normalising p and q to sum 1, in ONE pass.

    With P = sum p, Q = sum q: KL(p/P || q/Q) = sum(p ln(p/q)) / P + ln(Q/P), and the log
    terms cancel in the symmetric sum. Zero-mass terms contribute 0.
    """
    pc, qc = F.col(p), F.col(q)
    inf = F.lit(float("inf"))
    a = F.sum(F.when(pc <= 0, F.lit(0.0)).when(qc <= 0, inf).otherwise(pc * F.ln(pc / qc)))
    b = F.sum(F.when(qc <= 0, F.lit(0.0)).when(pc <= 0, inf).otherwise(qc * F.ln(qc / pc)))
    return df.groupBy(*by).agg(((a / F.sum(pc) + b / F.sum(qc)) / 2).alias("js"))


def confidence_prf(df: DataFrame, by: Sequence[str], target: str = "stereo", confidence: str = "confidence",
                   beta: float = 1.0) -> DataFrame:
    """Probabilistic precision / recall / F-beta from a [-1, 1] confidence score."""
    t, pr = F.col(target), F.col(target + "_pred")
    prob = (F.col(confidence) + 1) / 2
    prob_pos = F.when(pr == 1, prob).otherwise(1 - prob)
    m = {1: prob_pos, 0: 1 - prob_pos}
    aggs = []
    for label in (0, 1):
        aggs += [
            F.sum(F.when((pr == label) & (t == label), m[label]).otherwise(F.lit(0.0))).alias(f"_ctp{label}"),
            F.sum(F.when((pr == label) & (t != label), m[label]).otherwise(F.lit(0.0))).alias(f"_cfp{label}"),
            F.count_if(t == label).alias(f"_n{label}"),
        ]
    g = df.groupBy(*by).agg(*aggs)
    b2 = beta * beta
    out = []
    for label, suffix in ((0, "neg"), (1, "pos")):
        ctp, cfp, n = F.col(f"_ctp{label}"), F.col(f"_cfp{label}"), F.col(f"_n{label}")
        prec, rec = safe_div(ctp, ctp + cfp, None), safe_div(ctp, n, None)
        out += [prec.alias(f"c_precision_{suffix}"), rec.alias(f"c_recall_{suffix}"),
                safe_div((1 + b2) * prec * rec, b2 * prec + rec, None).alias(f"c_f1_{suffix}")]
    return g.select(*by, *out)


def gold_upper_bound(df: DataFrame, by: Sequence[str], target: str = "stereo", contextual: bool = False) -> DataFrame:
    """Task-1 metrics with the gold label as the prediction."""
    return task1_metrics(df.withColumn(target + "_pred", F.col(target)), by, target, confidence=(),
                         contextual=contextual)


def accuracy_by_category(df: DataFrame, by: Sequence[str], categories: Sequence[str], target: str = "stereo",
                         pred: str | None = None) -> DataFrame:
    """For each implicitness category, accuracy over gold = 1 rows without (< 0.5) and with (>= 0.5)
    the category; categories are unpivoted so one aggregation covers all of them (empty -> 0)."""
    pred = pred or target + "_pred"
    long = df.select(*by, target, pred, *[F.col(f"`{c}`").cast("double").alias(c) for c in categories]).unpivot(
        [*by, target, pred], list(categories), "category", "value")
    t, p, v = F.col(target), F.col(pred), F.col("value")
    ok = (p == t).cast("double")
    return long.groupBy(*by, "category").agg(
        zero_if_null(F.avg(F.when((t == 1) & (v < 0.5), ok))).alias("accuracy_without"),
        zero_if_null(F.avg(F.when((t == 1) & (v >= 0.5), ok))).alias("accuracy_with"))
