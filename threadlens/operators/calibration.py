"""Confidence, losses and calibration (F14-F16, E16-E20) on logit arrays.

Softmax, argmax and log-sum-exp are higher-order array expressions (JVM side). Temperature fitting is
a Newton iteration in beta = 1/T: each step is ONE aggregation returning NLL, gradient and Hessian
per group over the stored logits; the per-group table of betas stays in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.operators.metrics import metrics_from_confusion
from threadlens.session import maybe_broadcast, write_shared


def _softmax(z: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    zt = F.transform(z, lambda x: x / t)
    m = F.array_max(zt)
    e = F.transform(zt, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def softmax_confidence(df: DataFrame, logits: str, temperature: float | str = 1.0, scale: bool = False,
                       pred: str = "pred", confidence: str = "softmax_confidence") -> DataFrame:
    """softmax(z / T); argmax (first on ties); top-1 probability, or top-1 minus top-2 when ``scale``."""
    t = F.col(temperature) if isinstance(temperature, str) else float(temperature)
    out = df.withColumn("_probs", _softmax(F.col(logits), t))
    probs = F.col("_probs")
    top = F.array_max(probs)
    conf = top - F.element_at(F.sort_array(probs, asc=False), 2) if scale else top
    return (out.withColumn(pred, (F.array_position(probs, top) - 1).cast("int"))
            .withColumn(confidence, conf).drop("_probs"))


def threshold_soft(c: Column, threshold: float = 0.5) -> Column:
    """hard prediction from a soft score: ``soft > 0.5``."""
    return (c > threshold).cast("int")


def agreement(c: Column) -> Column:
    """F16: annotator agreement from a soft label: 0.67 when 0.2 < soft < 0.8, else 1."""
    return F.when((c > 0.2) & (c < 0.8), F.lit(0.67)).otherwise(F.lit(1.0))


def item_nll(logits: str, label: str, temperature: Column | float = 1.0) -> Column:
    """Per-item NLL: logsumexp(z / T) - z_y / T (stable form)."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    zt = F.transform(F.col(logits), lambda x: x / t)
    m = F.array_max(zt)
    lse = m + F.log(F.aggregate(zt, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
    return lse - F.element_at(zt, F.col(label) + 1)


def nll(df: DataFrame, by: Sequence[str], logits: str, label: str, temperature: float = 1.0,
        class_weights: dict[int, float] | None = None) -> DataFrame:
    """Mean NLL per group, and the class-weighted mean ``sum(w_y l) / sum(w_y)`` when weights are given."""
    l = item_nll(logits, label, temperature)
    aggs = [F.avg(l).alias("nll")]
    if class_weights:
        w = F.create_map(*[F.lit(x) for kv in class_weights.items() for x in (int(kv[0]), float(kv[1]))])[F.col(label)]
        aggs.append((F.sum(w * l) / F.sum(w)).alias("weighted_nll"))
    return df.groupBy(*by).agg(*aggs)


def focal_loss(df: DataFrame, batch: Sequence[str], logits: str, label: str, gamma: float = 5.0,
               alpha: float = 0.2) -> DataFrame:
    """``alpha * (1 - exp(-CE))^gamma * CE`` on each batch's mean cross-entropy."""
    ce = F.col("ce")
    per = df.groupBy(*batch).agg(F.avg(item_nll(logits, label)).alias("ce"))
    return per.withColumn("focal_loss", F.lit(alpha) * F.pow(1 - F.exp(-ce), gamma) * ce)


def ece(df: DataFrame, by: Sequence[str], logits: str, label: str, bins: int = 15, temperature: float = 1.0) -> DataFrame:
    """Expected calibration error with ``bins`` equal-width bins ``(l, u]`` on top-1 confidence."""
    probs = _softmax(F.col(logits), temperature)
    x = df.select(*by, probs.alias("_p"), F.col(label).alias("_y"))
    x = x.select(*by, F.array_max("_p").alias("_conf"),
                 ((F.array_position("_p", F.array_max("_p")) - 1) == F.col("_y")).cast("double").alias("_acc"))
    x = x.withColumn("_bin", F.ceil(F.col("_conf") * bins))
    per_bin = x.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.avg("_conf").alias("_c"), F.avg("_acc").alias("_a"))
    from pyspark.sql import Window

    n_all = F.sum("_n").over(Window.partitionBy(*by)) if by else F.sum("_n").over(Window.partitionBy())
    contrib = per_bin.withColumn("_w", F.when(F.col("_bin") > 0, F.abs(F.col("_c") - F.col("_a")) * F.col("_n") / n_all)
                                 .otherwise(F.lit(0.0)))
    return contrib.groupBy(*by).agg(F.sum("_w").alias("ece"))


def eval_logits_hard(df: DataFrame, by: Sequence[str], logits: str, label: str) -> DataFrame:
    """Argmax predictions -> accuracy, per-class precision/recall/F1, macro F1, MCC."""
    p = softmax_confidence(df, logits, pred="_pred")
    y, yp = F.col(label), F.col("_pred")
    conf = p.groupBy(*by).agg(F.count_if((y == 0) & (yp == 0)).alias("TN"), F.count_if((y == 0) & (yp == 1)).alias("FP"),
                              F.count_if((y == 1) & (yp == 0)).alias("FN"), F.count_if((y == 1) & (yp == 1)).alias("TP"))
    m = metrics_from_confusion(conf, keep=list(by))
    return m.select(*by, "accuracy", "precision_neg", "precision_pos", "recall_neg", "recall_pos", "f1_neg", "f1_pos",
                    ((F.col("f1_neg") + F.col("f1_pos")) / 2).alias("f1"), "mcc")


def eval_soft(df: DataFrame, by: Sequence[str], pred: str, target: str) -> DataFrame:
    """E16 (soft): cross-entropy (positive term, clipped) and RMSE of soft predictions."""
    q = F.least(F.greatest(F.col(pred), F.lit(1e-12)), F.lit(1.0 - 1e-12))
    return df.groupBy(*by).agg((-F.sum(F.col(target) * F.log(q + F.lit(1e-9))) / F.count(F.lit(1))).alias("ce"),
                               F.sqrt(F.avg(F.pow(F.col(target) - F.col(pred), 2))).alias("rmse"))


def _newton_stats(df: DataFrame, by: Sequence[str], logits: str, label: str) -> DataFrame:
    """NLL, dNLL/dbeta and d2NLL/dbeta2 at each group's beta (column ``_beta``)."""
    z = F.col(logits)
    bz = F.transform(z, lambda x: x * F.col("_beta"))
    m = F.array_max(bz)
    e = F.transform(bz, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    ez = F.aggregate(F.zip_with(e, z, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v) / s
    ez2 = F.aggregate(F.zip_with(e, z, lambda a, b: a * b * b), F.lit(0.0), lambda acc, v: acc + v) / s
    zy = F.element_at(z, F.col(label) + 1)
    l = m + F.log(s) - F.col("_beta") * zy
    return df.groupBy(*by).agg(F.avg(l).alias("nll"), F.avg(ez - zy).alias("grad"), F.avg(ez2 - ez * ez).alias("hess"))


def fit_temperature(df: DataFrame, by: Sequence[str], logits: str, label: str, t0: float = 1.5,
                    max_iter: int = 50, tol: float = 1e-10) -> DataFrame:
    """Temperature minimising the NLL per group, with NLL and ECE before and after, and ``converged``.

    The NLL is convex in beta = 1/T; a safeguarded Newton step (beta moves at most x4 per step) converges in
    a handful of aggregations. The table of betas (one row per group) stays in Spark; a step only tells the
    driver how many groups are still moving. ``converged`` is false where the steps ran out.
    """
    by = list(by)
    single = not by
    if single:  # one group: a constant key keeps every step an equi-join
        df, by = df.withColumn("_all", F.lit(0)), ["_all"]
    data = write_shared(df.select(*by, logits, label), "logits")
    betas = write_shared(data.select(*by).distinct().withColumn("_beta", F.lit(1.0 / t0)).withColumn("converged", F.lit(False)), "betas")
    first = None
    for _ in range(max_iter):
        x = data.join(maybe_broadcast(betas.where(~F.col("converged"))), by)
        stats = _newton_stats(x, by, logits, label)
        if first is None:
            first = stats = write_shared(stats, "newton")
        step = F.col("_beta") - F.col("grad") / F.col("hess")
        moved = F.least(F.greatest(step, F.col("_beta") / 4), F.col("_beta") * 4)
        still = (F.abs("grad") > tol) & (F.col("hess") > 0) & (F.abs(moved - F.col("_beta")) > 1e-12 * F.greatest(F.lit(1.0), F.abs("_beta")))
        flat = (F.abs("grad") > tol) & (F.col("hess") <= 0)  # no curvature left to step along: not a fit
        nxt = betas.join(stats, by, "left").select(
            *by, F.when(~F.col("converged") & (F.abs("grad") > tol) & (F.col("hess") > 0), moved).otherwise(F.col("_beta")).alias("_beta"),
            (F.col("converged") | ~(still | flat)).alias("converged"))
        betas = write_shared(nxt, "betas")
        if betas.where(~F.col("converged")).isEmpty():
            break
    bt = betas.select(*by, (1 / F.col("_beta")).alias("temperature"), "converged")
    x = data.join(maybe_broadcast(bt), by)
    after = x.groupBy(*by).agg(F.avg(item_nll(logits, label, F.col("temperature"))).alias("nll_after"),
                               F.first("temperature").alias("temperature"), F.first("converged").alias("converged"))
    ece_before = ece(data, by, logits, label).withColumnRenamed("ece", "ece_before")
    scaled = x.withColumn(logits, F.transform(F.col(logits), lambda v: v / F.col("temperature")))
    ece_after = ece(scaled, by, logits, label).withColumnRenamed("ece", "ece_after")
    out = after.join(first.select(*by, F.col("nll").alias("nll_before")), by).join(ece_before, by).join(ece_after, by)
    return out.drop("_all") if single else out


def temperature_grid(df: DataFrame, by: Sequence[str], logits: str, label: str, grid: Sequence[float]) -> DataFrame:
    """E20, grid form: (by..., temperature, nll) of the grid's best temperature, all of them in one pass."""
    losses = [F.avg(item_nll(logits, label, t)).alias(f"_{i}") for i, t in enumerate(grid)]
    means = df.groupBy(*by).agg(*losses)
    each = F.array(*[F.struct(F.col(f"_{i}").alias("nll"), F.lit(float(t)).alias("temperature")) for i, t in enumerate(grid)])
    return means.select(*by, F.array_min(each).alias("b")).select(*by, "b.temperature", "b.nll")
