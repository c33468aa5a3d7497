"""Seed aggregation and run reporting.

Run attributes (model, context, seed, ...) are ordinary grouping columns: one job covers every
model and context instead of a driver loop per run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.config import CONTEXT_NAMES, MODEL_LABEL_REPLACEMENTS, MODEL_NAMES, NO_CONTEXT
from threadlens.functions.common import safe_div

STATS = ("median", "std", "q1", "q3")


def run_identity(df: DataFrame, run: Sequence[str]) -> list[str]:
    """``run`` plus the corpus and kind (hard, soft) columns that ``df`` has: those never share an average."""
    return [c for c in ("data", "kind") if c in df.columns and c not in run] + list(run)


#: What names a run: never filled as if it were a metric.
RUN_KEYS = ("data", "model", "context", "context_level", "kind", "seed", "suffix", "task", "file_name")


def seed_average_hard(preds: DataFrame, keys: Sequence[str], run: Sequence[str] = ("model", "context"),
                      target: str = "stereo", confidence: str = "softmax_confidence") -> DataFrame:
    """A6 (+J11): mean/sd over seeds of the hard prediction and confidence per item and run.

    The gold label rides along in the same aggregation (taken from the highest seed, i.e. the last
    run file read by the reference), so no join back is needed.
    """
    pred = F.col(target + "_pred").cast("double")
    return preds.groupBy(*keys, *run_identity(preds, run)).agg(
        F.max_by(F.col(target), F.col("seed")).alias(target),
        F.avg(pred).alias(target + "_pred"),
        F.avg(confidence).alias(confidence),
        F.stddev_samp(confidence).alias(confidence + "_std"),
    )


def seed_average_soft(preds: DataFrame, keys: Sequence[str], run: Sequence[str] = ("model", "context"),
                      target: str = "stereo") -> DataFrame:
    """mean/sd over seeds of the soft prediction; hard prediction = round half to even of the mean."""
    ps = F.col(target + "_pred_soft")
    g = preds.groupBy(*keys, *run_identity(preds, run)).agg(
        F.max_by(F.col(target), F.col("seed")).alias(target),
        F.max_by(F.col(target + "_soft"), F.col("seed")).alias(target + "_soft"),
        F.avg(ps).alias(target + "_pred_soft"),
        F.stddev_samp(ps).alias(target + "_pred_soft_std"),
    )
    return g.withColumn(target + "_pred", F.bround(F.col(target + "_pred_soft"), 0).cast("int"))


def metrics_long(metrics: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Wide metrics (one column per metric) -> long (id..., metric, value)."""
    value_cols = [c for c in metrics.columns if c not in id_cols]
    casted = metrics.select(*id_cols, *[F.col(f"`{c}`").cast("double").alias(c) for c in value_cols])
    return casted.unpivot(list(id_cols), value_cols, "metric", "value")


def seed_summary(metrics_long_df: DataFrame, by: Sequence[str] = ("model", "context")) -> DataFrame:
    """Per group and metric, median, sd (n-1) and linear quartiles over seeds."""
    v = F.col("value")
    return metrics_long_df.groupBy(*run_identity(metrics_long_df, by), "metric").agg(
        F.percentile(v, 0.5).alias("median"),
        F.stddev_samp(v).alias("std"),
        F.percentile(v, 0.25).alias("q1"),
        F.percentile(v, 0.75).alias("q3"),
    )


def welch_test(metrics_long_df: DataFrame, by: Sequence[str] = ("model",), context_col: str = "context",
               baseline: str = NO_CONTEXT, with_pvalue: bool = True) -> DataFrame:
    """Welch t statistic and degrees of freedom of every context against the baseline context.

    Moments per (group, context, metric) come from one aggregation; the baseline row is joined back
    by key (the summary has one row per group x context x metric, tiny). The p-value needs a Student-t
    CDF, evaluated by a vectorised pandas UDF on the small summary only.
    """
    v, by = F.col("value"), run_identity(metrics_long_df, by)
    mom = metrics_long_df.groupBy(*by, context_col, "metric").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))
    base = mom.filter(F.col(context_col) == baseline).select(
        *by, "metric", F.col("n").alias("n_b"), F.col("mean").alias("mean_b"), F.col("var").alias("var_b"))
    j = mom.join(base, [*by, "metric"], "inner")
    se2_a, se2_b = F.col("var") / F.col("n"), F.col("var_b") / F.col("n_b")
    se2 = se2_a + se2_b
    t = safe_div(F.col("mean") - F.col("mean_b"), F.sqrt(se2), None)
    dof = safe_div(se2 * se2, se2_a * se2_a / (F.col("n") - 1) + se2_b * se2_b / (F.col("n_b") - 1), None)
    out = j.select(*by, context_col, "metric", t.alias("ttest"), dof.alias("dof"))
    if with_pvalue:
        from threadlens.functions.stats import t_two_sided_pvalue

        out = out.withColumn("pvalue", t_two_sided_pvalue(F.col("ttest"), F.col("dof")))
    return out


def min_max_norm(metrics: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """A10: ``(x - min) / (max - min)`` over the run table (optionally per group) -> ``<column>_norm``."""
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    c = F.col(column)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return metrics.withColumn(column + "_norm", safe_div(c - lo, hi - lo, None))


def union_metrics(frames: Sequence[DataFrame], keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Union runs with different metric columns; missing metrics -> 0, run keys (``keys``) stay null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    numeric = [f.name for f in out.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer") and f.name not in keys]
    return out.fillna(0, subset=numeric)


def seed_summary_wide(summary: DataFrame, by: Sequence[str] = ("model", "context")) -> DataFrame:
    """A8 output in the reference's wide layout: ``m``, ``m--std``, ``m--q1``, ``m--q3`` per group."""
    long = summary.unpivot([*by, "metric"], list(STATS), "stat", "value")
    name = F.when(F.col("stat") == "median", F.col("metric")).otherwise(F.concat_ws("--", "metric", "stat"))
    return long.withColumn("name", name).groupBy(*by).pivot("name").agg(F.first("value"))


def metrics_long_to_wide(wide: DataFrame, id_col: str = "model", scale_ce: bool = True) -> DataFrame:
    """Melt ``metric--stat`` columns, stat defaults to median, pivot stats into columns.

    ``cross_entropy`` columns are divided by their maximum over the rows, as in the reference plots.
    """
    value_cols = [c for c in wide.columns if c != id_col]
    long = metrics_long(wide, [id_col]).withColumnRenamed("metric", "name")
    if scale_ce:
        w = Window.partitionBy("name")
        long = long.withColumn("value", F.when(F.col("name").contains("cross_entropy"),
                                               safe_div(F.col("value"), F.max("value").over(w), None))
                               .otherwise(F.col("value")))
    has_stat = F.col("name").contains("--")
    stat = F.when(has_stat, F.substring_index("name", "--", -1)).otherwise(F.lit("median"))
    known = F.lit(["min", "max", "std", "q1", "q3", "ttest", "pvalue"])
    stat = F.when(F.array_contains(known, stat), stat).otherwise(F.lit("median"))
    metric = F.when(has_stat & (stat != "median"), F.expr("substring(name, 1, length(name) - length(substring_index(name, '--', -1)) - 2)")).otherwise(F.col("name"))
    stats_present = sorted({c.split("--")[-1] for c in value_cols if "--" in c} | {"median"})
    return (long.select(id_col, metric.alias("metric"), stat.alias("metric_type"), "value")
            .groupBy(id_col, "metric").pivot("metric_type", stats_present).agg(F.first("value")))


def filter_runs(runs: DataFrame, data: str | None = None, model: str | None = None, context: str | None = None,
                kind: str | None = None, suffixes: Sequence[str] | None = None, n_seeds: int = -1) -> DataFrame:
    """Keep runs by typed predicates on the parsed run columns; seeds 42..41+n when n_seeds > 0."""
    cond = F.lit(True)
    for name, value in (("data", data), ("model", model), ("context", context), ("kind", kind)):
        if value is not None:
            cond = cond & (F.col(name) == value)
    if suffixes:
        cond = cond & F.col("suffix").isin(list(suffixes))
    if n_seeds != -1:
        cond = cond & F.col("seed").between(42, 41 + n_seeds)
    return runs.filter(cond)


def _lookup(mapping: dict[str, str], c: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(m[c], c)


def display_names(df: DataFrame, model_col: str = "model", context_col: str = "context",
                  metric_col: str | None = None, change_col: str | None = None) -> DataFrame:
    """P10: display names for model / context / metric codes; change labels keep their cell code."""
    from threadlens.config import METRIC_NAMES

    out = df.withColumn(model_col + "_name", _lookup(MODEL_NAMES, F.col(model_col)))
    out = out.withColumn(context_col + "_name", _lookup(CONTEXT_NAMES, F.col(context_col)))
    if metric_col:
        out = out.withColumn(metric_col + "_name", _lookup(METRIC_NAMES, F.col(metric_col)))
    if change_col:
        out = out.withColumn(change_col + "_code", F.expr(f"substring(`{change_col}`, -3, 2)"))
    return out


def title_case(c: Column) -> Column:
    """Python ``str.title()``: upper-case a letter that follows a non-letter, lower-case the rest."""
    chars = F.split(c, "")
    return F.array_join(F.transform(chars, lambda ch, i: F.when(
        (i == 0) | ~F.element_at(chars, i).rlike("^\\p{L}$"), F.upper(ch)).otherwise(F.lower(ch))), "")


def clean_model_label(c: Column, data: str | None = None, remove: Sequence[str] = ()) -> Column:
    """Drop ``<data>-``, title-case, then the fixed replacement chain and user removals."""
    out = F.replace(c, F.lit(f"{data}-"), F.lit("")) if data else c
    out = title_case(out)
    for old, new in [*MODEL_LABEL_REPLACEMENTS, *[(r, "") for r in remove]]:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def beats_reference(summary: DataFrame, value: str = "median", by: Sequence[str] = ("model", "metric"),
                    context_col: str = "context", baseline: str = NO_CONTEXT) -> DataFrame:
    """Is each context's value greater than the baseline context's value within its model."""
    w = Window.partitionBy(*by)
    base = F.max(F.when(F.col(context_col) == baseline, F.col(value))).over(w)
    return summary.withColumn("beats_reference", F.col(value) > base)


def is_best(summary: DataFrame, value: str = "median", by: Sequence[str] = ("model", "metric")) -> DataFrame:
    """Equal to the max within model, equal to the max overall (per metric), below 0.5."""
    v = F.col(value)
    return (summary.withColumn("is_best_in_model", v == F.max(v).over(Window.partitionBy(*by)))
            .withColumn("is_best_overall", v == F.max(v).over(Window.partitionBy(by[-1])))
            .withColumn("below_half", v < 0.5))


def top_k_runs(df: DataFrame, k: int, metric: str, run: Sequence[str], checkpoint: str,
               greater_is_better: bool = False) -> DataFrame:
    """Keep the K best checkpoints per run (lowest metric by default) and flag the single best."""
    order = F.col(metric).desc() if greater_is_better else F.col(metric).asc()
    w = Window.partitionBy(*run).orderBy(order, F.col(checkpoint).asc())
    return (df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("is_best", F.col("rank") == 1))
