"""Seed-aggregation and run-reporting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.config import NO_CONTEXT
from threadlens.operators import metrics as M
from threadlens.operators import seeds as S
from threadlens.plans.q_evaluation import CELLS_SQL, METRICS1_NAMES, metrics1_sql
from threadlens.plans.registry import query
from threadlens.sources import adapters as A

RUN = ["model", "context", "seed"]
RUN_METRICS = ["TN", "FP", "FN", "TP", *METRICS1_NAMES, "cross_entropy", "MSE"]


def run_metrics(spark, d):
    """Per-run metric table (one aggregation over all runs)."""
    m = M.task1_metrics(A.preds(spark, d), RUN, "stereo", confidence=(), soft=True)
    return m.select(*RUN, *RUN_METRICS)


def run_metrics_long(spark, d):
    return S.metrics_long(run_metrics(spark, d), RUN)


_CE = "stereo_soft * ln(least(greatest(stereo_pred_soft, 1e-12), 1.0 - 1e-12) + 1e-9)"
RUN_METRICS_SQL = f"""
rm_c AS (SELECT model, context, seed, {CELLS_SQL},
  -sum({_CE}) / count(*) AS cross_entropy, sqrt(avg(pow(stereo_soft - stereo_pred_soft, 2))) AS MSE
  FROM preds GROUP BY model, context, seed),
run_metrics AS (SELECT model, context, seed, TN, FP, FN, TP, {metrics1_sql(False)},
  CAST(cross_entropy AS DOUBLE) AS cross_entropy, CAST(MSE AS DOUBLE) AS MSE FROM rm_c),
run_long AS (UNPIVOT run_metrics ON COLUMNS(* EXCLUDE (model, context, seed)) INTO NAME metric VALUE value)"""

SUMMARY_SQL = RUN_METRICS_SQL + """,
summary AS (SELECT model, context, metric, median(value) AS median, stddev_samp(value) AS std,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM run_long GROUP BY model, context, metric)"""


def summary(spark, d):
    return S.seed_summary(run_metrics_long(spark, d))


@query("seed_average_hard", views=("preds",), dbl=("stereo_pred", "softmax_confidence", "softmax_confidence_std"), sql="""
SELECT doc_id, model, context, arg_max(stereo, seed) AS stereo, avg(stereo_pred) AS stereo_pred,
  avg(softmax_confidence) AS softmax_confidence, stddev_samp(softmax_confidence) AS softmax_confidence_std
FROM preds GROUP BY doc_id, model, context""")
def q_seed_average_hard(spark, d):
    return S.seed_average_hard(A.preds(spark, d), ["doc_id"])


@query("seed_average_soft", views=("preds",), dbl=("stereo_soft", "stereo_pred_soft", "stereo_pred_soft_std"), sql="""
SELECT doc_id, model, context, arg_max(stereo, seed) AS stereo, arg_max(stereo_soft, seed) AS stereo_soft,
  avg(stereo_pred_soft) AS stereo_pred_soft, stddev_samp(stereo_pred_soft) AS stereo_pred_soft_std,
  CAST(round_even(avg(stereo_pred_soft), 0) AS INT) AS stereo_pred
FROM preds GROUP BY doc_id, model, context""")
def q_seed_average_soft(spark, d):
    return S.seed_average_soft(A.preds(spark, d), ["doc_id"])


@query("seed_summary", views=("preds",), dbl=("median", "std", "q1", "q3"), sql=f"WITH {SUMMARY_SQL} SELECT * FROM summary")
def q_seed_summary(spark, d):
    return summary(spark, d)


@query("welch_test", views=("preds",), dbl=("ttest", "dof"), sql=f"""
WITH {RUN_METRICS_SQL},
mom AS (SELECT model, context, metric, count(value) AS n, avg(value) AS mean, var_samp(value) AS var
        FROM run_long GROUP BY model, context, metric),
base AS (SELECT model, metric, n AS n_b, mean AS mean_b, var AS var_b FROM mom WHERE context = '{NO_CONTEXT}'),
j AS (SELECT *, var / n AS a, var_b / n_b AS b FROM mom JOIN base USING (model, metric))
SELECT model, context, metric,
  CASE WHEN sqrt(a + b) <> 0 THEN (mean - mean_b) / sqrt(a + b) END AS ttest,
  CASE WHEN (a*a/(n-1) + b*b/(n_b-1)) <> 0 THEN (a + b)*(a + b) / (a*a/(n-1) + b*b/(n_b-1)) END AS dof
FROM j""")
def q_welch_test(spark, d):
    return S.welch_test(run_metrics_long(spark, d), with_pvalue=False)


def _pvalue_sql(steps: int = 600) -> str:
    """Two-sided p by Simpson's rule over the angle atan(t / sqrt(dof)), where the density is a power of cos."""
    return f"""grid AS (SELECT *, unnest(range(0, {steps + 1})) AS i, atan(abs(ttest) / sqrt(dof)) AS low FROM test),
pts AS (SELECT *, low + (pi() / 2 - low) * i / {steps} AS angle, CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM grid),
area AS (SELECT model, context, metric, any_value(dof) AS v, (pi() / 2 - any_value(low)) / {steps} / 3
  * sum(w * CASE WHEN cos(angle) > 1e-12 THEN pow(cos(angle), dof - 1) WHEN dof = 1 THEN 1 ELSE 0 END) AS tail FROM pts WHERE ttest IS NOT NULL GROUP BY ALL)"""


@query("welch_pvalue", views=("preds",), dbl=("ttest", "dof", "pvalue"), sql=f"""
WITH {RUN_METRICS_SQL},
mom AS (SELECT model, context, metric, count(value) AS n, avg(value) AS mean, var_samp(value) AS var
        FROM run_long GROUP BY model, context, metric),
base AS (SELECT model, metric, n AS n_b, mean AS mean_b, var AS var_b FROM mom WHERE context = '{NO_CONTEXT}'),
j AS (SELECT *, var / n AS a, var_b / n_b AS b FROM mom JOIN base USING (model, metric)),
test AS (SELECT model, context, metric, CASE WHEN sqrt(a + b) <> 0 THEN (mean - mean_b) / sqrt(a + b) END AS ttest,
  CASE WHEN (a*a/(n-1) + b*b/(n_b-1)) <> 0 THEN (a + b)*(a + b) / (a*a/(n-1) + b*b/(n_b-1)) END AS dof FROM j),
{_pvalue_sql()}
SELECT t.model, t.context, t.metric, t.ttest, t.dof,
  2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(pi()) * tail AS pvalue
FROM test t LEFT JOIN area a ON a.model = t.model AND a.context = t.context AND a.metric = t.metric""")
def q_welch_pvalue(spark, d):
    """Welch t, dof and two-sided p-value (Student-t tail by pandas UDF on the small summary)."""
    return S.welch_test(run_metrics_long(spark, d), with_pvalue=True)


@query("min_max_norm", views=("preds",), dbl=("f1_pos", "f1_pos_norm"), sql=f"""
WITH {RUN_METRICS_SQL}
SELECT model, context, seed, f1_pos,
  CASE WHEN max(f1_pos) OVER () - min(f1_pos) OVER () <> 0
       THEN (f1_pos - min(f1_pos) OVER ()) / (max(f1_pos) OVER () - min(f1_pos) OVER ()) END AS f1_pos_norm
FROM run_metrics""")
def q_min_max_norm(spark, d):
    return S.min_max_norm(run_metrics(spark, d).select(*RUN, "f1_pos"), "f1_pos")


@query("union_metrics", views=("preds",), dbl=("f1_pos", "cross_entropy", "MSE"), sql=f"""
WITH {RUN_METRICS_SQL}
SELECT model, context, seed, coalesce(TN, 0) AS TN, coalesce(FP, 0) AS FP, coalesce(FN, 0) AS FN, coalesce(TP, 0) AS TP,
  coalesce(f1_pos, 0) AS f1_pos, coalesce(cross_entropy, 0) AS cross_entropy, coalesce(MSE, 0) AS MSE
FROM (SELECT model, context, seed, TN, FP, FN, TP, f1_pos FROM run_metrics WHERE context = '{NO_CONTEXT}'
      UNION ALL BY NAME
      SELECT model, context, seed, cross_entropy, MSE FROM run_metrics WHERE context <> '{NO_CONTEXT}')""")
def q_union_metrics(spark, d):
    rm = run_metrics(spark, d)
    hard = rm.filter(F.col("context") == NO_CONTEXT).select(*RUN, "TN", "FP", "FN", "TP", "f1_pos")
    soft = rm.filter(F.col("context") != NO_CONTEXT).select(*RUN, "cross_entropy", "MSE")
    return S.union_metrics([hard, soft])


@query("metrics_long_to_wide", views=("preds",), dbl=("median", "q1", "q3", "std"), sql=f"""
WITH {SUMMARY_SQL},
s AS (SELECT model || '-' || context AS model, metric, median, q1, q3, std FROM summary)
SELECT model, metric,
  CASE WHEN metric LIKE '%cross_entropy%' THEN median / nullif(max(median) OVER (PARTITION BY metric), 0) ELSE median END AS median,
  CASE WHEN metric LIKE '%cross_entropy%' THEN q1 / nullif(max(q1) OVER (PARTITION BY metric), 0) ELSE q1 END AS q1,
  CASE WHEN metric LIKE '%cross_entropy%' THEN q3 / nullif(max(q3) OVER (PARTITION BY metric), 0) ELSE q3 END AS q3,
  CASE WHEN metric LIKE '%cross_entropy%' THEN std / nullif(max(std) OVER (PARTITION BY metric), 0) ELSE std END AS std
FROM s""")
def q_metrics_long_to_wide(spark, d):
    sm = summary(spark, d).withColumn("model", F.concat_ws("-", "model", "context")).drop("context")
    wide = S.seed_summary_wide(sm, by=("model",))
    return S.metrics_long_to_wide(wide, "model")


@query("filter_runs", views=("preds",), sql=f"""
SELECT model, context, seed, {CELLS_SQL} FROM preds
WHERE model = 'beto' AND seed BETWEEN 42 AND 46 GROUP BY model, context, seed""")
def q_filter_runs(spark, d):
    return M.confusion(S.filter_runs(A.preds(spark, d), model="beto", n_seeds=5), RUN)


def _case_map(col: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} ELSE {col} END"


def _display_sql() -> str:
    from threadlens.config import CONTEXT_NAMES, MODEL_NAMES

    return f"""
WITH {RUN_METRICS_SQL}
SELECT model, context, seed, f1_pos, {_case_map('model', MODEL_NAMES)} AS model_name,
  {_case_map('context', CONTEXT_NAMES)} AS context_name FROM run_metrics"""


@query("display_names", views=("preds",), dbl=("f1_pos",), sql=_display_sql())
def q_display_names(spark, d):
    return S.display_names(run_metrics(spark, d).select(*RUN, "f1_pos"))


def _clean_label_sql() -> str:
    from threadlens.config import MODEL_LABEL_REPLACEMENTS

    s = "replace(replace(file_name, '-task1.csv', ''), 'stereohoax-', '')"
    title = (f"array_to_string(list_transform(range(length({s})), lambda i: CASE WHEN i = 0 OR NOT "
             f"regexp_matches(substr({s}, i, 1), '^\\p{{L}}$') THEN upper(substr({s}, i + 1, 1)) "
             f"ELSE lower(substr({s}, i + 1, 1)) END), '')")
    out = title
    for old, new in MODEL_LABEL_REPLACEMENTS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"SELECT file_name, {out} AS label FROM run_files"


@query("clean_model_label", views=("run_files",), sql=_clean_label_sql())
def q_clean_model_label(spark, d):
    f = A.run_files(spark, d)
    return f.select("file_name", S.clean_model_label(F.replace(F.col("file_name"), F.lit("-task1.csv"), F.lit("")),
                                                     data="stereohoax").alias("label"))


@query("beats_reference", views=("preds",), dbl=("median",), sql=f"""
WITH {SUMMARY_SQL}
SELECT model, context, metric, median,
  median > max(CASE WHEN context = '{NO_CONTEXT}' THEN median END) OVER (PARTITION BY model, metric) AS beats_reference
FROM summary""")
def q_beats_reference(spark, d):
    return S.beats_reference(summary(spark, d).select("model", "context", "metric", "median"))


@query("is_best", views=("preds",), dbl=("median",), sql=f"""
WITH {SUMMARY_SQL}
SELECT model, context, metric, median,
  median = max(median) OVER (PARTITION BY model, metric) AS is_best_in_model,
  median = max(median) OVER (PARTITION BY metric) AS is_best_overall, median < 0.5 AS below_half
FROM summary""")
def q_is_best(spark, d):
    return S.is_best(summary(spark, d).select("model", "context", "metric", "median"))


@query("top_k_runs", views=("preds",), dbl=("mcc",), sql=f"""
WITH {RUN_METRICS_SQL},
r AS (SELECT model, context, seed, mcc,
  row_number() OVER (PARTITION BY model, context ORDER BY mcc DESC, seed ASC) AS rank FROM run_metrics)
SELECT *, rank = 1 AS is_best FROM r WHERE rank <= 3""")
def q_top_k_runs(spark, d):
    rm = run_metrics(spark, d).select(*RUN, "mcc")
    return S.top_k_runs(rm, 3, "mcc", ["model", "context"], "seed", greater_is_better=True)
