"""Evaluation queries over all prediction runs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from threadlens.operators import metrics as M
from threadlens.plans.registry import query
from threadlens.sources import adapters as A

RUN = ["model", "context", "seed"]


def _r(expr: str) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE) + 1e-10, 6)"  # same canonical rounding as the Spark side


def _div(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) <> 0 THEN CAST({num} AS DOUBLE) / ({den}) ELSE 0.0 END"


CELLS_SQL = _CELLS_SQL = """count_if(stereo = 0 AND stereo_pred = 0) AS TN, count_if(stereo = 0 AND stereo_pred = 1) AS FP,
  count_if(stereo = 1 AND stereo_pred = 0) AS FN, count_if(stereo = 1 AND stereo_pred = 1) AS TP"""

def metrics1_sql(rounded: bool = True) -> str:
    r = _r if rounded else (lambda e: f"CAST({e} AS DOUBLE)")
    return ",\n  ".join([
        r(_div("2*TN", "2*TN+FP+FN")) + " AS f1_neg",
        r(_div("2*TP", "2*TP+FP+FN")) + " AS f1_pos",
        r(f"({_div('TP', 'TP+FN')} + {_div('TN', 'TN+FP')}) / 2") + " AS roc_auc",
        r(_div("CAST(TP AS DOUBLE)*TN - CAST(FP AS DOUBLE)*FN",
               "sqrt(CAST(TP+FP AS DOUBLE)*(TP+FN)*(TN+FP)*(TN+FN))")) + " AS mcc",
        r(_div("TN", "TN+FN")) + " AS precision_neg",
        r(_div("TP", "TP+FP")) + " AS precision_pos",
        r(_div("TN", "TN+FP")) + " AS recall_neg",
        r(_div("TP", "TP+FN")) + " AS recall_pos",
        r(_div("TP+TN", "TP+TN+FP+FN")) + " AS accuracy",
    ])


_METRICS1_SQL = metrics1_sql(True)
METRICS1_NAMES = ["f1_neg", "f1_pos", "roc_auc", "mcc", "precision_neg", "precision_pos", "recall_neg",
                  "recall_pos", "accuracy"]


@query("confusion", views=("preds",), sql=f"SELECT model, context, seed, {_CELLS_SQL} FROM preds GROUP BY model, context, seed")
def q_confusion(spark, d):
    return M.confusion(A.preds(spark, d), RUN, "stereo")


@query("metrics1", views=("preds",), sql=f"""
WITH c AS (SELECT model, context, seed, {_CELLS_SQL} FROM preds GROUP BY model, context, seed)
SELECT model, context, seed, TN, FP, FN, TP,
  {_METRICS1_SQL}
FROM c""")
def q_metrics1(spark, d):
    return M.metrics1(A.preds(spark, d), RUN, "stereo")


def _acc_by_sql(column: str, s0: str, s1: str) -> str:
    out = []
    for cond, suf in ((f"{column} < 0.5", s0), (f"{column} >= 0.5", s1)):
        out.append(_r(f"coalesce(avg(CASE WHEN stereo = 1 AND {cond} THEN CAST(stereo_pred = stereo AS INT) END), 0)")
                   + f" AS accuracy{suf}")
    return ",\n  ".join(out)


def _conf_sql(conf: str) -> str:
    cells = {"TN": "stereo = 0 AND stereo_pred = 0", "FP": "stereo = 0 AND stereo_pred = 1",
             "FN": "stereo = 1 AND stereo_pred = 0", "TP": "stereo = 1 AND stereo_pred = 1"}
    out = [_r(f"coalesce(avg({conf}), 0)") + f" AS {conf}", _r(f"coalesce(stddev_samp({conf}), 0)") + f" AS {conf}_std"]
    for name, cond in cells.items():
        out.append(_r(f"coalesce(avg(CASE WHEN {cond} THEN {conf} END), 0)") + f" AS {name}_{conf}")
        out.append(_r(f"coalesce(stddev_samp(CASE WHEN {cond} THEN {conf} END), 0)") + f" AS {name}_{conf}_std")
    return ",\n  ".join(out)


def _soft_sql() -> str:
    cells = {"TN": "stereo = 0 AND stereo_pred = 0", "FP": "stereo = 0 AND stereo_pred = 1",
             "FN": "stereo = 1 AND stereo_pred = 0", "TP": "stereo = 1 AND stereo_pred = 1"}
    term = "stereo_soft * ln(least(greatest(stereo_pred_soft, 1e-12), 1.0 - 1e-12) + 1e-9)"
    out = [_r(f"-sum({term}) / count(*)") + " AS cross_entropy",
           _r("sqrt(avg(pow(stereo_soft - stereo_pred_soft, 2)))") + " AS MSE"]
    for name, cond in cells.items():
        out.append(_r(f"coalesce(-sum(CASE WHEN {cond} THEN {term} END) / nullif(count_if({cond}), 0), 0)")
                   + f" AS {name}_cross_entropy")
        out.append(_r(f"coalesce(sqrt(avg(CASE WHEN {cond} THEN pow(stereo_soft - stereo_pred_soft, 2) END)), 0)")
                   + f" AS {name}_MSE")
    return ",\n  ".join(out)


_TASK1_SQL = f"""
WITH c AS (
  SELECT model, context, seed, {_CELLS_SQL},
  {_acc_by_sql('implicit', '_explicit', '_implicit')},
  {_acc_by_sql('contextual', '_no_contextual', '_contextual')},
  {_conf_sql('softmax_confidence')},
  {_soft_sql()}
  FROM preds GROUP BY model, context, seed)
SELECT *, {_METRICS1_SQL} FROM c"""


@query("task1_metrics", views=("preds",), sql=_TASK1_SQL)
def q_task1_metrics(spark, d):
    return M.task1_metrics(A.preds(spark, d), RUN, "stereo", soft=True, contextual=True)


@query("accuracy_by", views=("preds",), sql=f"""
SELECT model, context, seed, {_acc_by_sql('implicit', '_explicit', '_implicit')},
  {_acc_by_sql('contextual', '_no_contextual', '_contextual')}
FROM preds GROUP BY model, context, seed""")
def q_accuracy_by(spark, d):
    p = A.preds(spark, d)
    t, pr = F.col("stereo"), F.col("stereo_pred")
    exprs = M._accuracy_by_exprs(t, pr, "implicit", ("_explicit", "_implicit"))
    exprs += M._accuracy_by_exprs(t, pr, "contextual", ("_no_contextual", "_contextual"))
    return M.metrics_by(p, RUN, exprs)


@query("confidence_stats", views=("preds",), sql=f"""
SELECT model, context, seed, {_conf_sql('softmax_confidence')} FROM preds GROUP BY model, context, seed""")
def q_confidence_stats(spark, d):
    p = A.preds(spark, d)
    return M.metrics_by(p, RUN, M._confidence_exprs(F.col("stereo"), F.col("stereo_pred"), "softmax_confidence",
                                                    None, False))


@query("soft_metrics", views=("preds",), sql=f"""
SELECT model, context, seed, {_soft_sql()} FROM preds GROUP BY model, context, seed""")
def q_soft_metrics(spark, d):
    p = A.preds(spark, d)
    return M.metrics_by(p, RUN, M._soft_exprs(F.col("stereo"), F.col("stereo_pred"), "stereo_soft", "stereo_pred_soft"))


@query("symmetric_kl", views=("preds",), sql=f"""
SELECT model, context, seed,
  {_r("(sum(CASE WHEN stereo_soft > 0 THEN stereo_soft * ln(stereo_soft / q) ELSE 0 END) / sum(stereo_soft)"
      " + sum(CASE WHEN q > 0 THEN q * ln(q / stereo_soft) ELSE 0 END) / sum(q)) / 2")} AS js
FROM (SELECT *, (stereo_pred_soft + 0.01) / 1.01 AS q FROM preds) GROUP BY model, context, seed""")
def q_symmetric_kl(spark, d):
    # stereo_pred_soft reaches 0, where KL is infinite; score the add-0.01 smoothed prediction instead.
    p = A.preds(spark, d).withColumn("q", (F.col("stereo_pred_soft") + 0.01) / 1.01)
    return M.symmetric_kl(p, RUN, "stereo_soft", "q")


def _cprf_sql() -> str:
    prob = "((2*softmax_confidence - 1) + 1) / 2"
    prob_pos = f"CASE WHEN stereo_pred = 1 THEN {prob} ELSE 1 - {prob} END"
    m = {1: prob_pos, 0: f"(1 - ({prob_pos}))"}
    parts = []
    for label, suf in ((0, "neg"), (1, "pos")):
        ctp = f"sum(CASE WHEN stereo_pred = {label} AND stereo = {label} THEN {m[label]} ELSE 0 END)"
        cfp = f"sum(CASE WHEN stereo_pred = {label} AND stereo <> {label} THEN {m[label]} ELSE 0 END)"
        n = f"count_if(stereo = {label})"
        prec, rec = f"({ctp}) / nullif(({ctp}) + ({cfp}), 0)", f"({ctp}) / nullif({n}, 0)"
        parts += [_r(prec) + f" AS c_precision_{suf}", _r(rec) + f" AS c_recall_{suf}",
                  _r(f"2 * ({prec}) * ({rec}) / nullif(({prec}) + ({rec}), 0)") + f" AS c_f1_{suf}"]
    return ",\n  ".join(parts)


@query("confidence_prf", views=("preds",), sql=f"""
SELECT model, context, seed, {_cprf_sql()} FROM preds GROUP BY model, context, seed""")
def q_confidence_prf(spark, d):
    # the reference's `confidence` is a [-1, 1] margin; here 2*softmax_confidence - 1 of the runs.
    p = A.preds(spark, d).withColumn("confidence", 2 * F.col("softmax_confidence") - 1)
    return M.confidence_prf(p, RUN, "stereo", "confidence")


@query("gold_upper_bound", views=("gold",), sql=f"""
WITH g AS (SELECT 1 AS data, stereo, stereo AS stereo_pred, implicit, contextual FROM gold),
c AS (SELECT data, {_CELLS_SQL}, {_acc_by_sql('implicit', '_explicit', '_implicit')},
  {_acc_by_sql('contextual', '_no_contextual', '_contextual')} FROM g GROUP BY data)
SELECT *, {_METRICS1_SQL} FROM c""")
def q_gold_upper_bound(spark, d):
    g = A.gold(spark, d).withColumn("data", F.lit(1))
    return M.gold_upper_bound(g, ["data"], "stereo", contextual=True)


def _poisson_sql(rate: float = 1.0) -> str:
    total, term, steps = 0.0, math.exp(-rate), []
    for k in range(12):
        total += term
        term *= rate / (k + 1)
        steps.append(f"CAST(u >= CAST({total!r} AS DOUBLE) AS INT)")
    return " + ".join(steps)


_BOOT_DBL = [m + s for m in ("f1_neg", "f1_pos") for s in ("", "_min", "_max")]


@query("bootstrap_poisson", views=("preds",), dbl=_BOOT_DBL, sql=f"""
WITH x AS (SELECT model, context, seed, doc_id, stereo, stereo_pred, unnest(range(1, 21)) AS replicate FROM preds),
u AS (SELECT *, CAST(('0x' || substr(md5(concat_ws('|', doc_id, model, context, seed, replicate, 42)), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM x),
w AS (SELECT *, {_poisson_sql()} AS w FROM u),
c AS (SELECT model, context, seed, replicate,
  sum(CASE WHEN stereo = 0 AND stereo_pred = 0 THEN w ELSE 0 END) AS TN, sum(CASE WHEN stereo = 0 AND stereo_pred = 1 THEN w ELSE 0 END) AS FP,
  sum(CASE WHEN stereo = 1 AND stereo_pred = 0 THEN w ELSE 0 END) AS FN, sum(CASE WHEN stereo = 1 AND stereo_pred = 1 THEN w ELSE 0 END) AS TP
  FROM w GROUP BY ALL),
f AS (SELECT model, context, seed, {_div('2*TN', '2*TN+FP+FN')} AS f1_neg, {_div('2*TP', '2*TP+FP+FN')} AS f1_pos FROM c)
SELECT model, context, seed, avg(f1_neg) AS f1_neg, quantile_cont(f1_neg, 0.025) AS f1_neg_min, quantile_cont(f1_neg, 0.975) AS f1_neg_max,
  avg(f1_pos) AS f1_pos, quantile_cont(f1_pos, 0.025) AS f1_pos_min, quantile_cont(f1_pos, 0.975) AS f1_pos_max
FROM f GROUP BY model, context, seed""")
def q_bootstrap_poisson(spark, d):
    """E9 with md5-Poisson weights: the checkable form of the bootstrap."""
    from threadlens.operators.resample import bootstrap_poisson

    return bootstrap_poisson(A.preds(spark, d), RUN, ["doc_id"], "stereo", n=20)


_SOFT_BOOT = [m + s for m in ("f1_neg", "f1_pos", "cross_entropy", "MSE") for s in ("", "_min", "_max")]


@query("bootstrap_soft", views=("preds",), dbl=_SOFT_BOOT, sql=f"""
WITH x AS (SELECT model, context, seed, doc_id, stereo, stereo_pred, stereo_soft, stereo_pred_soft, unnest(range(1, 11)) AS replicate FROM preds),
u AS (SELECT *, CAST(('0x' || substr(md5(concat_ws('|', doc_id, model, context, seed, replicate, 42)), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM x),
w AS (SELECT *, {_poisson_sql(0.5)} AS w FROM u),
c AS (SELECT model, context, seed, replicate,
  sum(CASE WHEN stereo = 0 AND stereo_pred = 0 THEN w ELSE 0 END) AS TN, sum(CASE WHEN stereo = 0 AND stereo_pred = 1 THEN w ELSE 0 END) AS FP,
  sum(CASE WHEN stereo = 1 AND stereo_pred = 0 THEN w ELSE 0 END) AS FN, sum(CASE WHEN stereo = 1 AND stereo_pred = 1 THEN w ELSE 0 END) AS TP,
  sum(w) AS n, sum(w * stereo_soft * ln(least(greatest(stereo_pred_soft, 1e-12), 1.0 - 1e-12) + 1e-9)) AS ce,
  sum(w * pow(stereo_soft - stereo_pred_soft, 2)) AS se FROM w GROUP BY ALL),
f AS (SELECT model, context, seed, {_div('2*TN', '2*TN+FP+FN')} AS f1_neg, {_div('2*TP', '2*TP+FP+FN')} AS f1_pos,
  {_div('-ce', 'n')} AS cross_entropy, sqrt({_div('se', 'n')}) AS MSE FROM c)
SELECT model, context, seed, {", ".join(f"avg({m}) AS {m}, quantile_cont({m}, 0.025) AS {m}_min, quantile_cont({m}, 0.975) AS {m}_max"
                                        for m in ("f1_neg", "f1_pos", "cross_entropy", "MSE"))}
FROM f GROUP BY model, context, seed""")
def q_bootstrap_soft(spark, d):
    """E9, soft form: half of the items drawn per replicate, hard and soft metrics of the same draws."""
    from threadlens.operators.resample import bootstrap_poisson

    return bootstrap_poisson(A.preds(spark, d), RUN, ["doc_id"], "stereo", n=10, frac=0.5, soft=True).select(*RUN, *_SOFT_BOOT)


@query("bootstrap_ci")
def q_bootstrap_ci(spark, d):
    """Multinomial replicates of the cell counts (random by nature: rows-only check)."""
    from threadlens.operators.resample import bootstrap_ci

    return bootstrap_ci(A.preds(spark, d), RUN, "stereo", n=1000)
