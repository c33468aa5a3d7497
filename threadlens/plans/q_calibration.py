"""Calibration and loss queries on the two-class logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.operators import calibration as CAL
from threadlens.operators.splits import class_weights
from threadlens.plans.registry import query
from threadlens.sources import adapters as A

T = 1.5


def _logits(spark, d):
    return A.logits(spark, d).withColumn("z", F.array("z0", "z1"))


def _probs_sql(t: float = 1.0) -> str:
    return f"""pr AS (SELECT *, greatest(z0 / {t!r}, z1 / {t!r}) AS m FROM logits),
pe AS (SELECT *, exp(z0 / {t!r} - m) AS e0, exp(z1 / {t!r} - m) AS e1 FROM pr),
pp AS (SELECT *, e0 / (e0 + e1) AS p0, e1 / (e0 + e1) AS p1, m + ln(e0 + e1) AS lse FROM pe)"""


@query("softmax_confidence", views=("logits",), dbl=("softmax_confidence",), sql=f"""
WITH {_probs_sql(T)}
SELECT vec_id, CAST(CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS INT) AS pred, greatest(p0, p1) AS softmax_confidence FROM pp""")
def q_softmax_confidence(spark, d):
    return CAL.softmax_confidence(_logits(spark, d), "z", T).select("vec_id", "pred", "softmax_confidence")


@query("softmax_confidence_scaled", views=("logits",), dbl=("softmax_confidence",), sql=f"""
WITH {_probs_sql(1.0)}
SELECT vec_id, CAST(CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS INT) AS pred, abs(p0 - p1) AS softmax_confidence FROM pp""")
def q_softmax_confidence_scaled(spark, d):
    return CAL.softmax_confidence(_logits(spark, d), "z", 1.0, scale=True).select("vec_id", "pred", "softmax_confidence")


@query("threshold_soft", views=("preds",), sql="""
SELECT doc_id, model, context, seed, CAST(stereo_pred_soft > 0.5 AS INT) AS pred FROM preds""")
def q_threshold_soft(spark, d):
    p = A.preds(spark, d)
    return p.select("doc_id", "model", "context", "seed", CAL.threshold_soft(F.col("stereo_pred_soft")).alias("pred"))


@query("agreement", views=("gold",), dbl=("iaa",), sql="""
SELECT doc_id, CASE WHEN stereo_soft > 0.2 AND stereo_soft < 0.8 THEN 0.67 ELSE 1.0 END AS iaa FROM gold""")
def q_agreement(spark, d):
    return A.gold(spark, d).select("doc_id", CAL.agreement(F.col("stereo_soft")).alias("iaa"))


@query("nll", views=("logits",), dbl=("nll", "weighted_nll"), sql=f"""
WITH {_probs_sql(T)},
cw AS (SELECT label, count(*) AS n_c FROM logits GROUP BY label),
w AS (SELECT label, sum(n_c) OVER () / (count(*) OVER () * n_c) AS w FROM cw),
l AS (SELECT pp.label, lse - CASE WHEN pp.label = 0 THEN z0 / {T!r} ELSE z1 / {T!r} END AS l, w.w FROM pp JOIN w USING (label))
SELECT avg(l) AS nll, sum(w * l) / sum(w) AS weighted_nll FROM l""")
def q_nll(spark, d):
    lg = _logits(spark, d)
    weights = {r["label"]: r["weight"] for r in class_weights(lg, "label").collect()}
    return CAL.nll(lg, [], "z", "label", T, weights)


@query("focal_loss", views=("logits",), dbl=("ce", "focal_loss"), sql=f"""
WITH {_probs_sql(1.0)},
b AS (SELECT floor(vec_id / 32) AS batch, avg(lse - CASE WHEN label = 0 THEN z0 ELSE z1 END) AS ce FROM pp GROUP BY floor(vec_id / 32))
SELECT batch, ce, 0.2 * pow(1 - exp(-ce), 5.0) * ce AS focal_loss FROM b""")
def q_focal_loss(spark, d):
    lg = _logits(spark, d).withColumn("batch", F.floor(F.col("vec_id") / 32))
    return CAL.focal_loss(lg, ["batch"], "z", "label")


@query("ece", views=("logits",), dbl=("ece",), sql=f"""
WITH {_probs_sql(1.0)},
x AS (SELECT greatest(p0, p1) AS conf, CAST((CASE WHEN p0 >= p1 THEN 0 ELSE 1 END) = label AS DOUBLE) AS acc FROM pp),
b AS (SELECT ceil(conf * 15) AS bin, count(*) AS n, avg(conf) AS c, avg(acc) AS a FROM x GROUP BY ceil(conf * 15))
SELECT sum(CASE WHEN bin > 0 THEN abs(c - a) * n / (SELECT count(*) FROM x) ELSE 0 END) AS ece FROM b""")
def q_ece(spark, d):
    return CAL.ece(_logits(spark, d), [], "z", "label")


@query("eval_logits_hard", views=("logits",), dbl=("accuracy", "precision_neg", "precision_pos", "recall_neg", "recall_pos",
                                                    "f1_neg", "f1_pos", "f1", "mcc"), sql=f"""
WITH {_probs_sql(1.0)},
c AS (SELECT count_if(label = 0 AND p0 >= p1) AS TN, count_if(label = 0 AND p0 < p1) AS FP,
  count_if(label = 1 AND p0 >= p1) AS FN, count_if(label = 1 AND p0 < p1) AS TP FROM pp),
m AS (SELECT CAST(TP + TN AS DOUBLE) / (TP + TN + FP + FN) AS accuracy,
  CASE WHEN TN + FN > 0 THEN CAST(TN AS DOUBLE) / (TN + FN) ELSE 0 END AS precision_neg,
  CASE WHEN TP + FP > 0 THEN CAST(TP AS DOUBLE) / (TP + FP) ELSE 0 END AS precision_pos,
  CASE WHEN TN + FP > 0 THEN CAST(TN AS DOUBLE) / (TN + FP) ELSE 0 END AS recall_neg,
  CASE WHEN TP + FN > 0 THEN CAST(TP AS DOUBLE) / (TP + FN) ELSE 0 END AS recall_pos,
  CASE WHEN 2*TN + FP + FN > 0 THEN 2.0 * TN / (2*TN + FP + FN) ELSE 0 END AS f1_neg,
  CASE WHEN 2*TP + FP + FN > 0 THEN 2.0 * TP / (2*TP + FP + FN) ELSE 0 END AS f1_pos,
  CASE WHEN (TP+FP)*(TP+FN)*(TN+FP)*(TN+FN) > 0 THEN (CAST(TP AS DOUBLE)*TN - CAST(FP AS DOUBLE)*FN)
       / sqrt(CAST(TP+FP AS DOUBLE)*(TP+FN)*(TN+FP)*(TN+FN)) ELSE 0 END AS mcc FROM c)
SELECT accuracy, precision_neg, precision_pos, recall_neg, recall_pos, f1_neg, f1_pos, (f1_neg + f1_pos) / 2 AS f1, mcc FROM m""")
def q_eval_logits_hard(spark, d):
    return CAL.eval_logits_hard(_logits(spark, d), [], "z", "label")


@query("eval_soft", views=("logits",), dbl=("ce", "rmse"), sql=f"""
WITH {_probs_sql(1.0)}
SELECT -sum(label * ln(least(greatest(p1, 1e-12), 1 - 1e-12) + 1e-9)) / count(*) AS ce,
  sqrt(avg(pow(label - p1, 2))) AS rmse FROM pp""")
def q_eval_soft(spark, d):
    x = _logits(spark, d)
    m = F.greatest("z0", "z1")
    x = x.withColumn("p1", F.exp(F.col("z1") - m) / (F.exp(F.col("z0") - m) + F.exp(F.col("z1") - m)))
    return CAL.eval_soft(x, [], "p1", "label")


GRID = [0.25 * k for k in range(1, 25)]


@query("temperature_grid", views=("logits",), dbl=("nll", "temperature"), sql=f"""
WITH t AS (SELECT unnest(range(1, 25)) * CAST(0.25 AS DOUBLE) AS temperature),
x AS (SELECT t.temperature, l.label, z0 / temperature AS a, z1 / temperature AS b FROM logits l CROSS JOIN t),
n AS (SELECT temperature, avg(greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) - CASE WHEN label = 0 THEN a ELSE b END) AS nll
  FROM x GROUP BY temperature)
SELECT arg_min(temperature, nll) AS temperature, min(nll) AS nll FROM n""")
def q_temperature_grid(spark, d):
    """E20 on a grid: the NLL of every temperature in one pass, the best one by min_by."""
    return CAL.temperature_grid(_logits(spark, d), [], "z", "label", GRID)


@query("fit_temperature")
def q_fit_temperature(spark, d):
    """Newton iterations (one aggregation each); no SQL oracle, checked against a brute-force grid in tests."""
    return CAL.fit_temperature(_logits(spark, d), [], "z", "label", t0=1.5)
