"""Hierarchical metric queries on the task-3 table."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.config import TOPICS
from threadlens.operators import evaluate as EV
from threadlens.operators import hierarchical as H
from threadlens.plans.registry import query
from threadlens.sources import adapters as A

LABELS = ["stereo", *TOPICS]
PREDS = [c + "_pred" for c in LABELS]
A_, B_ = H.A_PROP, H.B_PROP


def _sets(cols):
    return ["1", f"(1 - {cols[0]})", *cols]


def hier_sql(preds=PREDS, subsets=True, contextual=True, source="(SELECT 'r' AS run, * FROM topic_preds)") -> str:
    y, p = _sets(LABELS), _sets(preds)
    m = len(y)
    if subsets:
        tags = ["''", "CASE WHEN stereo = 1 THEN CASE WHEN implicit < 0.5 THEN '_explicit' ELSE '_implicit' END END"]
        if contextual:
            tags.append("CASE WHEN stereo = 1 THEN CASE WHEN contextual < 0.5 THEN '_no_contextual' ELSE '_contextual' END END")
        tag_expr = f"unnest(list_filter([{', '.join(tags)}], lambda z: z IS NOT NULL))"
    else:
        tag_expr = "''"
    nc = [f"CAST(Nc{k} AS DOUBLE)" for k in range(m)]
    N = "CAST(N AS DOUBLE)"
    hits = [f"({y[k]}) * ({p[k]})" for k in range(m)]
    h, ps, ls = " + ".join(hits), " + ".join(p), " + ".join(y)
    hf = f"2 * (({h}) / ({ps})) * (({h}) / ({ls})) / ((({h}) / ({ps})) + (({h}) / ({ls})))"
    C = f"((log2({N}) - 1) * {(B_ + 1) ** A_!r})"
    inv = [f"(1 + {C} * exp(-{A_!r} * log2({nc[k]} + {B_!r})))" for k in range(m)]
    num = " + ".join(f"{inv[k]} * {hits[k]}" for k in range(m))
    pp = f"(({num}) / ({' + '.join(f'{inv[k]} * ({p[k]})' for k in range(m))}))"
    pr = f"(({num}) / ({' + '.join(f'{inv[k]} * ({y[k]})' for k in range(m))}))"
    pf = f"2 * {pp} * {pr} / ({pp} + {pr})"
    ic = [f"(CASE WHEN {nc[k]} > 0 THEN -log2({nc[k]} / {N}) ELSE 0.0 END)" for k in range(m)]

    def ic_set(s):
        term = [f"(CASE WHEN ({s[k]}) = 1 THEN {ic[k]} ELSE 0.0 END)" for k in range(m)]
        desc = " + ".join(term[3:])
        ncat = " + ".join(f"({x})" for x in s[3:])
        return f"(({desc}) - (({ncat}) - 1) * {term[2]} + {term[1]})"

    union = [f"greatest({y[k]}, {p[k]})" for k in range(m)]
    unknown = " OR ".join(f"({nc[k]} = 0 AND ({p[k]}) = 1)" for k in range(m))
    icm = (f"CASE WHEN {unknown} THEN NULL ELSE "
           f"2 * {ic_set(y)} + 2 * {ic_set(p)} - 3 * {ic_set(union)} END")
    stats = ", ".join(f"sum({y[k]}) AS Nc{k}" for k in range(m))
    return f"""x AS (SELECT *, {tag_expr} AS subset FROM {source}),
st AS (SELECT run, subset, count(*) AS N, {stats} FROM x GROUP BY run, subset),
per AS (SELECT x.run, x.subset, {icm} AS icm, {hf} AS hf, {pf} AS pf FROM x JOIN st ON st.run = x.run AND st.subset = x.subset),
means AS (SELECT run, subset, avg(icm) AS icm, avg(hf) AS hf, avg(pf) AS pf
  FROM per GROUP BY run, subset)"""


def wide_sql(subs) -> str:
    cols = []
    for s in subs:
        for n, c in (("ICM", "icm"), ("Hierarchical-F", "hf"), ("Propensity-F", "pf")):
            cols.append(f"max(CASE WHEN subset = '{s}' THEN {c} END) AS \"{n}{s}\"")
    return "SELECT run, " + ", ".join(cols) + " FROM means GROUP BY run"


def _df(spark, d):
    return A.topic_preds(spark, d).withColumn("run", F.lit("r"))


_SUBS = H.subsets(True)
_DBL = [f"{n}{s}" for s in _SUBS for n in H.METRICS]


@query("hierarchical_metrics", views=("topic_preds",), dbl=_DBL, sql=f"WITH {hier_sql()} {wide_sql(_SUBS)}")
def q_hierarchical_metrics(spark, d):
    return H.hierarchical_metrics(_df(spark, d), ["run"], LABELS, contextual=True)


def _single(name: str, col: str, metric: str):
    @query(name, views=("topic_preds",), dbl=(metric,),
           sql=f"WITH {hier_sql(subsets=False)} SELECT 'r' AS run, {col} AS \"{metric}\" FROM means")
    def build(spark, d):
        out = H.hierarchical_metrics(_df(spark, d), ["run"], LABELS, split_subsets=False)
        return out.select("run", F.col(f"`{metric}`"))

    return build


_single("hierarchical_f", "hf", "Hierarchical-F")
_single("propensity_f", "pf", "Propensity-F")
_single("icm", "icm", "ICM")


@query("gold_upper_bound_hierarchical", views=("topic_preds",), dbl=H.METRICS,
       sql=f"WITH {hier_sql(preds=LABELS, subsets=False)} SELECT 'r' AS run, icm AS ICM, hf AS \"Hierarchical-F\", pf AS \"Propensity-F\" FROM means")
def q_gold_upper_bound_hierarchical(spark, d):
    df = _df(spark, d)
    for c in LABELS:
        df = df.withColumn(c + "_pred", F.col(c))
    return H.hierarchical_metrics(df, ["run"], LABELS, split_subsets=False)


_RUNS_SQL = "runs AS (SELECT 'base' AS run, * FROM topic_preds UNION ALL SELECT 'gold' AS run, * REPLACE (" + ", ".join(
    f"{c} AS {c}_pred" for c in LABELS) + ") FROM topic_preds UNION ALL SELECT 'none' AS run, * REPLACE (" + ", ".join(
    f"CAST(0 AS INT) AS {c}_pred" for c in LABELS) + ") FROM topic_preds)"


@query("evaluate_runs_task3", views=("topic_preds",), dbl=[*_DBL, "ICM_norm"], sql=f"""
WITH {_RUNS_SQL}, {hier_sql(source="runs")},
w AS ({wide_sql(_SUBS)})
SELECT *, CASE WHEN max("ICM") OVER () - min("ICM") OVER () <> 0
  THEN ("ICM" - min("ICM") OVER ()) / (max("ICM") OVER () - min("ICM") OVER ()) END AS ICM_norm FROM w""")
def q_evaluate_runs_task3(spark, d):
    """E15, task 3: several runs joined with gold (J7), hierarchical metrics in all subsets, ICM_norm (A10)."""
    t = A.topic_preds(spark, d)
    gold = t.select("tweet_id", *LABELS, "implicit", "contextual")
    keep = ["run", "tweet_id", "stereo", *PREDS]
    base = t.withColumn("run", F.lit("base")).select(keep)
    same = t.withColumns({c + "_pred": F.col(c) for c in LABELS}).withColumn("run", F.lit("gold")).select(keep)
    none = t.withColumns({c: F.lit(0) for c in PREDS}).withColumn("run", F.lit("none")).select(keep)
    metrics, _ = EV.evaluate_runs(base.unionByName(same).unionByName(none), gold, ["tweet_id"], ["run"], task=3, topics=TOPICS, contextual=True)
    return metrics
