"""Context-effect analysis queries (C1-C7, U1, F17) on the seed-averaged runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.config import ANALYSIS_THRESHOLD, NO_CONTEXT
from threadlens.operators import changes as C
from threadlens.operators import seeds as S
from threadlens.operators.context import mark_same_context
from threadlens.plans.registry import query
from threadlens.sources import adapters as A

CTX = ["2_txt_father", "3_txt_head", "4_rh_text", "5_concat_contexts"]
SUM_CTX = CTX[:-1]
T = ANALYSIS_THRESHOLD
LO, HI = f"CAST({T} AS DOUBLE)", f"CAST({1 - T} AS DOUBLE)"


def _q(c: str) -> str:
    return f'"{c}"'


def _label_sql(pc: str) -> str:
    return (f"CASE WHEN stereo = 1 AND p0 >= {HI} AND {pc} <= {LO} THEN 'empeora (FN)' "
            f"WHEN stereo = 1 AND p0 <= {LO} AND {pc} >= {HI} THEN 'mejora (TP)' "
            f"WHEN stereo = 0 AND p0 <= {LO} AND {pc} >= {HI} THEN 'empeora (FP)' "
            f"WHEN stereo = 0 AND p0 >= {HI} AND {pc} <= {LO} THEN 'mejora (TN)' ELSE '' END")


def changes_sql(contexts=CTX, run_filter: str = "TRUE", extra_group: str = "") -> str:
    """CTEs avg, wide, changes (rows changed in any context)."""
    g = f"{extra_group}, " if extra_group else ""
    wide_cols = ", ".join(f"max(CASE WHEN context = '{c}' THEN p END) AS {_q('p_' + c)}" for c in contexts)
    labels = ", ".join(f"{_label_sql(_q('p_' + c))} AS {_q(c)}" for c in contexts)
    any_changed = " OR ".join(f"{_q(c)} <> ''" for c in contexts)
    return f"""
avg_p AS (SELECT {g}doc_id, model, context, arg_max(stereo, seed) AS stereo, avg(stereo_pred) AS p
          FROM preds WHERE {run_filter} GROUP BY {g}doc_id, model, context),
wide AS (SELECT {g}model, doc_id, max(CASE WHEN context = '{NO_CONTEXT}' THEN stereo END) AS stereo,
         max(CASE WHEN context = '{NO_CONTEXT}' THEN p END) AS p0, {wide_cols}
         FROM avg_p GROUP BY {g}model, doc_id HAVING count_if(context = '{NO_CONTEXT}') > 0),
labeled AS (SELECT {g}model, doc_id, stereo, {labels} FROM wide),
changes AS (SELECT * FROM labeled WHERE {any_changed})"""


def avg_runs(spark, d):
    return S.seed_average_hard(A.preds(spark, d), ["doc_id"])


def changes(spark, d):
    return C.context_changes_from_runs(A.preds(spark, d), ["doc_id"], CTX, T)


@query("context_changes", views=("preds",), sql=f"WITH {changes_sql()} SELECT * FROM changes")
def q_context_changes(spark, d):
    return changes(spark, d)


@query("context_changes_from_averages", views=("preds",), sql=f"WITH {changes_sql()} SELECT * FROM changes")
def q_context_changes_from_averages(spark, d):
    """C1 on an A6 output (seed averages per item x model x context), pivoted by context."""
    return C.context_changes(avg_runs(spark, d), ["doc_id"], CTX, T)


def _analysis_sql() -> str:
    return f"""WITH {changes_sql()},
att AS (SELECT tweet_id AS doc_id, txt_father, txt_head, rh_text, implicit, contextual FROM tweets),
j AS (SELECT c.*, att.txt_father, att.txt_head, att.rh_text, att.implicit, att.contextual
      FROM changes c LEFT JOIN att USING (doc_id)),
m1 AS (SELECT * REPLACE (CASE WHEN txt_father = txt_head THEN 'igual al father' ELSE txt_head END AS txt_head) FROM j),
m2 AS (SELECT * REPLACE (CASE WHEN txt_father = rh_text THEN 'igual al rh_text' ELSE txt_father END AS txt_father) FROM m1)
SELECT * REPLACE (CASE WHEN txt_head = rh_text THEN 'igual al rh_text' ELSE txt_head END AS txt_head) FROM m2"""


def analysis(spark, d):
    att = A.tweets(spark, d).select(F.col("tweet_id").alias("doc_id"), "txt_father", "txt_head", "rh_text",
                                    "implicit", "contextual")
    return C.context_analysis(changes(spark, d), att, ["doc_id"], mark_same_context)


@query("context_analysis", views=("preds", "tweets"), sql=_analysis_sql())
def q_context_analysis(spark, d):
    return analysis(spark, d)


_COUNTS_SQL = f"""
avg0 AS (SELECT doc_id, model, arg_max(stereo, seed) AS stereo, avg(stereo_pred) AS p
         FROM preds WHERE context = '{NO_CONTEXT}' GROUP BY doc_id, model),
counts AS (SELECT model, count_if(stereo = 0 AND p >= {HI}) AS FP, count_if(stereo = 0 AND p <= {LO}) AS TN,
  count_if(stereo = 1 AND p <= {LO}) AS FN, count_if(stereo = 1 AND p >= {HI}) AS TP,
  count_if(stereo = 0) AS n_neg, count_if(stereo = 1) AS n_pos FROM avg0 GROUP BY model)"""


@query("no_context_counts", views=("preds",), dbl=("FP_pct", "TN_pct", "FN_pct", "TP_pct"), sql=f"""
WITH {_COUNTS_SQL}
SELECT model, FP, TN, FN, TP, FP / nullif(n_neg, 0) * 100 AS FP_pct, TN / nullif(n_neg, 0) * 100 AS TN_pct,
  FN / nullif(n_pos, 0) * 100 AS FN_pct, TP / nullif(n_pos, 0) * 100 AS TP_pct FROM counts""")
def q_no_context_counts(spark, d):
    return C.no_context_counts(avg_runs(spark, d), T)


def _summary_sql(contexts=SUM_CTX) -> str:
    counts = ", ".join(f"count_if(context = '{c}') AS {_q(c)}" for c in contexts)
    ctx_list = ", ".join(_q(c) for c in contexts)
    return f"""
long AS (UNPIVOT (SELECT model, stereo, {ctx_list} FROM changes) ON {ctx_list} INTO NAME context VALUE "index"),
cnt AS (SELECT model, stereo, "index", {counts} FROM long WHERE "index" <> '' GROUP BY model, stereo, "index"),
skel AS (SELECT DISTINCT c.model, k.stereo, k."index" FROM changes c
         CROSS JOIN (VALUES (0, 'empeora (FP)'), (0, 'mejora (TN)'), (1, 'empeora (FN)'), (1, 'mejora (TP)')) AS k(stereo, "index")),
summary AS (SELECT s.model, s.stereo, s."index", {", ".join(f"CAST(coalesce(cnt.{_q(c)}, 0) AS BIGINT) AS {_q(c)}" for c in contexts)},
  CASE WHEN s."index" LIKE '%mejora%' THEN '↑' ELSE '↓' END AS arrows
  FROM skel s LEFT JOIN cnt USING (model, stereo, "index"))"""


@query("change_summary", views=("preds",), sql=f"WITH {changes_sql()}, {_summary_sql()} SELECT * FROM summary")
def q_change_summary(spark, d):
    return C.change_summary(changes(spark, d), SUM_CTX)


def _pct_sql(c: str) -> str:
    return (f"CASE WHEN {_q(c)} > 0 THEN '(' || CAST(CAST(round_even(CAST({_q(c)} AS DOUBLE) / nullif(total, 0) * 100, 0) AS BIGINT) AS VARCHAR)"
            f" || '% ' || arrows || ')' ELSE '' END AS {_q(c[0] + ' %')}")


@query("add_change_pct", views=("preds",), sql=f"""
WITH {changes_sql()}, {_summary_sql()}, {_COUNTS_SQL},
bases AS (UNPIVOT (SELECT model, FP, TN, FN, TP FROM counts) ON FP, TN, FN, TP INTO NAME cell VALUE total),
j AS (SELECT s.*, b.total FROM summary s LEFT JOIN bases b ON b.model = s.model AND b.cell = substr(s."index", -3, 2))
SELECT model, stereo, "index", {", ".join(_q(c) for c in SUM_CTX)}, arrows, {", ".join(_pct_sql(c) for c in SUM_CTX)}, total FROM j""")
def q_add_change_pct(spark, d):
    avg = avg_runs(spark, d)
    summary = C.change_summary(C.context_changes(avg, ["doc_id"], CTX, T), SUM_CTX)
    return C.add_change_pct(summary, C.no_context_counts(avg, T), SUM_CTX)


@query("change_attribute_sums", views=("preds", "tweets"), sql=f"""
{_analysis_sql()[:_analysis_sql().rindex("SELECT * REPLACE")]}, an AS (SELECT * REPLACE (CASE WHEN txt_head = rh_text THEN 'igual al rh_text' ELSE txt_head END AS txt_head) FROM m2),
long AS (UNPIVOT (SELECT model, doc_id, implicit, contextual, {", ".join(_q(c) for c in CTX)} FROM an)
         ON {", ".join(_q(c) for c in CTX)} INTO NAME context VALUE "index")
SELECT model, context, "index", CAST(sum(implicit) AS BIGINT) AS implicit, CAST(sum(contextual) AS BIGINT) AS contextual
FROM long WHERE "index" <> '' GROUP BY model, context, "index" """)
def q_change_attribute_sums(spark, d):
    long = C.changes_long(analysis(spark, d), CTX, ["model", "doc_id", "implicit", "contextual"])
    return C.change_attribute_sums(long, ["implicit", "contextual"])


def _convergence_sql() -> str:
    base = changes_sql(SUM_CTX, extra_group="n_seeds").replace(
        "FROM preds WHERE TRUE", "FROM preds JOIN (VALUES (2), (4), (6), (8), (10)) AS b(n_seeds) ON seed < 42 + n_seeds")
    counts = ", ".join(f"count_if(context = '{c}') AS {_q(c)}" for c in SUM_CTX)
    ctx_list = ", ".join(_q(c) for c in SUM_CTX)
    return f"""WITH {base},
long AS (UNPIVOT (SELECT n_seeds, model, stereo, {ctx_list} FROM labeled) ON {ctx_list} INTO NAME context VALUE "index")
SELECT n_seeds, model, stereo, "index", {counts} FROM long WHERE "index" <> '' GROUP BY n_seeds, model, stereo, "index" """


@query("seed_convergence", views=("preds",), sql=_convergence_sql())
def q_seed_convergence(spark, d):
    return C.seed_convergence(A.preds(spark, d), [2, 4, 6, 8, 10], ["doc_id"], SUM_CTX, T)


@query("common_changed_items", views=("preds",), sql=f"""
WITH {changes_sql()},
long AS (UNPIVOT changes ON {", ".join(_q(c) for c in CTX)} INTO NAME context VALUE "index")
SELECT context, stereo, doc_id FROM long WHERE "index" <> '' AND model = 'beto'
INTERSECT
SELECT context, stereo, doc_id FROM long WHERE "index" <> '' AND model = 'roberta_bne'""")
def q_common_changed_items(spark, d):
    long = C.changes_long(changes(spark, d), CTX, ["model", "doc_id", "stereo"])
    return C.common_changed_items(long, ["doc_id"], "beto", "roberta_bne")
