"""Context-building and model-view queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.config import STEREOHOAX
from threadlens.operators import context as X
from threadlens.plans.registry import query
from threadlens.plans.sql_text import strip
from threadlens.sources import adapters as A

CONTEXTS = STEREOHOAX.contexts  # txt_father, txt_head, rh_text (nearest -> farthest)
MISSING = "('', '0', '[]')"


@query("soft_label", views=("corpus",), dbl=("stereotype_soft",), sql="""
SELECT comment_id, sentence_pos, round_even(1 / (1 + exp(CAST(3 - 2 * (coalesce(stereotype_a1, 0) + coalesce(stereotype_a2, 0)
  + coalesce(stereotype_a3, 0)) AS DOUBLE))), 4) AS stereotype_soft FROM corpus""")
def q_soft_label(spark, d):
    return X.soft_label(A.corpus(spark, d), ["stereotype", "implicit"]).select("comment_id", "sentence_pos", "stereotype_soft")


def _fill_sql(flags: bool) -> str:
    """Sequential CTEs replaying F12 over (txt_father, txt_head, rh_text)."""
    steps = ["f0 AS (SELECT tweet_id, text, txt_father, txt_head, coalesce(rh_text, '') AS rh_text, "
             "coalesce(rh_text, '') AS concat_contexts FROM tweets)"]
    n = len(CONTEXTS)
    prev = "f0"
    for i, cont in enumerate(CONTEXTS[:-1][::-1]):
        nxt = CONTEXTS[n - 1 - i]
        a, b = f"s{i}a", f"s{i}b"
        steps.append(f"""{a} AS (SELECT * REPLACE (CASE WHEN coalesce({cont}, '') = text THEN '' ELSE coalesce({cont}, '') END AS {cont}) FROM {prev})""")
        steps.append(f"""{b} AS (SELECT * REPLACE (
    CASE WHEN {cont} IN {MISSING} THEN {nxt} ELSE {cont} END AS {cont},
    CASE WHEN (CASE WHEN {cont} IN {MISSING} THEN '' ELSE {cont} END) <> {nxt}
         THEN {strip(f"(CASE WHEN {cont} IN {MISSING} THEN '' ELSE {cont} END) || ' ' || concat_contexts")}
         ELSE concat_contexts END AS concat_contexts),
    {cont} IN {MISSING} AS _missing_{cont} FROM {a})""")
        prev = b
    return "WITH " + ",\n".join(steps) + f"\nSELECT * FROM {prev}"


@query("fill_context", views=("tweets",), sql=_fill_sql(False).replace(
    "SELECT * FROM s1b", "SELECT tweet_id, txt_father, txt_head, rh_text, concat_contexts FROM s1b"))
def q_fill_context(spark, d):
    t = A.tweets(spark, d)
    return X.fill_context(t, "text", CONTEXTS).select("tweet_id", *CONTEXTS, "concat_contexts")


@query("missing_context_report", views=("tweets",), dbl=("pct",), sql=_fill_sql(True).replace("SELECT * FROM s1b", """,
r AS (SELECT count(*) AS n, count_if(_missing_txt_father) AS txt_father, count_if(_missing_txt_head) AS txt_head FROM s1b)
SELECT 'txt_father' AS context, txt_father AS missing, txt_father / n * 100 AS pct FROM r
UNION ALL SELECT 'txt_head', txt_head, txt_head / n * 100 FROM r"""))
def q_missing_context_report(spark, d):
    filled = X.fill_context(A.tweets(spark, d), "text", CONTEXTS, keep_flags=True)
    return X.missing_context_report(filled, CONTEXTS)


@query("model_view", views=("tweets",), sql="SELECT text, stereo AS labels, txt_father AS parent_text FROM tweets")
def q_model_view(spark, d):
    return X.model_view(A.tweets(spark, d), "text", "stereo", "txt_father")


@query("append_context", views=("tweets",), sql="SELECT txt_head || ' ' || text AS text, stereo AS labels FROM tweets")
def q_append_context(spark, d):
    return X.append_context(A.tweets(spark, d), "txt_head", "text").select("text", F.col("stereo").alias("labels"))


@query("drop_missing_context", views=("tweets",), sql=f"""
SELECT tweet_id, txt_father FROM (SELECT tweet_id, txt_father, text, stereo FROM tweets)
WHERE txt_father NOT IN {MISSING} AND tweet_id IS NOT NULL AND txt_father IS NOT NULL AND text IS NOT NULL AND stereo IS NOT NULL""")
def q_drop_missing_context(spark, d):
    t = A.tweets(spark, d).select("tweet_id", "txt_father", "text", "stereo")
    return X.drop_missing_context(t, "txt_father").select("tweet_id", "txt_father")


@query("drop_context_equal_text", views=("tweets",), sql="""
SELECT tweet_id FROM (SELECT tweet_id, txt_father, text, stereo FROM tweets)
WHERE (txt_father IS DISTINCT FROM text OR txt_father IS NULL) AND tweet_id IS NOT NULL AND txt_father IS NOT NULL
  AND text IS NOT NULL AND stereo IS NOT NULL""")
def q_drop_context_equal_text(spark, d):
    t = A.tweets(spark, d).select("tweet_id", "txt_father", "text", "stereo")
    return X.drop_context_equal_text(t, "txt_father", "text").select("tweet_id")


@query("refill_context_equal_text", views=("tweets",), sql="""
SELECT tweet_id, coalesce(CASE WHEN txt_father <> text OR text IS NULL OR txt_father IS NULL THEN txt_father END,
  CASE WHEN txt_head <> text OR text IS NULL OR txt_head IS NULL THEN txt_head END,
  CASE WHEN rh_text <> text OR text IS NULL OR rh_text IS NULL THEN rh_text END, rh_text) AS txt_father FROM tweets""")
def q_refill_context_equal_text(spark, d):
    t = X.refill_context_equal_text(A.tweets(spark, d), "txt_father", "text", CONTEXTS)
    return t.select("tweet_id", "txt_father")


@query("debug_context", views=("tweets",), sql="""
SELECT tweet_id, CASE WHEN stereo = 1 THEN 'con estereotipo' ELSE 'sin estereotipo' END AS debug FROM tweets""")
def q_debug_context(spark, d):
    return X.debug_context(A.tweets(spark, d), "stereo").select("tweet_id", "debug")


@query("mark_same_context", views=("tweets",), sql="""
WITH m1 AS (SELECT tweet_id, txt_father, CASE WHEN txt_father = txt_head THEN 'igual al father' ELSE txt_head END AS txt_head, rh_text FROM tweets),
m2 AS (SELECT * REPLACE (CASE WHEN txt_father = rh_text THEN 'igual al rh_text' ELSE txt_father END AS txt_father) FROM m1)
SELECT * REPLACE (CASE WHEN txt_head = rh_text THEN 'igual al rh_text' ELSE txt_head END AS txt_head) FROM m2""")
def q_mark_same_context(spark, d):
    t = A.tweets(spark, d).select("tweet_id", "txt_father", "txt_head", "rh_text")
    return X.mark_same_context(t)


_STACK = [None, "txt_father", "txt_head", "rh_text", "concat_contexts"]


@query("stack_contexts", views=("tweets",), sql="""
WITH f AS (SELECT tweet_id, text, stereo, txt_father, txt_head, rh_text, rh_text AS concat_contexts FROM tweets)
SELECT tweet_id, '0_no_context' AS context, text, stereo AS labels, CAST(NULL AS VARCHAR) AS parent_text FROM f
UNION ALL SELECT tweet_id, 'txt_head', text, stereo, txt_head FROM f
UNION ALL SELECT tweet_id, 'rh_text', text, stereo, rh_text FROM f""")
def q_stack_contexts(spark, d):
    t = A.tweets(spark, d).withColumn("concat_contexts", F.col("rh_text"))
    ctx = X.context_spec(("all", "txt_father", "concat_contexts"), _STACK)
    return X.stack_contexts(t, ["tweet_id"], "text", "stereo", ctx)
