"""Thread queries on the sentence corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.operators import context as X
from threadlens.operators import threads as TH
from threadlens.plans.registry import query
from threadlens.plans.sql_text import squeeze, strip
from threadlens.sources import adapters as A

KEYS = ["comment_id", "sentence_pos"]

_PREV = strip("string_agg(coalesce(sentence, ''), ' ' ORDER BY sentence_pos) OVER "
              "(PARTITION BY comment_id ORDER BY sentence_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
PREV_SQL = f"prev AS (SELECT *, coalesce({_PREV}, '') AS previous_sentences FROM corpus)"
COMMENTS_SQL = f"""comments AS (SELECT comment_id, arg_max(reply_to, sentence_pos) AS reply_to,
  {strip("arg_max(previous_sentences, sentence_pos) || ' ' || arg_max(sentence, sentence_pos)")} AS comment
  FROM prev GROUP BY comment_id)"""
ROOT_SQL = """nodes AS (SELECT comment_id AS id, arg_min(reply_to, sentence_pos) AS parent FROM corpus GROUP BY comment_id),
walk AS (SELECT * FROM (WITH RECURSIVE w(start, cur, parent, depth) AS (
    SELECT id, id, parent, 0 FROM nodes
    UNION ALL
    SELECT w.start, n.id, n.parent, w.depth + 1 FROM w JOIN nodes n ON n.id = w.parent
    WHERE w.cur <> w.parent AND w.depth < 10000)
  SELECT * FROM w)),
node_root AS (SELECT n.id, coalesce(CAST(max(CASE WHEN w.cur = w.parent THEN w.cur END) AS VARCHAR), 'UNAVAILABLE') AS root
  FROM nodes n LEFT JOIN walk w ON w.start = n.id GROUP BY n.id),
rooted AS (SELECT c.*, CASE WHEN c.reply_to = c.comment_id THEN CAST(c.comment_id AS VARCHAR)
  ELSE coalesce(r.root, 'UNAVAILABLE') END AS first_comment_id FROM corpus c LEFT JOIN node_root r ON r.id = c.reply_to)"""


@query("normalise_thread_ids", views=("thread_export",), sql=f"""
SELECT {strip('FILE_ID')} AS file_id, COMMENT_ID AS sentence_id,
  {strip('FILE_ID')} || split_part(COMMENT_ID, '_', 1) AS comment_id, split_part(COMMENT_ID, '_', 2) AS sentence_pos,
  {strip('FILE_ID')} || substr(THREAD, 1, length(THREAD) - 1) AS reply_to, USER_ID AS user_id,
  {strip(squeeze('COMMENT'))} AS sentence
FROM thread_export""")
def q_normalise_thread_ids(spark, d):
    return TH.normalise_thread_ids(A.thread_export(spark, d))


@query("previous_sentences", views=("corpus",), sql=f"WITH {PREV_SQL} SELECT comment_id, sentence_pos, previous_sentences FROM prev")
def q_previous_sentences(spark, d):
    return TH.previous_sentences(A.corpus(spark, d)).select(*KEYS, "previous_sentences")


@query("previous_sentence", views=("corpus",), sql="""
SELECT comment_id, sentence_pos, lag(sentence, 1, '') OVER (PARTITION BY comment_id ORDER BY sentence_pos) AS previous_sentence
FROM corpus""")
def q_previous_sentence(spark, d):
    return TH.previous_sentence(A.corpus(spark, d)).select(*KEYS, "previous_sentence")


@query("last_sentence", views=("corpus",), sql="""
SELECT comment_id, max(sentence_pos) AS sentence_pos, arg_max(reply_to, sentence_pos) AS reply_to,
  arg_max(sentence, sentence_pos) AS sentence FROM corpus GROUP BY comment_id""")
def q_last_sentence(spark, d):
    return TH.last_sentence(A.corpus(spark, d))


@query("comment_table", views=("corpus",), sql=f"WITH {PREV_SQL}, {COMMENTS_SQL} SELECT * FROM comments")
def q_comment_table(spark, d):
    return TH.comment_table(A.corpus(spark, d))


@query("find_root", views=("corpus",), sql=f"WITH {ROOT_SQL} SELECT comment_id, sentence_pos, first_comment_id FROM rooted")
def q_find_root(spark, d):
    return TH.find_root(A.corpus(spark, d)).select(*KEYS, "first_comment_id")


@query("thread_components", views=("corpus",), sql="""
WITH RECURSIVE e(a, b) AS (SELECT comment_id, reply_to FROM corpus UNION SELECT reply_to, comment_id FROM corpus
  UNION SELECT comment_id, comment_id FROM corpus),
reach(src, dst) AS (SELECT a, b FROM e UNION SELECT r.src, e.b FROM reach r JOIN e ON e.a = r.dst),
comp AS (SELECT src, min(dst) AS thread FROM reach GROUP BY src)
SELECT c.comment_id, c.sentence_pos, comp.thread FROM corpus c JOIN comp ON comp.src = c.comment_id""")
def q_thread_components(spark, d):
    return TH.thread_components(A.corpus(spark, d)).select(*KEYS, "thread")


_CONTEXT_SQL = f"""WITH {PREV_SQL}, {COMMENTS_SQL}, {ROOT_SQL},
r2 AS (SELECT r.*, p.previous_sentences FROM rooted r JOIN prev p USING (comment_id, sentence_pos)),
withp AS (SELECT r2.*, CASE WHEN r2.reply_to = r2.comment_id THEN '' ELSE coalesce(pc.comment, '') END AS previous_comment
          FROM r2 LEFT JOIN comments pc ON pc.comment_id = r2.reply_to),
withr AS (SELECT w.*, CASE WHEN w.first_comment_id = CAST(w.comment_id AS VARCHAR) THEN '' ELSE coalesce(rc.comment, '') END AS first_comment
          FROM withp w LEFT JOIN comments rc ON CAST(rc.comment_id AS VARCHAR) = w.first_comment_id)"""


@query("add_parent_text", views=("corpus",), sql=f"{_CONTEXT_SQL} SELECT comment_id, sentence_pos, previous_comment FROM withr")
def q_add_parent_text(spark, d):
    c = TH.previous_sentences(A.corpus(spark, d))
    return TH.add_parent_text(c, TH.comment_table(c)).select(*KEYS, "previous_comment")


@query("add_root_text", views=("corpus",), sql=f"{_CONTEXT_SQL} SELECT comment_id, sentence_pos, first_comment_id, first_comment FROM withr")
def q_add_root_text(spark, d):
    c = TH.previous_sentences(A.corpus(spark, d))
    return TH.add_root_text(TH.find_root(c), TH.comment_table(c)).select(*KEYS, "first_comment_id", "first_comment")


@query("add_news", views=("corpus", "news"), sql="""
SELECT c.comment_id, c.sentence_pos, c.file_id, n.news_title FROM corpus c LEFT JOIN news n USING (file_id)""")
def q_add_news(spark, d):
    return X.add_news(A.corpus(spark, d), A.news(spark, d)).select(*KEYS, "file_id", "news_title")


@query("context_columns", views=("corpus", "news"), sql=f"""{_CONTEXT_SQL}
SELECT w.comment_id, w.sentence_pos, w.previous_sentences, w.previous_comment, w.first_comment_id, w.first_comment, n.news_title
FROM withr w LEFT JOIN news n USING (file_id)""")
def q_context_columns(spark, d):
    out = TH.context_columns(A.corpus(spark, d), A.news(spark, d))
    return out.select(*KEYS, "previous_sentences", "previous_comment", "first_comment_id", "first_comment", "news_title")


@query("add_parent_labels", views=("tweets",), sql="""
SELECT t.tweet_id, p.stereo AS stereo_father, p.implicit AS implicit_father, p.contextual AS contextual_father,
  h.stereo AS stereo_head, h.implicit AS implicit_head, h.contextual AS contextual_head
FROM tweets t LEFT JOIN tweets p ON p.tweet_id = t.in_reply_to_tweet_id LEFT JOIN tweets h ON h.tweet_id = t.conversation_id""")
def q_add_parent_labels(spark, d):
    t = A.tweets(spark, d).select("tweet_id", "in_reply_to_tweet_id", "conversation_id", "stereo", "implicit", "contextual")
    out = TH.add_root_labels(TH.add_parent_labels(t))
    return out.select("tweet_id", "stereo_father", "implicit_father", "contextual_father", "stereo_head",
                      "implicit_head", "contextual_head")


def _arr(c: str) -> str:
    return f"array_to_string({c}, ',')"


@query("add_comment_label_arrays", views=("corpus",), sql=f"""WITH {ROOT_SQL},
arrs AS (SELECT comment_id, list(stereotype ORDER BY sentence_pos) AS s, list(implicit ORDER BY sentence_pos) AS i
         FROM corpus GROUP BY comment_id)
SELECT r.comment_id, r.sentence_pos,
  {_arr('list_slice(a.s, 1, r.sentence_pos - 1)')} AS stereotype_previous_sentences,
  {_arr('list_slice(a.i, 1, r.sentence_pos - 1)')} AS implicit_previous_sentences,
  {_arr('p.s')} AS stereotype_previous_comment, {_arr('p.i')} AS implicit_previous_comment,
  {_arr('f.s')} AS stereotype_first_comment, {_arr('f.i')} AS implicit_first_comment
FROM rooted r JOIN arrs a ON a.comment_id = r.comment_id LEFT JOIN arrs p ON p.comment_id = r.reply_to
LEFT JOIN arrs f ON CAST(f.comment_id AS VARCHAR) = r.first_comment_id""")
def q_add_comment_label_arrays(spark, d):
    out = TH.add_comment_label_arrays(TH.find_root(A.corpus(spark, d)))
    arrays = [f"{lab}_{w}" for w in ("previous_sentences", "previous_comment", "first_comment")
              for lab in ("stereotype", "implicit")]
    return out.select(*KEYS, *[F.array_join(F.col(c), ",").alias(c) for c in arrays])
