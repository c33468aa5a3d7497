"""DuckDB text of the adapter views, used as CTEs by the oracle SQL (mirrors sources/adapters.py)."""

from __future__ import annotations

from threadlens.config import TOPICS

_TOPICS_SQL = ",\n  ".join(
    f"CAST(d.doc_id % 3 = 0 AND (d.doc_id*{7 + 2 * i}) % {9 + i} < 3 AS INT) AS {t}" for i, t in enumerate(TOPICS)
)
_TOPIC_PREDS_SQL = ",\n  ".join(
    f"t.{t}, CAST((t.{t} + CAST(t.tweet_id % {5 + i} = 1 AS INT)) % 2 AS INT) AS {t}_pred" for i, t in enumerate(TOPICS)
)

VIEWS: dict[str, str] = {
    "corpus": """
SELECT conv_id AS comment_id, CAST(turn + 1 AS INT) AS sentence_pos,
  CASE WHEN conv_id % 17 = 5 THEN conv_id + 1000000
       WHEN conv_id % 5 = 0 THEN conv_id ELSE conv_id - 1 END AS reply_to,
  concat('news', CAST(conv_id % 45 AS VARCHAR)) AS file_id, text AS sentence,
  CAST((conv_id*13 + turn*7) % 10 < 3 AS INT) AS stereotype,
  CAST((conv_id + turn) % 2 AS INT) AS implicit,
  CAST((conv_id*13 + turn*7 + 1) % 10 < 3 AS INT) AS stereotype_a1,
  CAST((conv_id*13 + turn*7) % 10 < 4 AS INT) AS stereotype_a2,
  CAST((conv_id*13 + turn*7) % 10 < 2 AS INT) AS stereotype_a3
FROM conversations""",
    "thread_export": """
SELECT concat(' f', CAST(conv_id % 45 AS VARCHAR), ' ') AS FILE_ID, role AS USER_ID,
  concat(CAST(conv_id AS VARCHAR), '_', CAST(turn + 1 AS VARCHAR)) AS COMMENT_ID,
  concat(CAST(CASE WHEN conv_id % 17 = 5 THEN conv_id + 1000000
       WHEN conv_id % 5 = 0 THEN conv_id ELSE conv_id - 1 END AS VARCHAR), 'R') AS THREAD,
  text AS COMMENT
FROM conversations""",
    "news": """
SELECT concat('news', CAST(item_id AS VARCHAR)) AS file_id, text AS news_title FROM benchmark""",
    "tweets": f"""
SELECT d.doc_id AS tweet_id, d.doc_id - d.doc_id % 6 AS conversation_id,
  CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE d.doc_id - 1 END AS in_reply_to_tweet_id,
  d.source AS rh_id, d.text AS text,
  CASE WHEN d.doc_id % 6 = 0 THEN '' WHEN d.doc_id % 11 = 0 THEN '[]'
       WHEN d.doc_id % 13 = 0 THEN d.text ELSE p.text END AS txt_father,
  CASE WHEN d.doc_id % 6 = 0 THEN '0' ELSE h.text END AS txt_head,
  concat('hoax ', d.source) AS rh_text,
  CAST(d.doc_id % 3 = 0 AS INT) AS stereo, CAST((d.doc_id*3) % 5 < 2 AS INT) AS implicit,
  CAST(d.doc_id % 4 = 1 AS INT) AS contextual,
  {_TOPICS_SQL}
FROM documents d LEFT JOIN documents p ON p.doc_id = d.doc_id - 1
LEFT JOIN documents h ON h.doc_id = d.doc_id - d.doc_id % 6""",
    "preds": """
SELECT l.doc_id, m.model, k.context, CAST(s.seed AS INT) AS seed, l.toxic AS stereo,
  CAST((l.doc_id*3) % 5 < 2 AS INT) AS implicit, CAST(l.doc_id % 3 = 0 AS INT) AS contextual,
  CASE WHEN (l.doc_id*7919 + s.seed*104729 + m.mid*31337 + k.kid*1299709) % 100 <
       CASE WHEN (l.doc_id*37 + k.kid*53 + m.mid*11) % 100 < 20 THEN 85
            WHEN (l.doc_id*37 + k.kid*53 + m.mid*11) % 100 < 50 THEN 30 ELSE 5 END
       THEN 1 - l.toxic ELSE l.toxic END AS stereo_pred,
  CAST(50 + (l.doc_id*31 + s.seed*17 + m.mid*7 + k.kid*13) % 50 AS DOUBLE) / 100 AS softmax_confidence,
  CASE WHEN l.toxic = 1 THEN CASE WHEN l.doc_id % 2 = 0 THEN CAST(0.9526 AS DOUBLE) ELSE CAST(0.7311 AS DOUBLE) END
       ELSE CASE WHEN l.doc_id % 2 = 0 THEN CAST(0.0474 AS DOUBLE) ELSE CAST(0.2689 AS DOUBLE) END END AS stereo_soft,
  CAST((l.doc_id*29 + s.seed*19 + m.mid*5 + k.kid*3) % 101 AS DOUBLE) / 100 AS stereo_pred_soft
FROM labels l
CROSS JOIN (VALUES (0,'beto'),(1,'roberta_bne'),(2,'mbert')) AS m(mid, model)
CROSS JOIN (VALUES (0,'0_no_context'),(2,'2_txt_father'),(3,'3_txt_head'),(4,'4_rh_text'),(5,'5_concat_contexts')) AS k(kid, context)
CROSS JOIN range(42, 52) AS s(seed)""",
    "gold": """
SELECT doc_id, toxic AS stereo, CAST((doc_id*3) % 5 < 2 AS INT) AS implicit,
  CAST(doc_id % 3 = 0 AS INT) AS contextual,
  CASE WHEN toxic = 1 THEN CASE WHEN doc_id % 2 = 0 THEN CAST(0.9526 AS DOUBLE) ELSE CAST(0.7311 AS DOUBLE) END
       ELSE CASE WHEN doc_id % 2 = 0 THEN CAST(0.0474 AS DOUBLE) ELSE CAST(0.2689 AS DOUBLE) END END AS stereo_soft,
  quality
FROM labels""",
    "topic_preds": f"""
SELECT t.tweet_id, t.stereo, t.implicit, t.contextual,
  CAST((t.stereo + CAST(t.tweet_id % 7 = 0 AS INT)) % 2 AS INT) AS stereo_pred,
  {_TOPIC_PREDS_SQL}
FROM tweets t""",
    "groups": """
SELECT c_custkey AS row_id, c_nationkey AS group_id,
  CAST(c_mktsegment = 'BUILDING' AS INT) AS l1, CAST(c_mktsegment = 'MACHINERY' AS INT) AS l2,
  CAST(c_acctbal < 0 AS INT) AS l3, CAST(c_acctbal > 5000 AS INT) AS l4
FROM customer""",
    "logits": """
SELECT vec_id, CAST(label % 2 AS INT) AS label,
  CAST(embedding[1] AS DOUBLE)*10 + CAST(label % 2 = 0 AS INT) AS z0,
  CAST(embedding[2] AS DOUBLE)*10 + CAST(label % 2 = 1 AS INT) AS z1
FROM embeddings""",
    "noisy": """
SELECT doc_id, concat(text, ' @ana_', CAST(doc_id AS VARCHAR),
  ' http://x.y/', CAST(doc_id AS VARCHAR), ' ', CAST(doc_id AS VARCHAR), '.5km abc',
  CAST(doc_id AS VARCHAR), ' ajajajaj jejeje ahahah texttd holaaaa :) ¿qué? #MiHashTag #2023') AS text
FROM documents""",
    "run_files": """
SELECT DISTINCT concat('stereohoax-', model, '-', context, '_hard_s', CAST(seed AS VARCHAR),
  '_max_tokens_512-task1.csv') AS file_name FROM preds""",
}

_DEPENDS = {"topic_preds": ["tweets"], "run_files": ["preds"]}


def with_views(views: list[str] | tuple[str, ...], body: str) -> str:
    """Prefix ``body`` with the adapter CTEs it uses (dependencies first)."""
    ordered: list[str] = []

    def add(v: str) -> None:
        for dep in _DEPENDS.get(v, []):
            add(dep)
        if v not in ordered:
            ordered.append(v)

    for v in views:
        add(v)
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]}\n)" for v in ordered)
    body = body.strip()
    if not ordered:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
