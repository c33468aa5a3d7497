"""Source / sink and gold-join queries.

Run files are first written by Spark from the `preds` table (one folder per run, named like the
reference's files) into a fresh folder under the session's checkpoint dir, then read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadlens.config import TOPICS
from threadlens.operators import evaluate as EV
from threadlens.operators import metrics as M
from threadlens.plans.q_evaluation import CELLS_SQL
from threadlens.plans.registry import query
from threadlens.session import ensure_checkpoint_dir
from threadlens.sources import adapters as A
from threadlens.sources import io as IO

RUN = ["model", "context", "seed"]
RUN_SCHEMA = "doc_id long, stereo int, stereo_pred int, softmax_confidence double"


def scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/threadlens-{name}-{uuid.uuid4().hex}"


def run_file_names():
    return F.concat(F.lit("stereohoax-"), F.col("model"), F.lit("-"), F.col("context"), F.lit("_hard_s"),
                    F.col("seed").cast("string"), F.lit("_max_tokens_512-task1.csv"))


#: Rows of a run in one of its files, about.
FILE_ROWS = 1_000_000


def save_run_files(p, path: str) -> None:
    """Each run's rows as CSV under a folder named like the run file, in as many files as its rows ask for, however ``p`` is cut."""
    most = p.groupBy(*RUN).count().agg(F.max("count")).first()[0] or 0
    slices = 1 + most // FILE_ROWS
    part = F.pmod(F.xxhash64("doc_id", "stereo_pred"), F.lit(slices))
    p = p.withColumn("file_name", run_file_names()).select("file_name", "doc_id", "stereo", "stereo_pred", "softmax_confidence")
    p.repartition("file_name", part).write.partitionBy("file_name").option("header", True).csv(path)


def write_run_files(spark, d) -> str:
    """S5-style writer: the runs of `preds` as files."""
    path = scratch(spark, "runs")
    save_run_files(A.preds(spark, d), path)
    return path


@query("parse_run", views=("run_files",), sql="""
SELECT file_name, 'stereohoax' AS data, regexp_extract(file_name, '^stereohoax-([a-z_]+?)-', 1) AS model,
  regexp_extract(file_name, '-(\\d_[a-z_]+?)_hard_', 1) AS context,
  CAST(regexp_extract(file_name, '-(\\d)_', 1) AS INT) AS context_level, 'hard' AS kind,
  CAST(regexp_extract(file_name, '_s(\\d+)_', 1) AS INT) AS seed, 'max_tokens_512' AS suffix, 1 AS task FROM run_files""")
def q_parse_run(spark, d):
    return IO.parse_run(A.run_files(spark, d))


@query("read_predictions", views=("preds",), sql=f"""
SELECT 'stereohoax' AS data, model, context, seed, {CELLS_SQL} FROM preds GROUP BY model, context, seed""")
def q_read_predictions(spark, d):
    runs = IO.read_predictions(spark, [write_run_files(spark, d)], RUN_SCHEMA)
    return M.confusion(runs, ["data", *RUN], "stereo")


@query("join_gold", views=("preds", "gold"), dbl=("stereo_soft", "softmax_confidence"), sql="""
SELECT p.doc_id, p.model, p.context, p.seed, p.stereo, p.stereo_pred, p.softmax_confidence,
  g.implicit, g.contextual, g.stereo_soft, g.quality
FROM preds p LEFT JOIN gold g USING (doc_id)""")
def q_join_gold(spark, d):
    p = A.preds(spark, d).select("doc_id", *RUN, "stereo", "stereo_pred", "softmax_confidence")
    joined, _ = EV.join_gold(p, A.gold(spark, d), ["doc_id"], RUN)
    return joined


@query("enrich_test", views=("gold", "tweets"), dbl=("stereo_soft",), sql=f"""
SELECT g.doc_id, g.stereo, g.quality, coalesce(s.stereo_soft, 0) AS stereo_soft, {", ".join(f"coalesce(t.{c}, 0) AS {c}" for c in TOPICS)}
FROM (SELECT doc_id, stereo, quality FROM gold) g LEFT JOIN (SELECT doc_id, stereo_soft FROM gold WHERE stereo = 1) s USING (doc_id)
LEFT JOIN (SELECT tweet_id AS doc_id, {", ".join(TOPICS)} FROM tweets) t USING (doc_id)""")
def q_enrich_test(spark, d):
    """Soft labels (of the items that have one) and all topics joined by key, nulls 0."""
    g = A.gold(spark, d)
    soft = g.where("stereo = 1").select("doc_id", "stereo_soft")
    cats = A.topic_preds(spark, d).select(F.col("tweet_id").alias("doc_id"), *TOPICS)
    return EV.enrich_test(g.select("doc_id", "stereo", "quality"), [soft, cats], ["doc_id"])


def _eval_sql() -> str:
    from threadlens.plans.q_evaluation import _TASK1_SQL

    return _TASK1_SQL


def _evaluate(spark, d):
    runs = IO.read_predictions(spark, [write_run_files(spark, d)], RUN_SCHEMA).drop("data", "suffix", "task",
                                                                                      "context_level", "file_name")
    metrics, _ = EV.evaluate_runs(runs, A.gold(spark, d), ["doc_id"], RUN, task=1, contextual=True, kind_col="kind")
    return metrics


def _evaluate_sql() -> str:
    from threadlens.plans import q_evaluation as QE

    return f"""
WITH c AS (
  SELECT model, context, seed, {QE.CELLS_SQL},
  {QE._acc_by_sql('implicit', '_explicit', '_implicit')},
  {QE._acc_by_sql('contextual', '_no_contextual', '_contextual')},
  {QE._conf_sql('softmax_confidence')}
  FROM preds GROUP BY model, context, seed)
SELECT *, {QE._METRICS1_SQL} FROM c"""


@query("evaluate_runs", views=("preds",), sql=_evaluate_sql())
def q_evaluate_runs(spark, d):
    return _evaluate(spark, d)


@query("stream_evaluate", views=("preds",), sql=_evaluate_sql())
def q_stream_evaluate(spark, d):
    """The run files streamed with the key check, micro-batches merged from the sink; the same rows as E15."""
    from threadlens.streaming.evaluate_stream import stream_evaluate, stream_metrics

    src = write_run_files(spark, d)
    out, ck = scratch(spark, "stream-out"), scratch(spark, "stream-ck")
    q = stream_evaluate(spark, src, RUN_SCHEMA + ", file_name string", A.gold(spark, d), ["doc_id"], out, ck,
                        contextual=True)
    q.awaitTermination()
    return stream_metrics(spark, out, contextual=True)
