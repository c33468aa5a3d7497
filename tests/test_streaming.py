"""Metrics from the file stream equal the batch evaluation of the same run files."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from threadlens.operators import evaluate as EV
from threadlens.plans.q_sources import RUN, RUN_SCHEMA, scratch, write_run_files
from threadlens.sources import adapters as A
from threadlens.sources import io as IO
from threadlens.streaming.evaluate_stream import stream_evaluate, stream_metrics, stream_rejects


def _rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_stream_equals_batch(spark):
    src = write_run_files(spark, SF_SMALL)
    gold = A.gold(spark, SF_SMALL)
    out, ck = scratch(spark, "t-out"), scratch(spark, "t-ck")
    q = stream_evaluate(spark, src, RUN_SCHEMA + ", file_name string", gold, ["doc_id"], out, ck, contextual=True,
                        max_files_per_trigger=400)
    q.awaitTermination()
    streamed = stream_metrics(spark, out, contextual=True)
    assert stream_rejects(spark, out).count() == 0
    runs = IO.read_predictions(spark, [src], RUN_SCHEMA)
    batch, rejects = EV.evaluate_runs(runs, gold, ["doc_id"], RUN, task=1, contextual=True)
    assert rejects.count() == 0
    assert streamed.select("model", "context", "seed").distinct().count() == 150
    assert _rows(streamed.select(*batch.columns)) == _rows(batch)


def test_join_gold_rejects_duplicate_keys(spark):
    p = A.preds(spark, SF_SMALL).select("doc_id", *RUN, "stereo", "stereo_pred")
    dup = p.unionByName(p.filter((F.col("model") == "beto") & (F.col("seed") == 42) & (F.col("context") == "0_no_context")))
    joined, rejects = EV.join_gold(dup, A.gold(spark, SF_SMALL), ["doc_id"], RUN)
    assert [tuple(r) for r in rejects.collect()] == [("beto", "0_no_context", 42)]
    assert joined.select(*RUN).distinct().count() == 149


def small_runs(spark, path, names, ids):
    """Run files of a few rows: one folder named like the run file each."""
    for i, name in enumerate(names):
        rows = [(k, k % 2, (k + i) % 3 % 2, 0.5 + k / 100) for k in ids]
        spark.createDataFrame(rows, RUN_SCHEMA).coalesce(1).write.mode("append").option("header", True).csv(f"{path}/file_name={name}")


def test_repeated_keys_reject_and_replays_change_nothing(spark):
    """A key that comes again in a later batch rejects its run; a batch that is run again leaves the results as they are."""
    import glob
    import os

    src, out, ck = scratch(spark, "t-src"), scratch(spark, "t-out"), scratch(spark, "t-ck")
    src, out, ck = (x.removeprefix("file:") for x in (src, out, ck))
    gold = spark.createDataFrame([(k, k % 2, k % 3, 0.25) for k in range(40)], "doc_id long, implicit int, contextual int, stereo_soft double")
    names = [f"stereohoax-beto-{c}_hard_s{s}_max_tokens_512-task1.csv" for c in ("0_no_context", "2_txt_father") for s in (42, 43)]

    def advance():
        stream_evaluate(spark, src, RUN_SCHEMA + ", file_name string", gold, ["doc_id"], out, ck, contextual=True).awaitTermination()
        runs = IO.read_predictions(spark, [src], RUN_SCHEMA)
        batch, rejects = EV.evaluate_runs(runs, gold, ["doc_id"], RUN, task=1, contextual=True)
        assert _rows(stream_metrics(spark, out, contextual=True).select(*batch.columns)) == _rows(batch)
        assert _rows(stream_rejects(spark, out)) == _rows(rejects)
        return _rows(batch), _rows(rejects)

    small_runs(spark, src, names, range(15))
    first, rejects = advance()
    assert len(first) == 4 and rejects == []
    small_runs(spark, src, names, range(15, 31))  # the runs go on in further files
    small_runs(spark, src, names[3:], range(14, 15))  # one key of the last run for the second time
    second, rejects = advance()
    assert len(second) == 3 and rejects == [("2_txt_father", "beto", 43)] and second[0] != first[0]
    last = max(glob.glob(f"{ck}/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    for f in glob.glob(f"{ck}/commits/.*.crc"):
        os.remove(f)
    os.remove(last)  # as if the stream had been lost before it noted the batch: it runs again
    assert advance() == (second, rejects)
    small_runs(spark, src, names[3:], range(31, 33))  # a rejected run stays rejected
    assert advance() == (second, rejects)


def test_stream_needs_unique_gold(spark):
    import pytest

    gold = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, implicit int")
    with pytest.raises(EV.MergeError):
        stream_evaluate(spark, scratch(spark, "none"), RUN_SCHEMA, gold, ["doc_id"], "", "")
