"""Score run files as they land, with the batch path's 1:1 key check, keeping exact metrics per run.

A file-source stream keeps one state row for each (run, key): how often the key has come. Keys that come for the
first time go on to the metrics of their micro-batch; a key that comes again, in whatever file or batch, rejects its run.
State is keyed by run and key together, so a run of any size is spread over all state partitions.

Every micro-batch writes what it adds (counts, means and squared deviations per run) and the runs that it
rejects to folders named by its number, replacing them if the batch is replayed. ``stream_metrics`` merges what all
batches have added; ``stream_rejects`` lists the rejected runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.operators import metrics as M
from threadlens.operators.evaluate import MergeError
from threadlens.session import write_shared
from threadlens.sources.io import with_run


def moments(target: str = "stereo", confidence: Sequence[str] = ("softmax_confidence",), soft: bool = False,
            contextual: bool = False) -> list[tuple[str, str, Column]]:
    """(metric, kind, value) of all task-1 metrics that are not made of cell counts.

    value is null outside the rows that count; kind says what the metric is of their mean or deviation.
    """
    t, p = F.col(target), F.col(target + "_pred")
    out = []
    splits = [("implicit", "_explicit", "_implicit")] + ([("contextual", "_no_contextual", "_contextual")] if contextual else [])
    for column, without, having in splits:
        for rows, suffix in ((F.col(column) < 0.5, without), (F.col(column) >= 0.5, having)):
            out.append(("accuracy" + suffix, "mean", F.when((t == 1) & rows, (p == t).cast("double"))))
    cells = [("", F.lit(True)), *[(f"{c}_", M._cell(t, p, c)) for c in M.CELLS]]
    for conf in confidence:
        for prefix, rows in cells:
            value = F.when(rows, F.col(conf).cast("double"))
            out += [(prefix + conf, "mean", value), (prefix + conf + "_std", "sd", value)]
    if soft:
        gold, guess = F.col(target + "_soft"), F.col(target + "_pred_soft")
        for prefix, rows in cells:
            out.append((prefix + "cross_entropy", "minus", F.when(rows, F.coalesce(M._ce_terms(gold, guess), F.lit(0.0)))))
            out.append((prefix + "MSE", "root", F.when(rows, F.pow(gold - guess, 2))))
    return out


def batch_moments(joined: DataFrame, run: Sequence[str], target: str, **options) -> DataFrame:
    """What the rows of one micro-batch add to the metrics of their runs."""
    t, p = F.col(target), F.col(target + "_pred")
    aggs = [F.count_if(M._cell(t, p, c)).alias(c) for c in M.CELLS]
    for name, _, value in moments(target, **options):
        aggs += [F.count(value).alias(f"n:{name}"), F.avg(value).alias(f"mean:{name}"), (F.var_pop(value) * F.count(value)).alias(f"m2:{name}")]
    return joined.groupBy(*run).agg(*aggs)


def merged_metrics(added: DataFrame, run: Sequence[str], target: str, **options) -> DataFrame:
    """Metrics of every run from what its micro-batches added."""
    same, kinds = Window.partitionBy(*run), [(n, k) for n, k, _ in moments(target, **options)]
    n, mean, m2 = ({name: F.col(f"`{part}:{name}`") for name, _ in kinds} for part in ("n", "mean", "m2"))
    whole = added.select("*", *[(F.sum(n[x] * mean[x]).over(same) / F.nullif(F.sum(n[x]).over(same), F.lit(0))).alias(f"all:{x}") for x, _ in kinds])
    aggs = [F.sum(c).alias(c) for c in M.CELLS]
    for name, kind in kinds:
        at = F.col(f"`all:{name}`")
        if kind == "sd":
            total = F.sum(n[name])
            value = F.when(total > 1, F.sqrt(F.sum(m2[name] + n[name] * F.pow(mean[name] - at, 2)) / (total - 1)))
        else:
            value = {"mean": F.max(at), "minus": -F.max(at), "root": F.sqrt(F.max(at))}[kind]
        aggs.append(F.coalesce(value, F.lit(0.0)).alias(name))
    grouped = whole.groupBy(*run).agg(*aggs)
    return M.metrics_from_confusion(grouped, keep=[*run, *M.CELLS, *[name for name, _ in kinds]])


def stream_evaluate(spark: SparkSession, source_dir: str, schema: T.StructType | str, test: DataFrame,
                    keys: Sequence[str], out_dir: str, checkpoint_dir: str, run: Sequence[str] = ("model", "context", "seed"),
                    target: str = "stereo", contextual: bool = False, soft: bool = False,
                    max_files_per_trigger: int | None = None, available_now: bool = True):
    """Start the stream and return the StreamingQuery; read its results with ``stream_metrics`` and ``stream_rejects``.

    ``test`` must be unique on ``keys`` (``MergeError`` otherwise); its attributes that the runs lack are joined to every row, as
    in the batch path. A null key is a key like any other. A run is rejected from the batch on in which one of its
    keys repeats, whatever it scored before.
    """
    if test.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise MergeError("test table is not unique on " + ", ".join(keys))
    reader = spark.readStream.schema(schema).option("header", True).option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    runs = with_run(reader.option("enforceSchema", False).csv(source_dir))
    by = [*run, *keys]
    # of the rest, the state keeps only what the metrics read
    read = {target, target + "_pred", "softmax_confidence", "implicit", "contextual", target + "_soft", target + "_pred_soft"}
    values = [c for c in runs.columns if c in read and c not in by]
    # a key that has come once has its values in the state; of one that came again only the count matters
    seen = runs.groupBy(*by).agg(F.count("*").alias("times"), *[F.max(c).alias(c) for c in values])
    extra = [c for c in test.columns if c not in runs.columns or c in keys]
    confidence = [c for c in ("softmax_confidence",) if c in runs.columns or c in extra]

    def write(batch: DataFrame, batch_id: int) -> None:
        # update mode: the (run, key) pairs that this batch has touched, with all their occurrences so far
        batch = write_shared(batch, "touched")  # read twice
        joined = batch.where("times = 1").join(test.select(*extra), list(keys), "left")
        added = batch_moments(joined, run, target, confidence=confidence, soft=soft, contextual=contextual)
        added.write.mode("overwrite").parquet(f"{out_dir}/added/batch={batch_id}")
        batch.where("times > 1").select(*run).distinct().write.mode("overwrite").parquet(f"{out_dir}/rejects/batch={batch_id}")

    writer = seen.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def stream_rejects(spark: SparkSession, out_dir: str, run: Sequence[str] = ("model", "context", "seed")) -> DataFrame:
    """The runs with a repeated key, as far as the stream has come."""
    return spark.read.parquet(f"{out_dir}/rejects").select(*run).distinct()


def stream_metrics(spark: SparkSession, out_dir: str, run: Sequence[str] = ("model", "context", "seed"), target: str = "stereo",
                   contextual: bool = False, soft: bool = False) -> DataFrame:
    """The metrics of all runs that are not rejected, as far as the stream has come; equal to the batch evaluation."""
    added = spark.read.parquet(f"{out_dir}/added")
    confidence = [c for c in ("softmax_confidence",) if f"n:{c}" in added.columns]
    merged = merged_metrics(added, run, target, confidence=confidence, soft=soft, contextual=contextual)
    return merged.join(stream_rejects(spark, out_dir, run), list(run), "left_anti")
