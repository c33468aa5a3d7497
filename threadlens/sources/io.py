"""Readers and writers (S1-S9): corpora, news, prediction runs, metrics, splits.

Run files are read with ONE reader per folder layout (not a loop per file); the run identity comes
from the file path (``_metadata.file_path``) and is parsed with column regexes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.session import write_shared

# --- fixed values: run file naming <data>-<model>-<level>_<context>_<hard|soft>_s<seed>_<suffix>-task<t>.csv
RUN_PATTERN = r"([a-z]+)-([a-z_]+?)-(\d)_([a-z_]+?)_(hard|soft)_s(\d+)_([^/]*?)-task(\d)\.csv_?$"
BASELINE_PATTERN = r"(?:^|/)([^/-]+)-task(\d)\.csv_?$"
#: The corpus of a baseline file is the folder that holds it, or the one above a ``baselines`` folder.
BASELINE_DATA = r"(?:^|/)([^/]+)/(?:baselines/)?[^/-]+-task\d\.csv_?$"
#: The run file of a path (or folder named like one), with up to two folders above it.
RUN_PATH = r"((?:[^/=]+/){0,2}?[^/=]+\.csv_?)(?:/[^/]*)?$"


def read_corpus(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Corpus as CSV (tab-separated when the name ends in .tsv) or Parquet, with a declared schema."""
    if path.endswith(".parquet") or path.endswith("/"):
        r = spark.read
        return (r.schema(schema) if schema is not None else r).parquet(path)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    reader = reader.option("sep", "\t" if path.endswith(".tsv") else ",")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_news(spark: SparkSession, path: str, tokenized: bool = False) -> DataFrame:
    """``;``-separated news file -> (file_id, news_title) with the (tokenized) title."""
    options = {"header": True, "sep": ";", "escape": '"', "multiLine": True}
    df = spark.read.options(**options).csv(path)
    column = "tokenized_news_title" if tokenized else "news_title"
    return df.select("file_id", F.col(column).alias("news_title"))


def _nz(c: Column) -> Column:
    return F.when(c == "", F.lit(None)).otherwise(c)


def parse_run(df: DataFrame, file_col: str = "file_name") -> DataFrame:
    """Run identity from the file name: data, model, context (level + name), level, kind, seed,
    suffix, task. Baseline files (``<data>/baselines/<model>-task<t>.csv``) fill data, model and task."""
    f = F.col(file_col)
    g = {i: _nz(F.regexp_extract(f, RUN_PATTERN, i)) for i in range(1, 9)}
    is_run = g[1].isNotNull()
    base_model = _nz(F.regexp_extract(f, BASELINE_PATTERN, 1))
    base_task = _nz(F.regexp_extract(f, BASELINE_PATTERN, 2))
    return df.select(
        "*",
        F.when(is_run, g[1]).otherwise(_nz(F.regexp_extract(f, BASELINE_DATA, 1))).alias("data"),
        F.when(is_run, g[2]).otherwise(base_model).alias("model"),
        F.when(is_run, F.concat_ws("_", g[3], g[4])).alias("context"),
        g[3].cast("int").alias("context_level"),
        g[5].alias("kind"),
        g[6].cast("int").alias("seed"),
        g[7].alias("suffix"),
        F.when(is_run, g[8]).otherwise(base_task).cast("int").alias("task"),
    )


def with_run(df: DataFrame) -> DataFrame:
    """Run columns parsed from the path of each row's file; ``file_name`` is the bare name.

    For streams, whose files are not known beforehand; ``read_predictions`` parses once per file.
    """
    out = parse_run(df.withColumn("file_name", run_path(F.col("_metadata.file_path"))))
    return out.withColumn("file_name", F.substring_index("file_name", "/", -1))


def run_path(path: Column) -> Column:
    """``RUN_PATH`` of a full path: only its last four parts, behind the last ``=`` of the folders, can hold it, so nothing else is searched."""
    name, tail = F.substring_index(path, "/", -1), F.substring_index(path, "/", -4)
    folders = F.substr(tail, F.lit(1), F.greatest(F.length(tail) - F.length(name) - 1, F.lit(0)))
    return F.regexp_extract(F.concat_ws("/", F.substring_index(folders, "=", -1), name), RUN_PATH, 1)


def run_files(spark: SparkSession, path: str, options: dict[str, str | bool]) -> DataFrame:
    """One row per file below ``path``: its full path as ``_file`` and the run columns of it. Nothing of a file's content is read."""
    files = spark.read.format("binaryFile").options(**options).load(path).select("_metadata.file_path")
    # names are parsed once per file and stored, so no plan can bring the expressions back to the rows
    named = parse_run(files.select(F.col("file_path").alias("_file"), run_path(F.col("file_path")).alias("file_name")))
    return write_shared(named.withColumn("file_name", F.substring_index("file_name", "/", -1)), "run-files")


def read_predictions(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str,
                     glob: str | None = None, modified_after: str | None = None) -> DataFrame:
    """S3 (+S9): the run files under ``paths``; run columns parsed from the path.

    ``schema`` names and types the columns wanted. Each of ``paths`` is one read, whose files share a header;
    its columns may come in any order, columns that a header lacks are null, others are ignored. A file whose
    header differs from the others of its path fails the read instead of being taken by position.
    ``modified_after`` (e.g. ``2024-01-01T00:00:00``) keeps only files changed after it (S9). File names are parsed once
    per file and joined to its rows; the table of files is no larger than the list that the scan itself keeps on the driver.
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    kinds = {f.name: f.dataType for f in wanted.fields}
    frames = []
    for path in paths:
        options: dict[str, str | bool] = {"recursiveFileLookup": True}
        if glob:
            options["pathGlobFilter"] = glob
        if modified_after:
            options["modifiedAfter"] = modified_after
        r = spark.read.option("header", True).option("enforceSchema", False).options(**options)
        header = r.csv(path).columns
        df = r.schema(T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])).csv(path)
        missing = [F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c not in header]
        files = run_files(spark, path, options)
        run = [c for c in files.columns if c != "_file" and c not in header]
        own = [c for c in kinds if c in header and c != "file_name"]  # the file's name replaces a column called so
        rows = df.select(*own, F.col("_metadata.file_path").alias("_file"))
        named = rows.join(F.broadcast(files.select("_file", *run, *(["file_name"] if "file_name" in header else []))), "_file", "left")
        frames.append(named.select(*[c for c in kinds if c in header], *missing, *run))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def incremental_files(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str, since: str,
                      glob: str | None = None) -> DataFrame:
    """Only result files modified after ``since`` (the metrics file's time)."""
    return read_predictions(spark, paths, schema, glob=glob, modified_after=since)


def run_dimension(preds: DataFrame, run_cols: Sequence[str], temperature: str = "temperature") -> DataFrame:
    """Temperature (first row of each run file) moved to one row per run."""
    return preds.groupBy(*run_cols).agg(F.max(temperature).alias(temperature))


def write_predictions(df: DataFrame, path: str, partition_cols: Sequence[str] = ("data", "model", "context", "seed"),
                      mode: str = "overwrite") -> None:
    """Persist keys, target, prediction, soft and confidence columns, partitioned by run."""
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(*[c for c in partition_cols if c in df.columns]).parquet(path))


#: Columns that name a run, as far as a metrics table has them.
RUN_KEYS = ("data", "model", "context", "kind", "seed", "suffix", "task")


def write_metrics(df: DataFrame, path: str, append: bool = True, digits: int = 3, keys: Sequence[str] | None = None, buckets: int = 16) -> None:
    """Metrics rounded to 3 decimals, one row for each run however often it is written.

    ``keys`` name a run (by default those of ``RUN_KEYS`` that ``df`` has; nulls are equal). Rows lie in folders by a hash of their
    keys. A write merges the folders that its runs fall into: their old rows of other runs stay, rows of its own runs are replaced, and
    columns may differ. The merged rows are staged in the shared folder, then swap their folders in one commit (dynamic partition overwrite),
    so a write that fails or is repeated leaves whole rows. ``append=False`` drops what was there. Writers take turns.
    """
    keys = list(keys if keys is not None else [c for c in RUN_KEYS if c in df.columns])
    rounded = df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
                          if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                          for f in df.schema.fields])
    spark = df.sparkSession
    new = write_shared(rounded.withColumn("bucket", F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")), "metrics")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if append and place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        old = spark.read.option("mergeSchema", True).parquet(path)
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        mine = new.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        old = old.where(F.col("bucket").isin(touched)).join(mine, same, "left_anti") if keys else old
        new = write_shared(new.unionByName(old, allowMissingColumns=True), "metrics")
    writer = new.repartition("bucket").write.partitionBy("bucket").mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic" if append else "static").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics table that ``write_metrics`` keeps; columns that some runs lack are null there (A11 fills them)."""
    return spark.read.option("mergeSchema", True).parquet(path).drop("bucket")


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """One folder per split (train / val / test)."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def write_analysis(df: DataFrame, path: str, partition_cols: Sequence[str] = ("model", "polarity")) -> None:
    """Improved / worsened tables per model and class (Parquet, not spreadsheets)."""
    df.write.mode("overwrite").partitionBy(*partition_cols).parquet(path)
