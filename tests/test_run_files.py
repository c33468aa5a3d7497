"""Run files: names are parsed once per file, and a run lies in as many files as its rows ask for."""

from pyspark.sql import functions as F

from threadlens.plans import q_sources as Q
from threadlens.sources import io as IO


def test_names_are_parsed_per_file_and_files_follow_rows(spark):
    rows = [(i, "beto", "0_no_context" if i % 2 else "2_txt_father", 42 + i % 3, i % 2, 1, 0.5) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, model string, context string, seed int, stereo int, stereo_pred int, softmax_confidence double")
    path = Q.scratch(spark, "files")
    Q.save_run_files(df.repartition(7), path)
    runs = IO.read_predictions(spark, [path], Q.RUN_SCHEMA)
    assert spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).count() == 6
    assert "regexp" not in runs._jdf.queryExecution().optimizedPlan().toString()
    got = runs.select("doc_id", "model", "context", "seed", "stereo", "stereo_pred", "softmax_confidence").collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_run_path_equals_the_whole_search(spark):
    paths = ["file:///a/b/c/stereohoax-m-0_x_hard_s1_y-task1.csv", "file:/a/x/baselines/m-task1.csv", "file:/t.csv", "t.csv", "s3a://b/t.csv_",
             "file:///r/file_name=stereohoax-m-0_x_hard_s1_y-task1.csv/part-0.csv", "file:///a/k=1/b/c.csv/p=1.csv", "file:///q/n.csv/part=1", "file:///a/b/c.txt", "/a=b.csv", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for r in df.select("p", IO.run_path(F.col("p")).alias("got"), F.regexp_extract("p", IO.RUN_PATH, 1).alias("want")).collect():
        assert r.got == r.want or (r.p is None and not r.got), r
