"""J2, J10 and W1 with one comment that holds a third of all sentences."""

import random

import pytest
from pyspark.sql import functions as F

from threadlens.operators import threads as TH


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    rows = []
    for comment in range(60):
        n = 150 if comment == 7 else r.randrange(1, 9)
        for pos in range(1, n + 1):
            text = r.choice([f" s{comment}.{pos}\n", f"t{pos}", "", None]) if r.random() < 0.3 else f"s{comment}.{pos}"
            rows.append((comment, pos, max(0, comment - r.randrange(3)), text, r.randrange(2), r.choice([0, 1, None])))
    r.shuffle(rows)
    return spark.createDataFrame(rows, "comment_id long, sentence_pos int, reply_to long, sentence string, stereotype int, implicit int")


def same(a, b):
    assert a.columns == b.columns
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_blocks_change_nothing(corpus):
    one = corpus.withColumn("first_comment_id", F.lit("7"))
    for rows in (1, 4, 149):
        assert same(TH.previous_sentences(corpus, block_rows=rows), TH.previous_sentences(corpus))
        assert same(TH.comment_table(corpus, block_rows=rows), TH.comment_table(corpus))
        assert same(TH.add_comment_label_arrays(one, block_rows=rows), TH.add_comment_label_arrays(one))


def test_a_long_comment_is_sorted_in_several_groups(corpus):
    for df in (TH.previous_sentences(corpus, block_rows=20), TH.comment_table(corpus, block_rows=20)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "_blk" in plan
    blocks = corpus.where("comment_id = 7").select(TH.block_of("sentence_pos", 20).alias("b")).distinct().count()
    assert blocks == 8
    assert "_blk" not in TH.comment_table(corpus)._jdf.queryExecution().optimizedPlan().toString()


def test_positions_that_are_no_numbers(spark):
    df = spark.createDataFrame([(1, "1", 1, "b"), (1, "10", 1, "d"), (1, "2", 1, "c")], "comment_id long, sentence_pos string, reply_to long, sentence string")
    assert [r.comment for r in TH.comment_table(df, block_rows=1).collect()] == ["b d c"]  # ordered as text
