"""op10: documents without words and sources at their cap stay out of the draw."""

from helpers import SCHEMA, rows

from threadlens.llm import mixing


def test_wordless_documents_are_not_drawn(spark, monkeypatch):
    # "empty" has no words; "full" is small and heavy, so it ends at its cap of three epochs
    docs = [(i, [None, "", " \n"][i % 3], "empty") for i in range(60)]
    docs += [(100 + i, "w " * 5 if i % 2 else "", "full") for i in range(20)]
    docs += [(200 + i, "w " * 100, "wide") for i in range(40)]
    df = spark.createDataFrame(rows(*docs), SCHEMA)
    seen, shared = {}, mixing.shared_table
    monkeypatch.setattr(mixing, "shared_table", lambda table, name: seen.setdefault(name, shared(table, name)) if name == "chosen" else shared(table, name))
    plan = {r.doc_id: r for r in mixing.mix_plan(df, group_rows=8).collect()}
    assert {r.source for r in seen["chosen"].select("source").distinct().collect()} <= {"wide"}
    assert len(plan) == len(docs)
    assert all(plan[i].copies == 0 and plan[i].taken == 0 for i in range(60))
    assert all(plan[100 + i].copies == 3 for i in range(20))  # never a fourth time
    out = mixing.mixed(df, group_rows=8)
    assert out.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
