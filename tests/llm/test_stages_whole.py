"""Stages of the pipeline on planted cases that the smallest tables do not hold."""

from helpers import SCHEMA, components, rows, shingles, words

import corpus_pipeline


def test_near_dedup_stage_links_from_080(spark):
    """Pairs between 0.80 and 0.85 are near-duplicates for the stage; a pair below 0.80 is not."""

    def edited(base, places):
        return [f"edit{i}" if i in places else w for i, w in enumerate(base)]

    docs = []
    for c in range(20):
        base = words(130, 500 + c, 100_000)
        copies = base, edited(base, {2, 40, 100}), edited(base, {10, 50, 90})
        docs += [(10 * c + k, " ".join(x)) for k, x in enumerate(copies)]
    a, b, far = (shingles(t) for _, t in docs[:3])
    assert 0.81 < len(a & b) / len(a | b) < 0.83 and len(a & far) / len(a | far) < 0.80
    groups = components(docs, percent=80)
    assert groups != components(docs, percent=85)
    df = spark.createDataFrame(rows(*[(i, t, "s") for i, t in docs]), SCHEMA)
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
