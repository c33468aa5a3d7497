"""The pipeline: every stage against a plain version of itself, on the smallest tables."""

import collections
import hashlib

import numpy as np
from helpers import components

import corpus_pipeline
from threadlens.llm.piece_bpe import PieceModel
from threadlens.llm.queries import MIN_SITES, piece_model
from threadlens.llm.rule_ensemble import quality_scores

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, before = docs.columns, docs
    stages = [f for _, f in corpus_pipeline.STAGES]

    def step(stage, docs):
        return corpus_pipeline.shared_table(stage(spark, docs, SF), "test")

    after = step(stages[0], docs)
    good = {r.doc_id for r in quality_scores(docs, labels).collect() if r.predicted}
    assert after.columns == columns and {r.doc_id for r in after.collect()} == good
    marked = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(marked[i] == (i in good) for i in marked) / len(marked) > 0.95

    before, after = after, step(stages[1], after)
    sites = collections.defaultdict(set)
    for r in before.collect():
        for line in r.text.split("\n"):
            sites[line].add(r.source)
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if not x.strip() or len(sites[x]) < MIN_SITES) for r in before.collect()}
    assert after.columns == columns and {r.doc_id: r.text for r in after.collect()} == want
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = after, step(stages[2], after)
    groups = components([(r.doc_id, r.text) for r in before.collect()], percent=80)
    assert after.columns == columns and sorted(r.doc_id for r in after.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)

    before, after = after, step(stages[3], after)
    size = {r.doc_id: len(r.text.split()) for r in before.collect()}
    count = collections.Counter(r.doc_id for r in after.collect())
    assert after.columns == columns and max(count.values()) <= 3
    assert abs(sum(size[i] * n for i, n in count.items()) - sum(size.values())) < 0.05 * sum(size.values())

    last = step(stages[4], after)
    library = PieceModel(piece_model()).library
    text = {r.doc_id: r.text for r in after.collect()}
    assert last.count() == after.count()
    for r in last.collect():
        ids = library.encode(text[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
