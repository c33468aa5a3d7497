"""J6, op7: components whose star table stays above ``small`` for several rounds."""

import random

from threadlens.operators.components import connected_components


def test_rounds_go_on_above_the_small_size(spark):
    rng = random.Random(5)
    chains, edges, want = 10, [], {}
    for c in range(chains):  # long chains in random order of ids fold up in several rounds
        nodes = list(range(c * 1000, c * 1000 + 40))
        rng.shuffle(nodes)
        edges += list(zip(nodes, nodes[1:]))
        want |= {n: c * 1000 for n in nodes}
    df = spark.createDataFrame(edges, "a long, b long")
    assert dict(map(tuple, connected_components(df, small=0).collect())) == want
