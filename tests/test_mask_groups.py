"""Masking steps behind cheap tests give what the steps give without them (F1)."""

import random

from pyspark.sql import functions as F

from threadlens.functions import text as TX


def test_groups_skip_only_steps_without_a_match(spark):
    r = random.Random(11)
    bits = ["@", "@user1", "http", "https://t.co/a1", "7", "1.000,5", "٣", "a", "ñ3", "3€", "j", "aj", "ja", "jaja", "h", "ahaha", "haaah", "text", "textdd",
            ":)", ";)", ")", ":", " ", "\n", "_", "é", "x"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(12)))) for i in range(3000)] + [(3000, None), (3001, "")]
    df = spark.createDataFrame(rows, "i int, t string")
    names = {"user": "@user", "url": "URL", "num": "NUM", "laughter": "jaja"}
    plain = F.col("t")
    for _, _, steps in TX.MASK_GROUPS:
        for pattern, repl in steps:
            plain = F.regexp_replace(plain, pattern, names.get(repl, repl))
    bad = df.where(~TX.mask(F.col("t")).eqNullSafe(plain)).collect()
    assert not bad
    steps = [pattern for _, _, steps in TX.MASK_GROUPS for pattern, _ in steps]
    assert len(steps) == 9 and all(holds or matches for holds, matches, _ in TX.MASK_GROUPS)
