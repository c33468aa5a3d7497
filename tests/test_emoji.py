"""emoji that begin others, joined sequences, and a table of thousands of names."""

import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from threadlens.functions import text as TX

NAMES = {"👍": "thumbs_up", "👍🏽": "thumbs_up_medium", "👩": "woman", "👩‍🚀": "astronaut", "👩‍👩‍👧": "family", "❤": "heart", "❤️": "red_heart",
         "🇪🇸": "spain", ":)": "smile", "$^": "odd"}


def plain(text, names):
    out, i = [], 0
    while i < len(text):
        hit = next((k for k in sorted(names, key=len, reverse=True) if text.startswith(k, i)), None)
        out.append(f" emoji {names[hit]} emoji " if hit else text[i])
        i += len(hit) if hit else 1
    return "".join(out).replace("_", " ")


def cleaned(spark, texts, names):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select(TX.demojize(F.col("t"), names).alias("t"), "i").orderBy("i").select("t").collect()]


def test_longest_emoji_wins(spark):
    texts = ["a 👍 b 👍🏽 c", "👩‍🚀👩👩‍👩‍👧‍", "❤️❤x_y", "🇪🇸🇪", "", ":):$^", "no emoji_here", "👍", "👍🏽👍🏽", "👩‍"]
    assert cleaned(spark, texts, NAMES) == [plain(t, NAMES) for t in texts]
    assert cleaned(spark, ["a 👍 b 👍🏽 c"], NAMES) == ["a  emoji thumbs up emoji  b  emoji thumbs up medium emoji  c"]
    assert cleaned(spark, [None, "a_b"], {}) == [None, "a b"] and cleaned(spark, [None], NAMES) == [None]


def test_thousands_of_names_are_no_thousands_of_literals(spark):
    r = random.Random(2)
    base = [chr(0x1F300 + i) for i in range(1000)]
    names = {e: f"n_{i}" for i, e in enumerate(base)}
    names |= {e + chr(0x1F3FB + k): f"t_{i}_{k}" for i, e in enumerate(base) for k in range(2)}
    texts = ["".join(r.choices([*names, " ", "x", chr(0x1F3FB)], k=60)) for _ in range(40)]
    assert len(names) == 3000 and cleaned(spark, texts, names) == [plain(t, names) for t in texts]
    plan = spark.range(1).select(TX.demojize(F.col("id").cast("string"), names).alias("t"))._jdf.queryExecution().optimizedPlan()
    assert "from_json" not in plan.toString() and plan.expressions().size() < 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab]^\\-", min_size=1, max_size=4), min_size=1, max_size=8), st.text(alphabet="ab]^\\-", max_size=20))
def test_pattern_is_leftmost_longest(words, text):
    import re

    pattern = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\x{int(m[1], 16):02x}", TX.longest_pattern(words))
    got = [m.group() for m in re.finditer(pattern, text)]
    want, i = [], 0
    while i < len(text):
        hit = next((w for w in sorted(words, key=len, reverse=True) if text.startswith(w, i)), None)
        want += [hit] if hit else []
        i += len(hit) if hit else 1
    assert got == want
