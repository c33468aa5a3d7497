"""Small column helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """num / den, or ``default`` when den is 0 or null (sklearn ``zero_division``)."""
    fallback = F.lit(default).cast("double") if default is not None else F.lit(None).cast("double")
    return F.when(den.isNotNull() & (den != 0), num.cast("double") / den).otherwise(fallback)


def zero_if_null(c: Column) -> Column:
    """pandas NaN -> 0 after ``fillna(0)``."""
    return F.coalesce(c, F.lit(0.0))


def md5_uniform(*parts: str | Column) -> Column:
    """Uniform [0, 1) from the first 32 bits of md5(parts joined by '|'); same value in DuckDB:
    ``('0x' || substr(md5(concat_ws('|', ...)), 1, 8))::BIGINT / 4294967296.0``."""
    key = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


ROUND_NUDGE = 1e-10  # exact decimal ties (e.g. 73.23 / 96 = 0.7628125) round the same way in every engine


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Canonical rounding of every double/float column for cross-engine value comparison.

    ``round(x + 1e-10, digits)``: summation order can move an exact tie by one ulp either way,
    which would round to different sides; the nudge (far above ulps, far below 10^-digits) sends
    ties the same way on both sides. The oracle SQL applies the same expression.
    """
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f"`{f.name}`").cast("double") + F.lit(ROUND_NUDGE), digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def place_in_order(df: DataFrame, out: str, *order: Column) -> DataFrame:
    """Number the rows from 1 in a global order, without a task that sees them all.

    Rows are range-partitioned and sorted, numbered inside each partition, and moved up by the number of
    rows of the partitions before; only one count per partition meets in a single task.
    """
    from pyspark.sql import Window

    from threadlens.session import write_shared

    numbered = write_shared(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), "in-order")
    part = F.shiftright("_mid", 33).alias("_part")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = numbered.groupBy(part).count().select("_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    rows = numbered.withColumn("_part", F.shiftright("_mid", 33)).join(before, "_part")
    return rows.withColumn(out, (F.col("_before") + F.col("_mid") % (1 << 33) + 1).cast("int")).drop("_mid", "_part", "_before")
