"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import pathlib
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.session import write_shared as shared_table  # noqa: F401  (used by the operators)

#: Words are runs of anything but ASCII white space, which is what ``bytes.split()`` cuts at.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text"):
    """The UTF-8 bytes of a text column; null becomes empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more.

    Called between the phases of long operators, whose results are in shared tables by then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this library to the Python workers, once for each application (what --py-files does)."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    package = pathlib.Path(__file__).resolve().parents[1]
    archive = pathlib.Path(tempfile.mkdtemp(prefix="py-files-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))  # the driver serves it to every executor
    _SHIPPED.add(spark.sparkContext.applicationId)


def map_rows(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterable[tuple]], schema: str, at_once: int = 4096) -> DataFrame:
    """``mapInArrow`` with a function that turns one input batch into output tuples.

    Output goes back in batches of at most ``at_once`` rows, however many rows an input batch gives.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            found = iter(rows(batch))
            while out := list(islice(found, at_once)):
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow.types)], schema=arrow)

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finaliser), element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of the words of a text, without a Python object per word.

    A word's hash is the sum of a random number for each byte times a power of its place, taken over
    the whole text at once; the power of the word's own start is divided out, so equal words have
    equal hashes wherever they stand. Long texts go block by block, cut at white space.
    """

    BASE = 0x9E3779B97F4A7C15
    SPACE = re.compile(rb"[\x09-\x0D\x20]")

    def __init__(self, block: int = 1 << 20):
        self.block = block
        self.letters = mix64(np.arange(1, 257, dtype=np.uint64))
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.letters[self.blank] = 0
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, 2 * len(self.powers))
            steps = np.full((2, n), self.BASE, np.uint64)
            steps[1] = pow(self.BASE, -1, 1 << 64)
            steps[:, 0] = 1
            with np.errstate(over="ignore"):
                self.powers, self.inverse = np.multiply.accumulate(steps, axis=1)

    def of(self, raw: bytes) -> np.ndarray:
        if len(raw) <= self.block:
            return self._block(raw)
        parts, at = [], 0
        while at < len(raw):
            cut = self.SPACE.search(raw, min(len(raw), at + self.block))
            end = cut.start() if cut else len(raw)
            parts.append(self._block(raw[at:end]))
            at = end
        return np.concatenate(parts)

    def _block(self, raw: bytes) -> np.ndarray:
        code = np.frombuffer(raw, np.uint8)
        word = ~self.blank[code]
        starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
        if len(word) and word[0]:
            starts = np.concatenate([[0], starts])
        if not len(starts):
            return np.empty(0, np.uint64)
        self._grow(len(code))
        with np.errstate(over="ignore"):
            total = np.add.reduceat(self.letters[code] * self.powers[: len(code)], starts)
            return mix64(total * self.inverse[starts])


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of every run of ``size`` consecutive words (order matters)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mix64(total)
