"""Quality rules by compression bands.

Each text is compressed with zstandard, whole and in fixed chunks. A ratio (raw bytes by compressed
bytes) above the band means repetition, one below it means noise that does not look like language.
The limits depend on the length: short texts hardly compress, long ones always do.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadlens.llm.common import map_rows, mix64, text_bytes

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of the rule.

    ``whole``: (smallest size in bytes, lowest ratio, highest ratio), the row with the largest
    fitting size counts. ``chunk`` has the same form for single chunks of ``chunk_bytes``; a text
    fails when more than ``bad_chunks`` of its chunks are outside.
    """

    level: int = 3
    chunk_bytes: int = 4096
    bad_chunks: float = 0.5
    whole: tuple[tuple[int, float, float], ...] = field(
        default=((0, 0.0, 2.5), (256, 1.1, 3.0), (1024, 1.35, 3.5), (4096, 1.45, 4.0), (32768, 1.5, 5.0)))
    chunk: tuple[tuple[int, float, float], ...] = field(
        default=((0, 0.0, 3.0), (256, 1.1, 3.5), (1024, 1.3, 4.0), (4096, 1.35, 4.5)))


def limits(bands: tuple[tuple[int, float, float], ...], size: int) -> tuple[float, float]:
    return next((lo, hi) for least, lo, hi in sorted(bands, reverse=True) if size >= least)


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more in the text, first included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    known = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    mixed, key = mix64(known + np.uint64(1)), np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            key = key * np.uint64(0x9E3779B97F4A7C15) + mixed[k : k + n]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = count[back] > 1
    steps = np.zeros(len(words) + 1, np.int64)
    steps[:n] += hit
    steps[size : size + n] -= hit
    return int((np.cumsum(steps[:-1]) > 0).sum())


def base_statistics(raw: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (len(words), len(b"".join(words).decode()), len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def compression_verdict(raw: bytes, compress, bands: Bands) -> tuple[float, int, int, bool]:
    """(ratio of the whole text, chunks, chunks out of band, within the bands)."""
    if not raw:
        return 0.0, 0, 0, False
    whole = len(raw) / len(compress(raw))
    lo, hi = limits(bands.whole, len(raw))
    starts = range(0, len(raw), bands.chunk_bytes)
    bad = 0
    if len(starts) == 1:  # the only chunk is the text
        ratios = [(len(raw), whole)]
    else:
        parts = (raw[i : i + bands.chunk_bytes] for i in starts)
        ratios = [(len(p), len(p) / len(compress(p))) for p in parts]
    for size, ratio in ratios:
        low, high = limits(bands.chunk, size)
        bad += not low <= ratio <= high
    return whole, len(ratios), bad, lo <= whole <= hi and bad <= bands.bad_chunks * len(ratios)


def compression_rules(docs: DataFrame, bands: Bands = Bands(), min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """Score every whole text of ``docs`` (columns doc_id, text; others are ignored).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    zstd_ratio, n_chunks, n_bad_chunks: one row for each input row, repeated rows and null ids
    included. A null text counts as empty: zero everywhere, base_failed, not kept. An empty table gives
    an empty result. Each row is judged alone, so nothing is shuffled and no key can be hot; memory is one
    Arrow batch plus the compressed form of one text.
    """
    schema = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, kept boolean, zstd_ratio double, n_chunks long, n_bad_chunks long")

    def rows(batch: pa.RecordBatch):
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level, write_checksum=False, write_content_size=False).compress
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = raw.as_py()
            stats = base_statistics(raw)
            failed = stats[0] < min_words or 100 * stats[4] > repeat_percent * stats[0]
            ratio, chunks, bad, within = compression_verdict(raw, compress, bands)
            yield (doc_id, *stats, failed, within and not failed, ratio, chunks, bad)

    return map_rows(docs.select("doc_id", text_bytes().alias("text")), rows, schema)
