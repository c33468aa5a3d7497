"""Tokens of many texts at once: Arrow splits and numbers them, so no token is a Python object."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def byte_table(blank: Iterable[int], lower: bool = True) -> bytes:
    """For ``bytes.translate``: A-Z lower-cased if ``lower``, the bytes of ``blank`` turned into spaces."""
    gone = set(blank)
    return bytes(32 if c in gone else c + 32 if lower and 65 <= c <= 90 else c for c in range(256))


#: Words are runs of anything but ASCII white space; only A-Z is lower-cased.
WORDS = byte_table([32, *range(9, 14)])
PLAIN_WORDS = byte_table([32, *range(9, 14)], lower=False)
#: Terms are runs of ASCII letters and of characters beyond ASCII; only A-Z is lower-cased.
TERMS = byte_table(c for c in range(128) if not chr(c).isalpha())


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``most`` bytes together, one text at least."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def tokens(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text number of each token, token number, distinct tokens), in reading order."""
    blank = pa.array([t.translate(table) for t in texts], pa.large_binary()).cast(pa.large_string(), safe=False)
    split = pc.ascii_split_whitespace(blank)
    flat = split.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    coded = flat.dictionary_encode()
    number, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:  # blanks at the ends of a text
        real = number != empty
        owner, number = owner[real], number[real]
        number = number - (number > empty)
        distinct = pa.concat_arrays([distinct[:empty], distinct[empty + 1 :]])
    return owner, number.astype(np.int64), distinct
