"""Counting of word n-grams over columns of tokens (M5), a slice of rows at a time and without an object per occurrence.

Tokens of a slice are numbered, so an n-gram is one whole number, exactly; hashes only choose what is counted by name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import mix64, ship, window_hashes
from threadlens.session import write_shared

BINS = 1 << 21
PART = 1 << 15  # bins that travel as one row


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """(first row, bounds of the rows, codes, words): whole rows of about ``most`` tokens, a null row as one without tokens."""
    bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    tokens, row = column.flatten(), 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1)
        part = tokens.slice(bounds[row], bounds[end] - bounds[row]).dictionary_encode()
        yield row, bounds[row : end + 1] - bounds[row], part.indices.to_numpy(zero_copy_only=False).astype(np.int64), part.dictionary
        row = end


def starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Places at which an n-gram within a row starts."""
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(bounds[-1])
    return np.flatnonzero(left >= n)


def numbered(codes: Sequence[np.ndarray], words: int) -> np.ndarray:
    """One whole number for each n-gram, given by the codes of its words: equal only for equal n-grams."""
    out, bound = codes[0], words
    for code in codes[1:]:
        if bound * words >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
            bound = len(out)
        out, bound = out * words + code, bound * words
    return out


def gram_bins(codes: np.ndarray, words: pa.Array, n: int) -> np.ndarray:
    """The bin of the n-gram that starts at each place, the same in every slice."""
    import xxhash

    own = np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()], np.uint64)[codes]
    hashes = mix64(own) if n == 1 else window_hashes(own, n)
    return (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)


def spelled(at: np.ndarray, codes: np.ndarray, words: pa.Array, n: int) -> pa.Array:
    """The n-grams at some places, words joined by spaces."""
    parts = [words.take(pa.array(codes[at + k])) for k in range(n)]
    return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")


def top_grams(toks: DataFrame, column: str, n_max: int, k: int) -> list[tuple[str, int]]:
    """The ``k`` most frequent n-grams (n up to ``n_max``) of a stored column of tokens with their counts (desc, then term), exact.

    Occurrences are first counted in bins by hash; an n-gram is at most as frequent as its bin. Those of the fullest bins are counted
    by name; if the k-th is rarer than the next bin is full, all bins that reach its count are taken instead. So what is
    shuffled is bounded by the bins of a task, not by the distinct n-grams.
    """
    ship(toks.sparkSession)
    toks = toks.select(column)

    def count_bins(batches):
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for _, bounds, codes, words in slices(batch.column(0)):
                for n in range(1, n_max + 1):
                    if len(at := starts(bounds, n)):
                        total += np.bincount(gram_bins(codes, words, n)[at], minlength=BINS)
        for i in range(0, BINS, PART):
            if total[i : i + PART].any():
                yield pa.record_batch([pa.array([i // PART], pa.int32()), pa.array([total[i : i + PART].tobytes()], pa.binary())], ["part", "n"])

    def add_bins(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, n in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[part] = total.get(part, 0) + np.frombuffer(n.as_buffer(), np.int64)
        for part, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array(at + part * PART, pa.int32()), pa.array(n[at])], ["bin", "n"])

    full = write_shared(toks.mapInArrow(count_bins, "part int, n binary").repartition("part").mapInArrow(add_bins, "bin int, n long"), "term-bins")
    first = full.orderBy(F.col("n").desc()).limit(2 * k).agg(F.count("n").alias("bins"), F.min("n").alias("n")).first()
    least = first.n if first.bins == 2 * k else 1
    while True:
        chosen = np.zeros(BINS, bool)
        chosen[[r["bin"] for r in full.where(F.col("n") >= least).select("bin").collect()]] = True  # at most BINS numbers

        def count_terms(batches, chosen=np.packbits(chosen)):
            chosen = np.unpackbits(chosen).astype(bool)
            for batch in batches:
                for _, bounds, codes, words in slices(batch.column(0)):
                    for n in range(1, n_max + 1):
                        if not len(at := starts(bounds, n)):
                            continue
                        at = at[chosen[gram_bins(codes, words, n)[at]]]
                        _, place, often = np.unique(numbered([codes[at + k] for k in range(n)], len(words)), return_index=True, return_counts=True)
                        terms = spelled(at[place], codes, words, n)
                        for i in range(0, len(terms), 1 << 16):
                            yield pa.record_batch([terms.slice(i, 1 << 16), pa.array(often[i : i + (1 << 16)], pa.int64())], ["term", "n"])

        counts = toks.mapInArrow(count_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        found = [(r.term, r.n) for r in counts.orderBy(F.col("n").desc(), F.col("term").asc()).limit(k).collect()]
        if least == 1 or len(found) == k and found[-1][1] >= least:
            return found
        least = found[-1][1] if len(found) == k else 1


def count_grams(column: pa.Array, vocab: list[list[str]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bounds of the rows, ids, counts): what each row has of the n-grams ``vocab``, by id, a slice of rows at a time."""
    by_size: dict[int, list[int]] = {}
    for i, gram in enumerate(vocab):
        by_size.setdefault(len(gram), []).append(i)
    for row, bounds, codes, words in slices(column):
        owner, keys = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), []
        for n, ids in by_size.items():
            at, ids = starts(bounds, n), np.array(ids)
            known = [pc.fill_null(pc.index_in(pa.array([vocab[i][k] for i in ids], pa.string()), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(n)]
            there = np.all([c >= 0 for c in known], axis=0)
            known, ids = [c[there] for c in known], ids[there]
            for k in range(n):  # only places whose words stand there in some n-gram
                used = np.zeros(len(words), bool)
                used[known[k]] = True
                at = at[used[codes[at + k]]]
            if not len(at):
                continue
            number = numbered([np.concatenate([known[k], codes[at + k]]) for k in range(n)], len(words))
            wanted, number = number[: len(ids)], number[len(ids) :]
            order = np.argsort(wanted)
            place = np.minimum(np.searchsorted(wanted[order], number), len(ids) - 1)
            hit = wanted[order][place] == number
            keys.append(owner[at[hit]] * len(vocab) + ids[order][place[hit]])
        key, often = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))
        yield row, np.searchsorted(key, np.arange(len(bounds)) * len(vocab)), key % max(len(vocab), 1), often
