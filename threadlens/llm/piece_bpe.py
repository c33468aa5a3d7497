"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is escaped as the model's normaliser does and cut into segments that no piece can cross. In a
segment, an agenda (priority queue) holds the adjacent symbol pairs whose joined form is a piece,
ordered by score, then position; the best pair merges until none is left. The ids of the distinct
segments of an Arrow batch are compared with the sentencepiece library before they are used.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import map_rows

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def merge(symbols: list[str], scores: dict[str, float]) -> list[str]:
    """Merge the best-scored adjacent pair (the leftmost of equals) until no pair forms a piece.

    >>> merge(list("abab"), {"ab": -1.0, "abab": -2.0})
    ['abab']
    """
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    best, push, pop = scores.get, heapq.heappush, heapq.heappop
    agenda = [(-score, i, i + 1, whole) for i in range(n - 1)
              if (score := best(whole := symbols[i] + symbols[i + 1])) is not None]
    heapq.heapify(agenda)
    while agenda:
        _, left, right, whole = pop(agenda)
        # stale when either side has merged since
        if after[left] != right or not symbols[left] or len(symbols[left]) + len(symbols[right]) != len(whole):
            continue
        symbols[left], symbols[right] = whole, ""
        after[left] = following = after[right]
        if following < n:
            before[following] = left
            if (score := best(joined := whole + symbols[following])) is not None:
                push(agenda, (-score, left, following, joined))
        if (preceding := before[left]) >= 0 and (score := best(joined := symbols[preceding] + whole)) is not None:
            push(agenda, (-score, preceding, left, joined))
    return [s for s in symbols if s]


class PieceModel:
    """Vocabulary of a BPE model file, with the segment encoder and the library's processor.

    The file is the library's public model format; its pieces, scores and switches are read through the
    library. ``remember_bytes`` bounds what a worker keeps of segments and their ids: when it is reached, they
    become the older generation, from which those that come up again are taken over. Segments of more than ``longest``
    characters (texts without spaces are one segment) are not kept.
    """

    def __init__(self, path: str, remember_bytes: int = 96 << 20, longest: int = 64):
        import sentencepiece

        with open(path, "rb") as f:
            blob = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        spec = model_switches(blob)
        if spec["kind"] != 2 or spec["charsmap"] or spec["squeeze"] or not spec["prefix"] or spec["user_pieces"]:
            raise ValueError("a merge-type model with identity normalisation, a space prefix and no user pieces is needed")
        lib = self.library
        pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        plain = [i for i in range(len(pieces)) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i))]
        self.ids = {pieces[i]: i for i in plain}
        self.scores = {pieces[i]: lib.get_score(i) for i in plain}
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(len(pieces)) if lib.is_byte(i)}
        self.unknown, self.bos, self.eos = lib.unk_id(), lib.bos_id(), lib.eos_id()
        # segments may be cut before a space run only if no piece holds a space after another character
        self.separable = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.remember_bytes, self.longest, self.held = remember_bytes, longest, 0
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def segments(self, text: str) -> list[str]:
        """Escaped text (space prefix, spaces as U+2581), cut where no piece can cross."""
        if not text:
            return []
        escaped = SPACE + text.replace(" ", SPACE)
        return SEGMENT.findall(escaped) if self.separable else [escaped]

    def segment_ids(self, segment: str) -> list[int]:
        whole = self.ids.get(segment)
        if whole is not None and len(segment) == 1:
            return [whole]
        out: list[int] = []
        for s in merge(list(segment), self.scores):
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in s.encode())
            else:
                if not out or out[-1] != self.unknown:  # neighbouring unknowns are one id
                    out.append(self.unknown)
        return out

    def learn(self, segments: Iterable[str]) -> None:
        """Take over what the older generation knows; encode the rest, each checked against the library."""
        for s in segments:
            if (ids := self.older.get(s)) is not None:
                self.known[s] = ids
                self.held += self._bytes(s, ids)
        new = [s for s in segments if s not in self.known]
        # the library puts the space prefix itself
        for s, want in zip(new, self.library.encode([s[1:] for s in new], num_threads=1)):
            got = self.segment_ids(s)
            if len(s) > 1 and got != want:
                raise ValueError(f"ids of {s[:80]!r} differ from the library's: {got[:20]} and {want[:20]}")
            self.known[s] = ids = array("I", got).tobytes()
            self.held += self._bytes(s, ids)

    @staticmethod
    def _bytes(segment: str, ids: bytes) -> int:
        """What an entry takes at most: characters, ids, two objects and a place in the table."""
        return 4 * len(segment) + len(ids) + 200

    def encode(self, texts: Iterable[str], block: int = 1_000_000) -> Iterator[bytes]:
        """Ids of each text with begin and end ids, as little-endian unsigned 32-bit integers.

        New segments are encoded and checked together for each ``block`` characters of texts.
        """
        waiting: list[list[str]] = []
        size = 0
        for text in texts:
            waiting.append(self.segments(text))
            size += len(text)
            if size >= block:
                yield from self._flush(waiting)
                waiting, size = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting: list[list[str]]) -> Iterator[bytes]:
        begin, end = (array("I", [i]).tobytes() for i in (self.bos, self.eos))
        parts = set().union(*waiting)
        missing = parts.difference(self.known)
        if missing and self.held > self.remember_bytes:
            self.older, self.known, self.held = self.known, {}, 0
            missing = parts
        if missing:
            self.learn(missing)
        known = self.known
        for segments in waiting:
            yield begin + b"".join([known[s] for s in segments]) + end
        for s in parts:
            if len(s) > self.longest:
                self.held -= self._bytes(s, known.pop(s))

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


def _fields(blob: bytes):
    """(number, value) pairs of one message of the model file (protocol buffer wire format)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = blob[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(blob):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, blob[at : at + size]
            at += size


def model_switches(blob: bytes) -> dict:
    """The few switches of a model file that the encoder depends on."""
    out = {"kind": 1, "charsmap": b"", "squeeze": True, "prefix": True, "user_pieces": 0}
    for number, value in _fields(blob):
        if number == 1:
            out["user_pieces"] += dict(_fields(value)).get(3, 1) == 4
        elif number == 2:
            out["kind"] = dict(_fields(value)).get(3, 1)
        elif number == 3:
            spec = dict(_fields(value))
            out |= {"charsmap": spec.get(2, b""), "prefix": bool(spec.get(3, 1)), "squeeze": bool(spec.get(4, 1))}
    return out


@functools.cache
def load(path: str) -> PieceModel:
    """One model for each Python worker."""
    return PieceModel(path)


@dataclass(frozen=True)
class Codec:
    """Where the model file is, on every worker."""

    model_file: str


def encode_decode(docs: DataFrame, codec: Codec) -> DataFrame:
    """Encode every whole text and decode its ids (columns doc_id, text; others are ignored).

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256: one row for each input row. A null text counts
    as empty: begin and end id only. Null ids and repeated rows pass through; an empty table gives an empty
    result. Very long texts cost time in proportion (the agenda is per segment). Rows are encoded alone:
    no shuffle. A segment whose ids differ from the library's fails the job rather than passing on.
    """

    def rows(batch: pa.RecordBatch):
        model = load(codec.model_file)
        texts = (x.as_py() for x in batch.column(1))
        for doc_id, ids in zip(batch.column(0).to_pylist(), model.encode(texts)):
            decoded = model.decode(ids)
            yield (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())

    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return map_rows(texts, rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, ids: the token ids themselves (begin and end included). Edge cases as in encode_decode."""

    def rows(batch: pa.RecordBatch):
        model = load(codec.model_file)
        texts = (x.as_py() for x in batch.column(1))
        for doc_id, ids in zip(batch.column(0).to_pylist(), model.encode(texts)):
            yield doc_id, np.frombuffer(ids, "<u4").astype(np.int64).tolist()

    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return map_rows(texts, rows, "doc_id long, ids array<long>")
