"""Linear support vector machine by dual coordinate ascent over blocks of rows, with a duality gap (M6).

Rows are dealt evenly over blocks and stored once, packed; a round keeps only their dual variables. It lets every block ascend on its own
rows against the common weights and sums up how all changes together move the weights. The dual objective is a quadratic
of how far one goes along them, so the best step is known exactly, and no round can lose. Blocks that see the same would all make the same
change, most of all along the mean of the rows, so a block counts its moves there once for each block, and all others as often
as the last steps showed to be right. After each round the rows whose variable is off its bounds, which are few, ascend once more as one block. Primal and dual objective come out of the same pass; their difference bounds the
distance from the optimum. The primal is taken at the better of the weights and their mean over rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import ship
from threadlens.session import maybe_broadcast, write_shared


@dataclass(frozen=True)
class LinearFit:
    """weights (the bias last), objective (mean hinge loss + |w|**2 / (2 C n)), duality gap, rounds."""

    weights: np.ndarray
    objective: float
    gap: float
    rounds: int


def sparse(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of ML vectors, none of them null, as views where they are sparse."""
    for kind, at, x in zip(column.field("type").to_pylist(), pieces(column.field("indices")), pieces(column.field("values"))):
        yield np.arange(len(x), dtype=np.int32) if kind == 1 else at, x


def pieces(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of a column without nulls as views of its buffer, with no Python number made."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=True)
    return (values[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()))


def ascend(rows: list[tuple], a: np.ndarray, w: np.ndarray, scale: float, passes: int, rng: np.random.Generator, mean: np.ndarray | None = None,
           often: float = 1.0, blocks: int = 1) -> np.ndarray:
    """Proposed changes of the variables ``a`` of (indices, values, y) after some passes in random order.

    ``scale`` is 1 / (lambda n), the last weight is the bias. Own moves count ``often`` times, those along the unit vector ``mean``
    as often as there are ``blocks``. After the first pass only rows are visited that moved or are off their bounds.
    """
    own, new, s = w.copy(), a.tolist(), scale * often
    extra = scale * (blocks - often) if mean is not None else 0.0
    along = [float(mean[at] @ x) + float(mean[-1]) for at, x, _ in rows] if extra else [0.0] * len(rows)
    size = [s * (float(x @ x) + 1) + extra * c * c for (_, x, _), c in zip(rows, along)]
    moved, visit = 0.0, np.arange(len(rows))
    for _ in range(passes):
        live = []
        for i in rng.permutation(visit).tolist():
            at, x, y = rows[i]
            old = new[i]
            to = min(1.0, max(0.0, old + (1 - y * (float(own[at] @ x) + own[-1] + moved * along[i])) / size[i]))
            if to != old:
                z = (to - old) * y
                own[at] += s * z * x
                own[-1] += s * z
                moved += extra * z * along[i]
                new[i] = to
            if to != old or 0 < to < 1:
                live.append(i)
        visit = np.array(live, np.int64)
    return np.array(new) - a


def packed(rows: list[tuple]) -> tuple:
    """(number of rows, and as bytes their bounds, indices, values and labels) of (indices, values, y)."""
    ends = np.cumsum([0, *(len(at) for at, _, _ in rows)], dtype=np.int64)
    return (len(rows), ends.tobytes(), np.concatenate([at for at, _, _ in rows]).astype(np.int32).tobytes(),
            np.concatenate([x for _, x, _ in rows]).astype(np.float64).tobytes(), np.array([y for _, _, y in rows], np.float64).tobytes())


def unpacked(ends: pa.Scalar, at: pa.Scalar, x: pa.Scalar, y: pa.Scalar) -> list[tuple]:
    """The rows of ``packed`` as views of its bytes."""
    ends, at, x, y = (np.frombuffer(v.as_buffer(), t) for v, t in zip((ends, at, x, y), (np.int64, np.int32, np.float64, np.float64)))
    ends = ends.tolist()
    return [(at[i:j], x[i:j], t) for i, j, t in zip(ends[:-1], ends[1:], y.tolist())]


def summed(vectors: DataFrame, size: int) -> np.ndarray:
    """Sum of a column of float64 vectors as bytes; every task sends one vector, and there are at most 32 of them."""

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            for v in batch.column(0):
                total += np.frombuffer(v.as_buffer(), np.float64)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["v"])

    total = np.zeros(size)
    for r in vectors.coalesce(32).mapInArrow(add, "v binary").collect():
        total += np.frombuffer(r.v, np.float64)
    return total


CHUNK = 1 << 18  # entries of one packed row


def fit_linear(train: DataFrame, features: str, target: str, C: float = 1.0, tol: float = 1e-3, max_rounds: int = 100,
               passes: int = 10, block_rows: int = 50_000, seed: int = 42) -> LinearFit:
    """Fit on ML vectors and 0/1 labels until the duality gap is at most ``tol`` (objectives of a zero model are 1).

    The bias is a feature that is always 1. Rows with a null label or vector are left out. A block holds about ``block_rows`` rows; the
    weights (number of features, a parameter of the features) go to every task. It stops at ``max_rounds`` with the gap that it has.
    """
    from pyspark import TaskContext

    known = train.where(F.col(features).isNotNull() & F.col(target).isNotNull()).select(features, F.col(target).cast("double").alias("y"))
    head = known.first()
    if head is None:
        return LinearFit(np.zeros(1), 1.0, 0.0, 0)
    bias = head[0].size
    n = known.count()
    blocks = max(1, -(-n // block_rows))
    ship(train.sparkSession)

    def pack(batches):
        own, part, rows, held = TaskContext.get().partitionId() << 24, 0, [], 0

        def out():
            total = np.zeros(bias + 1)
            for at, x, _ in rows:
                total[at] += x
            total[-1] = len(rows)
            return pa.record_batch([pa.array([v], t) for v, t in zip((own + part, *packed(rows), total.tobytes()), [pa.int64(), pa.int32(), *[pa.binary()] * 5])],
                                   ["chunk", "n", "ends", "at", "x", "y", "total"])

        for batch in batches:
            for (at, x), y in zip(sparse(batch.column(0)), batch.column(1).to_pylist()):
                rows.append((at, x, 1.0 if y > 0.5 else -1.0))
                held += len(at) + 1
                if held >= CHUNK:
                    yield out()
                    part, rows, held = part + 1, [], 0
        if rows:
            yield out()

    schema = "chunk long, n int, ends binary, at binary, x binary, y binary, total binary"
    table = write_shared(known.repartition(blocks).mapInArrow(pack, schema), "svm")  # dealt out evenly, whatever the order was
    mean = summed(table.select("total"), bias + 1)
    mean /= np.linalg.norm(mean)
    table = table.drop("total")
    kind = pa.schema([("chunk", pa.int64()), ("a", pa.binary()), ("da", pa.binary()), ("hinge", pa.float64()), ("calm", pa.float64()), ("dual", pa.float64()),
                      ("rise", pa.float64()), ("free", pa.int64()), ("move", pa.binary())])
    state, late = None, {}  # late: what the rows off their bounds changed after the last round
    w, scale, far, often = np.zeros(bias + 1), float(C), 0.0, 1.0  # lambda n = 1 / C
    calm, best, dual_best = w, None, -np.inf  # calm: a running mean of the weights

    def moved(rows: list[tuple], changes: np.ndarray) -> np.ndarray:
        move = np.zeros(bias + 1)
        for (at, x, y), z in zip(rows, changes.tolist()):
            if z:
                move[at] += (scale * z * y) * x
                move[-1] += scale * z * y
        return move

    def chunks(batch: pa.RecordBatch, far: float, late: dict):
        """(chunk, rows, variables) after the last step."""
        for i, (chunk, n_rows) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            a = np.zeros(n_rows)
            if batch.num_columns > 6:
                a, da = (np.frombuffer(batch.column(j)[i].as_buffer(), np.float64) for j in (6, 7))
                a = np.clip(a + far * da, 0.0, 1.0)
            if chunk in late:
                at, da = late[chunk]
                a[at] = np.clip(a[at] + da, 0.0, 1.0)
            yield chunk, unpacked(*(batch.column(j)[i] for j in (2, 3, 4, 5))), a

    for k in range(max_rounds + 1):
        def step(batches, w=w, calm=calm, k=k, far=far, often=often, late=late):
            rng, held = np.random.default_rng([seed, k, TaskContext.get().partitionId()]), []

            def out():
                """Ascends on the chunks that are held, as one block."""
                rows, a = [r for _, own, _ in held for r in own], np.concatenate([v for _, _, v in held])
                da = ascend(rows, a, w, scale, passes, rng, mean, often, blocks)
                lines, i = [], 0
                for chunk, own, v in held:
                    d = da[i : i + len(own)]
                    i += len(own)
                    loss = [sum(max(0.0, 1 - y * (float(u[at] @ x) + u[-1])) for at, x, y in own) for u in (w, calm)]
                    lines.append((chunk, v.tobytes(), d.tobytes(), *map(float, loss), float(v.sum()), float(d.sum()), int(((v + d > 0) & (v + d < 1)).sum()), None))
                lines[-1] = (*lines[-1][:-1], moved(rows, da).tobytes())
                return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*lines), kind.types)], schema=kind)

            for batch in batches:
                for chunk, own, a in chunks(batch, far, late):
                    if held and chunk >> 24 != held[-1][0] >> 24 and 2 * sum(len(v) for _, _, v in held) >= min(block_rows, n // blocks):
                        yield out()
                        held = []
                    held.append((chunk, own, a))
            if held:
                yield out()

        rows = table if state is None else table.join(maybe_broadcast(state.select("chunk", "a", "da")), "chunk")
        state = write_shared(rows.mapInArrow(step, "chunk long, a binary, da binary, hinge double, calm double, dual double, rise double, free long, move binary"), "svm-state")
        hinge, loss, dual, rise, free = state.agg(*(F.sum(c) for c in ("hinge", "calm", "dual", "rise", "free"))).first()
        norm = float(w @ w) / (2 * C * n)
        dual_best = max(dual_best, dual / n - norm)
        for u, lost in ((w, hinge), (calm, loss)):
            if best is None or float(u @ u) / (2 * C * n) + lost / n < best[0]:
                best = float(u @ u) / (2 * C * n) + lost / n, u
        fit = LinearFit(best[1], best[0], best[0] - dual_best, k)
        if fit.gap <= tol:
            break
        move = summed(state.where("move IS NOT NULL").select("move"), bias + 1)
        # dual(far) = (dual + far * rise) / n - |w + far * move|**2 / (2 C n), highest here
        right = (C * rise - float(w @ move)) / max(float(move @ move), 1e-300)
        far = min(1.0, max(0.0, right))
        w = w + far * move
        calm = w if k == 0 else (calm + w) / 2
        if right < 0.9:
            often = min(float(blocks), often * min(2.0, 1 / max(right, 0.1)))
        elif right > 1.1:
            often = max(1.0, often / min(1.5, right))
        late = {}
        if blocks > 1 and free:
            share = block_rows / free  # of them; below 1 only if they are more than a block

            def off(batches, far=far, k=k, share=share):
                for batch in batches:
                    for chunk, own, a in chunks(batch, far, {}):
                        there = np.flatnonzero((a > 0) & (a < 1) & (np.random.default_rng([seed, k, chunk]).random(len(a)) < share))
                        if len(there):
                            line = (chunk, *packed([own[i] for i in there]), there.tobytes(), a[there].tobytes())
                            yield pa.record_batch([pa.array([v], t) for v, t in zip(line, [pa.int64(), pa.int32(), *[pa.binary()] * 6])],
                                                  ["chunk", "n", "ends", "at", "x", "y", "there", "a"])

            def again(batches, w=w, k=k):
                held = [(b.column(0)[i].as_py(), unpacked(*(b.column(j)[i] for j in (2, 3, 4, 5))), b.column(6)[i].as_py(), np.frombuffer(b.column(7)[i].as_buffer(), np.float64))
                        for b in batches for i in range(b.num_rows)]
                if held:
                    held.sort(key=lambda x: x[0])
                    rows, a = [r for h in held for r in h[1]], np.concatenate([h[3] for h in held])
                    da = ascend(rows, a, w, scale, passes, np.random.default_rng([seed, k]))
                    parts = [d.tobytes() for d in np.split(da, np.cumsum([len(h[3]) for h in held])[:-1])]
                    moves = [None] * (len(held) - 1) + [moved(rows, da).tobytes()]
                    yield pa.record_batch([pa.array([h[0] for h in held], pa.int64()), pa.array([h[2] for h in held], pa.binary()), pa.array(parts, pa.binary()), pa.array(moves, pa.binary())],
                                          ["chunk", "there", "da", "move"])

            rows = table.join(maybe_broadcast(state.select("chunk", "a", "da")), "chunk")
            rows = rows.mapInArrow(off, "chunk long, n int, ends binary, at binary, x binary, y binary, there binary, a binary").repartition(1)
            for r in rows.mapInArrow(again, "chunk long, there binary, da binary, move binary").collect():  # at most about block_rows changes
                late[r.chunk] = np.frombuffer(r.there, np.int64), np.frombuffer(r.da, np.float64)
                calm = w = w if r.move is None else w + np.frombuffer(r.move, np.float64)
    return fit


def with_margin(df: DataFrame, features: str, fit: LinearFit, out: str) -> DataFrame:
    """``df`` without ``features`` and with the margin of the fit as ``out`` (null for a null vector)."""
    keep = [c for c in df.columns if c != features]
    w = fit.weights
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            column = batch.column(len(keep))
            real = column.is_valid()
            found = iter([float(w[at] @ x) + w[-1] for at, x in sparse(column.filter(real))])
            margin = pa.array([next(found) if ok else None for ok in real.to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), margin], [*keep, out])

    schema = df.select(*keep).schema.add(out, "double")
    return df.select(*keep, features).mapInArrow(run, schema)
