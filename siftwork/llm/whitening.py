"""Whitening of embeddings with principal components from a randomised range finder.

Every pass reads all rows. A task adds up its own rows and gives one small matrix (at most dimension times
dimension); these are added by a few tasks and then on the driver, so what meets in one place depends on the
dimension alone.

1. Exact sums: entries become integers, so the number of rows and the sums are exact.
2. Range finder: centred rows are multiplied with random vectors, some more than components are wanted, and
   POWER_PASSES further passes multiply the covariance in again, orthonormalised between passes.
3. Rayleigh-Ritz: the covariance in this basis is solved exactly. Where a residual |V u - e u| of a wanted
   component is above RESIDUAL of the smallest wanted value, the basis is filled up to the full dimension and solved again:
   then the values are those of the covariance itself.
4. A last pass measures the covariance of the whitened rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS, OVERSAMPLING, POWER_PASSES = 32, 10, 2
RESIDUAL = 1e-10
SUMMERS = 16  # tasks that add up what all others found
SCALE, SHIFT = 64, 1_000_000
MOST = 2.0**40  # entries beyond it, which no embedding has, count as not finite: sums of squares would not be numbers any more
SEED = 20240607


def valid_rows(column: pa.ListArray, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector (of that dimension) without null, non-finite or absurdly large entries, and the integers of
    these rows one after another."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    present = column.is_valid().to_numpy(zero_copy_only=False)
    size = np.where(present, size, 0)
    flat = column.flatten()  # of rows that are there
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
    bad = ~(np.abs(values) <= MOST)
    before = np.append(0, np.cumsum(bad))
    ends = np.cumsum(size)
    ok = present & (size > 0) & (before[ends] == before[ends - size])
    if dimension is not None:
        ok &= size == dimension
    x = np.floor(SCALE * values[np.repeat(ok, size)]).astype(np.int64) + SHIFT
    return ok, x


def _partial(vectors: DataFrame, work) -> np.ndarray:
    """The sum over all rows of what `work` makes of (rows of a batch x dimension) matrices, flat."""

    def of_task(batches):
        total = None
        for batch in batches:
            found = work(batch.column(0))
            if found is not None:
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, np.float64).tobytes()])], names=["m"])

    def added(batches):
        total = None
        for batch in batches:
            for m in batch.column(0).to_pylist():
                x = np.frombuffer(m, np.float64)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["m"])

    once = vectors.mapInArrow(of_task, "m binary").repartition(SUMMERS).mapInArrow(added, "m binary")
    parts = [np.frombuffer(r.m, np.float64) for r in once.collect()]  # SUMMERS rows at most
    return np.sum(parts, axis=0)


def exact_sums(vectors: DataFrame, column: str) -> tuple[int, int, list[int]]:
    """Dimension, rows and sums per dimension, exact. Of several dimensions the most frequent one counts, the smaller of a tie."""

    def of_task(batches):
        totals: dict[int, list] = {}
        for batch in batches:
            ok, x = valid_rows(batch.column(0))
            size = np.diff(batch.column(0).offsets.to_numpy())[ok]
            ends = np.cumsum(size)
            for d in np.unique(size).tolist():
                if (size == d).all():
                    rows = x.reshape(-1, d)
                else:
                    rows = np.stack([x[e - d : e] for e in ends[size == d].tolist()])
                t = totals.setdefault(d, [0, [0] * d])
                t[0] += len(rows)
                high, low = (rows >> 24).sum(0), (rows & ((1 << 24) - 1)).sum(0)  # in two halves, so that a batch's sums fit
                t[1] = [a + (int(h) << 24) + int(b) for a, h, b in zip(t[1], high, low, strict=True)]
        out = [(d, n, i, str(s)) for d, (n, sums) in totals.items() for i, s in enumerate(sums)]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["d", "n", "i", "s"])

    parts = vectors.select(column).mapInArrow(of_task, "d long, n long, i long, s string")
    size = parts.where("i = 0").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not size:
        return 0, 0, []
    d, n = size[0]
    sums = {r.i: int(r.s) for r in parts.where(F.col("d") == d).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return d, n, [sums[i] for i in range(d)]


@dataclass(frozen=True)
class Whitening:
    """What whitens: rows n, exact sums, components (dimension x m), their values and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    expanded: bool

    def centred(self, column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        return _centred(column, self.n, self.sums)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.components / np.sqrt(self.values)


def _centred(column: pa.ListArray, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows count, and x - S / n of these, rounded once."""
    ok, x = valid_rows(column, len(sums))
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return ok, (x.reshape(-1, len(sums)) - whole) - rest


def fit(df: DataFrame, column: str = "embedding", components: int = COMPONENTS, oversampling: int = OVERSAMPLING, power_passes: int = POWER_PASSES) -> Whitening | None:
    """Fit on all rows that count; None if there are none."""
    vectors = df.select(column)
    d, n, sums = exact_sums(df, column)
    if not n:
        return None
    sums = tuple(sums)
    wanted = min(components, d)

    def product(q: np.ndarray):
        """Adds up V q and the trace of V."""

        def work(batch):
            _, y = _centred(batch, n, sums)
            return np.append((y.T @ (y @ q)).ravel(), (y * y).sum()) if len(y) else None

        total = _partial(vectors, work) / n
        return total[:-1].reshape(d, -1), float(total[-1])

    def ritz(q: np.ndarray):
        image, trace = product(q)
        small = q.T @ image
        e, u = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-e, kind="stable")
        e, u = e[order], u[:, order]
        residual = np.linalg.norm(image @ u - q @ u * e, axis=0)
        # whitened rows are divided by the root of their value, so small components need small residuals
        return e, q @ u, trace, float(residual[:wanted].max() / max(e[wanted - 1], np.finfo(float).tiny))

    rng = np.random.default_rng(SEED)
    q = np.linalg.qr(rng.standard_normal((d, min(d, wanted + oversampling))))[0]
    for _ in range(1 + power_passes):  # the range itself, then the power passes
        q = np.linalg.qr(product(q)[0])[0]
    e, u, trace, residual = ritz(q)
    expanded = q.shape[1] < d and residual > RESIDUAL
    if expanded:
        more = rng.standard_normal((d, d - q.shape[1]))
        e, u, trace, residual = ritz(np.linalg.qr(np.hstack([u, more]))[0])
    # a value that is rounding alone has no direction
    keep = np.flatnonzero(e[:wanted] > max(e[0], 0) * d * np.finfo(float).eps)
    return Whitening(n, sums, u[:, keep], e[keep], trace, expanded)


def identity_error(df: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    m = len(model.values)
    if not m:
        return 0.0

    def work(batch):
        _, y = model.centred(batch)
        w = model.project(y)
        return np.append(w.sum(0), (w.T @ w).ravel()) if len(w) else None

    total = _partial(df.select(column), work) / model.n
    mean, second = total[:m], total[m:].reshape(m, m)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(m)).max())


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row that counts and component: id, component (from 1, by falling variance), n, deviation, whitened, explained,
    identity_error.

    Rows whose vector is null or empty, or holds null, non-finite or absurdly large (over 2**40) entries, are dropped, and
    so are rows of another dimension than the most frequent one. Rows that repeat count each, null ids pass through. Components
    without variance (equal vectors, one row) are left out. `deviation` is null where it does not fit a long. An empty
    table gives an empty result; further columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    model = fit(rows, "vector", components)
    if model is None or not len(model.values):
        return rows.select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (x.strip().split() for x in OUT.split(","))]).where("false")
    error = identity_error(rows, model, "vector")
    m, n = len(model.values), model.n
    explained = model.values / model.trace
    sums = np.array(model.sums, object)

    def deviations(x: np.ndarray) -> pa.Array:
        """Sums of (n x - S)^2, exact; in 64 bits where a bound shows that they fit."""
        low, high = (int(f(n * int(g) - int(s) for g, s in zip(x_side, sums, strict=True))) for f, x_side in ((min, x.min(0)), (max, x.max(0))))
        if max(abs(low), abs(high)) ** 2 * x.shape[1] < 1 << 63:
            off = n * x - np.array(model.sums, np.int64)
            return pa.array((off * off).sum(1))
        exact = [int(((n * r.astype(object) - sums) ** 2).sum()) for r in x]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                vectors = part.column(1)
                ok, y = model.centred(vectors)
                k = len(y)
                if not k:
                    continue
                x = valid_rows(vectors, len(model.sums))[1].reshape(k, -1)
                row = pa.array(np.repeat(np.arange(k), m))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).filter(pa.array(ok)).take(row),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)),
                        pa.array(np.full(k * m, n)),
                        deviations(x).take(row),
                        pa.array(model.project(y).ravel()),
                        pa.array(np.tile(explained, k)),
                        pa.array(np.full(k * m, error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(work, f"id {kind}, {OUT}").withColumnRenamed("id", id_col)
