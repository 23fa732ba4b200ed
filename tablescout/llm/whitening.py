"""Whitening of embeddings by an incremental eigendecomposition of their covariance.

* **Values.**  An entry ``c`` counts as the whole number ``floor(256 * c)``; the covariance is over every distinct
  vector of whole numbers once, so copies of a vector weigh nothing, however many there are.
* **Partitions** keep mean and spectrum of the scatter about it.  Each block's centred rows enter as the rows of their
  triangular factor, which has the same scatter with at most one row per dimension; every such row, and the move of the mean,
  is a rank-one update: the secular equation gives the new eigenvalues, Loewner's formula a vector that has exactly
  those, and with it orthogonal eigenvectors.  Components that the update does not move, and all but one of equal
  eigenvalues, are deflated first.
* **Spectra are combined** a few at a time, in levels: each eigenpair of one is a rank-one update of the other.
* **Refinement.**  All vectors are projected on the combined basis once more; the eigenvectors of that small matrix, whose
  entries far from the diagonal are nothing but rounding errors of the updates, turn the basis (Rayleigh-Ritz).

State per task and what reaches the driver are a few matrices of dimensions squared, whatever the number of vectors.

Defined cases: rows whose vector is null, empty, holds null or non-finite entries or has another length than most
(of equally common lengths the larger counts) are left out; null ids and repeated rows stay, row by row.  Columns other
than the two are not read.  Components without variance have null ``whitened`` and do not count in ``identity_error``.
A ``deviation`` beyond 64 bits is null.  Entries whose whole number is beyond 64 bits count as the nearest that fits.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.session import discard, durable

COMPONENTS = 4
EPS = float(np.finfo(float).eps)
#: Values (rows times dimensions) of one block, and how many spectra one task combines.
BLOCK_VALUES, FAN_IN = 1 << 19, 16
LARGEST = 2**63


def roots(poles: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(z**2 / (poles - x))`` for rising poles: the roots, and each root minus each pole."""
    k, weight = len(poles), z * z
    top = np.append(poles[1:], poles[-1] + weight.sum())
    middle = 0.5 * (poles + top)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        left = 1 + (weight / (poles - middle[:, None])).sum(1) >= 0
        left[-1] = True
        origin = np.where(left, poles, top)  # the nearer pole, so that differences to it are exact to the last digit
        gap = poles - origin[:, None]
        low, high = np.where(left, 0.0, middle - origin), np.where(left, middle - origin, 0.0)
        high[-1] = top[-1] - origin[-1]
        below = np.tril(np.ones((k, k), bool))
        x = 0.5 * (low + high)
        own = np.arange(k)
        for _ in range(120):
            part = weight / (gap - x[:, None])
            slope = part / (gap - x[:, None])
            value = 1 + part.sum(1)
            low, high = np.where(value < 0, x, low), np.where(value > 0, x, high)
            found = (np.abs(value) <= EPS * k * (1 + np.abs(part).sum(1))) | (high - low <= 2 * EPS * np.abs(x))
            if found.all():
                break
            rising, falling = (slope * below).sum(1), (slope * ~below).sum(1)
            a = gap[own, own] - x
            b = np.where(own < k - 1, gap[own, np.minimum(own + 1, k - 1)] - x, 1.0)
            # Both neighbouring poles are fitted in value and slope ("middle way"); the last root has one pole.
            c, half = value - a * rising - b * falling, (a + b) * value - a * b * (rising + falling)
            root = np.sqrt(np.maximum(half * half - 4 * a * b * value * c, 0))
            step = np.where(half <= 0, (half - root) / (2 * c), 2 * a * b * value / (half + root))
            rest = value[-1] - rising[-1] * a[-1]
            step[-1] = a[-1] + rising[-1] * a[-1] * a[-1] / rest
            new = x + step
            x = np.where(found, x, np.where((new > low) & (new < high), new, 0.5 * (low + high)))
    return origin + x, x[:, None] - gap


class Spectrum:
    """Number, mean, rising eigenvalues and eigenvectors (columns) of the scatter of the vectors seen."""

    def __init__(self, size: int) -> None:
        self.n, self.mean = 0, np.zeros(size)
        self.values, self.basis = np.zeros(size), np.eye(size)

    def update(self, v: np.ndarray) -> None:
        """Add ``v v'`` to the scatter."""
        z = v @ self.basis
        norm = float(np.sqrt(z @ z))
        tiny = 8 * EPS * max(float(np.abs(self.values).max(initial=0)), norm * norm)
        if norm * norm <= tiny * EPS:
            return
        moved = self._deflated(z, np.flatnonzero(np.abs(z) * norm > tiny), tiny)
        if not len(moved):
            return
        new, apart = roots(self.values[moved], z[moved])
        poles = self.values[moved]
        apart[apart == 0] = np.finfo(float).tiny
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = apart / (poles[:, None] - poles)
        np.fill_diagonal(ratio, np.abs(apart.diagonal()))
        exact = np.copysign(np.sqrt(np.abs(ratio.prod(0))), z[moved])
        turn = (exact / -apart).T
        turn /= np.sqrt((turn * turn).sum(0))
        self.values[moved] = new
        self.basis[:, moved] = self.basis[:, moved] @ turn
        order = np.argsort(self.values, kind="stable")
        self.values, self.basis = self.values[order], self.basis[:, order]

    def _deflated(self, z: np.ndarray, moved: np.ndarray, tiny: float) -> np.ndarray:
        """Turn pairs of equal eigenvalues so that the update moves one of them only; returns those it moves."""
        kept: list[int] = []
        for j in moved.tolist():
            if kept:
                i = kept[-1]
                length = float(np.hypot(z[i], z[j]))
                sine, cosine = z[i] / length, z[j] / length
                if abs((self.values[j] - self.values[i]) * sine * cosine) <= tiny:
                    z[i], z[j] = 0.0, length
                    a, b = self.basis[:, i].copy(), self.basis[:, j].copy()
                    self.basis[:, i], self.basis[:, j] = cosine * a - sine * b, sine * a + cosine * b
                    low, high = self.values[i], self.values[j]
                    self.values[i], self.values[j] = low * cosine**2 + high * sine**2, low * sine**2 + high * cosine**2
                    kept[-1] = j
                    continue
            kept.append(j)
        # A turned pair may have left its place by a rounding error.
        return np.array([k for n, k in enumerate(kept) if n == 0 or self.values[k] > self.values[kept[n - 1]]], int) if kept else np.array([], int)

    def _moved_mean(self, n: int, mean: np.ndarray) -> None:
        if self.n:
            self.update(np.sqrt(self.n * n / (self.n + n)) * (mean - self.mean))
        self.n += n
        self.mean = self.mean + (mean - self.mean) * (n / self.n)

    def add(self, rows: np.ndarray) -> None:
        """Take in a block of vectors."""
        mean = rows.mean(0)
        for v in np.linalg.qr(rows - mean, mode="r"):
            self.update(v)
        self._moved_mean(len(rows), mean)

    def merge(self, other: Spectrum) -> None:
        for value, v in zip(other.values, other.basis.T):
            if value > 0:
                self.update(np.sqrt(value) * v)
        self._moved_mean(other.n, other.mean)


def whole_numbers(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` and the whole numbers ``x`` of every usable vector."""
    v = F.col("v")
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    rows = embeddings.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{vector}`").alias("v")).where(finite & (F.size("v") > 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (common.d if common else 0)).select(
        "vec_id", F.transform("v", lambda c: F.floor(F.lit(256.0) * c.cast("double"))).alias("x"))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches) -> Iterator[np.ndarray]:
    """Batches of vectors joined to blocks."""
    held, values = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(_matrix(batch.column(0)))
            values += held[-1].size
            if values >= BLOCK_VALUES:
                yield np.concatenate(held)
                held, values = [], 0
    if held:
        yield np.concatenate(held)


def _scaled(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """``n * x - total`` without a rounding error, as 64-bit numbers if also the sum of their squares fits."""
    largest = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(t) for t in total)
    if largest * largest * x.shape[1] < LARGEST:
        return x * n - np.array(total, np.int64)
    return x.astype(object) * n - np.array(total, object)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""

    def added(batches):
        import pyarrow as pa

        n, total = 0, None
        for x in _blocks(batches):
            safe = max(abs(int(x.max())), abs(int(x.min()))) * len(x) < LARGEST
            part = (x if safe else x.astype(object)).sum(0)
            total, n = part.astype(object) + (0 if total is None else total), n + len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"cell": list(range(-1, len(total))), "value": [str(v) for v in [n, *total]]})

    cells = fit.select("x").mapInArrow(added, "cell long, value string")
    # One row per dimension; more digits than any sum of 64-bit numbers needs.
    found = {r.cell: int(r.value) for r in cells.groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    return found.get(-1, 0), [found[i] for i in range(len(found) - 1)]


SPECTRUM = "id long, n long, mean array<double>, vals array<double>, basis array<double>"


def _record(spectra: list[tuple[int, Spectrum]]):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({
        "id": [i for i, _ in spectra], "n": [s.n for _, s in spectra], "mean": [s.mean.tolist() for _, s in spectra],
        "vals": [s.values.tolist() for _, s in spectra], "basis": [s.basis.ravel().tolist() for _, s in spectra]})


def _spectra(table) -> Iterator[Spectrum]:
    for n, mean, values, basis in zip(*(table.column(c).to_pylist() for c in ("n", "mean", "vals", "basis"))):
        s = Spectrum(len(mean))
        s.n, s.mean, s.values, s.basis = n, np.array(mean), np.array(values), np.array(basis).reshape(len(mean), -1)
        yield s


def basis_of(fit: DataFrame) -> np.ndarray:
    """Orthonormal basis (columns) near the eigenvectors of the covariance of the vectors ``x``."""

    def own(batches):
        from pyspark import TaskContext

        spectrum = None
        for x in _blocks(batches):
            spectrum = spectrum or Spectrum(x.shape[1])
            spectrum.add(x.astype(float))
        if spectrum is not None:
            yield _record([(TaskContext.get().partitionId(), spectrum)])

    def combined(key, table):
        import pyarrow as pa

        first = None
        for s in _spectra(table.sort_by("id")):
            if first is None:
                first = s
            else:
                first.merge(s)
        return pa.Table.from_batches([_record([(key[0].as_py(), first)])])

    spectra = durable(fit.select("x").mapInArrow(own, SPECTRUM))
    while spectra.select("id").count() > 1:
        ranked = spectra.select("id").collect()  # one number per task of the level
        place = {r.id: i // FAN_IN for i, r in enumerate(sorted(ranked))}
        groups = spectra.sparkSession.createDataFrame(list(place.items()), "id long, next long")
        merged = durable(spectra.join(F.broadcast(groups), "id").groupBy("next").applyInArrow(combined, SPECTRUM))
        discard(spectra)
        spectra = merged
    out = next(_spectra(spectra.toArrow()))
    discard(spectra)
    return np.linalg.qr(out.basis[:, ::-1])[0]


def _moments(fit: DataFrame, n: int, total: list[int], turn: np.ndarray) -> np.ndarray:
    """Covariance of the vectors ``x``, centred and multiplied by ``turn``, over all of them."""
    shared = fit.sparkSession.sparkContext.broadcast((n, total, turn))

    def added(batches):
        import pyarrow as pa

        n, total, turn = shared.value
        scatter = np.zeros((turn.shape[1], turn.shape[1]))
        for x in _blocks(batches):
            y = _scaled(x, n, total).astype(float) / n @ turn
            scatter += y.T @ y
        yield pa.RecordBatch.from_pydict({"cell": np.arange(scatter.size), "value": scatter.ravel()})

    cells = fit.select("x").mapInArrow(added, "cell long, value double")
    out = np.zeros(turn.shape[1] ** 2)
    for r in cells.groupBy("cell").agg(F.sum("value").alias("value")).collect():  # dimensions squared
        out[r.cell] = r.value
    return out.reshape(turn.shape[1], -1) / n


def whiten(embeddings: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per usable vector and component: its ``whitened`` value, and what holds for all of them."""
    rows = whole_numbers(embeddings, key, vector)
    key_type = rows.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("vec_id", key_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
                           T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    fit = durable(rows.select("x").distinct())
    n, total = _sums(fit)
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    basis = basis_of(fit)
    projected = _moments(fit, n, total, basis)
    values, turn = np.linalg.eigh((projected + projected.T) / 2)
    trace = float(projected.trace())
    count = min(components, len(total))
    values, axes = values[::-1][:count], basis @ turn[:, ::-1][:, :count]
    axes /= np.sqrt((axes * axes).sum(0))
    axes *= np.where(axes[np.abs(axes).argmax(0), np.arange(count)] < 0, -1.0, 1.0)
    live = values > len(total) * EPS * max(float(values[0]), 0)
    scale = np.where(live, 1 / np.sqrt(np.where(live, values, 1)), np.nan)
    explained = np.where(live, values, 0) / trace if trace > 0 else np.zeros(count)
    error = 0.0
    if live.any():
        error = float(np.abs(_moments(fit, n, total, (axes * scale)[:, live]) - np.eye(int(live.sum()))).max())
    discard(fit)
    shared = rows.sparkSession.sparkContext.broadcast((n, total, axes, scale, explained, error))

    def projections(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        n, total, axes, scale, explained, error = shared.value
        k = len(scale)
        for batch in batches:
            if not batch.num_rows:
                continue
            off = _scaled(_matrix(batch.column(1)), n, total)
            deviation = (off * off).sum(1)
            if off.dtype == object:
                deviation = np.array([d if d < LARGEST else None for d in deviation], object)
            white = (off.astype(float) / n @ axes) * scale
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))).cast(to_arrow_type(key_type)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)), pa.array(np.repeat(deviation, k).tolist() if off.dtype == object else np.repeat(deviation, k), pa.int64()),
                pa.array(white.ravel(), from_pandas=True), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], names=[f.name for f in schema])

    return rows.mapInArrow(projections, schema)
