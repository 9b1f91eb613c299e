"""Whitening of embeddings by incremental eigendecomposition.

Each task keeps the number, the mean and the spectrum (eigenvalues and eigenvectors) of the scatter
of its vectors. A vector that comes w times changes the scatter by one centred rank-one term,
n w / (n + w) times the square of its difference from the mean. The eigenvalues after such an
update are the roots of a secular equation,

    1 + rho * sum_i z_i^2 / (d_i - x) = 0,

one between each two old eigenvalues; they are found by a safeguarded rational iteration on the
distance to the nearer old eigenvalue. Directions that the vector hardly touches, and pairs of
(nearly) equal eigenvalues after a rotation, are set aside first (deflation). The eigenvectors come
from the vector that has these roots exactly, so they are orthogonal to working precision.

Spectra of tasks are combined a few at a time, in rounds of one grouped job each: the other
spectrum's eigenvectors and the difference of the two means are further rank-one updates. The last
one gives a basis. A Rayleigh-Ritz step over all rows refines it: tasks add up the centred
covariance times the basis, and the small projected eigenproblem gives the components to double
precision. With `rank` set below the vectors' length, spectra keep only that many directions and
the step is repeated as subspace iteration until the components no longer move.

Entries c become integers x = floor(64 c) + 1000000, and sums of them are exact. With n vectors and sums S,
x - S/n is taken as (n x - S) / n, whose numerator is exact.

Vectors that are null or hold null or non-finite entries are left out, as are empty ones; all others
must be of one length, with entries below 2^52 / 64 in size: others raise an error. Repeated vectors
count as often as they come, rows with equal or null ids stay apart. Components without variance
(below 1e-12 of the trace) are not returned, so an empty table, a single vector or copies of one
give no rows. A deviation beyond a long is null. Ties between eigenvalues are broken by the fit, in
one way for all rows. Further columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercadia.llm.shared import Tables, prepared

#: Fixed values of the integer grid: steps per unit, and the offset.
STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: States that are combined in one task.
FAN = 8
#: Least share of the trace that a component has.
LEAST_SHARE = 1e-12
EPS = float(np.finfo(float).eps)


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum z2 / (d - x), for rising distinct d, positive z2 and rho.

    Root i lies between d[i] and d[i + 1] (the last one below d[-1] + rho * sum z2). Returns the number of
    the nearer d and the distance from it, which keeps all digits.
    """
    k = len(d)
    upper = np.append(d[1:], d[-1] + rho * z2.sum())
    width = upper - d
    # The sign at the middle tells the nearer pole.
    middle = d + width / 2
    at_middle = 1 + rho * (z2 / (d[None, :] - middle[:, None])).sum(axis=1)
    near = np.arange(k) + (at_middle < 0)
    near[-1] = k - 1
    gaps = d[None, :] - d[near][:, None]
    left_side = near == np.arange(k)
    low = np.where(left_side, 0.0, -width / 2)
    high = np.where(left_side, width / 2, 0.0)
    low[-1], high[-1] = (0.0, width[-1]) if at_middle[-1] >= 0 else (width[-1] / 2, width[-1])
    low[-1] = max(low[-1], 0.0)
    x = (low + high) / 2
    going = np.arange(k)
    lower_poles = np.arange(k)[None, :] <= np.arange(k)[:, None]
    for _ in range(80):
        delta = gaps[going] - x[going, None]
        term = rho * z2 / delta
        slope = term / delta
        f = 1 + term.sum(axis=1)
        size = 1 + np.abs(term).sum(axis=1)
        below = f < 0
        low[going] = np.where(below, x[going], low[going])
        high[going] = np.where(below, high[going], x[going])
        # Two-pole model: one pole at each end of the interval, slopes matched.
        pole_1 = gaps[going, going] - x[going]
        after = np.minimum(going + 1, k - 1)
        pole_2 = np.where(going < k - 1, gaps[going, after] - x[going], width[going] + pole_1)
        slope_1 = np.where(lower_poles[going], slope, 0.0).sum(axis=1)
        slope_2 = slope.sum(axis=1) - slope_1
        # c + s / (pole_1 - t) + S / (pole_2 - t) = 0 with value f and the slopes at t = 0.
        s, big_s = slope_1 * pole_1**2, slope_2 * pole_2**2
        c = f - slope_1 * pole_1 - slope_2 * pole_2
        a = c * (pole_1 + pole_2) + s + big_s
        b = c * pole_1 * pole_2 + s * pole_2 + big_s * pole_1
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = x[going] + step
        inside = np.isfinite(new) & (new > low[going]) & (new < high[going])
        new = np.where(inside, new, (low[going] + high[going]) / 2)
        done = (np.abs(f) <= 4 * EPS * size) | (high[going] - low[going] <= 2 * EPS * np.abs(x[going]))
        x[going] = np.where(done, x[going], new)
        going = going[~done]
        if not len(going):
            break
    return near, x


@dataclass
class Spectrum:
    """Number, mean and scatter of vectors; the scatter is basis * diag(values) * basis'."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @staticmethod
    def empty(size: int) -> Spectrum:
        return Spectrum(0, np.zeros(size), np.empty(0), np.empty((size, 0)))

    def add_term(self, vector: np.ndarray, rho: float, rank: int) -> None:
        """Add rho times the square of a vector to the scatter."""
        size = float(np.sqrt(vector @ vector))
        if size == 0.0 or rho <= 0.0:
            return
        z = self.basis.T @ vector
        rest = vector - self.basis @ z
        more = self.basis.T @ rest
        z, rest = z + more, rest - self.basis @ more
        length = float(np.sqrt(rest @ rest))
        if length > 1e-13 * size and len(self.values) < len(vector):
            # A direction that no vector had before.
            self.values = np.append(0.0, self.values)
            self.basis = np.column_stack((rest / length, self.basis))
            z = np.append(length, z)
        self.values, turned = rank_one(self.values, z, rho)
        self.basis = self.basis @ turned
        if len(self.values) > rank:
            self.values, self.basis = self.values[-rank:], self.basis[:, -rank:]

    def add_vector(self, x: np.ndarray, times: int, rank: int) -> None:
        if self.n:
            self.add_term(x - self.mean, self.n * times / (self.n + times), rank)
        self.mean = self.mean + (x - self.mean) * (times / (self.n + times))
        self.n += times

    def add_spectrum(self, other: Spectrum, rank: int) -> None:
        if not other.n:
            return
        n = self.n + other.n
        if not self.n:
            self.mean = other.mean.copy()
        for value, direction in zip(other.values, other.basis.T):
            self.add_term(direction, float(value), rank)
        difference = other.mean - self.mean
        self.add_term(difference, self.n * other.n / n, rank)
        self.mean = self.mean + difference * (other.n / n)
        self.n = n

    def to_bytes(self) -> bytes:
        head = struct.pack("<qqq", self.n, len(self.mean), len(self.values))
        return head + self.mean.tobytes() + self.values.tobytes() + np.ascontiguousarray(self.basis).tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> Spectrum:
        n, size, rank = struct.unpack_from("<qqq", data)
        numbers = np.frombuffer(data, float, offset=24)
        return Spectrum(n, numbers[:size], numbers[size : size + rank], numbers[size + rank :].reshape(size, rank))


def rank_one(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and eigenvectors of diag(d) + rho z z' for rising d and positive rho."""
    k = len(d)
    turned = np.eye(k)
    scale = max(abs(d[-1]), rho * float(z @ z), 1e-300) if k else 0.0
    z = z.copy()
    # Deflation of equal eigenvalues: a rotation moves the whole weight of a pair to its second.
    for i in np.flatnonzero(np.diff(d) <= 8 * EPS * scale):
        if z[i] != 0.0:
            r = float(np.hypot(z[i], z[i + 1]))
            c, s = z[i + 1] / r, z[i] / r
            pair = turned[:, [i, i + 1]] @ np.array([[c, s], [-s, c]])
            turned[:, i], turned[:, i + 1] = pair[:, 0], pair[:, 1]
            z[i], z[i + 1] = 0.0, r
    # Deflation of directions that the vector hardly touches.
    open_ = np.flatnonzero(rho * np.abs(z) * np.sqrt(float(z @ z)) > 8 * EPS * scale)
    if not len(open_):
        return d, turned
    own, w = d[open_], z[open_]
    near, x = secular_roots(own, w * w, rho)
    # Differences own[j] - root[i], exact to the last digits.
    apart = (own[None, :] - own[near][:, None]) - x[:, None]
    # The vector whose roots are exactly these.
    poles = own[None, :] - own[:, None]
    np.fill_diagonal(poles, 1.0)
    ratio = -apart / np.where(np.eye(len(own), dtype=bool), 1.0, poles).T
    fitted = np.sqrt(np.abs(np.prod(ratio, axis=0)))
    vectors = (np.copysign(fitted, w)[None, :] / apart).T
    vectors /= np.sqrt((vectors**2).sum(axis=0))
    values = d.copy()
    values[open_] = own[near] + x
    turned[:, open_] = turned[:, open_] @ vectors
    order = np.argsort(values, kind="stable")
    return values[order], turned[:, order]


def merged(states: DataFrame, fold: Callable[[bytes, bytes], bytes], tables: Tables) -> bytes | None:
    """One state out of rows (part, state): a few are folded in each task, in as many rounds as it takes."""

    def folded(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("state").to_pylist()))
        state = rows[0][1]
        for _, other in rows[1:]:
            state = fold(state, other)
        return pa.table({"part": pa.array([rows[0][0] // FAN], pa.int64()), "state": pa.array([state], pa.binary())})

    states = tables.stored(states)
    while len(found := states.limit(2).collect()) > 1:
        after = tables.stored(states.groupBy((F.col("part") / FAN).cast("long").alias("of")).applyInArrow(folded, "part long, state binary"))
        tables.drop(states)
        states = after
    tables.drop(states)
    return bytes(found[0].state) if found else None


def grid(batch: pa.RecordBatch, place: int = 0) -> np.ndarray:
    """Integers of a batch's vectors, a row for each; the sizes must agree."""
    lists = batch.column(place)
    sizes = set(lists.value_lengths().to_pylist())
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes)}")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    steps = np.floor(flat * STEPS)
    if len(steps) and np.abs(steps).max() >= 2.0**52:
        raise ValueError("an entry is too large for the integer grid")
    return (steps.astype(np.int64) + OFFSET).reshape(len(lists), -1)


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite numbers; the vector is named `vector`."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.filter(F.col(column).isNotNull() & (F.size(column) > 0) & F.coalesce(finite, F.lit(False))).withColumn(
        "vector", F.col(column).cast("array<double>")
    )


@dataclass
class Fit:
    """What whitening needs: the number of vectors, exact sums, components as columns and their variances."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        if max(map(abs, self.sums)) + self.n * int(np.abs(x).max(initial=0)) < 1 << 62:
            return (x * self.n - np.array(self.sums, np.int64)) / self.n
        return ((x.astype(object) * self.n - np.array(self.sums, object)) / self.n).astype(float)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of n x - S."""
        if max(map(abs, self.sums)) + self.n * int(np.abs(x).max(initial=0)) < 1 << 62:
            apart = x * self.n - np.array(self.sums, np.int64)
            if int(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
                return (apart * apart).sum(axis=1).tolist()
        apart = x.astype(object) * self.n - np.array(self.sums, object)
        return [s if s < 1 << 63 else None for s in (apart * apart).sum(axis=1)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.variances))


def sums_and_spectra(rows: DataFrame, rank: int | None) -> DataFrame:
    """Per task the exact sums of its integers and the spectrum of their scatter."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, sums, pivot = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = grid(batch)
            if spectrum is None:
                spectrum, sums, pivot = Spectrum.empty(x.shape[1]), [0] * x.shape[1], x[0].copy()
            sums = [a + b for a, b in zip(sums, x.sum(axis=0).tolist())]
            distinct, times = np.unique(x, axis=0, return_counts=True)
            most = rank or x.shape[1]
            # Differences from the task's first vector keep the mean small.
            for vector, w in zip((distinct - pivot).astype(float), times.tolist()):
                spectrum.add_vector(vector, w, most)
        if spectrum is not None:
            spectrum.mean = spectrum.mean + pivot
            state = packed_state(sums, spectrum)
            part = TaskContext.get().partitionId()
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([state], pa.binary())], ["part", "state"])

    return rows.select("vector").mapInArrow(task, "part long, state binary")


def packed_state(sums: list[int], spectrum: Spectrum) -> bytes:
    text = ",".join(map(str, sums)).encode()
    return struct.pack("<q", len(text)) + text + spectrum.to_bytes()


def unpacked_state(state: bytes) -> tuple[list[int], Spectrum]:
    (length,) = struct.unpack_from("<q", state)
    return list(map(int, state[8 : 8 + length].split(b","))), Spectrum.from_bytes(state[8 + length :])


def combined(rank: int | None) -> Callable[[bytes, bytes], bytes]:
    def fold(left: bytes, right: bytes) -> bytes:
        (sums, spectrum), (more, other) = unpacked_state(left), unpacked_state(right)
        if len(sums) != len(more):
            raise ValueError(f"vectors of different lengths: {sorted({len(sums), len(more)})}")
        own = Spectrum(spectrum.n, spectrum.mean.copy(), spectrum.values.copy(), spectrum.basis.copy())
        own.add_spectrum(other, rank or len(sums))
        return packed_state([a + b for a, b in zip(sums, more)], own)

    return fold


def added_up(left: bytes, right: bytes) -> bytes:
    return (np.frombuffer(left) + np.frombuffer(right)).tobytes()


def summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], tables: Tables) -> np.ndarray:
    """The sum over all rows of a matrix that `of` makes from a batch's integers, as a flat array."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(grid(batch))
                total = part if total is None else total + part
        if total is not None:
            part = TaskContext.get().partitionId()
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "state"])

    states = rows.select("vector").mapInArrow(task, "part long, state binary")
    return np.frombuffer(merged(states, added_up, tables))


def fit(rows: DataFrame, components: int, rank: int | None, tables: Tables, rounds: int = 50) -> Fit | None:
    """Components of the covariance of all rows; None if there are no rows or no variance."""
    state = merged(sums_and_spectra(rows, rank), combined(rank), tables)
    if state is None:
        return None
    sums, spectrum = unpacked_state(state)
    n, size = spectrum.n, len(sums)
    basis = np.linalg.qr(spectrum.basis[:, ::-1])[0]
    if not basis.shape[1]:
        return None
    centre = Fit(n, sums, np.empty((size, 0)), np.empty(0), 0.0).centred
    for _ in range(rounds):
        moving = basis

        def products(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return np.append((c.T @ (c @ moving)).ravel(), (c * c).sum())

        total = summed(rows, products, tables) / n
        image, trace = total[:-1].reshape(size, -1), float(total[-1])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, moved = basis @ turn, image @ turn
        lost = np.sqrt(((moved - ritz * values) ** 2).sum(axis=0))[:components].max()
        if basis.shape[1] == size or lost <= 1e-13 * max(trace, 1e-300):
            break
        basis = np.linalg.qr(moved)[0]
    kept = min(components, int((values > LEAST_SHARE * trace).sum()))
    if not kept:
        return None
    chosen = ritz[:, :kept]
    largest = np.abs(chosen).argmax(axis=0)
    chosen = chosen * np.where(chosen[largest, np.arange(kept)] < 0, -1.0, 1.0)
    return Fit(n, sums, chosen, values[:kept].copy(), trace)


def whitened(
    vectors: DataFrame,
    id_column: str = "vec_id",
    column: str = "embedding",
    components: int = COMPONENTS,
    rank: int | None = None,
) -> tuple[DataFrame, Fit | None, float]:
    """Rows (vec_id, deviation, whitened array) of all usable vectors, the fit, and its error.

    The error is the largest absolute entry of the covariance of the whitened vectors minus the
    identity, measured over all rows. The fit holds one matrix of the vectors' length; `rank` bounds
    the spectra of tasks where vectors are very long.
    """
    spark = prepared(vectors.sparkSession)
    tables = Tables(spark, "whitening")
    rows = usable(vectors, column).select(F.col(id_column).cast("long").alias("vec_id"), "vector")
    schema = "vec_id long, deviation long, whitened array<double>"
    found = fit(rows, components, rank, tables)
    if found is None:
        return spark.createDataFrame([], schema), None, 0.0

    def squares(x: np.ndarray) -> np.ndarray:
        w = found.whitened(x)
        return (w.T @ w).ravel()

    kept = len(found.variances)
    error = float(np.abs(summed(rows, squares, tables).reshape(kept, kept) / found.n - np.eye(kept)).max())

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = grid(batch, 1)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * kept)
            values = pa.ListArray.from_arrays(offsets, pa.array(found.whitened(x).ravel()))
            yield pa.record_batch([batch.column(0), pa.array(found.deviation(x), pa.int64()), values], ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(projected, schema), found, error


def by_component(whitened_rows: DataFrame, found: Fit | None, error: float) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    shares = [float(v / found.trace) for v in found.variances] if found else []
    at = F.posexplode("whitened").alias("place", "whitened")
    explained = F.element_at(F.array(*map(F.lit, shares)), F.col("place") + 1) if shares else F.lit(None).cast("double")
    return whitened_rows.select("vec_id", "deviation", at).select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(found.n if found else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained.alias("explained"),
        F.lit(error).alias("identity_error"),
    )
