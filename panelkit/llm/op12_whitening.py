"""Embedding whitening by incremental eigendecomposition.

Entries c become whole numbers x = floor(64 * c) + 1000000.  The fit list is
each distinct x vector once; its covariance's leading eigenvectors whiten every
row.

1. Distinct vectors (partial aggregation, so that copies of one vector are no
   hot key) are dealt to partitions of about FIT_ROWS.
2. Each partition keeps count, mean and the eigendecomposition of its centred
   scatter.  A vector changes the scatter by sqrt(n / (n + 1)) * (x - mean), a
   rank-one update: equal eigenvalues and zero weights are deflated, the other
   new eigenvalues are the roots of the secular equation, found together by
   rational iteration within brackets, and the eigenvectors come from weights
   recomputed from the roots, which keeps them orthogonal.
3. Spectra are combined FAN_IN at a time until one is left: the one takes the
   other's eigenpairs, and the difference of the means, as successive rank-one
   updates.  No task holds more than FAN_IN spectra.
4. Rayleigh-Ritz: the fit list is projected on the basis that came out,
   partitions add up the products, and the small eigenproblem turns the basis to
   double precision.  One more pass measures how far the whitened covariance is
   from the identity.

n, the sums and `deviation` are exact integers; a deviation beyond a long raises.

Rows whose vector is NULL or has NULL, NaN or infinite entries, or entries beyond
2**40 in size, are dropped, and so are rows whose vector is not of the commonest
length (of two equally common the shorter).  Repeated rows and NULL ids are kept.
Components have positive variance, so there may be fewer than `components`, and
none where all vectors are equal; among equal eigenvalues any basis may come.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table

SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 40
FIT_ROWS = 2_048        # distinct vectors that one partition decomposes
FAN_IN = 16             # spectra that one task combines
EPS = np.finfo(float).eps
_OUT = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
        "identity_error double")


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots m of 1 + sum z2 / (d - m) = 0, one above each of the ascending `d`,
    and the matrix d_i - m_j without cancellation: each root is held as its
    distance from the nearer pole."""
    k = np.arange(len(d))
    total = z2.sum()
    upper = np.append(d[1:], d[-1] + total)
    half = (upper - d) / 2
    at_mid = 1 + (z2[:, None] / ((d[:, None] - d) - half)).sum(axis=0)
    right = at_mid < 0
    right[-1] = False
    pole = k + right
    gap = d[:, None] - d[pole]
    lo, hi = np.where(right, -half, 0.0), np.where(right, 0.0, half)
    hi[-1] = total
    # the pole that bounds each root from above; the last has none, its bound stands for it
    above = np.append(gap[k[1:], k[:-1]], total)
    left = k[:, None] <= k
    tau = (lo + hi) / 2
    for _ in range(80):
        diff = gap - tau
        term = z2[:, None] / diff
        f = 1 + term.sum(axis=0)
        done = np.abs(f) <= 4 * EPS * len(d) * (1 + np.abs(term).sum(axis=0))
        if done.all():
            break
        lo, hi = np.where(f < 0, tau, lo), np.where(f >= 0, tau, hi)
        slope = term / diff
        below, over = np.where(left, slope, 0.0).sum(axis=0), np.where(left, 0.0, slope).sum(axis=0)
        x, y = diff[k, k], above - tau
        a, b, c = (x + y) * f - x * y * (below + over), x * y * f, f - x * below - y * over
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            new = tau + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        stuck = (new == tau) | done
        if stuck.all():
            break
        tau = np.where(done, tau, new)
    return d[pole] + tau, gap - tau


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors of basis diag(values) basis' + v v'."""
    z = basis.T @ v
    norm = math.sqrt(z @ z)
    tol = 8 * EPS * (values[-1] + norm * norm)
    if norm * norm <= tol * EPS:
        return values, basis
    values, basis = values.copy(), basis.copy()
    # deflation: within a run of equal eigenvalues one reflection leaves one weight
    near = np.diff(values) <= tol
    if near.any():
        edge = np.diff(np.concatenate(([0], near.astype(np.int8), [0])))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1, strict=True):
            w = z[a:b].copy()
            size = math.sqrt(w @ w)
            if size == 0:
                continue
            sign = 1.0 if w[-1] >= 0 else -1.0
            w[-1] += sign * size
            part = basis[:, a:b]
            basis[:, a:b] = part - np.outer(part @ w, w) * (2 / (w @ w))
            z[a:b] = 0
            z[b - 1] = -sign * size
    # and weights of next to nothing leave their pair as it is
    live = np.flatnonzero(np.abs(z) * norm > tol)
    if not len(live):
        return values, basis
    d, w = values[live], z[live]
    roots, diff = secular_roots(d, w * w)
    # weights for which the roots are exact, so that the vectors are orthogonal
    poles = d - d[:, None]
    np.fill_diagonal(poles, 1.0)
    weight = np.copysign(np.sqrt(np.abs(np.prod(-diff / poles, axis=1))), w)
    turn = weight[:, None] / diff
    turn /= np.sqrt((turn * turn).sum(axis=0))
    basis[:, live] = basis[:, live] @ turn
    values[live] = roots
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


class Spectrum:
    """Count, mean and eigendecomposition of the centred scatter of some vectors."""

    def __init__(self, width: int):
        self.n, self.mean = 0, np.zeros(width)
        self.values, self.basis = np.zeros(width), np.eye(width)

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        if self.n:
            self.values, self.basis = rank_one(self.values, self.basis, math.sqrt(self.n / (self.n + 1)) * away)
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        n, away = self.n + other.n, other.mean - self.mean
        for value, vector in zip(other.values, other.basis.T, strict=True):
            if value > 0:
                self.values, self.basis = rank_one(self.values, self.basis, math.sqrt(value) * vector)
        if self.n:
            self.values, self.basis = rank_one(self.values, self.basis, math.sqrt(self.n * other.n / n) * away)
        self.mean = self.mean + away * (other.n / n)
        self.n = n


_SPECTRUM = "part bigint, n bigint, sums array<bigint>, mean binary, vals binary, basis binary"


def _spectrum_batch(part: int, s: Spectrum, sums: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([s.n], pa.int64()),
         pa.array([None if sums is None else sums.tolist()], pa.list_(pa.int64())),
         *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (s.mean, s.values, s.basis)]],
        ["part", "n", "sums", "mean", "vals", "basis"])


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _decompose(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sums = Spectrum(width), np.zeros(width, dtype=np.int64)
        for batch in batches:
            x = _vectors(batch.column(0), width)
            sums += x.sum(axis=0)
            for row in (x - SHIFT).astype(float):
                found.add(row)
        if found.n:
            yield _spectrum_batch(TaskContext.get().partitionId(), found, sums)
    return run


def _combine(width: int):
    def run(group: pa.Table) -> pa.Table:
        total = Spectrum(width)
        rows = sorted(group.select(["part", "n", "mean", "vals", "basis"]).to_pylist(), key=lambda r: r["part"])
        for r in rows:
            one = Spectrum(width)
            one.n, one.mean, one.values = r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["vals"])
            one.basis = np.frombuffer(r["basis"]).reshape(width, width)
            if total.n:
                total.merge(one)
            else:
                total = one
        return pa.Table.from_batches([_spectrum_batch(rows[0]["part"] // FAN_IN, total, None)])
    return run


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n; the numerator is exact where it fits a long."""
    if int(np.abs(x).max(initial=0)) * n < 1 << 62:
        return (n * x - sums) / n
    return np.array([[(n * int(a) - int(s)) / n for a, s in zip(row, sums, strict=True)] for row in x]).reshape(x.shape)


def _products(fit: DataFrame, n: int, sums: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sum over the fit list of p p' / n with p = matrix' (x - mean)."""
    width, size = matrix.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            p = _centred(_vectors(batch.column(0), width), n, sums) @ matrix
            total += p.T @ p
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size, dtype=np.int32)), pa.array([TaskContext.get().partitionId()] * size, pa.int32()),
             pa.array([r.tobytes() for r in total], pa.binary())], ["row", "part", "held"])

    def add(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("part").to_numpy(), kind="stable")
        total = np.zeros(size)
        for b in group.column("held").take(order).to_pylist():
            total += np.frombuffer(b)
        return pa.table({"row": group.column("row")[:1], "held": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((size, size))
    for r in fit.mapInArrow(run, "row int, part int, held binary").groupBy("row").applyInArrow(
            add, "row int, held binary").collect():
        out[r["row"]] = np.frombuffer(r["held"])
    return (out + out.T) / (2 * n)


def _whitened(n: int, sums: np.ndarray, vectors: np.ndarray, values: np.ndarray, trace: float, error: float):
    width, size = vectors.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _vectors(part.column(1), width)
                rows = np.repeat(np.arange(len(x)), size)
                w = _centred(x, n, sums) @ vectors / np.sqrt(values)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(rows), n)), pa.array(deviations(x, n, sums)[rows]), pa.array(w.reshape(-1)),
                     pa.array(np.tile(values / trace, len(x))), pa.array(np.full(len(rows), error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """sum over dimensions of (n x - sums)**2 as longs, exact."""
    about = ((_centred(x, n, sums) * n) ** 2).sum(axis=1)
    if (about < 2.0 ** 62).all() and int(np.abs(x).max(initial=0)) * n < 1 << 62:
        return ((n * x - sums) ** 2).sum(axis=1)
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    if max(exact) >= 1 << 63:
        raise ValueError("a deviation does not fit a long")
    return np.array(exact, dtype=np.int64)


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) for
    every row that is kept and every component."""
    spark = vectors.sparkSession
    c = F.col("c").cast("array<double>")
    good = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= float(LARGEST)))
    rows = (vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).alias("c"))
            .filter(F.col("c").isNotNull() & good)
            .select("vec_id", F.transform(c, lambda x: F.floor(x * SCALE).cast("bigint") + SHIFT).alias("x"))
            .withColumn("width", F.size("x")))
    rows = stage_table(rows, "op12-rows")
    lengths = rows.groupBy("width").agg(F.count(F.lit(1)).alias("n"))
    common = lengths.agg(F.max(F.struct("n", (-F.col("width")).alias("w"))).alias("x")).select("x.*").first()
    if not common["n"] or not common["w"]:
        return spark.createDataFrame([], _OUT).withColumnRenamed("vec_id", id_col)
    width = -common["w"]
    rows = rows.filter(F.col("width") == width).select("vec_id", "x")
    tasks = max(1, math.ceil(common["n"] / FIT_ROWS))
    fit = stage_table(rows.select("x").distinct(), "op12-fit")
    # a file may hold several dealt parts; each is decomposed on its own
    spectra = stage_table(fit.repartition(tasks, "x").mapInArrow(_decompose(width), _SPECTRUM), "op12-spectra")
    n = spectra.agg(F.sum("n")).first()[0]
    sums = np.zeros(width, dtype=np.int64)
    for r in (spectra.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).collect()):
        sums[r["at"]] = r["s"]      # one row per dimension
    while spectra.select("part").limit(2).count() > 1:
        spectra = stage_table(spectra.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(_combine(width), _SPECTRUM),
                              "op12-spectra")
    basis, _ = np.linalg.qr(np.frombuffer(spectra.select("basis").first()[0]).reshape(width, width))
    # Rayleigh-Ritz on the whole basis
    values, turn = np.linalg.eigh(_products(fit, n, sums, basis))
    trace = float(values.sum())
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > 64 * EPS * width * max(trace, 0.0)]
    if not len(order):
        return spark.createDataFrame([], _OUT).withColumnRenamed("vec_id", id_col)
    values, leading = values[order], basis @ turn[:, order]
    cov = _products(fit, n, sums, leading / np.sqrt(values))
    error = float(np.abs(cov - np.eye(len(order))).max())
    return rows.mapInArrow(_whitened(n, sums, leading, values, trace, error), _OUT).withColumnRenamed("vec_id", id_col)
