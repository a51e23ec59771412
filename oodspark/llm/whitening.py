"""Whitening of embeddings by their leading principal components.

Vectors become whole numbers, and each distinct one counts once in the fit.  The components come from a subspace
iteration: a Chebyshev polynomial of the covariance, made by its recurrence, damps the spectrum below the block's
smallest value, then an orthogonal basis is taken and a Rayleigh-Ritz step turns it, until the residuals certify the
components.  The covariance itself is never formed: each step of the recurrence is one Spark job that centres the stored
vectors and sums X'(XQ) over all tasks.  The driver holds blocks of dimensions x (components + guard) numbers only.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import dropped, stored, table

#: Entries are floor(SCALE * c), and so many components are wanted.
SCALE, COMPONENTS = 256, 4
#: Columns of the block besides the wanted ones, degree of the filter, and steps that look for the lower end of the spectrum.
GUARD, DEGREE, STEPS = 20, 10, 8
#: A component is certified by a residual of so much of the largest eigenvalue; or of so much, once it falls by less than half in a turn.
CERTAIN, SETTLED = 2e-15, 1e-10
SEED = 5
#: Bytes of vectors that a task multiplies at a time.
BLOCK_BYTES = 1 << 22
RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


class WhiteningError(ArithmeticError):
    """Components that can't be certified."""


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and x, the vector as whole numbers, of the rows whose vector is neither null nor holds null or non-finite entries."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(F.coalesce(good, F.lit(False))).select("vec_id", F.transform("v", lambda c: F.floor(c * float(scale))).alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def packed(x: DataFrame, dims: int) -> DataFrame:
    """rows, kind and data: the vectors of x as matrices of the narrowest numbers that hold them."""

    def run(batches):
        for b in batches:
            m = matrix(b.column(0), dims)
            each = max(1, BLOCK_BYTES // (8 * dims))
            for part in (m[i : i + each] for i in range(0, len(m), each)):
                kind = next(k for k in ("i1", "i2", "i4", "i8") if np.iinfo(k).min <= part.min() and part.max() <= np.iinfo(k).max)
                yield pa.RecordBatch.from_pydict({"rows": pa.array([len(part)], pa.int64()), "kind": [kind], "data": pa.array([part.astype(f"<{kind}").tobytes()], pa.binary())})

    return x.mapInArrow(run, "rows long, kind string, data binary")


def unpacked(batches, dims: int):
    for b in batches:
        for kind, data in zip(b.column(1).to_pylist(), b.column(2), strict=True):
            yield np.frombuffer(data.as_buffer(), dtype=f"<{kind}").reshape(-1, dims)


def totals(blocks: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""

    def run(batches):
        sums, n = [0] * dims, 0
        for m in unpacked(batches, dims):
            whole = m.astype(object) if m.dtype.itemsize == 8 else m.astype(np.int64)
            sums, n = [a + int(b) for a, b in zip(sums, whole.sum(axis=0), strict=True)], n + len(m)
        if n:
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(-1, dims), pa.int32()), "value": pa.array([Decimal(v) for v in (n, *sums)], pa.decimal128(28, 0))})

    rows = blocks.mapInArrow(run, "place int, value decimal(28,0)").groupBy("place").agg(F.sum("value").alias("value")).collect()  # dims + 1 rows
    found = {r["place"]: int(r["value"]) for r in rows}
    return found[-1], [found[i] for i in range(dims)]


def summed(blocks: DataFrame, mean: np.ndarray, make: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum of make(centred vectors) over all vectors: each task adds up its own, and cells are then summed natively."""
    dims = len(mean)

    def run(batches):
        total = np.zeros(shape)
        for m in unpacked(batches, dims):
            total += make(m - mean)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(total.size, dtype=np.int32)), "value": pa.array(total.ravel())})

    out = np.zeros(shape[0] * shape[1])
    for r in blocks.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():  # as many rows as the shape has cells
        out[r["cell"]] = r["value"]
    return out.reshape(shape)


def lower_end(product: Callable[[np.ndarray], np.ndarray], dims: int, steps: int, rng: np.random.Generator) -> float:
    """A value below which the spectrum hardly reaches, by Lanczos steps; how good it is decides the speed, not the result."""
    q, before, beta, a, b = rng.normal(size=dims), np.zeros(dims), 0.0, [], []
    q /= np.linalg.norm(q)
    for _ in range(min(steps, dims)):
        w = product(q[:, None])[:, 0] - beta * before
        a.append(float(w @ q))
        w -= a[-1] * q
        beta = float(np.linalg.norm(w))
        b.append(beta)
        if beta <= 1e-12 * abs(a[0]):
            break
        before, q = q, w / beta
    return max(0.0, float(np.linalg.eigvalsh(np.diag(a) + np.diag(b[:-1], 1) + np.diag(b[:-1], -1))[0]) - b[-1])


def filtered(product: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """The scaled Chebyshev polynomial of the covariance V, small from low to cut and large above, times q; vq is Vq."""
    half, middle = max((cut - low) / 2, 1e-6 * top), (cut + low) / 2
    sigma = first = half / (top - middle)
    y = (vq - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        new = 1 / (2 / first - sigma)
        q, y = y, (product(y) - middle * y) * (2 * new / half) - (sigma * new) * q
        sigma = new
    return y


def components(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, guard: int = GUARD, degree: int = DEGREE, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues of V, falling, and unit eigenvectors as columns, their largest entry positive; product(Q) is VQ."""
    rng = np.random.default_rng(SEED)
    wanted, width = min(wanted, dims), min(dims, wanted + guard)
    q, _ = np.linalg.qr(rng.normal(size=(dims, width)))
    low = lower_end(product, dims, STEPS, rng) if width < dims else 0.0
    vq, last = product(q), np.inf
    for _ in range(most):
        e, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        e, turn = e[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        worst = float(np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * e[:wanted], axis=0).max())
        if worst <= CERTAIN * e[0] or worst <= SETTLED * e[0] and worst > last / 2:
            u = q[:, :wanted]
            return np.maximum(e[:wanted], 0), u * np.sign(u[np.abs(u).argmax(axis=0), range(wanted)])
        last = worst
        q, _ = np.linalg.qr(filtered(product, q, vq, low, float(e[-1]), float(e[0]), degree) if width < dims else vq)
        vq = product(q)
    raise WhiteningError(f"residual {worst} of {e[0]} after {most} turns")


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sum over dimensions of (n x - S) ** 2; null beyond 38 digits."""
    far = max(n * max(abs(int(x.max())), abs(int(x.min()))), *map(abs, sums), 1) if x.size else 1
    if 4 * far * far * x.shape[1] < 1 << 63:
        each = n * x.astype(np.int64) - np.array(sums, dtype=np.int64)
        return pa.array((each * each).sum(axis=1)).cast(pa.decimal128(38, 0))
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def whitened_of_length(rows: DataFrame, dims: int, wanted: int) -> DataFrame:
    blocks = stored(packed(rows.select("x").distinct(), dims), "whitening-blocks")
    n, sums = totals(blocks, dims)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    product = lambda q: summed(blocks, mean, lambda x: x.T @ (x @ q), q.shape) / n
    trace = float(summed(blocks, mean, lambda x: np.array([[np.vdot(x, x)]]), (1, 1))[0, 0]) / n
    wanted = min(wanted, dims)
    if trace > 0:
        e, u = components(product, dims, wanted)
    else:  # one distinct vector
        e, u = np.zeros(wanted), np.eye(dims)[:, :wanted]
    told = e > dims * np.finfo(float).eps * max(e[0], np.finfo(float).tiny)
    out = u[:, told] / np.sqrt(e[told])
    k = out.shape[1]
    error = float(np.abs(summed(blocks, mean, lambda x: (x @ out).T @ (x @ out), (k, k)) / n - np.eye(k)).max()) if k else None
    explained = [float(v / trace) if trace > 0 else None for v in e]
    dropped(blocks)

    def run(batches):
        for b in batches:
            x = matrix(b.column(1), dims)
            white = np.full((len(x), wanted), np.nan)
            white[:, told] = (x - mean) @ out
            m = len(x)
            repeat = np.repeat(np.arange(m), wanted)
            columns = [b.column(0).take(pa.array(repeat)), pa.array(np.tile(np.arange(1, wanted + 1, dtype=np.int32), m)), pa.array(np.full(m * wanted, n)), deviations(x, n, sums).take(pa.array(repeat))]
            columns += [pa.array(white.ravel(), from_pandas=True), pa.array(explained * m, pa.float64()), pa.array([error] * (m * wanted), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, RESULT)


def whitened(vectors: DataFrame, wanted: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """A row for each usable row of vectors (vec_id, embedding) and each component up to wanted, or up to the dimensions.

    Vectors that are null, or hold null or non-finite entries, have no rows, nor have those without entries.  Each distinct
    vector of whole numbers counts once in the fit, so n, the components and identity_error don't depend on copies.
    Repeated rows, rows of one id and rows of a null id each have their own results.  Vectors of different lengths
    are fitted and whitened among those of their length, so identity_error is one value for each length.  whitened is null
    for a component without variance, explained too if there is none at all (one distinct vector).  deviation is
    exact, and null beyond 38 digits.  Equal eigenvalues have any orthonormal eigenvectors.  Other columns play no part,
    and an empty table gives no rows.
    """
    rows = usable(vectors, scale)
    lengths = sorted(r["dims"] for r in rows.select(F.size("x").alias("dims")).distinct().filter("dims > 0").collect())  # a row for each length
    found = vectors.sparkSession.createDataFrame([], RESULT)
    for dims in lengths:
        found = found.union(whitened_of_length(rows.filter(F.size("x") == dims), dims, wanted))
    return found


def op12_whitening(spark, sf_dir):
    found = whitened(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLES: dict[str, str] = {}
