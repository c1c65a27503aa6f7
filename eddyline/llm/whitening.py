"""Embedding whitening along the leading principal components, found by
Jacobi-Davidson iteration without ever forming the covariance matrix.

Vectors become integers, x = floor(scale * c) + shift, and each distinct x is
fitted once.  The covariance V of the fit list is used only through products
V q: every task multiplies its chunks of centred vectors into a block of
columns, and the partial products are summed by dimension, so the driver sees
``dimensions x columns`` numbers however long the table is.

The iteration keeps a subspace and its products.  A Rayleigh-Ritz step gives
the leading pairs; those whose residuals have reached double precision are
locked, largest first; for the others the correction equation

    (I - QQ') (V - theta I) (I - QQ') t = -r,        Q: locked and current pairs

is solved by a few steps of MINRES, all columns at once, so that a step is one
distributed product.  The corrections widen the subspace, which restarts from
its best pairs when it is full.

Centring is exact: with c = floor(S / n) the integers x - c are small, and the
rest (S - n c) / n is below one, so a centred entry keeps all its digits
whatever ``shift`` is.

Defined cases: vectors that are null, or hold null or non-finite entries, take
no part; missing trailing entries count as 0; null ids stay; repeated rows are
rows of their own but one vector of the fit; directions without variance are
no components, so fewer than ``k`` may come back (none, if all vectors are
equal); an empty table gives an empty result; entries beyond 2^40 raise an
error instead of losing digits; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline.llm.common import load_table, prepare, stored

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
CHUNK = 4096                 # vectors in a stored chunk
INNER = 6                    # MINRES steps for a correction
INNER_TOL = 1e-3
MAX_OUTER = 200
EPS = float(np.finfo(float).eps)
LARGEST = 2 ** 40


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``(id, x array<bigint>)`` of the rows that take part."""
    bad = F.exists(vec_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform(vec_col, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long") + F.lit(shift).cast("long"))
    return df.filter(F.col(vec_col).isNotNull() & ~bad).select(F.col(id_col).alias("id"), scaled.alias("x"))


def _matrix(col: pa.Array, dims: int, fill: int) -> np.ndarray:
    """Arrow lists as rows of a matrix; what is missing is ``fill``."""
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy()
    if (sizes == dims).all():
        out = flat.reshape(len(sizes), dims)
    else:
        out = np.full((len(sizes), dims), fill, np.int64)
        out[np.arange(dims) < sizes[:, None]] = flat
    if out.size and max(-int(out.min()), int(out.max())) > LARGEST:
        raise OverflowError("an entry exceeds 2^40 after scaling")
    return out


class FitList:
    """The distinct vectors in stored chunks, their count and exact sums."""

    def __init__(self, vectors: DataFrame, shift: int = SHIFT):
        self.spark, self.shift = vectors.sparkSession, shift
        self.dims = dims = vectors.agg(F.max(F.size("x"))).first()[0] or 0
        padded = F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(dims) - F.size("x")))
        each = vectors.select(F.when(F.size("x") < dims, padded).otherwise(F.col("x")).alias("x")).distinct()

        def pack(batches):
            for b in batches:
                m = _matrix(b.column(0), dims, shift)
                parts = [m[i:i + CHUNK] for i in range(0, len(m), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array([len(p) for p in parts], pa.int64()),
                                                  pa.array([p.tobytes() for p in parts], pa.binary())], names=["m", "mat"])

        self.chunks = stored(each.mapInArrow(pack, "m long, mat binary"), "whitening-chunks")
        self.n = int(self.chunks.agg(F.sum("m")).first()[0] or 0) if dims else 0
        sums = self._summed(lambda x: x.sum(axis=0)[:, None], 1, dims, "long") if self.n else np.zeros((dims, 1), np.int64)
        self.sums = sums[:, 0]
        whole = self.sums // max(self.n, 1)
        self.whole, self.rest = whole, (self.sums - self.n * whole) / max(self.n, 1)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest

    def _summed(self, part, cols: int, rows: int, kind: str = "double") -> np.ndarray:
        """Sum over all chunks of ``part(x)``, a ``rows x cols`` matrix; each
        task adds up its own chunks first."""
        dims, names = self.dims, [f"y{j}" for j in range(cols)]

        def run(batches):
            total = np.zeros((rows, cols), np.int64 if kind == "long" else float)
            for pdf in batches:
                for mat in pdf["mat"]:
                    total += part(np.frombuffer(mat, np.int64).reshape(-1, dims))
            out = pd.DataFrame(total, columns=names)
            out.insert(0, "row", np.arange(rows, dtype=np.int32))
            yield out

        schema = "row int, " + ", ".join(f"{c} {kind}" for c in names)
        got = (self.chunks.select("mat").mapInPandas(run, schema).groupBy("row")
               .agg(*[F.sum(c).alias(c) for c in names]).collect())
        out = np.zeros((rows, cols), np.int64 if kind == "long" else float)
        for r in got:
            out[r["row"]] = r[1:]
        return out

    def _local(self):
        """What a task needs to centre its chunks."""
        whole, rest = self.whole, self.rest
        return lambda x: (x - whole).astype(float) - rest

    def product(self, q: np.ndarray) -> np.ndarray:
        """V q for a block of columns."""
        centre = self._local()

        def part(x):
            c = centre(x)
            return c.T @ (c @ q)

        return self._summed(part, q.shape[1], self.dims) / self.n

    def trace(self) -> float:
        centre = self._local()
        return float(self._summed(lambda x: (centre(x) ** 2).sum(axis=0)[:, None], 1, self.dims).sum()) / self.n

    def covariance_of(self, project: np.ndarray) -> np.ndarray:
        """Covariance of the projected fit list, centred before multiplying."""
        centre, k = self._local(), project.shape[1]
        mean = self._summed(lambda x: (centre(x) @ project).sum(axis=0)[:, None], 1, k)[:, 0] / self.n

        def part(x):
            z = centre(x) @ project - mean
            return z.T @ z

        return self._summed(part, k, k) / self.n


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns spanning what ``block`` adds to ``against`` (orthonormal)."""
    out = against
    for j in range(block.shape[1]):
        v = block[:, j]
        size = np.linalg.norm(v)
        for _ in range(3):
            if size > 0:
                v = v / np.linalg.norm(v)
                v = v - out @ (out.T @ v)
                if np.linalg.norm(v) < 1e-8:        # nothing new but rounding
                    size = 0
        if size > 0:
            out = np.column_stack([out, v / np.linalg.norm(v)])
    return out[:, against.shape[1]:]


def minres(product, shifts: np.ndarray, q: np.ndarray, rhs: np.ndarray, steps: int = INNER, tol: float = INNER_TOL) -> np.ndarray:
    """Approximate solutions t, orthogonal to ``q``, of the projected systems
    (V - shift_j I) t_j = rhs_j; a step is one product for all columns."""
    def project(a):
        a = a - q @ (q.T @ a)
        return a - q @ (q.T @ a)

    y = project(rhs)
    beta = np.linalg.norm(y, axis=0)
    first, x = beta.copy(), np.zeros_like(y)
    r1 = r2 = y
    w = w2 = np.zeros_like(y)
    old_beta, dbar, eps, phibar = np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta), beta.copy()
    cs, sn = -np.ones_like(beta), np.zeros_like(beta)
    for step in range(steps):
        live = (beta > EPS * np.maximum(first, 1e-300)) & (phibar > tol * first)
        if not live.any():
            break
        v = np.where(live, y / np.where(live, beta, 1), 0)
        y = project(product(v) - shifts * v)
        if step:
            y = y - np.where(live, beta / np.where(live, old_beta, 1), 0) * r1
        alpha = (v * y).sum(axis=0)
        y = np.where(live, y - alpha / np.where(live, beta, 1) * r2, 0)
        r1, r2, old_beta = r2, y, np.where(live, beta, old_beta)
        beta = np.linalg.norm(y, axis=0)
        old_eps, delta, gbar = eps, cs * dbar + sn * alpha, sn * dbar - cs * alpha
        eps, dbar = sn * beta, -cs * beta
        gamma = np.maximum(np.hypot(gbar, beta), 1e-300)
        cs, sn = gbar / gamma, beta / gamma
        phi, phibar = cs * phibar, np.where(live, sn * phibar, phibar)
        w1, w2 = w2, w
        w = (v - old_eps * w1 - delta * w2) / gamma
        x = np.where(live, x + phi * w, x)
    return project(x)


def jacobi_davidson(product, dims: int, k: int, seed: int = 1, max_outer: int = MAX_OUTER) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues (falling) and unit eigenvectors of the
    symmetric positive semi-definite operator ``product``."""
    k = min(k, dims)
    locked = np.zeros((dims, 0))
    basis = _orthonormal(np.random.default_rng(seed).normal(size=(dims, min(dims, 2 * k))), locked)
    image = product(basis)
    norm, best, stuck = 0.0, np.inf, 0
    for _ in range(max_outer):
        h = basis.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        norm = max(norm, theta[0], 1e-300)
        want = k - locked.shape[1]
        ritz, mapped = basis @ s, image @ s
        residual = mapped - ritz * theta
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual[:, :want], axis=0) / norm
        stuck = 0 if size.max() < best / 2 else stuck + 1
        best = min(best, size.max())
        full = locked.shape[1] + basis.shape[1] == dims
        # rounding in the products leaves a floor: a residual that no longer
        # falls and is a few digits from double precision is at that floor
        tol = 8 * EPS * np.sqrt(dims) if not (full or stuck >= 2) else 1e-12
        done = 0
        while done < want and size[done] <= tol:
            done += 1
        if done:
            locked = np.column_stack([locked, ritz[:, :done]])
            ritz, mapped, theta, residual = ritz[:, done:], mapped[:, done:], theta[done:], residual[:, done:]
            best, stuck, want = np.inf, 0, want - done
        if not want:
            break
        if full and not done:
            raise RuntimeError("residuals stay above double precision")
        if basis.shape[1] + want > 6 * k:                       # restart from the best pairs
            ritz, mapped = ritz[:, :2 * k], mapped[:, :2 * k]
        basis, image = ritz, mapped
        q = np.column_stack([locked, ritz[:, :want]])
        step = minres(product, theta[:want], q, -residual[:, :want])
        taken = np.column_stack([locked, basis])
        new = _orthonormal(step, taken)
        if not new.shape[1]:
            new = _orthonormal(residual[:, :want], taken)
        if new.shape[1]:
            basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
        else:
            stuck += 1
    else:
        raise RuntimeError("Jacobi-Davidson did not settle")
    # one more Rayleigh-Ritz step, with fresh products of the locked pairs
    locked = np.linalg.qr(locked)[0]
    h = locked.T @ product(locked)
    theta, s = np.linalg.eigh((h + h.T) / 2)
    return theta[::-1], locked @ s[:, ::-1]


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``
    for each row that takes part and each component, numbered from 1."""
    spark = df.sparkSession
    src = integer_vectors(df, id_col, vec_col, scale, shift)
    schema = T.StructType([T.StructField(id_col, src.schema["id"].dataType), T.StructField("component", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]])
    fit = FitList(src, shift)
    trace = fit.trace() if fit.n and fit.dims else 0.0
    if not trace:
        return spark.createDataFrame([], schema)
    values, vectors = jacobi_davidson(fit.product, fit.dims, k)
    some = values > fit.dims * EPS * trace
    values, vectors = values[some], vectors[:, some]
    project = vectors / np.sqrt(values)
    error = float(np.abs(fit.covariance_of(project) - np.eye(len(values))).max())
    explained, m = values / trace, len(values)
    n, dims, sums, centre = fit.n, fit.dims, fit.sums, fit._local()

    def rows(batches):
        for b in batches:
            x = _matrix(b.column(1), dims, shift)
            off = n * x - sums
            if off.size and float((off.astype(float) ** 2).sum(axis=1).max()) > 9e18:
                raise OverflowError("a deviation exceeds 64 bits")
            size = len(x)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(np.repeat(np.arange(size), m))),
                pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), size)),
                pa.array(np.full(size * m, n, np.int64)),
                pa.array(np.repeat((off * off).sum(axis=1), m)),
                pa.array((centre(x) @ project).ravel()),
                pa.array(np.tile(explained, size)),
                pa.array(np.full(size * m, error))], names=schema.names)

    return src.mapInArrow(rows, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return whiten(load_table(spark, sf_dir, "embeddings"))
