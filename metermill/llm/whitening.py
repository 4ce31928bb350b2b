"""Embedding whitening: leading eigenvectors of the covariance by Jacobi-Davidson, without forming a matrix.

An entry c becomes the long x = floor(256 c).  The fit list is each distinct x vector once, n of them with sums S per dimension; it is
stored as packed blocks.  All the solver knows of the data are products V W of the covariance with a few columns: each is one Spark job,
in which every task centres its vectors (n x - S, exact integers), multiplies, and adds up a dimension x columns array.

Jacobi-Davidson on top: Rayleigh-Ritz in a growing subspace gives the current pairs; for each unconverged pair the projected correction
equation (I - QQ')(V - theta)(I - QQ') t = -r is solved roughly by MINRES, Q being the converged and the current vectors.  The systems of
all pairs go in lockstep, so a step of all of them is one product.  A pair whose residual reaches ``TOLERANCE`` times the largest
eigenvalue is locked and projected out.  The driver holds vectors of the dimension only, never rows.

Defined results: rows whose vector is null, empty, or has null or non-finite entries are dropped, and so are vectors of another length
than the commonest (of equally common ones the longer); a null id stays null; repeated rows are repeated in the result and one vector in
the fit; directions without variance (eigenvalue below ``RANK`` times the largest) are no components, so there can be fewer than
``top`` and none if all vectors are equal; entries beyond the range of a long stop at its ends; a deviation beyond it is null;
equal eigenvalues share a space in which any orthonormal basis is right; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import prepare, stored

TOP = 4
#: Residual norm over the largest eigenvalue at which a pair is locked; below LOOSE it is also taken when it no longer falls.
TOLERANCE, LOOSE = 2e-14, 1e-11
RANK = 1e-12
#: Columns of the subspace before a restart, MINRES steps of a correction, outer steps at most.
SUBSPACE, INNER, OUTER = 40, 4, 200
BLOCK_BYTES = 1 << 17


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """wh_id and x of the rows that remain."""
    v = F.col("wh_vector")
    rows = vectors.select(F.col(f"`{id_col}`").alias("wh_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("wh_vector"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.filter(v.isNotNull() & (F.size(v) > 0) & finite)
    lengths = rows.groupBy(F.size(v).alias("length")).agg(F.count(F.lit(1)).alias("times"))
    common = lengths.orderBy(F.desc("times"), F.desc("length")).limit(1).collect()
    length = common[0].length if common else 0
    return rows.filter(F.size(v) == length).select("wh_id", F.transform(v, lambda c: F.floor(c * 256)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


class FitList:
    """The distinct vectors in blocks (of, data), their number and sums, and products with their covariance."""

    def __init__(self, rows: DataFrame):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("x"))
                step = max(1, BLOCK_BYTES // (8 * x.shape[1])) if len(x) else 1
                data = [np.ascontiguousarray(x[i : i + step]) for i in range(0, len(x), step)]
                yield pa.RecordBatch.from_arrays([pa.array([len(d) for d in data], pa.int64()), pa.array([d.tobytes() for d in data], pa.binary())], names=["of", "data"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            high = low = top = None
            for x in _blocks(batches):
                if high is None:
                    high, low, top = np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1])
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
                top = np.maximum(top, np.abs(x.astype(float)).max(axis=0))
            if high is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high))), pa.array(high), pa.array(low), pa.array(top)], names=["at", "high", "low", "top"])

        self.blocks = stored(rows.select("x").distinct().mapInArrow(pack, "of long, data binary"), "fit_list")
        sums = self.blocks.mapInArrow(add, "at long, high long, low long, top double").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.max("top").alias("top"))
        found = sums.orderBy("at").collect()
        self.n = self.blocks.agg(F.coalesce(F.sum("of"), F.lit(0)).alias("n")).collect()[0].n
        self.sums = [(r.high << 32) + r.low for r in found]
        self.wide = any((r.top + 1) * self.n >= 2.0**61 for r in found)
        self.products = 0

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """n x - S as integers; Python's own where 64 bits do not hold them."""
        n, sums, wide = self.n, self.sums, self.wide
        total = np.array(sums, object if wide else np.int64)
        return lambda x: (x.astype(object) if wide else x) * n - total

    def _summed(self, w: np.ndarray, inner: bool) -> np.ndarray:
        centre, n, k = self.centre(), self.n, w.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for x in _blocks(batches):
                c = centre(x).astype(float) / n
                y = c @ w
                more = np.vstack([(y if inner else c).T @ y, np.full(k, (c * c).sum())])
                out = more if out is None else out + more
            if out is not None:
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * k), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), values], names=["at", "v"])

        self.products += 1
        parts = self.blocks.mapInArrow(run, "at long, v array<double>").groupBy("at")
        found = parts.agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(k)]).orderBy("at").collect()
        return np.array([[r[f"v{i}"] for i in range(k)] for r in found]) / self.n

    def product(self, w: np.ndarray) -> np.ndarray:
        """V w; ``trace`` is that of V from then on."""
        out = self._summed(w, False)
        self.trace = float(out[-1, 0])
        return out[:-1]

    def gram(self, w: np.ndarray) -> np.ndarray:
        """w' V w, from the projected vectors themselves."""
        return self._summed(w, True)[:-1]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for of, data in zip(batch.column("of").to_pylist(), batch.column("data"), strict=True):
            if of:
                yield np.frombuffer(data.as_buffer(), np.int64).reshape(of, -1)


def _orthonormal(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Columns of t outside the bases, orthonormal; those that vanish are left out."""
    kept = np.zeros((len(t), 0))
    for v in t.T:
        size = np.linalg.norm(v)
        for _ in range(3):
            for b in (*bases, kept):
                v = v - b @ (b.T @ v)
        now = np.linalg.norm(v)
        if size > 0 and now > 1e-10 * size:
            v = v / now
            for b in (*bases, kept):
                v = v - b @ (b.T @ v)
            kept = np.column_stack([kept, v / np.linalg.norm(v)])
    return kept


def _correction(theta: float, q: np.ndarray, r: np.ndarray, steps: int) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """MINRES for the projected correction equation: yields vectors, is sent their products with V, returns t.

    The Lanczos basis (few columns) is kept and orthogonalised in full; t is the vector of the Krylov space with the least residual.
    """
    b = -(r - q @ (q.T @ r))
    size = np.linalg.norm(b)
    if size == 0:
        return b
    basis = (b / size)[:, None]
    t = np.zeros((1, 0))
    y = np.zeros(0)
    for step in range(steps):
        v = basis[:, -1]
        w = (yield v) - theta * v
        w = w - q @ (q.T @ w)
        h = np.zeros(step + 2)
        for _ in range(2):
            part = basis.T @ w
            w = w - basis @ part
            h[: step + 1] += part
        h[-1] = np.linalg.norm(w)
        t = np.column_stack([np.vstack([t, np.zeros(step)]) if step else np.zeros((2, 0)), h])
        y, *_ = np.linalg.lstsq(t, size * np.eye(step + 2)[0], rcond=None)
        if np.linalg.norm(t @ y - size * np.eye(step + 2)[0]) < 1e-3 * size or h[-1] < 1e-12 * abs(h[:-1]).max(initial=1e-300):
            break
        basis = np.column_stack([basis, w / h[-1]])
    return basis[:, : len(y)] @ y


def _lockstep(solvers: list[Generator], product: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """Results of solvers whose steps share a product."""
    out: list[np.ndarray | None] = [None] * len(solvers)
    asked: dict[int, np.ndarray] = {}

    def go(i: int, value: np.ndarray | None) -> None:
        try:
            asked[i] = solvers[i].send(value)
        except StopIteration as end:
            out[i] = end.value

    for i in range(len(solvers)):
        go(i, None)
    while asked:
        order = sorted(asked)
        answers = product(np.column_stack([asked[i] for i in order]))
        asked = {}
        for i, a in zip(order, answers.T, strict=True):
            go(i, a)
    return out


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], d: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``top`` largest eigenvalues of a symmetric matrix known by products, unit vectors (columns), and residual norms."""
    top = min(top, d)
    locked, values, residuals = np.zeros((d, 0)), [], []
    u = _orthonormal(np.random.default_rng(7).standard_normal((d, min(d, 2 * top))))
    w = product(u)
    best, stale = np.inf, 0
    for _ in range(OUTER):
        h = u.T @ w
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        ritz, images = u @ s, w @ s
        largest = max([abs(theta[0]), *map(abs, values)])
        wanted = top - len(values)
        r = images[:, :wanted] - ritz[:, :wanted] * theta[:wanted]
        r = r - locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0)
        if size[0] < best / 2:
            best, stale = size[0], 0
        else:
            stale += 1
        done = 0
        while done < len(size) and (size[done] <= TOLERANCE * largest or (stale >= 3 and size[done] <= LOOSE * largest)):
            done += 1
        if done:
            values += theta[:done].tolist()
            residuals += size[:done].tolist()
            locked = np.column_stack([locked, ritz[:, :done]])
            best, stale = np.inf, 0
        if len(values) == top:
            break
        left = ritz.shape[1] - done
        if left > SUBSPACE - wanted:  # restart with the best pairs
            left = 2 * top
        u, w = ritz[:, done : done + left], images[:, done : done + left]
        current = u[:, : wanted - done]
        q = np.column_stack([locked, current])
        solvers = [_correction(theta[done + j], q, r[:, done + j], min(INNER, d)) for j in range(current.shape[1])]
        more = _orthonormal(np.column_stack(_lockstep(solvers, product)), locked, u) if d > u.shape[1] + locked.shape[1] else np.zeros((d, 0))
        if more.shape[1]:
            u, w = np.column_stack([u, more]), np.column_stack([w, product(more)])
        else:  # the subspace is whole: refresh its images
            u = _orthonormal(u, locked)
            w = product(u)
    else:
        raise RuntimeError(f"residuals {size.tolist()} after {OUTER} steps")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order], np.array(residuals)[order]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP) -> DataFrame:
    """A row per remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, residual (the
    component's residual norm over the largest eigenvalue)."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = stored(whole_vectors(vectors, id_col, vector_col), "vectors")
    fit = FitList(rows)
    id_type = rows.schema["wh_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    if not fit.n:
        return spark.createDataFrame([], schema)
    e, q, r = eigenpairs(fit.product, len(fit.sums), top)
    some = e > RANK * max(e[0], 0)
    if not some.any() or fit.trace <= 0:
        return spark.createDataFrame([], schema)
    e, q, r = e[some], q[:, some], r[some]
    scaled = q / np.sqrt(e)
    error = float(np.abs(fit.gram(scaled) - np.eye(len(e))).max())
    centre, n, k, explained, residual = fit.centre(), fit.n, len(e), e / fit.trace, r / e[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = centre(_matrix(batch.column("x")))
            as_float = d.astype(float)
            far = (as_float * as_float).sum(axis=1)
            deviation = np.where(far < 9e18, (d * d).sum(axis=1), 0).tolist() if d.dtype != object else [0] * len(d)
            for i in np.flatnonzero((far >= 9e18) | (d.dtype == object)):
                exact = sum(int(v) ** 2 for v in d[i])
                deviation[i] = exact if exact < 2**63 else None
            m, each = len(d), np.repeat(np.arange(len(d)), k)
            columns = [
                batch.column("wh_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                pa.array(deviation, pa.int64()).take(pa.array(each)), pa.array(((as_float / n) @ scaled).ravel()), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)), pa.array(np.tile(residual, m)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"])

    return rows.mapInArrow(run, schema)
