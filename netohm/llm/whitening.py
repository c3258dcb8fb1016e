"""Whitening of embeddings by spectral divide and conquer on polar decompositions (QDWH).

Vectors become integers x = floor(scale * c). The distinct x vectors are the list that is fitted: their sums S are exact, and
their covariance V is summed from centred vectors, (x - S / n) times itself, by tasks. V has as many rows as a vector has
entries, so it fits the driver. There it is split: for a shift s the unitary polar factor U of V - s I, by the QR-free
QDWH iteration, gives the projector (I + U) / 2 on the eigenvectors above s; an orthonormal basis of its range and one of
the rest make two smaller problems, down to single components. The leading components go to all tasks, and every row is projected.

Defined cases: rows whose vector is null, or holds null or non-finite entries, are dropped, and so are vectors of another
length than most have (ties: the longer); rows that repeat a vec_id or a vector stay, while the fit takes each distinct x
once; components of no variance are left out, so a table of one distinct vector or of none gives no rows; extra columns
are ignored; equal eigenvalues leave their components' directions open, but alike for all rows. Numbers stay
exact while n * x and the sum of squares fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netohm.llm.work import ship, written

SCALE, COMPONENTS = 256.0, 4
EPS = np.finfo(float).eps
#: Tasks' sums are added in so many groups before the driver sees them.
GROUPS = 32


# --- spectral divide and conquer on one symmetric matrix -------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric regular matrix by dynamically weighted Halley iteration."""
    x = a / np.linalg.norm(a, 2 if len(a) < 3 else "fro")
    low = max(1 / np.linalg.norm(np.linalg.inv(x), "fro"), EPS)  # below the least singular value
    eye = np.eye(len(a))
    for _ in range(60):
        s = low * low
        d = np.cbrt(4 * (1 - s) / (s * s))
        w = np.sqrt(1 + d)
        wa = w + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - s) / (s * w), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:  # by QR while the weights are large
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[: len(a)] @ q[len(a) :].T
        else:
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(eye + wc * x.T @ x, x.T).T
        low = min(low * (wa + wb * s) / (1 + wc * s), 1.0)
        change = np.linalg.norm(new - x, "fro")
        x = (new + new.T) / 2
        if change <= np.cbrt(4 * EPS) and abs(1 - low) < 1e-8 or change <= 8 * EPS * len(a):
            break
    return x


def _bases(projector: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range, of dimension k, and of the rest."""
    q = np.linalg.qr(projector @ rng.standard_normal((len(projector), k)))[0]
    whole = np.linalg.qr(np.hstack([projector @ q, rng.standard_normal((len(projector), len(projector) - k))]))[0]
    return whole[:, :k], whole[:, k:]


def spectrum(a: np.ndarray, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of a symmetric matrix, split recursively by spectral projectors."""
    n = len(a)
    scale = scale or np.linalg.norm(a, "fro")
    mean = np.trace(a) / n
    if n == 1 or np.linalg.norm(a - mean * np.eye(n), "fro") <= 4 * EPS * n * scale:  # one eigenvalue
        return np.diag(a).copy(), np.eye(n)
    rng = np.random.default_rng(n)
    spread = np.linalg.norm(a - mean * np.eye(n), "fro") / np.sqrt(n)
    # eigenvalues lie on both sides of their mean; a shift beside it where an eigenvalue stands there
    for shift in (np.median(np.diag(a)), mean, mean + 0.1 * spread, mean - 0.1 * spread, mean + 0.01 * spread, mean - 0.01 * spread):
        moved = a - shift * np.eye(n)
        try:
            u = polar(moved)
        except np.linalg.LinAlgError:
            continue
        k = round((n + np.trace(u)) / 2)
        if not 0 < k < n or np.linalg.norm(u @ u - np.eye(n), "fro") > 1e-8:
            continue
        top, rest = _bases((np.eye(n) + u) / 2, k, rng)
        if np.linalg.norm(rest.T @ a @ top, "fro") <= 64 * EPS * n * scale:
            break
    else:
        raise ArithmeticError("no shift splits the spectrum")
    values, vectors = [], []
    for basis in (top, rest):
        part = basis.T @ a @ basis
        e, v = spectrum((part + part.T) / 2, scale)
        values.append(e)
        vectors.append(basis @ v)
    return np.concatenate(values), np.hstack(vectors)


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of v, falling, and unit eigenvectors as columns, after one step of refinement."""
    e, q = spectrum(v)
    q = np.linalg.qr(q)[0]
    m = q.T @ v @ q
    gap = np.subtract.outer(np.diag(m), np.diag(m))
    safe = np.abs(gap) > 1e-6 * max(np.abs(np.diag(m)).max(), 1e-300)
    q = np.linalg.qr(q @ (np.eye(len(m)) - np.where(safe, m / np.where(safe, gap, 1), 0)))[0]  # first-order turn of off-diagonal remains
    e = np.einsum("ij,ij->j", q, v @ q)
    order = np.argsort(-e, kind="stable")
    return e[order], q[:, order]


# --- tables ----------------------------------------------------------------------------------------------------------


def integer_vectors(embeddings: DataFrame, column: str = "embedding", scale: float = SCALE) -> DataFrame:
    """vec_id and x (array of long) of the rows with whole vectors of the usual length."""
    c = F.col(column)
    whole = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = written(embeddings.where(c.isNotNull() & whole & (F.size(c) > 0)).select("vec_id", F.transform(c, lambda v: F.floor(v.cast("double") * scale)).alias("x")), "vectors")
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows if usual is None else rows.where(F.size("x") == usual["d"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums by dimension of a task's vectors."""
    total = None
    for b in batches:
        if b.num_rows:
            s = _matrix(b.column("x")).sum(0)
            total = s if total is None else total + s
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.int64())], names=["i", "s"])


def _products(mean: np.ndarray, groups: int):
    """Rows of a task's sum of centred vectors times themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((len(mean), len(mean))), 0
        for b in batches:
            x = _matrix(b.column("x")) - mean
            total += x.T @ x
            rows += b.num_rows
        if rows:
            group = np.full(len(mean), rows % groups)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mean)), pa.int32()), pa.array(group, pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "g", "row"])

    return run


def _added(table: pa.Table) -> pa.Table:
    row = np.sum(np.stack(table.column("row").to_numpy()), axis=0)
    return pa.table({"i": table.column("i")[:1], "row": pa.array([row], pa.list_(pa.float64()))})


def covariance(fit: DataFrame, mean: np.ndarray, n: int) -> np.ndarray:
    """The covariance of x over fit, divisor n, centred before multiplying."""
    parts = fit.mapInArrow(_products(mean, GROUPS), "i int, g int, row array<double>")
    once = parts.groupBy("i", "g").applyInArrow(_added, "i int, row array<double>").groupBy("i").applyInArrow(_added, "i int, row array<double>")
    rows = once.orderBy("i").toArrow().column("row").to_pylist()  # a row for each dimension
    v = np.array(rows) / n
    return (v + v.T) / 2


def _projected(s: np.ndarray, n: int, turn: np.ndarray):
    """Rows with the exact deviation and the whitened components of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x")) if b.num_rows else np.zeros((0, len(s)), np.int64)
            deviation = ((n * x - s) ** 2).sum(1)
            z = (x - s / n) @ turn
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(deviation, pa.int64()), pa.array(list(z), pa.list_(pa.float64()))], names=["vec_id", "deviation", "z"])

    return run


def whiten(embeddings: DataFrame, most: int = COMPONENTS, column: str = "embedding", scale: float = SCALE) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and leading component."""
    spark = embeddings.sparkSession
    ship(spark)
    rows = integer_vectors(embeddings, column, scale)
    kind = rows.schema["vec_id"].dataType.simpleString()
    fit = written(rows.select("x").distinct(), "fit")
    n = fit.count()
    empty = spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if n < 2:
        return empty
    sums = fit.mapInArrow(_sums, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()  # a row for each dimension
    s = np.array([r["s"] for r in sums], np.int64)
    v = covariance(fit, s / n, n)
    e, q = components(v)
    k = int(np.count_nonzero(e[:most] > 64 * EPS * len(e) * e[0]))
    turn = q[:, :k] / np.sqrt(e[:k])
    shape = f"vec_id {kind}, deviation long, z array<double>"
    ours = fit.select(F.lit(None).cast(kind).alias("vec_id"), "x").mapInArrow(_projected(s, n, turn), shape).select(*[F.get("z", F.lit(i)).alias(f"z{i}") for i in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = ours.agg(*[F.covar_pop(f"z{i}", f"z{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    explained = F.get(F.array(*[F.lit(float(x)) for x in e[:k] / np.trace(v)]), F.col("at"))
    out = rows.mapInArrow(_projected(s, n, turn), shape).select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(float(error)).alias("identity_error"))
