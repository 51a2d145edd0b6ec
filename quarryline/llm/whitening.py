"""Whitening of embeddings by a randomised range finder.

1. Entries become whole numbers; rows with null or non-finite entries go. Each distinct vector is in the fit list once.
2. Exact sums of the fit list give its mean. A random basis of ``components + OVERSAMPLE`` columns is multiplied by the covariance again and again: every
   pass reads all centred rows of the fit list, each task adds its rows' products, and the tasks' matrices are added in rounds. After each product
   Rayleigh-Ritz in the basis gives components and eigenvalues, and their residuals.
3. Where residuals are still above ``RESIDUAL`` of the greatest eigenvalue after ``PASSES``, or fall too slowly to get there, the basis is expanded to the
   full dimension, for which Rayleigh-Ritz is exact.
4. A pass over the fit list measures the whitened vectors' covariance; the last one whitens all rows.

Only matrices of the vectors' dimension leave the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import written

COMPONENTS, OVERSAMPLE, PASSES = 16, 10, 6
#: The greatest residual of a component, as a share of the greatest eigenvalue.
RESIDUAL = 1e-13
#: An eigenvalue below this share of the greatest is nothing but rounding.
NOTHING = 1e-12
#: Tasks whose matrices one task adds; rows centred at once.
GATHER, ROWS = 64, 4096
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Beyond this an entry times 64 isn't a whole number of its own.
_LARGEST = float(2**46)


def prepared(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: rows whose entries are all finite, as whole numbers."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= _LARGEST), F.lit(False)))
    return rows.where(v.isNotNull() & (F.size(v) > 0)).where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(64 * c.cast("double")) + 1_000_000).alias("x"))


def _matrix(batch: pa.RecordBatch, column: int, d: int) -> Iterator[tuple[int, np.ndarray]]:
    x = batch.column(column).flatten().to_numpy().reshape(-1, d)
    for lo in range(0, len(x), ROWS):
        yield lo, x[lo : lo + ROWS]


class Centre:
    """The exact mean of the fit list: ``n`` vectors with the sums ``s``, as whole parts and remainders."""

    def __init__(self, n: int, s: list[int]) -> None:
        self.n, self.s = n, s
        self.whole = np.array([v // n for v in s], np.int64)
        self.rest = np.array([v % n for v in s], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of ``(n x - s)**2``, exact; None beyond 64 bits."""
        far = self.n * self.centred(x)
        rough = (far * far).sum(1)
        small = rough < 2**62
        out: list[int | None] = [None] * len(x)
        v = self.n * (x[small] - self.whole) - self.rest  # each below 2**31, as its square is below 2**62
        for i, d in zip(np.flatnonzero(small).tolist(), (v * v).sum(1).tolist(), strict=True):
            out[i] = d
        for i in np.flatnonzero(~small & (rough < 2**64)).tolist():
            d = sum((self.n * int(a) - b) ** 2 for a, b in zip(x[i], self.s, strict=True))
            out[i] = d if d < 2**63 else None
        return out


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    n, s = 0, [0] * d
    for batch in batches:
        for _, x in _matrix(batch, 0, d):
            n += len(x)
            # halves, so that no sum leaves 64 bits
            s = [a + (int(h) << 24) + int(low) for a, h, low in zip(s, (x >> 24).sum(0), (x & 0xFFFFFF).sum(0), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([str(n)]), pa.array([[str(v) for v in s]], pa.list_(pa.string()))], ["n", "sums"])


def _add(key: tuple, table: pa.Table) -> pa.Table:
    """The matrices of some tasks added, in the tasks' order."""
    order = np.argsort(table.column("src").to_numpy(), kind="stable")
    total: np.ndarray | None = None
    for i in order.tolist():
        m = np.frombuffer(table.column("matrix")[i].as_py(), np.float64)
        total = m.copy() if total is None else total + m
    return pa.table({"src": pa.array([key[0].as_py()], pa.int64()), "matrix": pa.array([total.tobytes()], pa.binary())})


def _gathered(fit: DataFrame, each: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray | None:
    """The sum over all rows of a matrix that ``each`` makes of some of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            for _, x in _matrix(batch, 0, d):
                m = each(x)
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["matrix"])

    parts = fit.select("x").mapInArrow(run, "matrix binary").withColumn("src", F.spark_partition_id().cast("long"))
    tasks = fit.rdd.getNumPartitions()
    while tasks > GATHER:
        parts = written(parts.withColumn("src", F.expr(f"src div {GATHER}")).groupBy("src").applyInArrow(_add, "src long, matrix binary"), "matrices")
        tasks = -(-tasks // GATHER)
    found = sorted(parts.select("src", "matrix").collect(), key=lambda r: r.src)  # GATHER matrices at most
    return sum((np.frombuffer(r.matrix, np.float64) for r in found[1:]), np.frombuffer(found[0].matrix, np.float64)) if found else None


def _ritz(q: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Of an orthonormal basis and its product with the covariance: the first ``k`` eigenvalues and components, and their greatest residual as a share of the
    first eigenvalue."""
    t = q.T @ y
    e, u = np.linalg.eigh((t + t.T) / 2)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    w = q @ u
    residual = float(np.linalg.norm(y @ u - w * e, axis=0).max())
    return e, w, residual / e[0] if e[0] > 0 else 0.0


def components(fit: DataFrame, centre: Centre, count: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = 0) -> dict:
    """The covariance's first eigenvalues ``e`` and unit eigenvectors ``w`` (columns; each's greatest entry is positive), its ``trace``, and how they were found: ``passes`` and
    ``expanded``."""
    d, n = len(centre.s), centre.n
    k, width = min(count, d), min(d, count + oversample)

    def product(q: np.ndarray) -> tuple[np.ndarray, float]:
        def each(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return np.concatenate(((c.T @ (c @ q)).ravel(), [(c * c).sum()]))

        flat = _gathered(fit, each, d) / n
        return flat[:-1].reshape(d, -1), float(flat[-1])

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0] if width < d else np.eye(d)
    before, done = np.inf, 0
    while True:
        y, trace = product(q)
        done += 1
        e, w, residual = _ritz(q, y, k)
        if residual <= RESIDUAL or q.shape[1] == d:
            break
        # what is to be gained in the passes that are left, at the rate of the last one
        rate = residual / before
        before = residual
        if done < passes and residual * rate ** (passes - done) <= RESIDUAL:
            q = np.linalg.qr(y)[0]
        else:
            q = np.eye(d)
    return {"e": e, "w": w * np.sign(w[np.abs(w).argmax(0), np.arange(k)]), "trace": trace, "passes": done, "expanded": q.shape[1] == d and width < d}


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS, seed: int = 0) -> DataFrame:
    """One row for each remaining row of ``rows`` and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Rows whose vector is null, empty, or holds a null, non-finite or huge entry (over 2**46) are dropped; so are those of another length than most have (the greater
    where as many have either). Repeated rows are whitened each and count once in the fit list; a null id stays null. Components of
    a vanishing eigenvalue (fewer distinct vectors than components) are returned with null ``whitened``. ``deviation`` is null beyond 64 bits. No
    remaining row gives no rows; other columns are not read.
    """
    ready = written(prepared(rows, id_col, vector_col), "vectors")
    most = ready.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("d")).limit(1).collect()
    if not most:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    d = most[0].d
    ready = ready.where(F.size("x") == d)
    fit = written(ready.select("x").distinct(), "fit-list")
    sums = fit.mapInArrow(lambda b: _sums(b, d), "n string, sums array<string>").select(F.col("n").cast("decimal(38,0)").alias("n"), F.posexplode("sums").alias("i", "s"))
    added = sorted(sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect(), key=lambda r: r.i)  # a row for each dimension
    centre = Centre(int(added[0].n), [int(r.s) for r in added])
    found = components(fit, centre, count, seed=seed)
    e, w, trace = found["e"], found["w"], found["trace"]
    k, real = len(e), e > NOTHING * max(e[0], 0.0)
    scale = np.where(real, 1 / np.sqrt(np.where(real, e, 1.0)), np.nan)
    error = None
    if real.any():
        kept = w[:, real] * scale[real]

        def each(x: np.ndarray) -> np.ndarray:
            z = centre.centred(x) @ kept
            return (z.T @ z).ravel()

        cov = _gathered(fit, each, d).reshape(kept.shape[1], -1) / centre.n
        error = float(np.abs(cov - np.eye(len(cov))).max())
    explained = [float(v / trace) if trace > 0 else None for v in np.maximum(e, 0.0)]

    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, x in _matrix(batch, 1, d):
                z = (centre.centred(x) @ w) * scale
                m = len(x)
                each_row = np.repeat(np.arange(m), k)
                arrays = [
                    ids.slice(lo, m).take(pa.array(each_row)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, centre.n)),
                    pa.array(centre.deviation(x), pa.int64()).take(pa.array(each_row)),
                    pa.array(z.ravel(), from_pandas=True),
                    pa.array(explained * m, pa.float64()),
                    pa.array([error] * (m * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return ready.select("vec_id", "x").mapInArrow(run, SCHEMA)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_whitening": op12_whitening}
#: Eigenvectors can't be expressed in SQL; the query is tested against a full decomposition on one machine.
SQL: dict[str, str] = {}
