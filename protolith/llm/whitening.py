"""Whitening by the leading principal components, found by block Lanczos without a covariance matrix.

Vectors are integers floor(scale * c) + shift. The exact sums S of each dimension come from one pass; from then on a
vector is its exact deviation n * x - S. A pass over the table multiplies the covariance with a block of vectors,
V Q = 1/n sum z (z'Q) with z = (n * x - S) / n: each task sums its rows, the tasks' blocks are summed by Spark, and a
block of d x `block` numbers reaches the driver. Block Lanczos orthogonalises every new block against the whole basis,
twice; directions that break down are replaced by random ones, orthogonal to the basis; a basis of `most` vectors is
cut back to its best Ritz vectors. It ends when the residual |V y - e y| of each wanted pair is below `tolerance` times
the largest eigenvalue, or the basis spans the space. The trace is the sum of the deviations over n**3, so shares of
variance need no eigenvalue but the wanted ones.

Rows with a null vec_id stay. Vectors that are null, empty, or hold null or non-finite components, or one whose integer
isn't a long, take no part. Vectors of different dimension are whitened apart, each dimension as a table of its own.
Repeated rows are rows as all others. Components without variance (an eigenvalue below 1e-12 of the trace) aren't given:
a table of one vector, or of equal ones, has none and gives no rows, as does an empty table. A deviation that isn't a
long is null. Of equal eigenvalues any orthonormal vectors may be given; the largest entry of each is positive. Other
columns play no part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

COMPONENTS, BLOCK, TOLERANCE = 8, 8, 1e-13


def integers(vectors: DataFrame, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """vec_id and x, the vectors as longs; what isn't finite, or isn't a long then, is left out."""
    c = F.col("embedding")
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < 2.0**62))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * scale) + F.lit(shift).cast("long"))
    return vectors.filter(c.isNotNull() & (F.size(c) > 0) & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _matrix(batch, name: str) -> np.ndarray:
    """The batch's vectors, all of one dimension, as rows."""
    lists = batch.column(batch.schema.get_field_index(name))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.int64)


def sums(rows: DataFrame, d: int) -> tuple[int, list[int], int]:
    """How many rows, the exact sum of each dimension, and the largest absolute entry."""

    def run(batches):
        n, high, low, most = 0, np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for b in batches:
            x = _matrix(b, "x")
            if len(x):
                n += len(x)
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
                most = max(most, int(x.max()), -int(x.min()))
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "high": pa.array(high), "low": pa.array(low), "most": pa.array([min(most, 2**63 - 1)] * d, pa.int64())})

    each = rows.select("x").mapInArrow(run, "k int, n long, high long, low long, most long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = each.groupBy("k").agg(F.sum("n").alias("n"), wide("high"), wide("low"), F.max("most").alias("most")).orderBy("k").collect()
    return found[0]["n"], [int(r["high"]) * 2**32 + int(r["low"]) for r in found], found[0]["most"]


class Centre:
    """Deviations of vectors from the mean: exact as n * x - S while that is a long, else rounded."""

    def __init__(self, n: int, s: list[int], most: int):
        self.n, self.exact = n, 2 * n * most < 2**63
        self.s = np.array(s, np.int64) if self.exact else np.array([v / n for v in s])

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, as doubles."""
        return (self.n * x - self.s) / self.n if self.exact else x - self.s

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of (n * x - S)**2 of each row, as doubles, and as longs where it is one (else -1)."""
        rounded = ((self.scaled(x) * self.n) ** 2).sum(axis=1)
        if not self.exact:
            return rounded, np.full(len(x), -1, np.int64)
        # Sums modulo 2**64 are right where the true sum is a long, which the rounded sum tells but for its last bits.
        z = self.n * x - self.s
        whole = (z * z).sum(axis=1)
        near = np.flatnonzero((rounded > 2.0**62.9) & (rounded < 2.0**63.1))
        whole[rounded >= 2.0**63] = -1
        for i in near:
            true = sum(int(v) ** 2 for v in z[i])
            whole[i] = true if true < 2**63 else -1
        return rounded, whole


def summed(rows: DataFrame, size: int, each) -> np.ndarray:
    """The sum over all rows of each(x, sum so far), an array of `size` doubles: one for each task, then over the tasks."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            x = _matrix(b, "x")
            for i in range(0, len(x), 4096):
                total += each(x[i : i + 4096])
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(size), pa.int32()), "v": pa.array(total)})

    found = rows.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in found:
        out[r["at"]] = r["v"]
    return out


def _fresh(q: np.ndarray, block: np.ndarray, scale: float, rng) -> np.ndarray:
    """An orthonormal basis of what `block` adds to q, with random directions for those that break down."""
    d, out = len(block), np.zeros((len(block), 0))
    for v in block.T:
        for attempt in range(4):
            if q.shape[1] + out.shape[1] >= d:
                return out
            v = v if attempt == 0 else rng.standard_normal(d)
            before = scale if attempt == 0 else np.linalg.norm(v)
            for _ in range(2):
                for basis in (q, out):
                    v = v - basis @ (basis.T @ v)
            left = np.linalg.norm(v)
            if left > 1e-11 * before:
                v = v / left
                for basis in (q, out):
                    v = v - basis @ (basis.T @ v)
                out = np.column_stack([out, v / np.linalg.norm(v)])
                break
    return out


def block_lanczos(multiply, d: int, k: int = COMPONENTS, block: int = BLOCK, tolerance: float = TOLERANCE, most: int = 256, passes: int = 1000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of a symmetric matrix, their vectors as columns, and their residuals' norms.

    `multiply` gives the matrix times a block of columns. A basis of more than `most` vectors restarts from its best
    Ritz vectors.
    """
    rng = np.random.default_rng(11)
    k, block = min(k, d), min(block, d)
    most = max(most, 2 * (k + block))
    q = w = np.zeros((d, 0))
    new = _fresh(q, rng.standard_normal((d, block)), 1.0, rng)
    for _ in range(passes):
        q, w = np.column_stack([q, new]), np.column_stack([w, multiply(new)])
        inner = q.T @ w
        e, y = np.linalg.eigh((inner + inner.T) / 2)
        e, y = e[::-1], y[:, ::-1]
        ritz, image = q @ y[:, :k], w @ y[:, :k]
        left = np.linalg.norm(image - ritz * e[:k], axis=0)
        if q.shape[1] >= d or (q.shape[1] >= k + block and (left <= tolerance * max(abs(e[0]), 1e-300)).all()):
            break
        last = w[:, -new.shape[1] :]
        if q.shape[1] + block > most:
            keep = k + block
            q, w, e = q @ y[:, :keep], w @ y[:, :keep], e[:keep]
            last = (w - q * e)[:, :block]
        new = _fresh(q, last - q @ (q.T @ last), max(abs(e[0]), 1e-300), rng)
        if not new.shape[1]:
            break
    sign = np.sign(ritz[np.argmax(np.abs(ritz), axis=0), np.arange(ritz.shape[1])])
    return e[:k], ritz * np.where(sign == 0, 1, sign), left


def components(rows: DataFrame, d: int, k: int = COMPONENTS, block: int = BLOCK) -> dict:
    """Of vectors x of dimension d: n, the centre, eigenvalues and vectors (columns), residuals, trace and mean squares."""
    n, s, most = sums(rows, d)
    centre = Centre(n, s, most)

    def multiply(q):
        def each(x):
            z = centre.scaled(x)
            return (z.T @ (z @ q)).ravel()

        return summed(rows, q.size, each).reshape(q.shape) / n

    trace = summed(rows, 1, lambda x: np.array([(centre.deviations(x)[0] / n**2).sum()]))[0] / n
    e, v, left = block_lanczos(multiply, d, k, block)
    some = e > 1e-12 * trace
    e, v, left = e[some], v[:, some], left[some]
    return {"n": n, "d": d, "centre": centre, "e": e, "v": v / np.sqrt(e), "residuals": left, "trace": trace}


def identity_error(rows: DataFrame, found: dict) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity."""
    centre, v, n, k = found["centre"], found["v"], found["n"], len(found["e"])
    mean = summed(rows, k, lambda x: (centre.scaled(x) @ v).sum(axis=0)) / n

    def each(x):
        w = centre.scaled(x) @ v - mean
        return (w.T @ w).ravel()

    return float(np.abs(summed(rows, k * k, each).reshape(k, k) / n - np.eye(k)).max())


def project(rows: DataFrame, found: dict, error: float) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row and component."""
    centre, v, n = found["centre"], found["v"], found["n"]
    k, share = len(found["e"]), found["e"] / found["trace"]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                x = _matrix(part, "x")
                whole = centre.deviations(x)[1]
                m = len(x)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column(0).take(pa.array(each)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * k, n, np.int64)),
                    "deviation": pa.array(whole[each], mask=whole[each] < 0),
                    "whitened": pa.array((centre.scaled(x) @ v).ravel()),
                    "explained": pa.array(np.tile(share, m)),
                    "identity_error": pa.array(np.full(m * k, error)),
                })

    return rows.select("vec_id", "x").mapInArrow(run, SCHEMA)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, k: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """Of integer vectors (vec_id, x), what `project` gives."""
    rows = materialize(vectors)
    parts = []
    # As many tables as there are dimensions; nearly always one.
    for r in rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect():
        own = rows.filter(F.size("x") == r["d"])
        found = components(own, r["d"], k, block)
        if len(found["e"]):
            parts.append(project(own, found, identity_error(own, found)))
    return reduce(DataFrame.unionAll, parts) if parts else rows.sparkSession.createDataFrame([], SCHEMA)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(integers(table(spark, sf_dir, "embeddings")))
