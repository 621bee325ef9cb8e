"""Embedding whitening by shifted CholeskyQR.

The centred rows A are orthogonalised in a few passes over the table. A pass solves Q = A R^-1 by triangular solves in the
tasks, adds up the Gram matrix of Q, and multiplies its Cholesky factor onto R. The first Gram matrix is shifted, so that its
factor exists whatever the condition of A; the following passes take the shift out again. R has the singular values and
right singular vectors of A to double precision: they give the components and their variances.

Entries are whole numbers: x = floor(SCALE * c) + SHIFT. Sums, and with them the centred rows (n x - S) / n, are exact up to
one rounding. Only d x d numbers for vectors of d entries meet on the driver. Every pass reads the table again, so give a
stored one.

Edge cases: null vectors and those with a null, NaN or infinite entry are dropped. Vectors that have another length than
most (ties: the longer) can't be centred with them and are dropped too; an empty vector has nothing to whiten. Null and
repeated ids are kept, every row by itself. Directions without variance (fewer rows than entries, constant entries, equal
rows) are no components, so one vector or equal vectors give no row, like an empty table. A deviation beyond a long is null.
x is held within 2^52. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve.llm.common import cut

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
PASSES = 5              # at most; three do unless the rows lack directions
ORTHOGONAL = 1e-13      # a Gram matrix this close to the identity ends the passes
LEAST_VARIANCE = 1e-20  # of the largest; rounding stays far below, at about 1e-26
_UNIT = np.finfo(float).eps
_MOST = float(1 << 52)
_SCHEMA = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
           "identity_error double")


def _blocks(column: pa.Array, size: int):
    """(rows, x): places of the usable vectors of ``size`` entries, and their whole numbers."""
    rows = np.flatnonzero(pc.equal(pc.list_value_length(column), size).fill_null(False).to_numpy(zero_copy_only=False))
    c = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), size)
    good = np.isfinite(c).all(axis=1)
    x = np.clip(np.floor(SCALE * c[good]) + SHIFT, -_MOST, _MOST)
    return rows[good], x.astype(np.int64)


def _sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """(n, S) of the vectors of the most frequent length."""
    def run(batches):
        totals: dict[int, list] = {}
        for batch in batches:
            column = batch.column(0)
            for size in pc.unique(pc.list_value_length(column).drop_null()).to_pylist():
                if size:
                    _, x = _blocks(column, size)
                    held = totals.setdefault(size, [0, np.zeros(size, dtype=np.int64)])
                    held[0] += len(x)
                    held[1] += x.sum(axis=0)
        rows = [(size, n, s.tolist()) for size, (n, s) in totals.items() if n]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows), (pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=["size", "n", "s"])
    parts = cut(vectors.select("embedding").mapInArrow(run, "size int, n bigint, s array<bigint>"))
    usual = parts.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if usual is None:
        return 0, np.zeros(0, dtype=np.int64)
    entries = parts.where(F.col("size") == usual["size"]).select(F.posexplode("s").alias("i", "s"))
    rows = entries.groupBy("i").agg(F.sum("s").alias("s")).collect()    # one per entry of a vector
    s = np.zeros(usual["size"], dtype=np.int64)
    for r in rows:
        s[r["i"]] = r["s"]
    return usual["n"], s


def solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with Q R = A, column by column; R is upper triangular."""
    q = np.empty_like(a, order="F")
    for j in range(r.shape[0]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _gram(vectors: DataFrame, n: int, s: np.ndarray, factors: list[np.ndarray],
          onto: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sum, Gram matrix) of the centred rows after the solves with ``factors`` in turn, projected ``onto`` vectors if given.
    Map tasks add up their rows; the sums per entry are added by Spark."""
    shared = vectors.sparkSession.sparkContext.broadcast((s, factors, onto))

    def run(batches):
        s, factors, onto = shared.value
        g, total = 0.0, 0.0
        for batch in batches:
            _, x = _blocks(batch.column(0), len(s))
            q = (n * x - s) / n
            for r in factors:
                q = solved(q, r)
            q = q if onto is None else q @ onto
            g, total = g + q.T @ q, total + q.sum(axis=0)
        if np.ndim(g):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(g)), pa.int32()), pa.array(total), pa.array(g.tolist(), pa.list_(pa.float64()))],
                names=["i", "total", "g"])
    parts = vectors.select("embedding").mapInArrow(run, "i int, total double, g array<double>")
    entries = parts.select("i", "total", F.posexplode("g").alias("j", "g")).where("i <= j")
    rows = entries.groupBy("i", "j").agg(F.sum("g").alias("g"), F.sum("total").alias("total")).collect()
    d = len(s) if onto is None else onto.shape[1]
    g, total = np.zeros((d, d)), np.zeros(d)
    for r in rows:
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["g"]
        total[r["i"]] = r["total"]
    return total, g


def _cholesky(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper factor of ``g`` plus a shift, which grows only where rounding leaves ``g`` without a factor."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, len(g) * _UNIT * np.trace(g))


def triangular(vectors: DataFrame, n: int, s: np.ndarray) -> np.ndarray:
    """R of the centred rows, composed of the passes' factors."""
    d = len(s)
    factors: list[np.ndarray] = []
    for turn in range(PASSES):
        _, g = _gram(vectors, n, s, factors)
        if not np.trace(g) > 0:
            return np.zeros((d, d))
        if turn and np.abs(g - np.eye(d)).max() < ORTHOGONAL:
            break
        shift = 0.0 if turn else 11 * (n * d + d * (d + 1)) * _UNIT * float(np.trace(g))
        factors.append(_cholesky(g, shift))
    r = np.eye(d)
    for factor in factors:
        r = factor @ r
    return r


class Whitening:
    """Fitted components: ``vectors`` (d x k, a column each), their variances, and the whole variance."""

    def __init__(self, n: int, sums: np.ndarray, r: np.ndarray, components: int):
        _, sigma, right = np.linalg.svd(r) if len(r) else (None, np.zeros(0), np.zeros((0, 0)))
        variances = sigma ** 2 / max(n, 1)
        k = int((variances > LEAST_VARIANCE * max(variances.max(initial=0.0), 1e-300)).sum())
        k = min(k, components) if variances.max(initial=0.0) > 0 else 0
        self.n, self.sums, self.total = n, sums, float(variances.sum())
        self.vectors, self.variances = right[:k].T.copy(), variances[:k]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Components of all usable ``embedding`` values of ``vectors``."""
    n, sums = _sums(vectors)
    return Whitening(n, sums, triangular(vectors, n, sums) if n else np.zeros((0, 0)), components)


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured over all rows."""
    total, g = _gram(vectors, w.n, w.sums, [], w.vectors / np.sqrt(w.variances))
    mean = total / w.n
    return float(np.abs(g / w.n - np.outer(mean, mean) - np.eye(len(g))).max())


def _deviation(x: np.ndarray, n: int, s: np.ndarray) -> pa.Array:
    centred = n * x - s
    about = np.square(centred.astype(float)).sum(axis=1)
    exact = np.square(centred).sum(axis=1)      # modulo 2^64: negative from 2^63 on
    return pa.array(exact, pa.int64(), mask=(about > 9.3e18) | (exact < 0))


def whitened(vectors: DataFrame, w: Whitening | None = None, vec_id: Column | str = "vec_id") -> DataFrame:
    """A row per usable vector and component: its deviation, the whitened coordinate, and what the component explains."""
    w = w or fit(vectors)
    k = len(w.variances)
    if not k:
        return vectors.sparkSession.createDataFrame([], _SCHEMA)
    error = identity_error(vectors, w)
    shared = vectors.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        w = shared.value
        project = w.vectors / np.sqrt(w.variances)
        explained = w.variances / w.total
        for batch in batches:
            rows, x = _blocks(batch.column(1), len(w.sums))
            if not len(rows):
                continue
            every = np.repeat(np.arange(len(rows)), k)
            out = ((w.n * x - w.sums) / w.n) @ project
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[every])), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                 pa.array(np.full(len(every), w.n)), _deviation(x, w.n, w.sums).take(pa.array(every)), pa.array(out.ravel()),
                 pa.array(np.tile(explained, len(rows))), pa.array(np.full(len(every), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    key = F.col(vec_id) if isinstance(vec_id, str) else vec_id
    return vectors.select(key.cast("bigint").alias("vec_id"), "embedding").mapInArrow(run, _SCHEMA)
