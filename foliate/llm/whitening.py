"""Whitening of embeddings by a block Jacobi-Davidson method over distributed, centred products.

The covariance is never formed: the method only asks for products of it with a few vectors, and each product is one
pass over the rows, y y'Z summed over tasks with y the centred vector. Rows are stored once, packed, in the smallest integer type
that holds them, so a pass reads little.

All wanted pairs are worked on as one block. Per round: Rayleigh-Ritz in the search space; pairs whose residual is at rounding
level are locked; the correction equations of the others, projected against all locked and current Ritz vectors, are solved by
MINRES side by side, so one pass serves all of them; the corrections widen the space, which restarts from its best Ritz vectors
when it is full. A true residual from a fresh product has the last word.

On the driver are only blocks of (dimensions x components) numbers and what the tasks sum into them.

Defined results: a null vector, or one with a null or non-finite entry, is dropped, and so is an empty one, one whose length is not
the most frequent (of equally frequent ones the largest) or with an entry of which 64 times is beyond 2^62; repeated rows and null ids
are rows of their own; components end where the covariance has no more rank (eigenvalues below 1e-10 of the first), so equal or single vectors
give no row; ties between eigenvalues are settled by any basis of their space; columns other than the two are ignored; an empty table gives an
empty result. A deviation beyond 64 bits is null. ``whitened`` runs its passes while the plan is built.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm import arrays as A
from foliate.llm.common import stored

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Steps of MINRES in a round, its relative residual, and blocks that the search space holds.
INNER, ENOUGH, BLOCKS = 5, 1e-2, 4
#: Rounding level of a residual, against the largest eigenvalue.
LEVEL, ROUNDS, RANK = 2e-14, 200, 1e-10
#: Rows in a packed row.
PACK = 4096
OWNER = "whitening"

PACKED = "vec_ids array<bigint>, width int, data binary"
OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def packed(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, int]:
    """Rows of whole numbers floor(scale * entry), without the shift, packed; and their dimension."""
    v = F.col(embedding).cast("array<double>")
    fits = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * F.lit(float(scale))) < F.lit(2.0**62)))
    fine = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).filter((F.size("v") > 0) & fits)
    sizes = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    d = int(sizes["d"]) if sizes else 0

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                x = np.floor(part.column(1).flatten().to_numpy() * scale).astype(np.int64)
                low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
                width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([width], pa.int32()), pa.array([x.astype(f"<i{width}").tobytes()], pa.binary())],
                    ["vec_ids", "width", "data"],
                )

    return stored(fine.filter(F.size("v") == d).mapInArrow(run, PACKED), "vectors"), d


def _blocks(batches, d: int):
    """(ids, matrix of whole numbers) of each packed row."""
    for batch in batches:
        A.MEMORIES.clear()
        for i in range(batch.num_rows):
            data = np.frombuffer(batch.column(batch.schema.get_field_index("data"))[i].as_py(), f"<i{batch.column(batch.schema.get_field_index('width'))[i].as_py()}")
            yield batch.slice(i, 1), data.reshape(-1, d).astype(np.int64)


class Rows:
    """The packed rows as an operator: sums and centred products."""

    def __init__(self, table: DataFrame, d: int):
        self.table, self.d = table, d
        self.n, self.sums = self._sums()
        self.passes = 0

    def _sums(self) -> tuple[int, list[int]]:
        """Rows and exact sums per dimension; whole numbers of any size, so in decimal digits of Spark."""
        d = self.d

        def run(batches):
            n, low, high = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
            for _, x in _blocks(batches, d):
                n += len(x)
                # two halves of 32 bits, so that sums of any values stay exact
                low += (x & 0xFFFFFFFF).sum(0)
                high += (x >> 32).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d)), pa.array(np.append(n, low)), pa.array(np.append(0, high))], ["k", "low", "high"])

        parts = self.table.mapInArrow(run, "k bigint, low bigint, high bigint").groupBy("k").agg(
            F.sum(F.col("low").cast("decimal(20)")).alias("low"), F.sum(F.col("high").cast("decimal(20)")).alias("high")
        )
        found = {r["k"]: int(r["low"]) + (int(r["high"]) << 32) for r in parts.collect()}
        return found.get(-1, 0), [found.get(k, 0) for k in range(d)]

    def centred(self):
        """A function from whole numbers to centred rows: (n x - S) / n, where the difference is of whole numbers."""
        n = max(self.n, 1)
        whole, rest = zip(*[divmod(s, n) for s in self.sums]) if self.d else ((), ())
        whole, rest = np.array(whole, np.int64), np.array(rest, np.float64) / n
        return lambda x: (x - whole).astype(np.float64) - rest

    def _summed(self, partial, size: int) -> np.ndarray:
        """Sums over all tasks of an array that each task gives."""

        def run(batches):
            total = partial(batches)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total.reshape(-1))], ["k", "v"])

        out = np.zeros(size)
        for k, v in self.table.select("width", "data").mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow().to_pandas().itertuples(index=False):
            out[k] = v
        self.passes += 1
        return out

    def times(self, z: np.ndarray) -> np.ndarray:
        """The covariance times ``z``."""
        d, b, centre = self.d, z.shape[1], self.centred()
        z = np.ascontiguousarray(z)

        def partial(batches):
            total = np.zeros((d, b))
            for _, x in _blocks(batches, d):
                y = centre(x)
                total += y.T @ (y @ z)
            return total

        return self._summed(partial, d * b).reshape(d, b) / self.n

    def trace(self) -> float:
        d, centre = self.d, self.centred()
        return float(self._summed(lambda batches: sum(((centre(x) ** 2).sum(0) for _, x in _blocks(batches, d)), np.zeros(d)), d).sum() / self.n)

    def projected(self, z: np.ndarray, middle: np.ndarray | None = None) -> np.ndarray:
        """Sums of the projections on ``z``; with their means, the projections' covariance."""
        d, b, centre = self.d, z.shape[1], self.centred()

        def partial(batches):
            total = np.zeros(b if middle is None else (b, b))
            for _, x in _blocks(batches, d):
                w = centre(x) @ z
                total += w.sum(0) if middle is None else (w - middle).T @ (w - middle)
            return total

        return self._summed(partial, b if middle is None else b * b) / self.n


def orthonormal(z: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``z`` adds to an orthonormal basis; vectors that add nothing go."""
    for _ in range(2):
        z = z - against @ (against.T @ z)
        size = np.linalg.norm(z, axis=0)
        z = z[:, size > 1e-12] / size[size > 1e-12]
    q, r = np.linalg.qr(z)
    q = q[:, np.abs(np.diag(r)) > 1e-10]
    q = q - against @ (against.T @ q)
    return np.linalg.qr(q)[0]


def minres(times, theta: np.ndarray, basis: np.ndarray, right: np.ndarray, steps: int = INNER, enough: float = ENOUGH) -> np.ndarray:
    """Solutions t of P (A - theta_j) P t_j = right_j, all side by side, P = 1 - basis basis'.

    One product per step for all right sides. A column stops to change once its residual is small enough or its Krylov space is used up.
    """
    project = lambda z: z - basis @ (basis.T @ z)
    beta = np.linalg.norm(right, axis=0)
    start = beta.copy()
    x, v_old, w, w_old = (np.zeros_like(right) for _ in range(4))
    live = beta > 0
    v = np.where(live, right / np.where(live, beta, 1), 0)
    eta, c, c_old, s, s_old = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    beta = np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        p = project(times(v)) - theta * v
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * v_old
        beta_new = np.linalg.norm(p, axis=0)
        # the two last rotations, then a new one
        delta = c * alpha - c_old * s * beta
        gamma = np.hypot(delta, beta_new)
        eps = s_old * beta
        mid = s * alpha + c_old * c * beta
        live &= gamma > 0
        safe = np.where(live, gamma, 1)
        c_old, s_old, c, s = c, s, np.where(live, delta / safe, 1), np.where(live, beta_new / safe, 0)
        w_old, w = w, np.where(live, (v - mid * w - eps * w_old) / safe, 0)
        x = x + np.where(live, c * eta, 0) * w
        eta = np.where(live, -s * eta, eta)
        live &= (np.abs(eta) > enough * start) & (beta_new > 1e-14 * np.abs(alpha))
        v_old, v, beta = v, np.where(live, p / np.where(beta_new > 0, beta_new, 1), 0), beta_new
    return project(x)


def eigenpairs(times, d: int, k: int, level: float = LEVEL, rounds: int = ROUNDS, inner: int = INNER, blocks: int = BLOCKS, seed: int = 7):
    """The ``k`` largest eigenvalues of a symmetric operator, their unit vectors and their residuals."""
    k = min(k, d)
    search = orthonormal(np.random.default_rng(seed).standard_normal((d, k)), np.zeros((d, 0)))
    product = times(search)
    for _ in range(rounds):
        h = search.T @ product
        value, u = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-value, kind="stable")
        value, u = value[order], u[:, order]
        top, q = value[:k], search @ u[:, :k]
        residual = product @ u[:, :k] - q * top
        size = np.linalg.norm(residual, axis=0)
        scale = max(abs(value[0]), np.finfo(float).tiny)
        open_ = size > level * scale * np.sqrt(d)
        if not open_.any():
            # what was carried along may have drifted: a fresh product decides
            q = np.linalg.qr(q)[0]
            fresh = times(q)
            top = (q * fresh).sum(0)
            size = np.linalg.norm(fresh - q * top, axis=0)
            if not (size > level * scale * np.sqrt(d)).any() or search.shape[1] <= k:
                break
            search, product = q, fresh
            continue
        if search.shape[1] == d:
            # nothing is left to add, so products have drifted
            search = q = np.linalg.qr(q)[0]
            product = times(q)
        elif search.shape[1] >= blocks * k:
            search, product = search @ u[:, : 2 * k], product @ u[:, : 2 * k]
        # locked pairs take no further part, but stay projected out; so do all current vectors of the block
        step = minres(times, top[open_], q, -residual[:, open_], inner)
        new = orthonormal(step, search)
        if not new.shape[1]:
            break
        search, product = np.column_stack([search, new]), np.column_stack([product, times(new)])
    order = np.argsort(-top, kind="stable")
    return top[order], q[:, order], size[order]


def whitened(rows: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Each row's coordinates along the components, at unit variance."""
    spark = rows.sparkSession
    table, d = packed(rows, vec_id, embedding, scale, shift)
    own = Rows(table, d)
    if not own.n or not d:
        return spark.createDataFrame([], OUT)
    trace = own.trace()
    value, z, _ = eigenpairs(own.times, d, components) if trace > 0 else (np.zeros(0), np.zeros((d, 0)), None)
    keep = value > RANK * max(value.max(initial=0), 0)
    value, z = value[keep], z[:, keep]
    if not len(value):
        return spark.createDataFrame([], OUT)
    middle = own.projected(z)
    covariance = own.projected(z, middle).reshape(len(value), -1)
    value = np.diag(covariance).copy()
    order = np.argsort(-value, kind="stable")
    value, z, covariance = value[order], z[:, order], covariance[np.ix_(order, order)]
    root = np.sqrt(value)
    error = float(np.abs(covariance / np.outer(root, root) - np.eye(len(value))).max())
    n, sums, centre, share = own.n, own.sums, own.centred(), value / trace

    def run(batches):
        k = len(root)
        for part, x in _blocks(batches, d):
            w = centre(x) @ z / root
            m = len(x)
            ids = part.column(part.schema.get_field_index("vec_ids")).flatten()
            repeated = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(repeated)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    deviations(x, n, sums).take(pa.array(repeated)),
                    pa.array(w.reshape(-1)),
                    pa.array(np.tile(share, m)),
                    pa.array(np.full(m * k, error)),
                ],
                [c.split()[0] for c in OUT.split(", ")],
            )

    return table.mapInArrow(run, OUT)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sums of (n x - S)^2; null beyond 64 bits."""
    s = np.array(sums, np.float64)
    about = ((x.astype(np.float64) * n - s) ** 2).sum(1)
    largest = max(int(np.abs(x).max(initial=0)) * n, *[abs(v) for v in sums])
    if largest < 2**62 and about.max(initial=0) < 2.0**62:
        own = ((x * n - np.array(sums, np.int64)) ** 2).sum(1)
        return pa.array(own)
    exact = [sum((int(v) * n - t) ** 2 for v, t in zip(row, sums)) for row in x]
    return pa.array([v if v < 2**63 else None for v in exact], pa.int64())
