"""Embedding whitening: leading eigenvectors of the covariance by block Jacobi-Davidson.

The covariance is never built. A product with a block of vectors is one pass over the table: every
task centres its rows, multiplies them with the block and back, and sends one row per dimension;
Spark sums them, so the driver sees a block of (dimensions x vectors). On it, Ritz pairs of a growing
subspace are refined: the correction equations of all open pairs, projected off the found vectors,
go through MINRES together, one pass a step. Pairs whose residual is at the rounding level are locked
and kept out of the subspace; at the end all are checked with one more pass.

Components are integers ``floor(scale * c)``, so sums and deviations are exact. A constant added to
all of them changes nothing here.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 64
COMPONENTS = 32
GUARD = 8  # more Ritz vectors than wanted are kept over a restart
INNER = 6  # steps of MINRES
ROUNDS = 200
LARGEST = 1 << 52  # an entry beyond it counts as this
CHUNK_VALUES = 1 << 21

Product = Callable[[np.ndarray], np.ndarray]


def _kept(column: pa.Array, dim: int) -> np.ndarray:
    """Which vectors are whole: not null, of ``dim`` entries, none of them null or not finite."""
    lengths = np.diff(_offsets(column))
    good = column.is_valid().to_numpy(zero_copy_only=False) & (lengths == dim)
    if dim and len(column):
        flat = column.flatten()
        bad = ~np.isfinite(flat.to_numpy(zero_copy_only=False).astype(np.float64))  # a null becomes NaN
        owner = np.repeat(np.arange(len(column)), np.where(column.is_valid().to_numpy(zero_copy_only=False), lengths, 0))
        good[owner[bad]] = False
    return good


def _offsets(column: pa.Array) -> np.ndarray:
    return column.offsets.to_numpy().astype(np.int64) if len(column) else np.zeros(1, np.int64)


def _integers(batch: pa.RecordBatch, vector: int, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their integer entries, of the whole vectors of a batch, a bounded number at a time."""
    step = max(1, CHUNK_VALUES // max(dim, 1))
    for k in range(0, batch.num_rows, step):
        column = batch.column(vector).slice(k, step)
        rows = np.flatnonzero(_kept(column, dim))
        if not len(rows):
            continue
        values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        y = np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype(np.int64)
        yield rows + k, y.reshape(len(rows), dim)


@dataclass
class Fit:
    """What the rows have in common: their number, the exact sums and the dimension."""

    dim: int
    n: int
    sums: list[int]

    def centred(self, y: np.ndarray) -> np.ndarray:
        """The entries less their means, as exact ``n * y - sum`` divided by n."""
        return self.wide(y).astype(np.float64) / self.n

    def wide(self, y: np.ndarray) -> np.ndarray:
        """``n * y - sum``, in Python's integers where 64 bits may not do."""
        top = max(self.n * int(np.abs(y).max(initial=0)), max(map(abs, self.sums), default=0))
        kind = np.int64 if top < 1 << 61 else object
        return y.astype(kind) * self.n - np.array(self.sums, kind)

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """The sums of squares of ``n * y - sum``; None where one does not fit 64 bits."""
        t = self.wide(y)
        if t.dtype == object or self.dim * int(np.abs(t).max(initial=0)) ** 2 >= 1 << 63:
            t = t.astype(object)
            return [v if (v := int((row * row).sum())) < 1 << 63 else None for row in t]
        return (t * t).sum(axis=1).tolist()


def fit(vectors: DataFrame, vector: str = "embedding") -> Fit:
    """Number, sums and dimension: that which most vectors have, the larger of equally common ones."""
    size = F.size(vector).alias("dim")
    common = vectors.where(F.col(vector).isNotNull()).groupBy(size).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = common["dim"] if common else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dim, 0
        for batch in batches:
            for _, y in _integers(batch, 0, dim):
                for k in range(0, len(y), 512):
                    total = [a + b for a, b in zip(total, y[k:k + 512].sum(axis=0).tolist(), strict=True)]
                n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, dim), pa.int32()), pa.array([decimal.Decimal(v) for v in [n, *total]], pa.decimal128(38, 0))], ["pos", "s"])

    found = {r["pos"]: int(r["s"]) for r in vectors.select(vector).mapInArrow(run, "pos int, s decimal(38,0)").groupBy("pos").agg(F.sum("s").alias("s")).collect()}
    return Fit(dim, found.get(-1, 0), [found[k] for k in range(dim)] if found else [0] * dim)


def _summed(vectors: DataFrame, vector: str, fitted: Fit, of_chunk: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of_chunk(centred rows)``, a matrix of few rows, over all vectors; one row of the
    matrix at a time is summed by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, y in _integers(batch, 0, fitted.dim):
                part = of_chunk(fitted.centred(y))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["pos", "v"])

    width = of_chunk(np.zeros((0, fitted.dim))).shape[1]
    parts = vectors.select(vector).mapInArrow(run, "pos int, v array<double>")
    rows = parts.groupBy("pos").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(width)]).alias("v")).collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["pos"])])


def minres(apply: Product, right: np.ndarray, steps: int) -> np.ndarray:
    """``steps`` steps of MINRES for each column of ``right`` at once, from zero. ``apply`` is a
    symmetric operator on the columns."""
    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros_like(a), where=b > 0)

    width = right.shape[1]
    x, older, old = (np.zeros_like(right) for _ in range(3))
    beta = np.linalg.norm(right, axis=0)
    least = 1e-14 * beta
    v, before = over(right, np.broadcast_to(beta, right.shape)), np.zeros_like(right)
    left = beta.copy()
    c, s, c_old, s_old = np.ones(width), np.zeros(width), np.ones(width), np.zeros(width)
    linked = np.zeros(width)
    for _ in range(steps):
        y = apply(v) - linked * before
        alpha = (v * y).sum(axis=0)
        y -= alpha * v
        following = np.linalg.norm(y, axis=0)
        top = s_old * linked
        middle = c * (c_old * linked) + s * alpha
        end = -s * (c_old * linked) + c * alpha
        length = np.hypot(end, following)
        c_old, s_old = c, s
        c, s = np.where(length > 0, over(np.abs(end), length) * np.sign(end), 1.0), over(following, length)
        step = v - top * older - middle * old
        step = np.divide(step, length, out=np.zeros_like(step), where=np.broadcast_to(length > least, step.shape))
        older, old = old, step
        x += step * (c * left)
        left = -s * left
        before, linked = v, following
        v = np.divide(y, following, out=np.zeros_like(y), where=np.broadcast_to(following > least, y.shape))
        if not (np.abs(left) > least).any():
            break
    return x


def _against(found: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``x`` without its part in the span of the orthonormal columns ``found``."""
    for _ in range(2):
        x = x - found @ (found.T @ x)
    return x


def _orthonormal(found: np.ndarray, x: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """Orthonormal columns for what ``x`` adds to ``found``."""
    lengths = np.linalg.norm(x, axis=0)
    x = x[:, lengths > 0] / lengths[lengths > 0]
    u, sizes, _ = np.linalg.svd(_against(found, x), full_matrices=False)
    u = u[:, sizes > least][:, :found.shape[0] - found.shape[1]]
    return np.linalg.qr(_against(found, u))[0] if u.shape[1] else u


def eigenpairs(product: Product, dim: int, wanted: int, largest_basis: int | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues and their vectors of a symmetric positive semidefinite
    operator, and the largest residual. Raises if that does not reach the rounding level."""
    if not wanted:
        return np.zeros(0), np.zeros((dim, 0)), 0.0
    kept = min(dim, wanted + GUARD)
    most = max(kept + wanted, largest_basis or 3 * kept)
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, kept)))[0]
    image = product(basis)
    locked = np.zeros((dim, 0))
    for _ in range(ROUNDS):
        values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        open_ = wanted - locked.shape[1]
        ritz, rotated = basis @ turn, image @ turn
        residual = _against(locked, rotated[:, :open_] - ritz[:, :open_] * values[:open_])
        size = np.linalg.norm(residual, axis=0)
        scale = values[0] if not locked.shape[1] else max(values[0], top)
        top = max(float(scale), 0.0)
        tolerance = 64 * np.finfo(float).eps * np.sqrt(dim) * top
        done = size <= tolerance
        # locked vectors leave the subspace
        locked = np.concatenate([locked, ritz[:, :open_][:, done]], axis=1)
        rest = np.append(~done, np.ones(ritz.shape[1] - open_, bool))
        basis, image = ritz[:, rest], rotated[:, rest]
        if done.all():
            locked = np.linalg.qr(locked)[0]
            image = product(locked)
            values, turn = np.linalg.eigh((locked.T @ image + image.T @ locked) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            worst = float(np.linalg.norm(image @ turn - locked @ turn * values, axis=0).max())
            if worst <= 4 * tolerance:
                return np.maximum(values, 0), locked @ turn, worst
            basis, image, locked = locked, image, np.zeros((dim, 0))  # once more from the true products
            continue
        if basis.shape[1] + int((~done).sum()) > most:
            basis, image = basis[:, :kept], image[:, :kept]
        theta, direction = values[:open_][~done], residual[:, ~done]
        own = ritz[:, :open_][:, ~done]

        def project(x: np.ndarray) -> np.ndarray:
            x = _against(locked, x)
            return x - own * (own * x).sum(axis=0)

        def corrected(x: np.ndarray) -> np.ndarray:
            x = project(x)
            return project(product(x) - x * theta)

        found = np.concatenate([locked, basis], axis=1)
        added = _orthonormal(found, minres(corrected, project(-direction), INNER))
        if not added.shape[1]:  # nothing new: go on from another direction
            added = _orthonormal(found, np.random.default_rng(basis.shape[1]).standard_normal((dim, GUARD)))
        if added.shape[1]:
            basis, image = np.concatenate([basis, added], axis=1), np.concatenate([image, product(added)], axis=1)
        else:  # the space is full: what is left is rounding of the products held
            basis = np.linalg.qr(_against(locked, basis))[0]
            image = product(basis)
    raise RuntimeError("the residuals did not reach double precision")


@dataclass
class Whitening:
    """Fitted components: unit ``vectors`` (columns) by falling ``values`` of the covariance."""

    fitted: Fit
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    trace: float
    identity_error: float

    @property
    def scaled(self) -> np.ndarray:
        """Components over the root of their variance; those without variance are left as zeros."""
        able = self.able
        return np.where(able, self.vectors / np.sqrt(np.where(able, self.values, 1)), 0.0)

    @property
    def able(self) -> np.ndarray:
        return self.values > 64 * np.finfo(float).eps * np.sqrt(max(self.fitted.dim, 1)) * self.values.max(initial=0)


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> Whitening:
    """The leading components of the whole vectors (see ``whiten``), by passes over ``vectors``, whose
    rows have to be the same in every pass."""
    fitted = fit(vectors, vector)
    n, dim = fitted.n, fitted.dim

    def product(block: np.ndarray) -> np.ndarray:
        return _summed(vectors, vector, fitted, lambda x: x.T @ (x @ block)) / n

    wanted = min(components, dim) if n else 0
    values, found, residual = eigenpairs(product, dim, wanted)
    model = Whitening(fitted, values, found, residual, 0.0, 0.0)
    if wanted:
        scaled, able = model.scaled, model.able
        # traces and means first, then the covariance of what is centred once more
        first = _summed(vectors, vector, fitted, lambda x: np.append((x * x).sum(), (x @ scaled).sum(axis=0))[None]) / n
        model.trace, mean = float(first[0, 0]), first[0, 1:]
        square = _summed(vectors, vector, fitted, lambda x: (w := x @ scaled - mean).T @ w) / n
        model.identity_error = float(np.abs((square - np.eye(wanted))[np.ix_(able, able)]).max(initial=0))
    return model


def whiten(vectors: DataFrame, model: Whitening, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: one row for each
    whole vector and component of ``model``.

    A vector is whole if it is not null, has no null or non-finite entry and as many entries as most
    vectors (the larger number of equally common ones); others are dropped. Rows that repeat a key,
    or have none, are rows like others; other columns are not read. Entries beyond 2^52 / 64 count as
    that. A component without variance gives a null ``whitened`` and an ``explained`` of 0, and is not
    part of ``identity_error``. A ``deviation`` beyond 64 bits is null. An empty table gives no rows.
    """
    fitted, able = model.fitted, model.able
    scaled, k = model.scaled, len(model.values)
    explained = np.where(able, model.values / model.trace, 0.0) if model.trace else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, y in _integers(batch, 1, fitted.dim):
                w = fitted.centred(y) @ scaled
                for s in range(0, len(rows), 4096):
                    part = rows[s:s + 4096]
                    m = len(part)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(np.repeat(part, k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                        pa.array(np.full(m * k, fitted.n, np.int64)), pa.array(fitted.deviations(y[s:s + 4096]), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(w[s:s + 4096].ravel(), mask=np.tile(~able, m)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error)),
                    ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(F.col(key).alias("vec_id"), vector).mapInArrow(
        run, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
