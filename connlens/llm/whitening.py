"""Whitening of embeddings by an incremental eigendecomposition.

Every task goes through its rows once and keeps the eigenvalues and eigenvectors of their scatter: a row, centred
on the mean so far, is a rank-one update, whose eigenvalues are the roots of a secular equation; entries that do
not matter and equal eigenvalues are deflated first. Two spectra are combined by further rank-one updates, one for each
eigenvector of the second and one for the distance of the means, a few spectra to a task, in rounds. The result is a
basis; a Rayleigh-Ritz step over all rows (scatter of the centred rows in that basis, summed over
tasks) takes it to double precision.

What a task holds is a batch of rows and some matrices of the size of one spectrum. A state is one row of
8 x (dimensions + 2) x dimensions bytes, at most ``FAN`` of them meet in a task, and one reaches the driver.

Rows whose vector is null, empty, or has a null or non-finite entry take no part, nor do vectors of another length than
the most frequent one (of equally frequent ones: the shortest). A null vec_id counts as any other; repeated rows count
each time; extra columns are ignored; an empty table gives no rows. Entries beyond 2^40 in size are taken as 2^40. The sign of a component
is such that its largest entry is positive; equal eigenvalues keep any of their bases. A component
without variance has null in ``whitened``, and is left out of identity_error, which is null where all are. ``deviation`` is null where
it does not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, stored

COMPONENTS = 8
FAN = 8  # spectra that one task combines
CHUNK = 1 << 18  # entries of vectors worked on at once
EPS = np.finfo(float).eps
LARGE = 1 << 40


@cache
def _below(k: int) -> np.ndarray:
    """[j, i]: pole j is not above root i."""
    return (np.arange(k)[:, None] <= np.arange(k)[None, :]).astype(float)


def secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + z z', and the differences d[j] - eigenvalue[i], exact also where they nearly vanish.

    d ascends without equal values and z has no zeros, so one root of 1 + sum z[j]^2 / (d[j] - x) lies in each
    gap. All are sought at once, as distances from the nearer pole, by steps to the root of a function with the
    two poles around it; a step out of the known bounds is replaced by halving them.
    """
    k, z2 = len(d), z * z
    at, reach = np.arange(k), z2.sum()
    upper = np.append(d[1:], d[-1] + reach)
    middle = (d + upper) / 2
    term = z2[:, None] / (d[:, None] - middle[None, :])
    value = 1 + term.sum(axis=0)
    right = value < 0
    right[-1] = False
    origin = np.where(right, upper, d)
    low, high = np.where(right, middle - origin, 0.0), np.where(right, 0.0, middle - origin)
    if value[-1] < 0:
        low[-1], high[-1] = high[-1], reach
    # The start: the root where the poles around it have their weights and the rest its value in the middle.
    wide, two = upper - d, np.append(z2[1:], 0)
    c = value - term[at, at] - np.append(term[at[1:], at[:-1]], 0)
    near = np.where(right, two, z2) * wide
    a = np.where(right, c * wide - z2 - two, c * wide + z2 + two)
    root = np.sqrt(np.abs(a * a - np.where(right, -4, 4) * near * c))
    with np.errstate(all="ignore"):
        x = np.where(
            right,
            np.where(a < 0, 2 * near / (a - root), -(a + root) / (2 * c)),
            np.where(a > 0, 2 * near / (a + root), (a - root) / (2 * c)),
        )
    x = np.where((x > low) & (x < high), x, (low + high) / 2)
    next_pole = np.append(d[1:], d[-1] + 2 * reach) - origin
    apart, below = d[:, None] - origin[None, :], _below(k)
    open_, own, gaps, under = at, x, apart, below
    for _ in range(100):
        gap = gaps - own
        term = z2[:, None] / gap
        value = 1 + term.sum(axis=0)
        wrong = np.abs(value) > 2 * EPS * k * (1 + np.abs(term).sum(axis=0))
        if not wrong.all():
            x[open_] = own
            if not wrong.any():
                break
            open_, own, gaps, under = open_[wrong], own[wrong], gaps[:, wrong], under[:, wrong]
            gap, term, value = gap[:, wrong], term[:, wrong], value[wrong]
        high[open_] = np.where(value > 0, own, high[open_])
        low[open_] = np.where(value > 0, low[open_], own)
        slope = term / gap
        left = (slope * under).sum(axis=0)
        rest = slope.sum(axis=0) - left
        one, two = gap[open_, np.arange(len(open_))], next_pole[open_] - own
        a = (one + two) * value - one * two * (left + rest)
        b = one * two * value
        c = value - one * left - two * rest
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(all="ignore"):
            step = own + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        halves = (low[open_] + high[open_]) / 2
        own = np.where((step > low[open_]) & (step < high[open_]), step, halves)
    else:
        x[open_] = own
    return origin + x, apart - x


def rank_one(d: np.ndarray, q: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors of q (diag(d) + z z') q'."""
    length = np.sqrt(z @ z)
    least = 8 * EPS * max(np.abs(d).max(), length**2)
    if length**2 <= least * EPS:
        return d, q
    d, q, z = d.copy(), q.copy(), z.copy()
    # Equal eigenvalues: turn their vectors so that only the last of them meets z.
    equal = np.diff(d) <= least
    if equal.any():
        edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(int)))
        for a, b in zip(edges[::2], edges[1::2] + 1):
            size = np.sqrt(z[a:b] @ z[a:b])
            mirror = z[a:b].copy()
            mirror[-1] += size if mirror[-1] >= 0 else -size
            weight = mirror @ mirror
            if weight > 0:
                q[:, a:b] -= np.outer(q[:, a:b] @ mirror, mirror * (2 / weight))
                z[b - 1] = -size if z[b - 1] >= 0 else size
                z[a : b - 1] = 0
            d[a:b] = d[b - 1]
    own = np.flatnonzero(np.abs(z) * length > least)
    if not len(own):
        return d, q
    values, gap = secular(d[own], z[own])
    # The z whose roots these exactly are, so that the vectors are orthogonal.
    poles, k = d[own], len(own)
    other = np.where(np.arange(k)[None, :] < np.arange(k)[:, None], poles[None, :], np.append(poles[1:], 0)[None, :]) - poles[:, None]
    other[:, -1] = 1
    exact = np.sqrt(np.abs(np.prod(-gap / other, axis=1))) * np.sign(z[own])
    turn = exact[:, None] / gap
    turn /= np.sqrt((turn * turn).sum(axis=0))
    q[:, own] = q[:, own] @ turn
    d[own] = values
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


@dataclass
class Spectrum:
    """Number, exact sums, mean and eigendecomposition of the scatter of some rows."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size, dtype=np.int64), np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, rows: np.ndarray, block: int = 1) -> None:
        """One update for each row of integers; with a ``block``, for each row of its triangular factor and for its mean."""
        self.sums += rows.sum(axis=0)
        for at in range(0, len(rows), block):
            some = rows[at : at + block].astype(float)
            mean, n, total = some.mean(axis=0), len(some), self.n + len(some)
            apart = mean - self.mean
            within = np.linalg.qr(some - mean, mode="r") if n > 1 else np.zeros((0, len(mean)))
            for update in [*within, *([apart * np.sqrt(self.n / total * n)] if self.n else [])]:
                self.values, self.vectors = rank_one(self.values, self.vectors, self.vectors.T @ update)
            self.n, self.mean = total, self.mean + apart * (n / total)

    def merge(self, other: Spectrum) -> None:
        """The spectrum of the rows of both."""
        if not other.n:
            return
        if not self.n:
            self.__dict__.update(other.__dict__)
            return
        total, apart = self.n + other.n, other.mean - self.mean
        updates = [np.sqrt(max(value, 0)) * vector for value, vector in zip(other.values, other.vectors.T)]
        for update in [*updates, apart * np.sqrt(self.n / total * other.n)]:
            self.values, self.vectors = rank_one(self.values, self.vectors, self.vectors.T @ update)
        self.n, self.sums = total, self.sums + other.sums
        self.mean = self.mean + apart * (other.n / total)

    def row(self) -> dict:
        return {"n": self.n, "sums": self.sums.tobytes(), "mean": self.mean.tobytes(), "values": self.values.tobytes(), "vectors": self.vectors.tobytes()}

    @classmethod
    def of(cls, row) -> Spectrum:
        values = np.frombuffer(row["values"])
        return cls(int(row["n"]), np.frombuffer(row["sums"], dtype=np.int64).copy(), np.frombuffer(row["mean"]).copy(), values.copy(), np.frombuffer(row["vectors"]).reshape(len(values), -1).copy())


_STATE = "part int, n bigint, sums binary, mean binary, values binary, vectors binary"


def usable(rows: DataFrame, *more: str) -> DataFrame:
    """vec_id, ``more`` columns and embedding of the rows that take part."""
    entries = F.col("embedding").cast("array<double>")
    clean = rows.select("vec_id", *more, entries.alias("embedding")).where(
        (F.size("embedding") > 0) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    often = clean.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return clean.where(F.size("embedding") == often[0]["size"]) if often else clean


def integers(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the first row, a row of floor(1024 c) + 100000 each), some rows at a time."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = len(flat) // max(len(column), 1)
    each = max(1, CHUNK // max(size, 1))
    for at in range(0, len(column), each):
        some = flat[at * size : (at + each) * size].reshape(-1, size)
        yield at, np.clip(np.floor(1024 * some), -LARGE, LARGE).astype(np.int64) + 100_000


def _spectra(rows: DataFrame, block: int) -> DataFrame:
    def run(batches):
        state = None
        for batch in batches:
            for _, x in integers(batch.column(0)):
                state = state or Spectrum.empty(x.shape[1])
                state.add(x, block)
        if state:
            own = {"part": TaskContext.get().partitionId()} | state.row()
            yield pa.RecordBatch.from_pylist([own], pa.schema([("part", pa.int32()), ("n", pa.int64()), *((c, pa.binary()) for c in ("sums", "mean", "values", "vectors"))]))

    return rows.select("embedding").mapInArrow(run, _STATE)


def _combine(key: tuple, states: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for _, row in states.sort_values("part").iterrows():
        if whole is None:
            whole = Spectrum.of(row)
        else:
            whole.merge(Spectrum.of(row))
    return pd.DataFrame([{"part": int(key[0])} | whole.row()])


def spectrum(rows: DataFrame, block: int = 1) -> Spectrum | None:
    """Of all usable rows; each round of combining is written to the shared folder."""
    states = stored(_spectra(rows, block))
    while (top := states.agg(F.max("part")).first()[0]) is not None and (top > 0 or states.count() > 1):
        fewer = stored(states.groupBy((F.col("part") / FAN).cast("int").alias("to")).applyInPandas(_combine, _STATE))
        drop(states)
        states = fewer
    found = states.collect()
    drop(states)
    return Spectrum.of(found[0].asDict()) if found else None


def _sum_parts(rows: DataFrame, of) -> np.ndarray:
    """The sum over all rows of the matrices that ``of`` gives for blocks of integers, by tasks, then by groups of tasks."""

    def run(batches):
        total = None
        for batch in batches:
            for _, x in integers(batch.column(0)):
                part = of(x)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        whole = sum(np.frombuffer(x) for x in parts.sort_values("part")["total"])
        return pd.DataFrame([{"part": int(key[0]), "total": whole.tobytes()}])

    sums = rows.select("embedding").mapInArrow(run, "part int, total binary")
    # At most FAN x FAN matrices to a task, and to the driver those of so many groups of tasks.
    fewer = sums.groupBy((F.col("part") / (FAN * FAN)).cast("int").alias("to")).applyInPandas(add, "part int, total binary")
    found = fewer.collect()
    return sum(np.frombuffer(r["total"]) for r in sorted(found, key=lambda r: r["part"]))


@dataclass
class Whitening:
    n: int
    sums: np.ndarray  # exact, per dimension
    vectors: np.ndarray  # dimensions x components, of falling variance
    values: np.ndarray  # variances of the components
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        live = self.live()
        return np.where(live, self.centred(x) @ self.vectors / np.sqrt(np.where(live, self.values, 1)), np.nan)

    def live(self) -> np.ndarray:
        return self.values > 64 * EPS * self.trace


def fit(rows: DataFrame, components: int = COMPONENTS, block: int = 1) -> Whitening | None:
    """``rows`` as ``usable`` gives them. None without any.

    With a ``block`` so many rows at a time are turned into the triangular factor of their scatter, and its rows
    are the updates: fewer of them, for very many vectors.
    """
    whole = spectrum(rows, block)
    if whole is None:
        return None
    basis, size = whole.vectors, len(whole.values)
    model = Whitening(whole.n, whole.sums, basis, whole.values, 0.0)

    def scatter(x: np.ndarray) -> np.ndarray:
        y = model.centred(x) @ basis
        return y.T @ y

    projected = _sum_parts(rows, scatter).reshape(size, size) / whole.n
    values, turn = np.linalg.eigh((projected + projected.T) / 2)
    best = np.argsort(-values, kind="stable")[:components]
    vectors = basis @ turn[:, best]
    vectors /= np.sqrt((vectors**2).sum(axis=0))
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[top, np.arange(len(best))] < 0, -1, 1)
    return Whitening(whole.n, whole.sums, vectors, np.maximum(values[best], 0), float(max(values.sum(), 0)))


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of all whitened rows minus the identity."""
    live = np.flatnonzero(model.live())
    if not len(live):
        return None

    def moments(x: np.ndarray) -> np.ndarray:
        w = np.column_stack([np.ones(len(x)), model.whiten(x)[:, live]])
        return w.T @ w

    total = _sum_parts(rows, moments).reshape(len(live) + 1, -1) / model.n
    covariance = total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:])
    return float(np.abs(covariance - np.eye(len(live))).max())


_OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row and component, see the module's text; all rows are in the fit."""
    rows = usable(embeddings)
    model = fit(rows, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], _OUT)
    error = identity_error(rows, model)

    def run(batches):
        k, live = len(model.values), model.live()
        share = model.values / model.trace if model.trace else np.full(k, np.nan)
        for batch in batches:
            for at, x in integers(batch.column("embedding")):
                w = model.whiten(x)
                apart = model.n * x - model.sums
                fits = (apart.astype(float) ** 2).sum(axis=1) < 2.0**62
                deviation = pa.array((apart * apart).sum(axis=1), mask=~fits)
                ids = batch.column("vec_id").slice(at, len(x))
                every = pa.array(np.repeat(np.arange(len(x)), k))
                arrays = [
                    ids.take(every),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, model.n)),
                    deviation.take(every),
                    pa.array(w.ravel(), mask=np.tile(~live, len(x))),
                    pa.array(np.tile(share, len(x)), mask=np.isnan(np.tile(share, len(x)))),
                    pa.array([error] * (len(x) * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _OUT.split(", ")])

    return rows.mapInArrow(run, _OUT)
