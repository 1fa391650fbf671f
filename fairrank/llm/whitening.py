"""Embedding whitening on the leading components of the covariance.

Components become whole numbers x = floor(64 c) + 1,000,000.  Every distinct x vector counts once
in the fit (made distinct by a grouped shuffle, so that copies of one vector are pre-aggregated).
Two passes over the distinct vectors give the exact covariance: sums, then products of the values
less the rounded mean.  Products are whole numbers that double precision holds exactly, added up
as decimals, so that neither the order of tasks nor a lost executor changes a digit; the rest of
the mean is taken off in whole numbers.  Only the d x d sums of each vector length d reach the
driver, where ``spectrum`` finds the leading eigenpairs.  A third pass measures the covariance of
the whitened vectors; the last one whitens all rows without a shuffle.

Defined results: vectors that are null, empty or hold null or non-finite components are left out;
vectors of each length are whitened by themselves (own n, sums, components); |64 c| beyond 2^62
counts as 2^62; components whose variance rounding can't tell from zero don't exist (vectors that
are all equal have none and give no rows in the component table); a deviation over 2^63 - 1 is
null; rows without id are rows; repeated rows are rows, but one vector of the fit; an empty table
gives an empty table; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairrank.llm.common import pick, small_batches, staged
from fairrank.llm.spectrum import leading_pairs

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
_EDGE = float(1 << 62)
_LIMB = 60
#: Whole numbers that double and long arithmetic hold exactly.
_DOUBLE, _LONG = 1 << 53, 1 << 62


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<bigint>) of the usable rows."""
    v = pick(vectors, [id_col, vec_col]).toDF("vec_id", "v").select("vec_id", F.col("v").cast("array<double>").alias("v"))
    v = v.where("size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('inf'))")
    x = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-_EDGE)), F.lit(_EDGE))).cast("bigint") + OFFSET)
    return v.select("vec_id", x.alias("x"))


@dataclass
class Whitening:
    """The fit of the vectors of one length."""

    n: int
    centre: list[int]  # the rounded mean
    rest: list[int]  # sum of the vectors less n times the centre
    values: np.ndarray
    axes: np.ndarray  # eigenvectors over the root of their values, as columns
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S in whole numbers, for rows of x."""
        if max(map(abs, (int(x.min()), int(x.max()), *self.centre))) * 2 * self.n >= _LONG:
            x = x.astype(object)
        return (x - np.array(self.centre)) * self.n - np.array(self.rest)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(float) / self.n) @ self.axes

    def deviations(self, centred: np.ndarray) -> list[int]:
        if centred.dtype != object and max(abs(int(centred.min())), abs(int(centred.max()))) ** 2 * centred.shape[1] >= _LONG:
            centred = centred.astype(object)
        return [int(d) for d in (centred * centred).sum(axis=1)]


def _matrices(batches, column: int):
    """(rows, matrix of whole numbers) per batch and vector length."""
    for b in batches:
        v = b.column(column)
        flat, lengths = v.flatten().to_numpy(), np.diff(v.offsets.to_numpy())
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(lengths) else lengths
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            yield b, at, flat[starts[at][:, None] + np.arange(d)]


def _column_sums(x: np.ndarray) -> np.ndarray:
    if max(abs(int(x.min())), abs(int(x.max()))) * len(x) >= _LONG:
        x = x.astype(object)
    return x.sum(axis=0).astype(object)


def _products(x: np.ndarray) -> np.ndarray:
    """xᵀ x in whole numbers: by double precision in pieces small enough to be exact."""
    big = max(abs(int(x.min())), abs(int(x.max())), 1)
    rows = _DOUBLE // (big * big)
    if rows < 8:
        x = x.astype(object)
        return x.T @ x
    f = x.astype(float)
    return sum((f[i:i + rows].T @ f[i:i + rows]).astype(np.int64).astype(object) for i in range(0, len(f), rows))


def _added(x: DataFrame, work, cells) -> dict[int, dict[tuple[int, int], tuple[int, int]]]:
    """length -> {(i, j): (vectors, exact sum)}; ``work(d, matrix)`` gives an array that is summed over all
    vectors, ``cells(array)`` its (i, j, value).  A sum is two decimals, so that it never overflows."""
    def run(batches):
        total, n = {}, {}
        for _, at, m in _matrices(batches, 0):
            d = m.shape[1]
            part = work(d, m)
            total[d] = total[d] + part if d in total else part
            n[d] = n.get(d, 0) + len(at)
        for d, t in total.items():
            i, j, v = zip(*cells(t))
            v = [int(z) for z in v]
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([
                pa.array([d] * len(v), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([n[d]] * len(v), pa.int64()),
                pa.array([Decimal(z >> _LIMB) for z in v], kind), pa.array([Decimal(z & ((1 << _LIMB) - 1)) for z in v], kind)],
                ["d", "i", "j", "n", "h", "l"])

    parts = x.select("x").mapInArrow(run, "d int, i int, j int, n bigint, h decimal(38,0), l decimal(38,0)")
    out: dict[int, dict] = {}
    for r in parts.groupBy("d", "i", "j").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.sum("l").alias("l")).collect():
        out.setdefault(r.d, {})[r.i, r.j] = (r.n, (int(r.h) << _LIMB) + int(r.l))
    return out


def fit(whole: DataFrame, components: int = COMPONENTS) -> tuple[dict[int, Whitening], float]:
    """The whitening of every vector length, and the largest entry of |covariance of the whitened - identity|.

    ``whole``: rows with x, as ``whole_vectors`` makes them."""
    small_batches(whole.sparkSession)
    x = staged(whole.select("x").distinct(), "distinct-vectors")
    sums = _added(x, lambda d, m: _column_sums(m - OFFSET), lambda t: [(i, 0, v) for i, v in enumerate(t)])
    centres, rests, models = {}, {}, {}
    for d, s in sums.items():
        n = s[0, 0][0]
        whole_sums = [s[i, 0][1] + n * OFFSET for i in range(d)]
        centres[d] = [(2 * v + n) // (2 * n) for v in whole_sums]
        rests[d] = [v - n * c for v, c in zip(whole_sums, centres[d])]

    def less_centre(d, m):
        c = centres[d]
        if max(map(abs, (int(m.min()), int(m.max()), *c))) * 2 >= _LONG:
            m = m.astype(object)
        return _products(m - np.array(c))

    upper = _added(x, less_centre, lambda t: [(i, j, t[i, j]) for i in range(len(t)) for j in range(i, len(t))])
    for d, products in upper.items():
        n, rest = products[0, 0][0], rests[d]
        cov = np.zeros((d, d))
        for (i, j), (_, v) in products.items():
            cov[i, j] = cov[j, i] = (n * v - rest[i] * rest[j]) / (n * n)
        values, axes = leading_pairs(cov, components)
        models[d] = Whitening(n, centres[d], rest, values, axes / np.sqrt(values), float(np.trace(cov)))
    return models, _identity_error(x, models)


def _identity_error(x: DataFrame, models: dict[int, Whitening]) -> float:
    """Measured on the whitened distinct vectors themselves, in fixed-point sums of 2^-60."""
    unit = float(1 << _LIMB)

    def second_moments(d, m):
        z = models[d].whitened(models[d].centred(m))
        z = np.column_stack((np.ones(len(z)), z))
        return np.array([[int(v * unit) for v in row] for row in z.T @ z], object)

    worst = 0.0
    if not any(len(m.values) for m in models.values()):
        return worst
    got = _added(x, second_moments, lambda t: [(i, j, t[i, j]) for i in range(len(t)) for j in range(i, len(t))])
    for cells in got.values():
        n = cells[0, 0][0]
        mean = {j: v / unit / n for (i, j), (_, v) in cells.items() if i == 0}
        for (i, j), (_, v) in cells.items():
            if i > 0:
                worst = max(worst, abs(v / unit / n - mean[i] * mean[j] - (i == j)))
    return worst


def transform(whole: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """(vec_id, n, deviation, whitened array<double>, explained array<double>) per usable row."""
    small_batches(whole.sparkSession)
    id_type = whole.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for b, at, m in _matrices(batches, 1):
            w = models[m.shape[1]]
            c = w.centred(m)
            z = w.whitened(c)
            dev = [v if v < 1 << 63 else None for v in w.deviations(c)]
            share = (w.values / w.trace).tolist() if w.trace else []
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(at)), pa.array([w.n] * len(at), pa.int64()), pa.array(dev, pa.int64()),
                pa.array(z.tolist(), pa.list_(pa.float64())), pa.array([share] * len(at), pa.list_(pa.float64()))],
                ["vec_id", "n", "deviation", "whitened", "explained"])

    return whole.select("vec_id", "x").mapInArrow(
        run, f"vec_id {id_type}, n bigint, deviation bigint, whitened array<double>, explained array<double>")


def whiten_components(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id",
                      vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per component."""
    whole = whole_vectors(vectors, id_col, vec_col)
    models, error = fit(whole, components)
    z = F.posexplode(F.arrays_zip("whitened", "explained")).alias("p", "z")
    return transform(whole, models).select("vec_id", "n", "deviation", z).select(
        "vec_id", (F.col("p") + 1).alias("component"), "n", "deviation", F.col("z.whitened").alias("whitened"),
        F.col("z.explained").alias("explained"), F.lit(error).alias("identity_error"))
