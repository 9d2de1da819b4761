"""Embedding whitening by polarisation covariance.

Vectors are made whole numbers x; two passes give everything the covariance needs as exact integers. The
first sums every dimension. The second sums the squares of n*x - S, which is centred and still whole,
for every dimension and for the sum of every two dimensions. As var(a + b) = var(a) + var(b) + 2 cov(a, b),
differences of these variances are the covariances; they are divided only once, so V is correct to the
last bit of a double, and eigh takes it apart. A third pass measures the whitened rows themselves.

Sums are kept as limbs of 30 bits in long columns, so Spark adds them exactly at any size; a task gives
one row for each pair of dimensions, the driver one number for each.

Defined cases: a vector that is null, holds a null or an entry that is not finite, or an entry too large to be a
long x, is dropped; of several lengths the most frequent (of those the longest) is the fit list, other vectors
are dropped; repeated rows and null ids count like any; components without variance (not above 1e-12 of
the trace) are not given; an empty fit list or one of a single point gives no rows."""

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limbs of exact sums: bits of each, and how many (signed, 270 bits).
BITS, LIMBS = 30, 9
#: Rows that are squared at once, and bits of the halves they are squared by: rows x 2^(2 bits) fits a long.
ROWS, HALF = 4096, 25
_LIMBS = ", ".join(f"l{i} long" for i in range(LIMBS))


def limbs_of(x: int) -> list:
    out = []
    for _ in range(LIMBS - 1):
        out.append(x & ((1 << BITS) - 1))
        x >>= BITS
    return [*out, x]


def whole_of(row) -> int:
    return sum(int(row[f"l{i}"]) << (BITS * i) for i in range(LIMBS))


def wholes(vectors: DataFrame, vector_col: str, scale: float, shift: int) -> DataFrame:
    """The remaining rows with ``_x``, their whole numbers."""
    v = F.col(vector_col).cast("array<double>")
    # NaN is above every number, so one comparison tells what is finite and fits
    ok = F.coalesce(F.forall(v, lambda c: F.coalesce(F.abs(c) < F.lit(2.0**62 / scale), F.lit(False))), F.lit(False))
    return vectors.filter(ok).withColumn("_x", F.transform(v, lambda c: F.floor(F.lit(scale) * c).cast("long") + F.lit(shift).cast("long")))


def matrices(batches, columns: int = 1):
    """Rows of the last column of Arrow batches, as matrices of one length each, ``ROWS`` rows at most, with their places."""
    for batch in batches:
        x = batch.column(batch.num_columns - 1)
        lengths = np.diff(x.offsets.to_numpy())
        flat = x.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        for d in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == d)
            for i in range(0, len(at), ROWS):
                rows = at[i:i + ROWS]
                yield batch, rows, flat[starts[rows][:, None] + np.arange(d)]


def exact_sums(x: np.ndarray) -> list:
    """Column sums of a matrix of longs, as Python integers."""
    if not len(x):
        return [0] * x.shape[1]
    high = x >> 31
    return [(int(a) << 31) + int(b) for a, b in zip(high.sum(axis=0), (x - (high << 31)).sum(axis=0))]


def exact_squares(w: np.ndarray) -> list:
    """Column sums of the squares of a matrix of longs, as Python integers."""
    total = [0] * w.shape[1]
    for at in range(0, len(w), ROWS):
        parts, rest = [], w[at:at + ROWS]
        while int(np.abs(rest).max()) >> HALF:
            parts.append(rest & ((1 << HALF) - 1))
            rest = rest >> HALF
        parts.append(rest)
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[i:], i):
                for k, s in enumerate(np.einsum("ij,ij->j", a, b)):
                    total[k] += int(s) << (HALF * (i + j) + (i != j))
    return total


def _frame(keys: list, sums: dict) -> pd.DataFrame:
    return pd.DataFrame([(*k, *limbs_of(s)) for k, s in sums.items()], columns=[*keys, *[f"l{i}" for i in range(LIMBS)]])


def _added(df: DataFrame, keys: list) -> list:
    return df.groupBy(*keys).agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in range(LIMBS)]).collect()


def sums(rows: DataFrame) -> tuple:
    """(n, S) of the fit list: its length and the sum of every dimension."""
    def run(batches):
        total = {}
        for _, at, x in matrices(batches):
            d = x.shape[1]
            total[d, -1] = total.get((d, -1), 0) + len(at)
            for i, s in enumerate(exact_sums(x)):
                total[d, i] = total.get((d, i), 0) + s
        if total:
            yield pa.RecordBatch.from_pandas(_frame(["d", "i"], total), preserve_index=False)

    got = {(r["d"], r["i"]): whole_of(r) for r in _added(rows.select("_x").mapInArrow(run, f"d long, i long, {_LIMBS}"), ["d", "i"])}
    if not got:
        return 0, []
    n, d = max((n, d) for (d, i), n in got.items() if i < 0)
    return n, [got[d, i] for i in range(d)]


def centred(x: np.ndarray, n: int, total: list) -> np.ndarray:
    """n*x - S: longs, or whole Python numbers where a long can't hold it or the sum of two of it."""
    largest = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in total), default=0)
    if largest < 1 << 62:
        return np.int64(n) * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def squares(rows: DataFrame, n: int, total: list) -> dict:
    """{(i, j): sum of (n*(x_i + x_j) - S_i - S_j)^2} for i < j, and of one dimension under (i, i)."""
    dims = len(total)

    def run(batches):
        sums = {}
        for _, _, x in matrices(batches):
            if x.shape[1] != dims:
                continue
            z = centred(x, n, total)
            for i in range(dims):
                w = np.concatenate([z[:, i:i + 1], z[:, i:i + 1] + z[:, i + 1:]], axis=1)
                for j, s in enumerate(exact_squares(w) if z.dtype != object else (w * w).sum(axis=0), i):
                    sums[i, j] = sums.get((i, j), 0) + s
        if sums:
            yield pa.RecordBatch.from_pandas(_frame(["i", "j"], sums), preserve_index=False)

    return {(r["i"], r["j"]): whole_of(r) for r in _added(rows.select("_x").mapInArrow(run, f"i long, j long, {_LIMBS}"), ["i", "j"])}


def components(n: int, square: dict, dims: int, most: int) -> tuple:
    """(vectors as columns, eigenvalues, trace) of the first components of the covariance."""
    cov = np.zeros((dims, dims))
    for (i, j), s in square.items():
        of = s if i == j else (s - square[i, i] - square[j, j]) // 2  # always even
        cov[i, j] = cov[j, i] = float(Fraction(of, n**3))
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > 1e-12 * max(np.trace(cov), 1e-300)]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]) if len(order) else 1.0
    return vectors * signs, values[order], float(np.trace(cov))


class Whitener:
    """Everything that makes whitened rows of whole numbers; of fixed size, dims x components. Made anew in each
    task from ``parts``, plain values that any worker can read."""

    def __init__(self, n, total, vectors, values, trace):
        self.parts = n, total, vectors, values, trace
        self.n, self.total, self.values, self.trace = n, total, values, trace
        self.out = vectors / np.sqrt(values)

    def rows(self, z: np.ndarray) -> np.ndarray:
        return (z.astype(np.float64) / self.n) @ self.out

    def of(self, x):
        return centred(x, self.n, self.total)


def fit(rows: DataFrame, most: int) -> Whitener | None:
    n, total = sums(rows)
    if not n:
        return None
    vectors, values, trace = components(n, squares(rows, n, total), len(total), most)
    return Whitener(n, total, vectors, values, trace) if len(values) else None


def identity_error(rows: DataFrame, known) -> float:
    """Largest entry, without sign, of the whitened rows' covariance less the identity: each task's products
    are centred by the task's mean, what its mean is off the whole mean is added after."""
    def run(batches):
        m = Whitener(*known.value)
        k = m.out.shape[1]
        count, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for _, _, x in matrices(batches):
            if x.shape[1] != len(m.total):
                continue
            y = m.rows(m.of(x))
            own = y.mean(axis=0)
            off = own - mean
            products += (y - own).T @ (y - own) + np.outer(off, off) * (count * len(y) / (count + len(y)))
            mean += off * (len(y) / (count + len(y)))
            count += len(y)
        if count:
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"i": i, "j": j, "within": products[i, j], "apart": count * mean[i] * mean[j], "a": count * mean[i], "b": count * mean[j], "n": count}), preserve_index=False)

    got = rows.select("_x").mapInArrow(run, "i long, j long, within double, apart double, a double, b double, n long")
    got = got.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("within", "apart", "a", "b", "n")])
    cov = (F.col("within") + F.col("apart") - F.col("a") * F.col("b") / F.col("n")) / F.col("n")
    return got.agg(F.max(F.abs(cov - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0]


def whitened(vectors: DataFrame, most: int = 32, scale: float = 64.0, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row for each vector and
    component. Three passes fit and measure, the returned frame makes one more."""
    spark = vectors.sparkSession
    rows = wholes(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("_v")), "_v", scale, shift).select("vec_id", "_x")
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(rows, most)
    if model is None:
        return spark.createDataFrame([], schema)
    known = spark.sparkContext.broadcast(model.parts)
    error = identity_error(rows, known)

    def run(batches):
        from decimal import Decimal

        m = Whitener(*known.value)
        k, explained = m.out.shape[1], m.values / m.trace
        for batch, at, x in matrices(batches):
            if x.shape[1] != len(m.total):
                continue
            z = m.of(x)
            total = exact_squares(np.ascontiguousarray(z.T)) if z.dtype != object else (z * z).sum(axis=1).tolist()
            each = lambda c: c.take(pa.array(np.repeat(np.arange(len(at)), k)))
            deviation = pa.array([Decimal(t) if t < 10**38 else None for t in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([
                each(batch.column(0).take(pa.array(at))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * k, m.n)),
                each(deviation), pa.array(m.rows(z).ravel()), pa.array(np.tile(explained, len(at))), pa.array(np.full(len(at) * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
