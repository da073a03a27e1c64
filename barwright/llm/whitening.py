"""Whitening of embeddings by Jacobi-Davidson.

The covariance of the distinct vectors is never formed: all that the solver asks for are products with it, each one pass of
Spark tasks over the centred vectors whose partial sums are added in a fixed order. All wanted eigenpairs are sought together,
so that a pass serves one vector of each. Per round: Rayleigh-Ritz on the subspace, locking of the leading pairs
whose residuals have reached double precision, then for every other pair the correction equation
(I - PP')(V - theta I)(I - PP') t = -r, P the locked and the current Ritz vectors, by a few steps of MINRES (all equations in
step), whose solutions enlarge the subspace. It ends when all pairs are locked.

The driver holds vectors only: the subspace (dimensions times a few dozen) and, per pass, at most FAN partial sums.

Nulls: a row whose vector is null, empty, or holds null or non-finite entries is left out; a null vec_id is kept. Vectors of another
length than most have no place in the covariance and are left out. Entries count as at most 2^31 after scaling. Repeated rows
and equal vectors enter the covariance once and each get their rows. Components without variance have a null ``whitened``, all
of them a null ``explained`` if no vector differs from another; deviations beyond a long are null. An empty table gives an empty
result. Other columns of the table are not read, whatever their names.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from barwright.llm.common import settle, table
from barwright.llm.vectors import common_length, floors, matrix, norms, usable

COMPONENTS = 16
SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 31
#: Vectors in a block, bytes of blocks that a task takes, tasks at least, and partial sums that are added at once.
BLOCK, TASK_BYTES, LEAST_TASKS, FAN = 1024, 64 << 20, 8, 64
#: A residual of this share of the largest eigenvalue is one of double precision.
PRECISE = 64 * np.finfo(float).eps
INNER, ROUNDS = 5, 200


def pack(vectors, width):
    """Blocks (x binary: rows of little-endian longs) of the vectors in column ``x``."""
    def run(batches):
        for b in batches:
            m = matrix(b.column("x"), width)
            for i in range(0, len(m), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([m[i:i + BLOCK].astype("<i8").tobytes()], pa.binary())], ["x"])
    return vectors.select("x").mapInArrow(run, "x binary")


def add_up(blocks, tasks, width, work, dtype=np.float64):
    """Sum of ``work`` (matrix of longs -> array of one shape) over all blocks; None without blocks.

    Each task adds its own; partial sums are added FAN at a time in the order of tasks, the last ones here.
    """
    def run(batches):
        total = None
        for b in batches:
            for blob in b.column("x"):
                part = work(np.frombuffer(blob.as_buffer(), "<i8").reshape(-1, width))
                total = part if total is None else total + part
        if total is not None:
            cell = np.ascontiguousarray(total, dtype)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([list(cell.shape)], pa.list_(pa.int32())), pa.array([cell.tobytes()], pa.binary())], ["part", "shape", "total"])

    def summed(parts):
        return sum((np.frombuffer(p["total"], dtype).reshape(p["shape"]) for p in sorted(parts, key=lambda p: p["part"])[1:]),
                   np.frombuffer(min(parts, key=lambda p: p["part"])["total"], dtype).reshape(min(parts, key=lambda p: p["part"])["shape"]).copy())

    def level(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        return pa.table({"part": pa.array([min(r["part"] for r in rows) // FAN], pa.int32()), "shape": pa.array([rows[0]["shape"]], pa.list_(pa.int32())), "total": pa.array([summed(rows).tobytes()], pa.binary())})

    schema = "part int, shape array<int>, total binary"
    parts = blocks.mapInArrow(run, schema)
    while tasks > FAN:
        parts, tasks = parts.groupBy(F.expr(f"part div {FAN}").alias("_group")).applyInArrow(level, schema), -(-tasks // FAN)
    rows = [r.asDict() for r in parts.collect()]
    return summed(rows) if rows else None


def orthonormal(new, *bases):
    """Orthonormal columns that span ``new`` beside the orthonormal ``bases``; what lies in them is dropped."""
    kept = []
    for j in range(new.shape[1]):
        t = new[:, j]
        before = np.linalg.norm(t)
        if not np.isfinite(before) or before == 0:
            continue
        t = t / before
        for _ in range(3):
            for q in (*bases, np.array(kept).T if kept else np.zeros((len(t), 0))):
                t = t - q @ (q.T @ t)
            size = np.linalg.norm(t)
            if size < 1e-10:
                break
            t = t / size
        else:
            kept.append(t)
    return np.array(kept).T if kept else np.zeros((new.shape[0], 0))


def minres(product, rhs, steps):
    """Approximate solutions of symmetric systems, one per column, by ``steps`` steps of MINRES in parallel."""
    def over(a, b):
        return np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    x, w, w_old, v_old = (np.zeros_like(rhs) for _ in range(4))
    beta = norms(rhs)
    v, eta = over(rhs, np.broadcast_to(beta, rhs.shape)), beta
    c, c_old, s, s_old = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        p = product(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        after = norms(p)
        delta = c * alpha - c_old * s * beta
        rho = np.hypot(delta, after)
        w, w_old = over(v - (s_old * beta) * w_old - (s * alpha + c_old * c * beta) * w, np.broadcast_to(rho, v.shape)), w
        c_old, c, s_old, s = c, over(delta, rho), s, over(after, rho)
        x = x + (c * eta) * w
        eta = -s * eta
        v_old, v, beta = v, over(p, np.broadcast_to(after, p.shape)), after
    return x


def jacobi_davidson(product, width, wanted, seed=7):
    """(values falling, unit vectors as columns) of the ``wanted`` largest eigenpairs of the symmetric positive operator ``product``.

    ``product`` maps a block of columns to its products. Raises if residuals have not reached double precision after ROUNDS rounds.
    """
    most = min(width, max(4 * wanted, 32))
    locked, values = np.zeros((width, 0)), []
    basis = orthonormal(np.random.default_rng(seed).standard_normal((width, min(width, wanted + 8))))
    images, scale = product(basis), 0.0
    for _ in range(ROUNDS):
        small = basis.T @ images
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, images = basis @ turn, images @ turn
        scale = max(scale, abs(theta[0]))
        left = wanted - len(values)
        ritz, value = basis[:, :left], theta[:left]
        rest = images[:, :left] - ritz * value
        rest = rest - locked @ (locked.T @ rest)
        ready = norms(rest) <= PRECISE * scale
        count = left if ready.all() else int(np.argmin(ready))
        if count:
            locked = np.hstack([locked, ritz[:, :count]])
            values.extend(value[:count])
            basis, images = basis[:, count:], images[:, count:]
            if len(values) == wanted:
                return np.array(values), locked
            ritz, value, rest = ritz[:, count:], value[count:], rest[:, count:]
        if basis.shape[1] + len(value) > most and basis.shape[1] < width - len(values):
            keep = max(len(value), most - 2 * len(value))
            basis, images = basis[:, :keep], images[:, :keep]
        held = np.hstack([locked, ritz])

        def projected(z, held=held, value=value):
            z = z - held @ (held.T @ z)
            y = product(z) - z * value
            return y - held @ (held.T @ y)
        new = orthonormal(minres(projected, -rest, INNER), locked, basis)
        if not new.shape[1]:
            new = orthonormal(np.random.default_rng(seed + len(values)).standard_normal((width, 4)), locked, basis)
        if new.shape[1]:
            basis, images = np.hstack([basis, new]), np.hstack([images, product(new)])
        else:
            # the whole space is in the basis: one fresh product removes what rounding has gathered
            basis = orthonormal(basis, locked)
            images = product(basis)
    raise RuntimeError("eigenpairs have not reached double precision")


def fit(rows, width, n_rows, components=COMPONENTS):
    """The whitening of the distinct vectors in ``rows`` (x array<long>): a dict of numpy arrays and numbers."""
    tasks = max(LEAST_TASKS, -(-n_rows * width * 8 // TASK_BYTES))
    blocks = settle(pack(rows.select("x").distinct().coalesce(tasks), width))
    first = add_up(blocks, tasks, width, lambda x: np.append(x.sum(axis=0), len(x)), np.int64)
    n, sums = int(first[-1]), [int(s) for s in first[:-1]]
    shift = np.array([s // n for s in sums], np.int64)
    mean = np.array([(s - n * (s // n)) / n for s in sums])

    def product(z):
        def work(x):
            y = (x - shift) - mean
            return y.T @ (y @ z)
        return add_up(blocks, tasks, width, work) / n
    trace = float(add_up(blocks, tasks, width, lambda x: np.square((x - shift) - mean).sum(keepdims=True).ravel())[0]) / n
    k = min(components, width)
    values, vectors = jacobi_davidson(product, width, k)
    values = np.maximum(values, 0.0)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    real = values > width * np.finfo(float).eps * values[0] if values[0] > 0 else np.zeros(k, bool)
    to = vectors / np.sqrt(np.where(real, values, 1.0))

    def whitened(x):
        z = ((x - shift) - mean) @ to[:, real]
        return z.T @ z
    error = float(np.abs(add_up(blocks, tasks, width, whitened) / n - np.eye(int(real.sum()))).max()) if real.any() else 0.0
    return {"n": n, "sums": sums, "shift": shift, "mean": mean, "values": values, "to": to, "real": real, "trace": trace, "error": error}


def deviations(x, model):
    """Sum over dimensions of (n x - S)^2, exactly; None beyond a long."""
    n = model["n"]
    rest = [s - n * int(h) for s, h in zip(model["sums"], model["shift"])]
    y = x - model["shift"]
    if len(y) and (n * (int(np.abs(y).max()) + 1)) ** 2 * x.shape[1] < 1 << 63:
        return pa.array(np.square(n * y - np.array(rest, np.int64)).sum(axis=1), pa.int64())
    exact = [sum((n * int(v) - r) ** 2 for v, r in zip(row, rest)) for row in y]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whiten(emb, components=COMPONENTS, key="vec_id", vector="embedding"):
    """One row per usable vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    spark = emb.sparkSession
    rows = usable(emb, vector).select(F.col(key).cast("long").alias("vec_id"), F.transform(floors(vector, SCALE, MOST), lambda v: v + SHIFT).alias("x"))
    width, n_rows = common_length(rows, "x")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n_rows:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == width)
    model = fit(rows, width, n_rows, components)
    k = len(model["values"])
    explained = model["values"] / model["trace"] if model["trace"] > 0 else None

    def run(batches):
        for b in batches:
            x = matrix(b.column("x"), width)
            z = ((x - model["shift"]) - model["mean"]) @ model["to"]
            each = pa.array(np.repeat(np.arange(len(x)), k))
            count = len(x) * k
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(count, model["n"], np.int64)),
                deviations(x, model).take(each), pa.array(z.ravel(), mask=np.tile(~model["real"], len(x))),
                pa.nulls(count, pa.float64()) if explained is None else pa.array(np.tile(explained, len(x))), pa.array(np.full(count, model["error"]))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(run, schema)


def query(spark, sf_dir):
    """All usable embeddings, whitened to 16 components."""
    return whiten(table(spark, sf_dir, "embeddings"))
