"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers x = floor(64 c) + 1,000,000. Everything is fitted on
the fit list, each distinct integer vector once, which is stored. With A the
centred rows, every step makes one distributed pass that takes a direction w
to Aw and at once back to z = A'(Aw), a sum of one vector for each task. The
left vectors u = Aw are as many as rows and are never stored: each is known by
its direction w, so that the products of a new Aw with all earlier u are the
products of z with their directions, and taking them out of w and z takes them
out of Aw. Both sides are reorthogonalised in full, twice. Where a direction
is used up (equal deviations, too few distinct rows) the next begins anew, at
right angles to all before. The bidiagonal matrix, dimensions by dimensions at
most, is decomposed on the driver. Sums of integers are exact; rows are centred
as (n x - S) / n, from exact integers.

The driver sees sums of one vector's length, or its square for 16 components;
nothing else is sent to the tasks either.

Defined results: null vectors and those with null or non-finite entries are
left out; vectors of several lengths are an error, as are entries of 2**40 or
more. Components without deviation (fewer distinct rows than dimensions, or
constant ones) do not exist, so no rows, one distinct row or empty vectors give
no result. deviation is null where it exceeds a long. Repeated rows and null
ids are rows of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_tasks, stored

SCALE, SHIFT = 64.0, 1_000_000
LARGEST = float(1 << 40)
NONE = 1e-9  # deviations of less than this share of the largest are none
_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and x of the rows without null or non-finite entries."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = lambda c: F.floor(F.when(F.abs(c) < LARGEST, c).otherwise(F.raise_error(F.lit("an entry of 2**40 or more"))) * SCALE) + SHIFT
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & fine)
    return rows.select("vec_id", F.transform("v", scaled).alias("x"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The integer rows of a batch."""
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def summed(rows: DataFrame, of, kind: str) -> np.ndarray:
    """The sum over all rows of what ``of`` gives for each batch, an array of one length."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(matrix(batch))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64() if kind == "long" else pa.float64()))], ["v"])

    sums = in_tasks(rows, run, f"v array<{kind}>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    return np.array([r["v"] for r in sorted(sums.collect(), key=lambda r: r["k"])])


def _without(r: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """r at right angles to the rows of basis."""
    for _ in range(2):
        r = r - basis.T @ (basis @ r)
    return r


def bidiagonalise(product, d: int, steps: int, scale: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(right vectors as rows, upper bidiagonal matrix) of A, given product(w) = A'(Aw). scale: A's Frobenius norm."""
    rng, tiny = np.random.default_rng(seed), 1e-13 * scale
    right, upper = np.zeros((0, d)), np.zeros((steps, steps))
    w_all, z_all = np.zeros((0, d)), np.zeros((0, d))  # directions of the left vectors, and A' of those
    r, beta = None, 0.0
    for j in range(steps):
        if r is None:
            r = _without(rng.standard_normal(d), right)
        v = _without(r / np.linalg.norm(r), right)
        v /= np.linalg.norm(v)
        right = np.vstack([right, v])
        w = v - beta * w_all[-1] if beta else v
        z = product(w)
        for _ in range(2):
            c = w_all @ z
            w, z = w - w_all.T @ c, z - z_all.T @ c
        alpha = float(np.sqrt(max(w @ z, 0.0)))
        r = None
        if alpha <= tiny:
            alpha, w, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, z = w / alpha, z / alpha
            r = _without(z - alpha * v, right)
        w_all, z_all = np.vstack([w_all, w]), np.vstack([z_all, z])
        upper[j, j] = alpha
        beta = float(np.linalg.norm(r)) if r is not None else 0.0
        if beta <= tiny:
            r, beta = None, 0.0
        if j + 1 < steps:
            upper[j, j + 1] = beta
    return right, upper


def whiten(vectors: DataFrame, components: int = 16, steps: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row and component. steps: of the bidiagonalisation; as many as dimensions if None, which leaves nothing to converge."""
    spark, rows = vectors.sparkSession, integers(vectors)
    nothing = spark.createDataFrame([], _SCHEMA)
    fit = stored(rows.select("x").distinct(), "fit-list")
    facts = fit.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("d")).first()
    n, d = facts["n"], facts["d"]
    if not n or not d:
        return nothing
    if facts["least"] != d:
        raise ValueError(f"vectors of {facts['least']} and of {d} entries")
    totals = summed(fit, lambda x: x.sum(axis=0), "long")
    centred = lambda x: (n * x - totals) / n
    square = float(summed(fit, lambda x: np.array([(centred(x) ** 2).sum()]), "double")[0])
    if square == 0:
        return nothing

    def product(w: np.ndarray) -> np.ndarray:
        def part(x):
            a = centred(x)
            return a.T @ (a @ w)

        return summed(fit, part, "double")

    right, upper = bidiagonalise(product, d, min(steps or d, d), square**0.5)
    _, deviations, turn = np.linalg.svd(upper)
    kept = min(components, int((deviations > NONE * deviations[0]).sum()))
    axes = turn[:kept] @ right
    axes *= np.sign(axes[np.arange(kept), np.abs(axes).argmax(axis=1)])[:, None]
    scaled = axes.T / (deviations[:kept] / n**0.5)
    explained = deviations[:kept] ** 2 / square
    mean = summed(fit, lambda x: (centred(x) @ scaled).sum(axis=0), "double") / n

    def spread(x):
        y = centred(x) @ scaled - mean
        return (y.T @ y).ravel()

    error = float(np.abs(summed(fit, spread, "double").reshape(kept, kept) / n - np.eye(kept)).max())

    def project(batches):
        names = [c.split(" ")[0] for c in _SCHEMA.split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch)
            far = n * x - totals
            deviation = np.repeat((far * far).sum(axis=1), kept)
            over = np.repeat((far.astype(float) ** 2).sum(axis=1) >= 2.0**63, kept)
            m, y = len(x), (far / n) @ scaled
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), kept)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, n)), pa.array(deviation, mask=over), pa.array(y.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error))], names,
            )

    return in_tasks(rows, project, _SCHEMA)
