"""Helpers for the operators on embedding vectors."""

import numpy as np
from pyspark.sql import functions as F


def usable(table, column="embedding"):
    """The rows whose vector is there, has entries, and holds neither nulls nor NaN nor infinities."""
    finite = F.forall(column, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return table.where(F.col(column).isNotNull() & (F.size(column) > 0) & finite)


def floors(column, scale, most):
    """Array of floor(scale * entry) as long; what lies beyond ``most`` counts as ``most``."""
    def one(e):
        x = F.floor(F.greatest(F.least(e.cast("double") * scale, F.lit(float(most))), F.lit(-float(most))))
        return x.cast("long")
    return F.transform(column, one)


def common_length(rows, column):
    """(length, rows): the length that most vectors have, the longer one of two as frequent, and how many have it; (0, 0) without rows."""
    top = rows.groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return (top.d, top.n) if top else (0, 0)


def matrix(column, width):
    """An Arrow list column of longs as a numpy matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def norms(m):
    return np.sqrt((m * m).sum(axis=0))
