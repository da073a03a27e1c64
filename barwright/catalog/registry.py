"""Where queries and their SQL counterparts are declared side by side."""

from pyspark.sql import functions as F, types as T

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def tidy(df, digits=6):
    """Round doubles and widen integers, so that results compare exactly."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("long") if f.dataType.scale == 0 else F.round(c.cast("double"), digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def r(expr, digits=6):
    """The SQL form of that rounding; adding zero folds -0 into 0."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def rcols(names, digits=6, prefix=""):
    return ", ".join(f"{r(prefix + n, digits)} AS {n}" for n in names.split())


def he(expr, digits):
    """Half-even rounding of the shortest decimal form of a double, in SQL."""
    return f"CAST(round_even(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 20)), {digits}) AS DOUBLE)"
