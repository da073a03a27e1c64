"""Null-safe arithmetic and small scalar rules (all JVM-side columns)."""

from pyspark.sql import Column, functions as F


def col(c):
    return c if isinstance(c, Column) else F.col(c)


def safe_div(a, b):
    """a/b, null when either is null or b is zero."""
    return F.try_divide(col(a), col(b))


def safe_growth(cur, prev):
    """(cur-prev)/|prev|, null when prev is null or zero."""
    return F.try_divide(col(cur) - col(prev), F.abs(col(prev)))


def nan_to_null(c):
    return F.when(~F.isnan(col(c)), col(c))


def clamp(c, lo, hi):
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(c)))


def ladder(c, cuts, default=0.0, op=">"):
    """First cut passed gives its points: ``cuts`` is [(cut, points), ...] in order."""
    c = col(c)
    tests = {">": c.__gt__, ">=": c.__ge__, "<": c.__lt__, "<=": c.__le__}
    test = tests[op]
    out = None
    for cut, points in cuts:
        cond = test(F.lit(cut))
        out = F.when(cond, F.lit(points)) if out is None else out.when(cond, F.lit(points))
    return out.otherwise(F.lit(default))


def flag(cond, points=1.0):
    """Points when the condition holds, 0 otherwise (null counts as not holding)."""
    return F.when(cond, F.lit(points)).otherwise(F.lit(0.0))


def round_half_even(c, digits=0):
    return F.bround(col(c), digits)


def reason(*parts):
    """Non-null text parts joined by '; '."""
    return F.concat_ws("; ", *parts)


def vol_limit(ann_vol):
    """Share of the portfolio one position may take at a given annual volatility."""
    v = col(ann_vol)
    mult = (
        F.when(v < 0.15, F.lit(1.25))
        .when(v < 0.30, 1.0 - (v - 0.15) * 0.5)
        .when(v < 0.50, 0.75 - (v - 0.30) * 0.5)
        .otherwise(F.lit(0.50))
    )
    return clamp(mult, 0.25, 1.25) * 0.20


def corr_multiplier(avg_corr):
    """Limit multiplier for the mean correlation with what is held; 1 when unknown."""
    c = col(avg_corr)
    return F.when(c.isNull(), F.lit(1.0)).otherwise(
        ladder(c, [(0.80, 0.70), (0.60, 0.85), (0.40, 1.00), (0.20, 1.05)], 1.10, ">=")
    )


def fill_price(price, direction, action, slippage=0.0005):
    """Price after slippage: entries pay up, exits give way; rounded half-even to 4 digits."""
    up = (col(direction) == "long") == F.lit(action == "entry")
    return F.bround(col(price) * F.when(up, 1.0 + slippage).otherwise(1.0 - slippage), 4)


def trade_pnl(entry, exit_, shares, direction):
    move = F.when(col(direction) == "long", col(exit_) - col(entry)).otherwise(col(entry) - col(exit_))
    return move * col(shares)
