"""Aggregate expressions shared by the operators."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uniq(*cols, approx: bool = False) -> Column:
    """Distinct values (or tuples); ``approx`` trades exactness for a sketch."""
    if approx:
        value = _col(cols[0]) if len(cols) == 1 else F.struct(*cols)
        return F.approx_count_distinct(F.xxhash64(*cols) if len(cols) > 1 else value)
    return F.count_distinct(*[_col(c) for c in cols])


def uniq_if(cond: Column, c, approx: bool = False) -> Column:
    return uniq(F.when(cond, _col(c)), approx=approx)


def fold(df: DataFrame, *keys) -> DataFrame:
    """Heartbeats with equal keys as one row: ``hits``, ``first_ts``, ``last_ts``.

    The buffers have fixed width, so this is a hash aggregation with map-side partial
    results, and what comes after it sees page loads instead of heartbeats.
    """
    return df.groupBy(*keys).agg(
        F.count("*").alias("hits"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


def first_of(*cols) -> Column:
    """Struct of the columns on the earliest folded row of a group.

    The columns themselves order rows of the same second (an event id is made from
    the second and cannot), so the result does not depend on how the data was split.
    """
    return F.min(F.struct("first_ts", *cols))


def last_of(*cols) -> Column:
    return F.max(F.struct("last_ts", *cols))


def span() -> Column:
    """Seconds between the first and the last event of the folded rows."""
    return F.max("last_ts") - F.min("first_ts")


def ratio(num, den) -> Column:
    """``num / den``, null when the denominator is zero."""
    return F.try_divide(_col(num), _col(den))


def avg_or_zero(c) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def round_at(c, places: int) -> Column:
    """Half-away rounding done on a scaled number, so engines agree on ties."""
    scale = float(10**places)
    return F.round(_col(c) * scale) / scale


def sketch(c, cond: Column | None = None, lg_k: int = 12) -> Column:
    """Mergeable distinct-count state; rows outside ``cond`` are left out."""
    value = _col(c) if cond is None else F.when(cond, _col(c))
    return F.hll_sketch_agg(value, lg_k)


def sketch_count(c) -> Column:
    """Distinct count from merged states."""
    return F.hll_sketch_estimate(F.hll_union_agg(c))
