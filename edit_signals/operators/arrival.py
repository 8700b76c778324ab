"""One orderable scalar for a composite arrival order.

Aggregates over struct keys (``min(struct(...))``, ``min_by(x, struct(...))``) cannot use
the hash aggregate and fall back to sorting every map partition. Packing the order
columns into one ``decimal(38,0)`` keeps them hash-based. The packing is exact: each
component gets a fixed number of decimal digits and a row outside its range fails the
job (``raise_error``) instead of being misordered. When the digits do not fit in 38 the
caller gets ``None`` and uses the struct form.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import Arrival

_DEC = "decimal(38,0)"
# Digits per component type. Timestamps are epoch microseconds shifted by 1e17, which makes every
# time of the years 1 to 9999 a non-negative number of 18 digits (times before 1970 too).
_DIGITS = {T.TimestampType: 18, T.TimestampNTZType: 18, T.LongType: 19, T.IntegerType: 10,
           T.ShortType: 5, T.ByteType: 3}
_TIME_SHIFT = 10 ** 17


def _component(df: DataFrame, c: str) -> tuple[Column, int]:
    dt = df.schema[c].dataType
    digits = _DIGITS.get(type(dt))
    if digits is None:
        raise TypeError(f"arrival column {c} has unsupported type {dt.simpleString()}")
    if digits == 18:
        return F.unix_micros(F.col(c).cast("timestamp")) + F.lit(_TIME_SHIFT), digits
    return F.col(c).cast("bigint"), digits


def packable_prefix(df: DataFrame, cols: list[str]) -> list[str]:
    """The leading columns that pack into one key."""
    used = 0
    for i, c in enumerate(cols):
        used += _DIGITS.get(type(df.schema[c].dataType), 99)
        if used > 38:
            return cols[:i]
    return cols


def arrival_key(df: DataFrame, arrival: Arrival, nulls_first: bool = False) -> Column | None:
    """Scalar key ordered like ``arrival.order`` (single column: the column itself). ``nulls_first`` packs a
    missing component as the smallest value of its column, as a struct would order it."""
    cols = list(arrival.order)
    if len(cols) == 1 and not nulls_first:
        return F.col(cols[0])
    parts = [_component(df, c) for c in cols]
    if arrival.digits is not None:
        if len(arrival.digits) != len(cols):
            raise ValueError("Arrival.digits needs one width per order column")
        parts = [(v, min(d, dflt)) for (v, dflt), d in zip(parts, arrival.digits)]
    if sum(d for _, d in parts) > 38:
        return None
    key, ok, missing = None, F.lit(True), F.lit(False)
    for v, d in parts:
        if nulls_first:  # one more, and nothing for a missing one
            v = F.coalesce(v.cast("decimal(20,0)") + F.lit(1), F.lit(0).cast("decimal(20,0)"))
        missing = missing | v.isNull()
        # every non-negative bigint has at most 19 digits
        ok = ok & ((v >= 0) if d >= 19 else v.between(0, 10 ** d - 1))
        dv = v.cast(_DEC)
        key = dv if key is None else (key * F.lit(Decimal(10 ** d)).cast(_DEC) + dv).cast(_DEC)
    msg = f"arrival order {tuple(cols)} out of range for exact packing"
    # a NULL component gives a NULL key (ignored by min/max, never compares as earlier)
    return (F.when(missing, F.lit(None).cast(_DEC)).when(ok, key)
            .otherwise(F.raise_error(F.lit(msg)).cast(_DEC)))


def arrival_struct(arrival: Arrival) -> Column:
    return F.struct(*[F.col(c) for c in arrival.order])


def split_key(df: DataFrame, arrival: Arrival) -> tuple[Column | None, list[str]]:
    """(packed key of the order without ``arrival.split``, those columns); (None, []) if the order
    needs no split or does not pack even so. Within one value of the split columns the packed key
    orders like the whole order."""
    rest = [c for c in arrival.order if c not in arrival.split]
    if not arrival.split or arrival_key(df, arrival) is not None:
        return None, []
    key = arrival_key(df, Arrival(order=tuple(rest)))
    return (None, []) if key is None else (key, rest)
