"""Python values of operations, made to fit a column's type before a plan is built."""

from __future__ import annotations

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

from pyspark.sql import types as T

from ..errors import CompileError

_TRUE, _FALSE = {"true", "t", "yes", "1"}, {"false", "f", "no", "0"}
_RANGES = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def coerce(value, kind: T.DataType, column: str):
    """The value as one of ``kind``; CompileError where it isn't one, so that errors are text."""
    if value is None:
        return None
    wrong = CompileError(f"{value!r} is not a value of {kind.simpleString()} for {column}")
    try:
        if isinstance(kind, T.StringType):
            if not isinstance(value, str):
                raise wrong
            return value
        if isinstance(kind, T.BooleanType):
            if isinstance(value, bool):
                return value
            if isinstance(value, str) and value.lower() in _TRUE | _FALSE:
                return value.lower() in _TRUE
            raise wrong
        if isinstance(value, (bool, list, dict)):
            raise wrong
        if type(kind) in _RANGES:
            number = Decimal(value) if isinstance(value, (str, int)) else Decimal(str(value))
            if number != number.to_integral_value() or not -(2 ** _RANGES[type(kind)]) <= number < 2 ** _RANGES[type(kind)]:
                raise wrong
            return int(number)
        if isinstance(kind, T.DecimalType):
            number = Decimal(str(value)).quantize(Decimal(1).scaleb(-kind.scale), ROUND_HALF_UP)
            if abs(number) >= Decimal(10) ** (kind.precision - kind.scale):
                raise wrong
            return number
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(value)
        if isinstance(kind, T.DateType):
            if isinstance(value, dt.datetime):
                return value.date()
            return value if isinstance(value, dt.date) else dt.date.fromisoformat(value.strip()[:10])
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            if isinstance(value, dt.datetime):
                return value
            if isinstance(value, dt.date):
                return dt.datetime(value.year, value.month, value.day)
            return dt.datetime.fromisoformat(value.strip())
    except (ValueError, TypeError, AttributeError, InvalidOperation):
        raise wrong from None
    raise wrong
