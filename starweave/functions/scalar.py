"""Scalar functions of the measure language, with the semantics of that language, as built-in Spark columns.

Each entry takes columns and gives a column. Blank is null. Divisions go through ``try_divide``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from starweave.plans.dax import DaxError

_ten = lambda n: F.pow(F.lit(10.0), n)


def _away(x: Column, n: Column) -> Column:
    return F.signum(x) * F.ceil(F.abs(x) * _ten(n)) / _ten(n)


def _toward(x: Column, n: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) * _ten(n)) / _ten(n)


def _blank_as_empty(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def _weekday(d: Column, kind: int = 1) -> Column:
    if kind == 1:
        return F.dayofweek(d)
    if kind == 2:
        return F.weekday(d) + 1
    if kind == 3:
        return F.weekday(d)
    raise DaxError(f"weekday type {kind}")


def _weeknum(d: Column, kind: int = 1) -> Column:
    if kind == 21:
        return F.weekofyear(d)
    first = F.trunc(d, "year")
    shift = F.dayofweek(first) - 1 if kind == 1 else F.weekday(first)
    return F.floor((F.dayofyear(d) + shift - 1) / 7).cast("int") + 1


def _datediff(a: Column, b: Column, unit: str) -> Column:
    """Boundaries crossed between two dates."""
    months = (F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))
    kinds = {
        "DAY": lambda: F.datediff(b, a),
        "MONTH": lambda: months,
        "QUARTER": lambda: (F.year(b) * 4 + F.quarter(b)) - (F.year(a) * 4 + F.quarter(a)),
        "YEAR": lambda: F.year(b) - F.year(a),
        "WEEK": lambda: F.floor(F.datediff(F.date_trunc("week", F.date_add(b, 1)), F.date_trunc("week", F.date_add(a, 1))) / 7).cast("int"),
        "HOUR": lambda: ((F.unix_timestamp(F.date_trunc("hour", b)) - F.unix_timestamp(F.date_trunc("hour", a))) / 3600).cast("long"),
        "MINUTE": lambda: ((F.unix_timestamp(F.date_trunc("minute", b)) - F.unix_timestamp(F.date_trunc("minute", a))) / 60).cast("long"),
        "SECOND": lambda: F.unix_timestamp(b) - F.unix_timestamp(a),
    }
    if unit not in kinds:
        raise DaxError(f"DATEDIFF by {unit}")
    return kinds[unit]()


# Number and date formats that FORMAT knows.
FORMATS: dict[str, Callable[[Column], Column]] = {
    "0": lambda x: F.format_string("%.0f", F.round(x.cast("double"), 0)),
    "0.00": lambda x: F.format_string("%.2f", F.round(x.cast("double"), 2)),
    "#,##0": lambda x: F.format_number(x, 0),
    "#,##0.00": lambda x: F.format_number(x, 2),
    "0%": lambda x: F.concat(F.format_string("%.0f", F.round(x.cast("double") * 100, 0)), F.lit("%")),
    "0.0%": lambda x: F.concat(F.format_string("%.1f", F.round(x.cast("double") * 100, 1)), F.lit("%")),
    "yyyy-MM-dd": lambda x: F.date_format(x, "yyyy-MM-dd"),
    "yyyy-MM": lambda x: F.date_format(x, "yyyy-MM"),
    "MMM yyyy": lambda x: F.date_format(x, "MMM yyyy"),
    "MMMM": lambda x: F.date_format(x, "MMMM"),
    "yyyy": lambda x: F.date_format(x, "yyyy"),
}
KINDS = {"INTEGER": "bigint", "DOUBLE": "double", "STRING": "string", "BOOLEAN": "boolean", "CURRENCY": "decimal(19,4)", "DATETIME": "timestamp"}


def _format(x: Column, form: str) -> Column:
    if form not in FORMATS:
        raise DaxError(f"FORMAT with {form!r}; known are {', '.join(FORMATS)}")
    return FORMATS[form](x)


def _convert(x: Column, kind: str) -> Column:
    if str(kind).upper() not in KINDS:
        raise DaxError(f"CONVERT to {kind}")
    return x.cast(KINDS[str(kind).upper()])


def _found(what: Column, s: Column, start: int, miss: object) -> Column:
    """The place of the first occurrence from ``start`` on, from 1."""
    return F.coalesce(F.nullif(F.position(what, s, F.lit(int(start))), F.lit(0)), F.lit(miss))


def _unichar(n: Column) -> Column:
    """The character of a code point, beyond the first 256 too."""
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32")



#: name: (function, positions of arguments that are compile-time literals)
FUNCTIONS: dict[str, tuple[Callable[..., Column], tuple[int, ...]]] = {
    "ABS": (F.abs, ()),
    "SQRT": (lambda x: F.when(x >= 0, F.sqrt(x)), ()),
    "EXP": (F.exp, ()),
    "LN": (lambda x: F.when(x > 0, F.log(x)), ()),
    "LOG10": (lambda x: F.when(x > 0, F.log10(x)), ()),
    "LOG": (lambda x, base=None: F.when(x > 0, F.log(x) / F.log(base if base is not None else F.lit(10.0))), ()),
    "POWER": (F.pow, ()),
    "PI": (F.pi, ()),
    "RAND": (lambda: F.rand(), ()),
    "SIGN": (lambda x: F.signum(x), ()),
    "ROUND": (lambda x, n=0: F.round(x, int(n)), (1,)),
    "ROUNDUP": (lambda x, n=None: _away(x, n if n is not None else F.lit(0)), ()),
    "ROUNDDOWN": (lambda x, n=None: _toward(x, n if n is not None else F.lit(0)), ()),
    "INT": (lambda x: F.floor(x), ()),
    "TRUNC": (lambda x, n=None: _toward(x, n if n is not None else F.lit(0)), ()),
    "MOD": (lambda a, b: a - b * F.floor(F.try_divide(a, b)), ()),
    "QUOTIENT": (lambda a, b: _toward(F.try_divide(a, b), F.lit(0)), ()),
    "CURRENCY": (lambda x: x.cast("decimal(19,4)"), ()),
    "CONVERT": (_convert, (1,)),
    "DIVIDE": (lambda a, b, other=None: F.try_divide(a, b) if other is None else F.coalesce(F.try_divide(a, b), other), ()),
    "MIN": (F.least, ()),
    "MAX": (F.greatest, ()),
    "CONCATENATE": (lambda a, b: F.concat(_blank_as_empty(a), _blank_as_empty(b)), ()),
    "COMBINEVALUES": (lambda sep, *xs: F.concat_ws(str(sep), *[_blank_as_empty(x) for x in xs]), (0,)),
    "LEFT": (lambda s, n=None: F.left(s, n if n is not None else F.lit(1)), ()),
    "RIGHT": (lambda s, n=None: F.right(s, n if n is not None else F.lit(1)), ()),
    "MID": (lambda s, i, n: F.substr(s, i, n), ()),
    "LEN": (F.char_length, ()),
    "UPPER": (F.upper, ()),
    "LOWER": (F.lower, ()),
    "TRIM": (lambda s: F.regexp_replace(F.trim(s), " +", " "), ()),
    "REPT": (lambda s, n: F.repeat(s, n), ()),
    "SUBSTITUTE": (lambda s, old, new: F.replace(s, old, new), ()),
    "REPLACE": (lambda s, i, n, new: F.overlay(s, new, i, n), ()),
    "SEARCH": (lambda what, s, start=1, miss=None: _found(F.lower(what), F.lower(s), start, miss), (2, 3)),
    "FIND": (lambda what, s, start=1, miss=None: _found(what, s, start, miss), (2, 3)),
    "EXACT": (lambda a, b: a == b, ()),
    "UNICHAR": (_unichar, ()),
    "UNICODE": (F.ascii, ()),
    "PATHITEM": (lambda p, n: F.get(F.split(p, "\\|"), n - 1), ()),
    "FORMAT": (_format, (1,)),
    "TODAY": (F.current_date, ()),
    "NOW": (F.current_timestamp, ()),
    "YEAR": (F.year, ()),
    "QUARTER": (F.quarter, ()),
    "MONTH": (F.month, ()),
    "DAY": (F.dayofmonth, ()),
    "HOUR": (F.hour, ()),
    "MINUTE": (F.minute, ()),
    "SECOND": (F.second, ()),
    "WEEKDAY": (_weekday, (1,)),
    "WEEKNUM": (_weeknum, (1,)),
    "EOMONTH": (lambda d, n: F.last_day(F.add_months(d, n)), ()),
    "EDATE": (lambda d, n: F.add_months(d, n), ()),
    "DATE": (F.make_date, ()),
    "DATEDIFF": (_datediff, (2,)),
    "TRUE": (lambda: F.lit(True), ()),
    "FALSE": (lambda: F.lit(False), ()),
    "AND": (lambda a, b: a & b, ()),
    "OR": (lambda a, b: a | b, ()),
    "NOT": (lambda a: ~a, ()),
    "BLANK": (lambda: F.lit(None), ()),
    "ISBLANK": (lambda x: x.isNull(), ()),
    "COALESCE": (F.coalesce, ()),
    "IF": (lambda c, a, b=None: F.when(c, a) if b is None else F.when(c, a).otherwise(b), ()),
    "IFERROR": (lambda a, b: F.coalesce(a, b), ()),
    "STARTOFMONTH": (lambda d: F.trunc(d, "month"), ()),
    "STARTOFQUARTER": (lambda d: F.trunc(d, "quarter"), ()),
    "STARTOFYEAR": (lambda d: F.trunc(d, "year"), ()),
    "ENDOFMONTH": (lambda d: F.last_day(d), ()),
    "ENDOFQUARTER": (lambda d: F.last_day(F.add_months(F.trunc(d, "quarter"), 2)), ()),
    "ENDOFYEAR": (lambda d: F.last_day(F.add_months(F.trunc(d, "year"), 11)), ()),
}


def switch(value: Column | None, pairs: list[tuple[Column, Column]], rest: Column | None) -> Column:
    """SWITCH: without a value the searched form."""
    test = lambda w: w if value is None else value == w
    out = reduce(lambda c, p: c.when(test(p[0]), p[1]), pairs[1:], F.when(test(pairs[0][0]), pairs[0][1]))
    return out if rest is None else out.otherwise(rest)


# Cleaning casts: values that don't fit become null.


def to_number(x: Column) -> Column:
    return F.regexp_replace(x, ",", "").try_cast("double")


def to_day(x: Column, form: str = "yyyy-MM-dd") -> Column:
    return F.try_to_timestamp(x, F.lit(form)).cast("date")


def to_flag(x: Column) -> Column:
    text = F.lower(F.trim(x.cast("string")))
    return F.when(text.isin("true", "t", "yes", "y", "1"), True).when(text.isin("false", "f", "no", "n", "0"), False)
