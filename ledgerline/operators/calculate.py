"""Exact calculation: one call with an answer envelope, and the same over rows.

Numbers are decimal strings and become exact fractions, so quotients are only rounded once, at the end, by whole numbers. A result of more than
DIGITS digits is out of range. What can't be calculated is an error in the envelope, never a NaN.

Over rows, sums and differences of usual size are Spark decimals; only the rest of the rows reaches Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.numbers import ROUNDINGS

#: The form of a number and its longest, digits of a result, greatest scale.
NUMBER = r"-?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"
LONGEST, DIGITS, MOST_SCALE = 100, 28, 12


class CalculationError(ValueError):
    pass


def rank_desc(values: list[Fraction]) -> list[int]:
    """Indices from the largest; equal values keep their order."""
    return [i for _, i in sorted((-v, i) for i, v in enumerate(values))]


def _pairs(xs: list[Fraction]) -> list[Fraction]:
    if min(xs[1::2]) <= 0:
        raise CalculationError("denominators must be positive")
    return [n / d for n, d in zip(xs[::2], xs[1::2], strict=True)]


@dataclass(frozen=True)
class Operation:
    """How many inputs it takes, in what steps, and what it makes of them; a ranking's result is that of the first in order."""

    least: int
    most: int
    value: Callable[[list[Fraction]], Fraction | list[Fraction]]
    step: int = 1
    ranks: bool = False
    factor: int = 1


#: Names of the operations and how many inputs each takes.
OPERATIONS = {
    "add": Operation(2, 2, sum),
    "subtract": Operation(2, 2, lambda x: x[0] - x[1]),
    "multiply": Operation(2, 2, lambda x: x[0] * x[1]),
    "divide": Operation(2, 2, lambda x: x[0] / x[1]),
    "ratio_percent": Operation(2, 2, lambda x: x[0] / x[1], factor=100),
    "percent_change": Operation(2, 2, lambda x: x[1] / x[0] - 1, factor=100),
    "sum": Operation(1, 20, sum),
    "rank_desc": Operation(2, 10, list, ranks=True),
    "rank_ratio_desc": Operation(4, 20, _pairs, step=2, ranks=True, factor=100),
}


def rounded(x: Fraction, scale: int, rounding: str) -> str:
    """x with so many places, as text; a negative number that rounds to nothing keeps its sign."""
    size = abs(x) * 10**scale
    whole, rest = divmod(size.numerator, size.denominator)
    twice = 2 * rest - size.denominator  # the sign of what is left against a half
    up = {"ROUND_HALF_UP": twice >= 0, "ROUND_HALF_EVEN": twice > 0 or (twice == 0 and whole % 2 == 1), "ROUND_DOWN": False, "ROUND_UP": rest > 0}
    whole += up[rounding]
    digits = str(whole).rjust(scale + 1, "0")
    if len(str(whole)) > DIGITS:
        raise CalculationError("the result is out of range")
    return ("-" if x < 0 else "") + (f"{digits[:-scale]}.{digits[-scale:]}" if scale else digits)


def evaluate(operation: str, inputs: list[str], scale: int = 2, rounding: str = "ROUND_HALF_UP") -> tuple[str, list[int] | None]:
    """(result, order of the inputs for rankings)."""
    op = OPERATIONS.get(operation) if isinstance(operation, str) else None
    faults = {
        "unknown operation": op is None,
        f"the scale must be 0..{MOST_SCALE} and the rounding a known one": type(scale) is not int or scale not in range(MOST_SCALE + 1) or rounding not in ROUNDINGS,
        "another number of inputs is needed": op is not None and (len(inputs) not in range(op.least, op.most + 1) or len(inputs) % op.step > 0),
        "inputs must be decimal strings": not all(isinstance(x, str) and len(x) <= LONGEST and re.fullmatch(NUMBER, x) for x in inputs),
    }
    if found := [text for text, bad in faults.items() if bad]:
        raise CalculationError(found[0])
    try:
        made = op.value([Fraction(x.replace(",", "")) for x in inputs])
    except ZeroDivisionError:
        raise CalculationError("division by zero") from None
    order = rank_desc(made) if op.ranks else None
    return rounded((made[order[0]] if op.ranks else Fraction(made)) * op.factor, scale, rounding), order


def calculate(operation: str, inputs: list[str], *, scale: int = 2, rounding: str = "ROUND_HALF_UP") -> dict:
    """{status, data, citations, limitations}."""
    envelope = {"status": "ok", "data": {}, "citations": [], "limitations": []}
    try:
        value, order = evaluate(operation, list(inputs), scale, rounding)
    except (CalculationError, TypeError) as e:
        return envelope | {"status": "error", "limitations": [str(e)]}
    data = {"operation": operation, "inputs": list(inputs), "scale": scale, "rounding": rounding, "result": value}
    return envelope | {"data": data if order is None else data | {"ordered_indices": order}}


_RESULT = T.StructType().add("status", "string").add("result", "string").add("ordered_indices", T.ArrayType(T.IntegerType())).add("message", "string")


@F.pandas_udf(_RESULT)
def _in_python(op: pd.Series, xs: pd.Series, scale: pd.Series, rounding: pd.Series) -> pd.DataFrame:
    out = []
    for a, b, c, d in zip(op, xs, scale, rounding, strict=True):
        if a is None and d is None:  # a row that is worked out already
            out.append((None,) * 4)
            continue
        got = calculate(a, [] if b is None else list(b), scale=int(c), rounding=d)
        out.append((got["status"], got["data"].get("result"), got["data"].get("ordered_indices"), (got["limitations"] or [None])[0]))
    return pd.DataFrame(out, columns=_RESULT.names)


def calculated(operation: Column, inputs: Column, scale: Column | int = 2, rounding: Column | str = "ROUND_HALF_UP") -> Column:
    """The same for each row: status, result, ordered_indices, message."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    if isinstance(scale, Column) or rounding != "ROUND_HALF_UP" or not 0 <= scale <= 6:
        return _in_python(operation, inputs, lit(scale), lit(rounding))
    # up to 12 digits before the point and 6 after it, sums of 20 of them are exact in 38 digits
    usual = F.forall(inputs, lambda x: F.coalesce(x.rlike(f"^{NUMBER}$") & x.rlike(r"^-?[0-9,]{1,15}(?:\.[0-9]{1,6})?$"), F.lit(False)))
    numbers = F.transform(inputs, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("decimal(24,6)"))
    of = lambda i: F.get(numbers, i)
    raw = (
        F.when((operation == "add") & (F.size(inputs) == 2), (of(0) + of(1)).cast("decimal(30,6)")).when((operation == "subtract") & (F.size(inputs) == 2), (of(0) - of(1)).cast("decimal(30,6)"))
        .when((operation == "sum") & F.size(inputs).between(1, 20), F.aggregate(numbers, F.lit(0).cast("decimal(30,6)"), lambda a, x: (a + x).cast("decimal(30,6)")))
    )
    raw = F.when(F.coalesce(usual, F.lit(False)), raw)
    near = F.round(raw, scale).cast(f"decimal(30,{scale})")
    text = F.concat(F.when((raw < 0) & (near == 0), "-").otherwise(""), near.cast("string"))
    own = F.struct(F.lit("ok").alias("status"), text.alias("result"), F.lit(None).cast("array<int>").alias("ordered_indices"), F.lit(None).cast("string").alias("message"))
    rest = lambda c: F.when(raw.isNull(), c)
    return F.when(raw.isNotNull(), own).otherwise(_in_python(rest(operation), rest(inputs), lit(scale), rest(lit(rounding))))
