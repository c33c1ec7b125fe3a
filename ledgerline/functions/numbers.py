"""Exact decimals on columns; what can't be read becomes null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.text import bound

DECIMAL = "decimal(38,6)"
#: How many won a unit is, and how many hundred million won.
WON = {"원": "1", "천원": "1000", "백만원": "1000000", "억원": "100000000", "조원": "1000000000000"}
HUNDRED_MILLION = {"원": "0.00000001", "천원": "0.00001", "백만원": "0.01", "억원": "1", "조원": "10000"}
ROUNDINGS = ("ROUND_HALF_UP", "ROUND_HALF_EVEN", "ROUND_DOWN", "ROUND_UP")


def decimal_text(c: Column, kind: str = DECIMAL) -> Column:
    """A decimal string with or without thousands separators."""
    t = F.trim(c)
    return F.when(t.rlike(r"^-?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?$"), F.replace(t, F.lit(","), F.lit("")).try_cast(kind))


def loose_decimal(c: Column, kind: str = DECIMAL) -> Column:
    """Commas dropped, then cast if that works."""
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast(kind)


def first_amount(c: Column, kind: str = DECIMAL) -> Column:
    """The first number in a text; blanks part numbers."""
    return F.replace(F.nullif(F.regexp_extract(c, r"-?[0-9,]+(?:\.[0-9]+)?", 0), F.lit("")), F.lit(","), F.lit("")).try_cast(kind)


def accounting(c: Column, kind: str = DECIMAL) -> Column:
    """Parentheses and triangles mean minus; a dash alone is no number."""
    t = F.regexp_replace(F.trim(c), r"[,\s]", "")
    minus = t.rlike(r"^(\(.*\)|[△▲-].*)$")
    number = F.regexp_replace(t, r"[()△▲-]", "").try_cast(kind)
    return F.when(minus, -number).otherwise(number)


def strict_accounting(c: Column, kind: str = DECIMAL) -> Column:
    """Non-negative numbers only: signs and parentheses are refused."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[0-9][0-9,]*(\.[0-9]+)?$"), F.replace(t, F.lit(","), F.lit("")).try_cast(kind))


def round_as(c: Column, scale: int, rounding: str = "ROUND_HALF_UP") -> Column:
    if not 0 <= scale <= 12 or rounding not in ROUNDINGS:
        raise ValueError("scale must be 0..12 and rounding one of " + ", ".join(ROUNDINGS))
    if rounding == "ROUND_HALF_UP":
        return F.round(c, scale)
    if rounding == "ROUND_HALF_EVEN":
        return F.bround(c, scale)
    whole = (F.floor if rounding == "ROUND_DOWN" else F.ceil)(F.abs(c), F.lit(scale))
    return F.when(c < 0, -whole).otherwise(whole)


def divided(a: Column, b: Column) -> Column:
    """a / b with at least ten places, null for a zero divisor."""
    return F.try_divide(a.cast("decimal(28,4)"), b.cast("decimal(28,4)"))


def ratio_percent(a: Column, b: Column, scale: int = 2) -> Column:
    return F.round(F.try_divide(a.cast("decimal(26,2)") * 100, b.cast("decimal(26,2)")), scale)


def percent_change(old: Column, new: Column, scale: int = 2) -> Column:
    return F.round(F.try_divide((new.cast("decimal(24,2)") - old.cast("decimal(24,2)")) * 100, old.cast("decimal(24,2)")), scale)


def _by_unit(table: dict[str, str], unit: Column, kind: str) -> Column:
    out = None
    for name, factor in table.items():
        own = F.when(unit == name, F.lit(factor).cast(kind))
        out = own if out is None else out.when(unit == name, F.lit(factor).cast(kind))
    return out


def in_won(amount: Column, unit: Column) -> Column:
    """null for an unknown unit."""
    return amount.cast("decimal(24,4)") * _by_unit(WON, unit, "decimal(13,0)")


def in_hundred_millions(amount: Column, unit: Column) -> Column:
    return F.round(amount.cast("decimal(24,4)") * _by_unit(HUNDRED_MILLION, unit, "decimal(13,8)"), 2)


def formatted(c: Column) -> Column:
    """Thousands separators, a dash for nothing."""
    text = F.format_number(c, 0)
    return F.when(c.isNull(), F.lit("-")).otherwise(text)


def accounting_text(c: Column) -> Column:
    """An amount as text with thousands separators: a leading minus or parentheses around it mean minus, nothing is a dash, other text stays."""
    def told(t: Column, digits: Column) -> Column:
        whole, rest = F.substring_index(digits, ".", 1), F.regexp_extract(digits, r"(\..*)$", 1)
        grouped = F.regexp_replace(F.regexp_replace(whole, "^0+(?=[0-9])", ""), "(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")
        minus = F.when(t.startswith("-") | (t.startswith("(") & t.endswith(")")), "-").otherwise("")
        return F.when(whole == "", t).otherwise(F.concat(minus, grouped, F.when(F.contains(digits, F.lit(".")), rest).otherwise("")))

    own = lambda t: F.when(t.isin("", "-"), "-").otherwise(bound(F.regexp_replace(t, "[^0-9.]", ""), lambda digits: told(t, digits)))
    return bound(F.trim(F.coalesce(c, F.lit(""))), own)


def plain_numbers(c: Column) -> Column:
    """The numbers of a text as they are written, without separators."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")))


def number_set(c: Column) -> Column:
    """Distinct numbers of a text without separators; a negative one also stands for its absolute value."""
    found = plain_numbers(c)
    return F.array_distinct(F.concat(found, F.transform(F.filter(found, lambda x: x.startswith("-")), lambda x: F.substring(x, 2, F.length(x)))))
