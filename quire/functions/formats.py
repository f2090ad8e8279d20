"""How reports write numbers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def fixed(value: Column, digits: int) -> Column:
    """With 0 to 3 digits, of the double's exact value, ties to even: Java's formatter rounds its shortest decimal form, ties up."""
    if not digits:
        return F.format_string("%.0f", F.rint(value))
    size = F.abs(value)
    known = F.coalesce(size < 2.0**53, F.lit(False))
    size = F.when(known, size).otherwise(0.0)
    part, limb, ten = size - F.floor(size), 2**52, 10**digits
    # the fraction as two integers of 52 bits, which holds all of it that can count
    high = F.floor(part * 2.0**52)
    low = F.floor((part * 2.0**52 - high) * 2.0**52) * ten
    high = high * ten + F.shiftright(low, 52)
    low, left, shown = low % limb, high % limb, F.shiftright(high, 52)
    up = (left > limb // 2) | ((left == limb // 2) & ((low > 0) | (shown % 2 == 1)))
    shown = shown + F.when(up, 1).otherwise(0)
    sign = F.when((value < 0) | (value.cast("string") == "-0.0"), "-").otherwise("")
    exact = F.format_string(f"%s%d.%0{digits}d", sign, F.floor(size) + F.when(shown == ten, 1).otherwise(0), shown % ten)
    return F.when(known, exact).otherwise(F.format_string(f"%.{digits}f", value))


def seconds(value: Column, digits: int) -> Column:
    return F.concat(fixed(value, digits), F.lit("s"))


def duration(value: Column) -> Column:
    """Whole seconds below a minute, else minutes with one digit."""
    return F.when(value < 60, seconds(value, 0)).otherwise(F.concat(fixed(value / 60, 1), F.lit(" min")))


def moment(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def padded(number: Column, width: Column | int) -> Column:
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width) if isinstance(width, int) else width, F.length(text)), F.lit("0"))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def suffix(name: Column) -> Column:
    """With its dot, in lower case; empty where a name has none or only starts with one."""
    return F.lower(F.regexp_extract(name, r".(\.[^.]+)\z", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)
