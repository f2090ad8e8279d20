"""LaTeX in page texts: spaces inside inline formulas, doubled scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.regex import SPACE, sub

#: A lone dollar; what a script holds; how often scripts are looked through.
LONE = r"(?<!\$)\$(?!\$)"
BODY = r"(?:\{([^{}]*)\}|([a-zA-Z0-9]+|\\[a-zA-Z]+))"
PASSES = 10
DISPLAY = r"\$\$.*?\$\$"
INLINE = rf"{LONE}.*?{LONE}"


def strip_math_spacing(text: Column) -> Column:
    """Strips what stands between two lone dollars; `$$` pairs stay."""
    return F.when(text.contains("$"), sub(text, rf"(?sU){LONE}{SPACE}*(.*?){SPACE}*{LONE}", r"\$$1\$")).otherwise(text)


def _group_scripts(formula: Column) -> Column:
    for sign in (r"\^", "_"):
        plain = sign.strip("\\")
        for _ in range(PASSES):
            formula = sub(formula, f"{sign}{BODY}{sign}{BODY}", f"{plain}{{$1$2{plain}$3$4}}")
    return formula


def _in_formulas(text: Column, formula: str) -> Column:
    """Groups scripts inside each formula; what stands between formulas stays."""
    pieces = rf"(?s)(.*?)({formula}|\z)"
    between, inside = (F.regexp_extract_all(text, F.lit(pieces), F.lit(i)) for i in (1, 2))
    joined = F.zip_with(between, inside, lambda a, b: F.concat(a, F.when(F.length(b) > 0, _group_scripts(b)).otherwise(b)))
    return F.array_join(joined, "")


def fix_double_scripts(text: Column) -> Column:
    """x^a^b becomes x^{a^b}, x_a_b becomes x_{a_b}; in display formulas first, then in inline ones."""
    double = text.rlike(rf"\^{BODY}\^|_{BODY}_") & text.contains("$")
    return F.when(double, _in_formulas(_in_formulas(text, DISPLAY), INLINE)).otherwise(text)
