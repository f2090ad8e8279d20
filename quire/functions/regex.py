"""Regular expressions that mean in Java what the page rules mean, and the string helpers built on them.

Rules are stated over Unicode classes; Java's own shorthands are ASCII or differ in single characters, so each class is
spelled out once here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character classes of the rules.
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
SPACE = r"[\s\x1c-\x1f]"  # with the flag U
LOWER = "a-zéèêëàâîïôùûüçœ"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once: a lambda's variable is, an expression that a lambda holds is computed each time."""
    return F.element_at(F.transform(F.array(value), f), 1)


def sub(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(replacement))


def chain(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The rules (pattern, replacement), each in one pass over what the one before left."""
    for pattern, replacement in rules:
        text = sub(text, pattern, replacement)
    return text


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return sub(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def split_lines(text: Column) -> Column:
    """Lines without their ends; an end at the very end opens no line, and an empty text has none."""

    def whole(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    return F.when(text == "", F.array().cast("array<string>")).otherwise(bind(F.split(text, LINE_ENDS, -1), whole))


def starts(text: Column, pattern: str) -> Column:
    """Whether the pattern matches at the start of text."""
    return text.rlike(rf"\A(?:{pattern})")


def quoted(replacement: str) -> str:
    """A literal as a replacement."""
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def folder(path: str) -> str:
    """A folder's path with forward slashes and none at its end."""
    return path.replace("\\", "/").rstrip("/")
