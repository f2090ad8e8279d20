"""Printed page numbers, page blocks, page ids and headers."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.regex import DIGIT, SPACE, bind, split_lines, starts, strip

#: Lines looked at on either end; a number line; marks of a block; limits of a header line.
MARGIN_LINES = 5
NUMBER_LINE = rf"(?Ud)\A{SPACE}*({DIGIT}{{1,3}}){SPACE}*\n?\z"
DONE_PAGE = r"(?U)<!-- Page ([^\s\x1c-\x1f]+)"
HEADER_MOST = 120

#: Decimal digits of all scripts but the first, and what they stand for.
_DIGITS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd" and ord(c) < 0x10000]
_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def _number(digits: Column) -> Column:
    return F.translate(digits, "".join(_DIGITS), _VALUES).try_cast("int")


def page_number(text: Column) -> Column:
    """Struct (label, text): the number or two numbers in a row that stand alone in the first or last lines; the text without such lines.

    A text without any is left as it is, line ends included.
    """

    def mark(lines: Column) -> Column:
        n = F.size(lines)
        return F.transform(lines, lambda line, i: F.struct(line.alias("line"), F.when((i < MARGIN_LINES) | (i >= n - MARGIN_LINES), F.regexp_extract(line, NUMBER_LINE, 1)).otherwise("").alias("number")))

    def settle(marked: Column) -> Column:
        numbers = F.transform(F.filter(marked, lambda m: m["number"] != ""), lambda m: _number(m["number"]))
        first, second = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
        label = F.when(second == first + 1, F.concat_ws("-", first.cast("string"), second.cast("string"))).otherwise(first.cast("string"))
        rest = F.array_join(F.transform(F.filter(marked, lambda m: m["number"] == ""), lambda m: m["line"]), "\n")
        none = ~F.exists(marked, lambda m: m["number"] != "")
        return F.struct(F.when(~none, label).alias("label"), F.when(none, text).otherwise(rest).alias("text"))

    return bind(split_lines(text), lambda lines: bind(mark(lines), settle))


def page_block(page_id: Column, text: Column, label: Column) -> Column:
    named = F.when(F.coalesce(label, F.lit("")) != "", F.concat(page_id, F.lit(" (p. "), label, F.lit(")"))).otherwise(page_id)
    return F.concat(F.lit("\n\n<!-- Page "), named, F.lit(" -->\n\n"), text, F.lit("\n"))


def error_block(page_id: Column, error: Column) -> Column:
    return F.concat(F.lit("\n\n<!-- Page "), page_id, F.lit(" — ERROR: "), error, F.lit(" -->\n"))


def done_pages(text: Column) -> Column:
    """Ids of the pages that an assembled text holds, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(DONE_PAGE), F.lit(1)))


def pdf_page_id(stem: Column, number: Column) -> Column:
    return F.concat(stem, F.lit("_p"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))


def may_be_header(line: Column) -> Column:
    """line: stripped."""
    return (line != "") & ~line.startswith("#") & ~line.startswith("<!--") & (F.length(line) <= HEADER_MOST) & ~line.rlike(r"[,;:]\z")


def header_detection(text: Column, patterns: list[tuple[str, int]]) -> Column:
    """Lines that match a pattern (of Java) at their start get its level's marks; the first pattern that matches counts."""

    def mark(line: Column) -> Column:
        return bind(strip(line), lambda bare: case_of(line, bare))

    def case_of(line: Column, bare: Column) -> Column:
        found = None
        for pattern, level in patterns:
            case = starts(bare, pattern), F.concat(F.lit("#" * level + " "), bare)
            found = F.when(*case) if found is None else found.when(*case)
        return line if found is None else F.when(may_be_header(bare), found.otherwise(line)).otherwise(line)

    return F.array_join(F.transform(split_lines(text), mark), "\n")
