"""Clean-up of a page's text; each rule is one left-to-right pass, and their order is part of their meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.loops import collapse_loops
from quire.functions.regex import DIGIT, LOWER, SPACE, WORD, bind, strip, sub

#: What a rule looks for, and what it leaves.
PAGE_NUMBER_LINE = (rf"(?md)(?U)^{SPACE}*{DIGIT}{{1,3}}{SPACE}*$", "")
HYPHEN_AT_LINE_END = (rf"({WORD})-\n({WORD})", "$1$2")
HYPHEN_AT_PARAGRAPH_END = (rf"({WORD})-\n\n([{LOWER}])", "$1$2")
HYPHEN_IN_LINE = (rf"({WORD})- ({WORD})", "$1$2")
PARAGRAPH_IN_SENTENCE = (rf"([{LOWER},])\n\n(\(|[{LOWER}\p{{Nd}}])", "$1 $2")
BLANK_LINES = (r"\n{3,}", "\n\n")


def _where(text: Column, literal: str, rule: tuple[str, str]) -> Column:
    """The rule where the text holds the literal that each match of it does, which most texts don't: a search for it takes a fraction of the pattern's time."""
    return bind(text, lambda t: F.when(t.contains(literal), sub(t, *rule)).otherwise(t))


def remove_page_numbers(text: Column) -> Column:
    """Drops lines of one to three digits, with the blank lines about them."""
    return sub(text, *PAGE_NUMBER_LINE)


def rejoin_line_hyphens(text: Column) -> Column:
    return _where(text, "-\n", HYPHEN_AT_LINE_END)


def rejoin_paragraph_hyphens(text: Column) -> Column:
    """Across a blank line, where a small letter follows: no title does."""
    return _where(text, "-\n\n", HYPHEN_AT_PARAGRAPH_END)


def rejoin_inline_hyphens(text: Column) -> Column:
    return _where(text, "- ", HYPHEN_IN_LINE)


def join_paragraphs(text: Column) -> Column:
    """Joins a paragraph that breaks off in a sentence to the next."""
    return _where(text, "\n\n", PARAGRAPH_IN_SENTENCE)


def collapse_blank_lines(text: Column) -> Column:
    return _where(text, "\n\n\n", BLANK_LINES)


def clean_page(text: Column, no_layout: Column | bool = False, page_numbers: bool = True, hyphens: bool = True, blank_lines: bool = True, spare: bool = False) -> Column:
    """All rules that are on, in order; loops only where no_layout holds and hyphens are on."""
    if page_numbers:
        text = remove_page_numbers(text)
    if hyphens:
        text = rejoin_paragraph_hyphens(rejoin_line_hyphens(text))
        if no_layout is True:
            text = collapse_loops(text)
        elif isinstance(no_layout, Column):
            text = collapse_loops(text, no_layout, spare)
        text = join_paragraphs(rejoin_inline_hyphens(text))
    if blank_lines:
        text = collapse_blank_lines(text)
    return strip(text)
