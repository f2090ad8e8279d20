"""HTML tags and links in page texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.regex import SPACE, chain, folder, quoted, sub

#: Tags as the recogniser writes them.
TABLE_STYLE = (r"<table\b[^>]*\bstyle='[^']*'", '<table align="center" border=1')
CELL_STYLE = (r"<(t[dh])\b[^>]*\bstyle='[^']*'>", "<$1>")
PAGE_IMAGE = r'<img\b[^>]*\bsrc="imgs/([^"]+)"[^>]*/?\s*>'
BOOK_IMAGE = r'<img\b[^>]*\bsrc="[^"]*/imgs/([^"]+)"[^>]*/?\s*>'
LONE_IN_DIV = (rf"(?U)<div\b[^>]*>{SPACE}*(!\[\[[^\]]+\]\]){SPACE}*</div>", "$1")
MARKDOWN_IMAGE = r"(?d)!\[.*?\]\((?!https?://)(?:[^)]*/)?([^/)]+)\)"
TABLE_CELL = "<fcel>"


def strip_table_styles(text: Column) -> Column:
    return chain(text, [TABLE_STYLE, CELL_STYLE])


def fix_image_paths(text: Column, page_id: Column, figures: str) -> Column:
    """src="imgs/ gets the page's folder under figures."""
    return F.replace(text, F.lit('src="imgs/'), F.concat(F.lit(f'src="{figures.replace(chr(92), "/")}/'), page_id, F.lit("/imgs/")))


def _wikilinks(text: Column, image: str, prefix: str) -> Column:
    if not prefix:
        raise ValueError("a folder for figures is needed")
    return sub(text, image, f"![[{quoted(folder(prefix))}/$1]]")


def wikilinks_html(text: Column, prefix: str) -> Column:
    """A page's image tags as wiki links; a div that holds nothing else goes."""
    return sub(_wikilinks(text, PAGE_IMAGE, prefix), *LONE_IN_DIV)


def wikilinks_book(text: Column, prefix: str) -> Column:
    """The same in an assembled book, where sources have a folder before imgs/."""
    return sub(_wikilinks(text, BOOK_IMAGE, prefix), *LONE_IN_DIV)


def wikilinks_markdown(text: Column, prefix: str) -> Column:
    """Markdown images as wiki links, but for those on the web."""
    return _wikilinks(text, MARKDOWN_IMAGE, prefix)


def figure_tags(count: Column) -> Column:
    """One tag per detected figure, one per line."""
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(numbers, lambda i: F.concat(F.lit('<img src="imgs/figure_'), i.cast("string"), F.lit('.png" />'))), "\n")


def recovered_table(message: Column) -> Column:
    """What an error message holds of a table: all from its first cell on, else nothing."""
    at = F.instr(message, TABLE_CELL)
    return F.when(at > 0, message.substr(at, F.length(message))).otherwise("")
