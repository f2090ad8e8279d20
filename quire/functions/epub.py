"""Clean-up of Markdown that a converter made from an EPUB, line by line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.regex import SPACE, bind, chain, split_lines, strip, sub

#: What each step takes out or rewrites.
SVG = r"<svg\b.*?</svg>"
SVG_WITH_IMAGE = r'<image\b[^>]*\bxlink:href="[^"]+"'
FENCE = rf"(?U)\A{SPACE}*(?:>{SPACE}*)?:{{3,}}"
IMAGE = r"(?d)!\[(.*?)\]\((.+?)\)"
ATTRIBUTES = (rf"(?U){SPACE}*\{{[^{{}}]+\}}", "")
RAW_HTML = (r"`[^`]*`\{=html\}", "")
EMPTY_SPAN = (r"\[\]\{[^{}]*\}", "")
EMPTY_BRACKETS = (r"(?<!!)\[\](?!\()", "")
NUMBERED_HEADING = (rf"(?U)\A(#{{1,6}}{SPACE}*)\[\[?{SPACE}*(\p{{Nd}}+(?:\.\p{{Nd}}+)*){SPACE}*\]?{SPACE}*\](?:\[{SPACE}*([^\]]*?){SPACE}*\])?", "$1$2 $3")
INTERNAL_LINK = (r"(?<!!)\[\[([^\]]+)\]\](?!\()", "$1")
DOUBLED_LINK = (r"\[\[([^\]]+)\]\]\(([^)]+)\)", "[$1]($2)")
PLAIN_BRACKETS = (r"(?<!!)\[([^\]]+)\](?!\[|\()", "$1")
ESCAPES = [(r"\\(?=[,;.!?])", ""), (r"\\\z", "")]
COMMENT_LINE = rf"(?Ud)\A{SPACE}*(?:<!--.*?-->|`<!--.*?-->`)"
SPACES = [("  +", " "), (rf"(?U){SPACE}+\z", "")]


def inline_svgs(text: Column) -> Column:
    """The vector drawings of a text in order, without those that only wrap an image."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"(?s)({SVG})"), F.lit(1)), lambda s: ~s.rlike(SVG_WITH_IMAGE))


def link_svgs(text: Column) -> Column:
    """Drawings as links to inline_svg_001.svg and so on, numbered within the text."""
    pieces = rf"(?s)(.*?)({SVG}|\z)"
    between, svgs = (F.regexp_extract_all(text, F.lit(pieces), F.lit(i)) for i in (1, 2))
    vector = F.transform(svgs, lambda s: (s != "") & ~s.rlike(SVG_WITH_IMAGE))

    def links(vector: Column) -> Column:
        def link(is_vector: Column, i: Column) -> Column:
            number = F.size(F.filter(F.slice(vector, F.lit(1), i + 1), lambda v: v))
            padded = F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))
            return F.when(is_vector, F.concat(F.lit("\n\n![](figures/inline_svg_"), padded, F.lit(".svg)\n\n"))).otherwise("")

        return F.transform(vector, link)

    linked = F.array_join(F.zip_with(between, bind(vector, links), lambda a, b: F.concat(a, b)), "")
    return F.when(text.contains("<svg"), linked).otherwise(text)


def image_refs(line: Column, names: Column | None = None) -> Column:
    """Image links to figures/ and the saved name: names (a map) has it by source, else it is the source's last part."""
    pieces = rf"(?d)(.*?)(!\[.*?\]\(.+?\)|\z)"
    between, refs = (F.regexp_extract_all(line, F.lit(pieces), F.lit(i)) for i in (1, 2))

    def fixed(ref: Column) -> Column:
        alt, source = F.regexp_extract(ref, IMAGE, 1), F.regexp_extract(ref, IMAGE, 2)
        name = F.regexp_extract(source, r"([^/]+)/*\z", 1)
        if names is not None:
            name = F.coalesce(F.try_element_at(names, source), F.try_element_at(names, F.replace(source, F.lit("\\"), F.lit("/"))), name)
        return F.when(ref == "", "").otherwise(F.concat(F.lit("!["), alt, F.lit("](figures/"), name, F.lit(")")))

    return F.when(line.contains("!["), F.array_join(F.zip_with(between, refs, lambda a, r: F.concat(a, fixed(r))), "")).otherwise(line)


def clean_line(line: Column, names: Column | None = None) -> Column:
    """A line after all steps that rewrite it; fences and comments are left to keep_line."""
    line = F.replace(image_refs(line, names), F.lit("[/]"), F.lit("/"))
    line = chain(line, [ATTRIBUTES, RAW_HTML, EMPTY_SPAN, EMPTY_BRACKETS])
    line = F.when(strip(line).startswith("#"), sub(line, *NUMBERED_HEADING)).otherwise(line)
    return chain(line, [INTERNAL_LINK, DOUBLED_LINK, PLAIN_BRACKETS, *ESCAPES])


def clean_markdown(text: Column, names: Column | None = None) -> Column:
    """The whole clean-up.  names: map from a source in the archive to the file it was saved as."""
    lines = F.filter(split_lines(link_svgs(text)), lambda line: ~line.rlike(FENCE))
    lines = F.filter(F.transform(lines, lambda line: clean_line(line, names)), lambda line: ~line.rlike(COMMENT_LINE))
    lines = F.transform(lines, lambda line: chain(line, SPACES))
    # of blank lines in a row the first stays, of those at the start none
    kept = bind(lines, lambda own: F.filter(own, lambda line, i: (line != "") | ((i > 0) & (F.get(own, i - 1) != ""))))
    return strip(sub(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def metrics(raw: Column, clean: Column, images: Column) -> Column:
    count = lambda c: F.regexp_count(c, F.lit("\n"))
    return F.struct(F.length(raw).alias("raw_chars"), F.length(clean).alias("clean_chars"), count(clean).alias("lines"), images.alias("images"))
