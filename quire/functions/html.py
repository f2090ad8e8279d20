"""HTML in page texts to Markdown, in slices of rows.

Code spans stay as they are.  Paragraphs (parted by blank lines) without block tags count as paragraphs of their own, with white space
collapsed; others are converted tag by tag: headings, lists, tables, links, images, line breaks, bold, italic, code,
quotations, `sup` to ^x^ and `sub` to ~x~.  Unknown tags go and their content stays; `style` and `script` keep no
tag.  Nothing is escaped.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column

from quire.functions.batches import by_slice

#: Tags that make a block, and a code span.
BLOCK = re.compile(r"<(?:div|p|table|h[1-6]|ul|ol|li|blockquote|pre)[\s>]", re.I)
CODE = re.compile(r"(`[^`]*`)")
PARAGRAPHS = {"div", "p", "section", "article", "figure", "figcaption", "header", "footer"}
WRAPS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "del": "~~", "s": "~~", "sup": "^", "sub": "~"}


class _Writer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict, list[str]]] = [("", {}, [])]
        self.lists: list[list] = []

    @property
    def out(self) -> list[str]:
        return self.open[-1][2]

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "img":
            title = f' "{a["title"]}"' if a.get("title") else ""
            self.out.append(f"![{a.get('alt', '')}]({a.get('src', '')}{title})")
        else:
            if tag in ("ul", "ol"):
                self.lists.append([tag, 0])
            self.open.append((tag, a, []))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in ("br", "hr", "img"):
            self.handle_endtag(tag)

    def handle_data(self, data):
        inside = {t for t, _, _ in self.open}
        if inside & {"table", "ul", "ol", "tr"} and not data.strip() and not inside & {"td", "th", "li", "caption"}:
            return
        if not data.strip() and "pre" not in inside and (not self.out or self.out[-1].endswith("\n")):
            return  # between blocks
        self.out.append(data if "pre" in inside else re.sub(r"\s+", " ", data))

    def handle_endtag(self, tag):
        if tag not in {t for t, _, _ in self.open}:
            return
        while True:
            name, attrs, parts = self.open.pop()
            self.out.append(self._written(name, attrs, "".join(parts)))
            if name == tag:
                return

    def _written(self, tag: str, attrs: dict, text: str) -> str:
        bare = text.strip()
        if tag in WRAPS:
            before, after = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
            if tag in ("sup", "sub"):
                return f"{WRAPS[tag]}{text}{WRAPS[tag]}" if text else ""
            return f"{before}{WRAPS[tag]}{bare}{WRAPS[tag]}{after}" if bare else text
        if re.fullmatch(r"h[1-6]", tag):
            return f"\n\n{'#' * int(tag[1])} {' '.join(bare.split())}\n\n" if bare else ""
        if tag in PARAGRAPHS:
            return f"\n\n{bare}\n\n" if bare else ""
        if tag == "a":
            return f"[{bare}]({attrs['href']})" if bare and attrs.get("href") else text
        if tag == "blockquote":
            return "\n\n" + "\n".join(f"> {line}".rstrip() for line in bare.split("\n")) + "\n\n" if bare else ""
        if tag == "pre":
            return f"\n\n```\n{text.strip(chr(10))}\n```\n\n" if bare else ""
        if tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            mark = f"{kind[1]}. " if kind[0] == "ol" else "* "
            return mark + bare.replace("\n", "\n" + " " * len(mark)) + "\n"
        if tag in ("ul", "ol"):
            self.lists.pop()
            return f"\n\n{text.rstrip()}\n\n" if not self.lists else f"\n{text.rstrip()}"
        if tag in ("td", "th"):
            return " " + " ".join(bare.split()) + " |"
        if tag == "tr":
            row = f"|{text}\n" if text else ""
            return row
        if tag == "table":
            rows = [r for r in text.strip().split("\n") if r.strip()]
            if rows:
                rows.insert(1, "|" + " --- |" * max(1, rows[0].count(" |")))
            return "\n\n" + "\n".join(r.strip() for r in rows) + "\n\n"
        return text

    def result(self) -> str:
        self.close()
        while len(self.open) > 1:
            self.handle_endtag(self.open[-1][0])
        return re.sub(r"\n{3,}", "\n\n", self.out and "".join(self.out) or "").strip("\n")


def to_markdown(text: str | None) -> str | None:
    if text is None:
        return None
    spans = CODE.split(text)  # odd places are code
    held = spans[1::2]
    marked = "".join(s if k % 2 == 0 else f"\ue000{k // 2}\ue001" for k, s in enumerate(spans))
    segments = [s for s in (s.strip() for s in marked.split("\n\n")) if s]
    blocks = [s if BLOCK.search(s) else f"<p>{' '.join(s.split())}</p>" for s in segments]
    writer = _Writer()
    writer.feed("\n\n".join(blocks))
    return re.sub("\ue000(\\d+)\ue001", lambda m: held[int(m[1])] if int(m[1]) < len(held) else m[0], writer.result())


def _converted(texts: list[str | None]) -> list[str | None]:
    return [to_markdown(t) for t in texts]


_convert = by_slice(_converted)


def html_to_markdown(text: Column) -> Column:
    return _convert(text)
