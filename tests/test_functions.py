"""Column functions against plain Python, on cases by hand and on random texts."""

import random
import time
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.functions import clean, epub, formats, html, loops, markup, math, pages
from quire.functions.regex import split_lines, strip


def run(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


ALPHABET = ["a", "é", "A", "5", "42", "-", "$", "^", "_", "{", "}", "\n", "\n\n", " ", "\xa0", "\x85", "\x1c", "\r\n", ",", "(", "#", "²", " "]


def texts(seed, n=300, size=30):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, size))) for _ in range(n)]


LOW = "a-zéèêëàâîïôùûüçœ"


def py_clean(t, loops=False):
    """The rules as the survey states them, in Python's own regular expressions."""
    steps = [(re.compile(r"^\s*\d{1,3}\s*$", re.M), ""), (re.compile(r"(\w)-\n(\w)"), r"\1\2"), (re.compile(rf"(\w)-\n\n([{LOW}])"), r"\1\2")]
    if loops:
        steps.append((re.compile(r"(.{15,}?)\1{2,}"), r"\1"))
    steps += [(re.compile(r"(\w)- (\w)"), r"\1\2"), (re.compile(rf"([{LOW},])\n\n(\(|[{LOW}\d])"), r"\1 \2"), (re.compile(r"\n{3,}"), "\n\n")]
    for pattern, new in steps:
        t = pattern.sub(new, t)
    return t.strip()


def test_helpers(spark):
    t = texts(1)
    assert run(spark, strip, t) == [x.strip() for x in t]
    assert run(spark, split_lines, t) == [x.splitlines() for x in t]


def test_clean_page(spark):
    t = texts(2) + ["Some text\n\n42\n\nMore text", "There are 42 items.", "condi-\ntion", "condi-\n\ntion", "condi- tion", "condi-\n\nTitle", "first part,\n\nsecond part", "A\n\n\n\nB", "a-\nb-\nc"]
    assert run(spark, clean.clean_page, t) == [py_clean(x) for x in t]
    assert run(spark, lambda c: clean.clean_page(c, page_numbers=False), ["Text\n\n42\n\nMore"]) == ["Text 42\n\nMore"]  # a sentence goes on with a digit
    assert run(spark, lambda c: clean.clean_page(c, blank_lines=False), ["A\n\n\n\nB"]) == ["A\n\n\n\nB"]


def test_loops(spark):
    r = random.Random(5)
    unit = lambda: "".join(r.choice("ab ") for _ in range(r.randint(5, 20)))
    t = [unit() + (u := unit()) * r.randint(1, 5) + unit() + r.choice(["", "\n"]) + u * 2 for _ in range(200)] + ["x" * 44, "x" * 45, "x" * 46, "", "y\n" + "word and more. " * 4]
    assert run(spark, lambda c: clean.clean_page(c, no_layout=True), t) == [py_clean(x, loops=True) for x in t]
    assert run(spark, lambda c: clean.clean_page(c, no_layout=F.lit(False)), t) == [py_clean(x) for x in t]


LAZY = re.compile(r"(.{15,}?)\1{2,}")


def test_repeats_of_random_lines():
    """100,000 lines of few letters, with repeats planted, next to one another, inside one another and cut off."""
    r = random.Random(8)

    def line():
        kind = r.random()
        if kind < 0.3:
            return "".join(r.choice("ab") for _ in range(r.randint(0, 90)))
        unit = "".join(r.choice("abc é😀") for _ in range(r.randint(1, 24)))
        if kind < 0.5:
            unit = unit[: r.randint(1, 8)] * r.randint(1, 4) + unit
        return "".join(unit * r.randint(0, 5) + unit[: r.randint(0, len(unit))] + r.choice(["", "x", "ab"]) for _ in range(r.randint(1, 3)))

    lines = [line() for _ in range(100_000)]
    some = [LAZY.sub(r"\1", x) for x in lines]
    assert loops.collapse(lines) == some and sum(a != b for a, b in zip(lines, some, strict=True)) > 10_000
    whole = ["\n".join(lines[i : i + 7]) for i in range(0, len(lines), 7)]
    assert loops.collapse(whole) == ["\n".join(some[i : i + 7]) for i in range(0, len(lines), 7)]
    assert loops.collapse([]) == [] and loops.collapse(["", "\n", "x" * 45]) == ["", "\n", "x" * 15]


def test_repeats_of_long_lines_take_no_time():
    """Lines on which the pattern would take minutes."""
    began = time.perf_counter()
    thue = "a"
    while len(thue) < 60_000:
        thue += thue.translate(str.maketrans("ab", "ba"))
    r = random.Random(2)
    noise = "".join(r.choice("abcdefgh ") for _ in range(300_000))
    unit = noise[:5000]
    assert loops.collapse([thue, noise, noise + unit * 3 + "x", "ab" * 100_000]) == [thue, noise, noise + unit + "x", "ab" * 8]
    assert time.perf_counter() - began < 60


def test_loops_reach_python_only_where_they_must(spark):
    df = spark.createDataFrame([("z" * 60, True), ("z" * 60, False), (None, True), ("short", True)], "t string, only boolean")
    assert [x[0] for x in df.select(loops.collapse_loops(F.col("t"), F.col("only"))).collect()] == ["z" * 15, "z" * 60, None, "short"]


def py_math_spacing(t):
    out, tokens = [], re.findall(r"\$+|[^$]+", t)
    lone = [i for i, x in enumerate(tokens) if x == "$"]
    pairs = list(zip(lone[::2], lone[1::2], strict=False))
    for i, x in enumerate(tokens):
        for a, b in pairs:
            if i == a + 1 == b - 1:
                x = x.strip()
            elif i == a + 1 < b:
                x = x.lstrip()
            elif a < i == b - 1:
                x = x.rstrip()
        out.append(x)
    return "".join(out)


def test_math(spark):
    t = [x for x in texts(3, 600) if "\x1c" not in x]
    assert run(spark, math.strip_math_spacing, t) == [py_math_spacing(x) for x in t]
    cases = {"$x^a^b$": "$x^{a^b}$", "$x_a_b$": "$x_{a_b}$", "$x^{a}^b$": "$x^{a^b}$", "$x^a^{b}$": "$x^{a^b}$", "$$x^a^b$$": "$$x^{a^b}$$", "$x^a^b^c$": "$x^{a^{b^c}}$", "x^a^b": "x^a^b", "$x^a$": "$x^a$", r"$x^\pi^2$": r"$x^{\pi^2}$"}
    assert run(spark, math.fix_double_scripts, list(cases)) == list(cases.values())
    assert run(spark, math.strip_math_spacing, ["$  a + b  $", "$$ x + y $$", "$5 and $6", "$ $"]) == ["$a + b$", "$$ x + y $$", "$5 and$6", "$$"]


def py_page_number(t):
    lines = t.splitlines()
    found = [(i, int(m[1])) for i, x in enumerate(lines) if (i < 5 or i >= len(lines) - 5) and (m := re.match(r"^\s*(\d{1,3})\s*$", x))]
    if not found:
        return None, t
    n = [v for _, v in found]
    gone = {i for i, _ in found}
    return f"{n[0]}-{n[1]}" if len(n) > 1 and n[1] == n[0] + 1 else str(n[0]), "\n".join(x for i, x in enumerate(lines) if i not in gone)


def test_page_numbers(spark):
    t = texts(4) + ["42\nSome content here.", "12\n13\nContent", "\n".join([*"abcde", "7", *"fghij"]), " 007 \nx", "٤٢\nx", ""]
    assert [tuple(x) for x in run(spark, pages.page_number, t)] == [py_page_number(x) for x in t]


def test_headers(spark):
    patterns = [(r"^Chapter \d+", 1), (r"^Section \d+", 2)]
    t = ["Chapter 3", "Section 1\n", "Chapter 1,", "Chapter 1;", "Chapter 1:", "# Chapter 1", "<!-- Page 3 -->", "  Chapter 4  \ntext", "Chapter 5" + "x" * 120, "a Chapter 6"]
    assert run(spark, lambda c: pages.header_detection(c, patterns), t) == ["# Chapter 3", "## Section 1", "Chapter 1,", "Chapter 1;", "Chapter 1:", "# Chapter 1", "<!-- Page 3 -->", "# Chapter 4\ntext", "Chapter 5" + "x" * 120, "a Chapter 6"]


def test_blocks(spark):
    one = spark.range(1)
    row = one.select(pages.page_block(F.lit("page_001"), F.lit("Content"), F.lit("42")), pages.page_block(F.lit("p"), F.lit("C"), F.lit(None).cast("string")), pages.error_block(F.lit("page_002"), F.lit("timeout")), pages.pdf_page_id(F.lit("b"), F.lit(7))).first()
    assert list(row) == ["\n\n<!-- Page page_001 (p. 42) -->\n\nContent\n", "\n\n<!-- Page p -->\n\nC\n", "\n\n<!-- Page page_002 — ERROR: timeout -->\n", "b_p007"]
    assert run(spark, pages.done_pages, ["<!-- Page page_001 -->\n<!-- Page page_002 (p. 3) --><!-- Page page_001 -->"]) == [["page_001", "page_002"]]


def test_markup(spark):
    assert run(spark, markup.strip_table_styles, ["<td style='padding:4px'>cell</td>", "<div style='text-align:center'>c</div>", "<table a=b style='x'>"]) == ["<td>cell</td>", "<div style='text-align:center'>c</div>", '<table align="center" border=1>']
    assert run(spark, lambda c: markup.fix_image_paths(c, F.lit("page_003"), "figures"), ['<img src="imgs/fig1.png">']) == ['<img src="figures/page_003/imgs/fig1.png">']
    link = lambda c: markup.wikilinks_html(c, "Vault\\Figures/")
    assert run(spark, link, ['<div class="figure"><img src="imgs/fig1.png" /></div>', '<div><img src="imgs/f.png" /> caption text</div>']) == ["![[Vault/Figures/fig1.png]]", "<div>![[Vault/Figures/f.png]] caption text</div>"]
    assert run(spark, lambda c: markup.wikilinks_markdown(c, "V"), ["![alt text](figures/page_001/imgs/fig1.png)", "![logo](https://example.com/logo.png)"]) == ["![[V/fig1.png]]", "![logo](https://example.com/logo.png)"]
    with pytest.raises(ValueError):
        markup.wikilinks_html(F.lit(""), "")
    assert run(spark, markup.recovered_table, ["bad <fcel>a<nl>", "bad"]) == ["<fcel>a<nl>", ""]
    assert run(spark, lambda c: markup.figure_tags(F.length(c)), ["", "xx"]) == ["", '<img src="imgs/figure_0.png" />\n<img src="imgs/figure_1.png" />']


def test_epub(spark):
    cases = {
        "::: {.x}\n> ::: y\nkept": "kept",
        "![a](../i/x.png){width=1}": "![a](figures/x.png)",
        "## [1.3] Popular": "## 1.3 Popular",
        "# [1 ]LLMs": "# 1 LLMs",
        "# [[1] ][LLMs ]": "# 1 LLMs",
        "see [[text]] and [[t]](u) and [plain] and [l](u)": "see text and [t](u) and plain and [l](u)",
        "a\\, b\\! c\\": "a, b! c",
        "<!-- c -->\n `<!-- c -->`\nx": "x",
        "a\n\n\n\nb  c \n\n": "a\n\nb c",
        "x [] y ![](z)": "x y ![](figures/z)",
        '<svg><image xlink:href="a"/></svg>t': "t",
        "p<svg>\n</svg>q<svg></svg>": "p\n\n![](figures/inline_svg_001.svg)\n\nq\n\n![](figures/inline_svg_002.svg)",
        "a[/]b": "a/b",
    }
    assert run(spark, epub.clean_markdown, list(cases)) == list(cases.values())


def test_html():
    cases = {
        "plain  text": "plain text",
        "x<sup>2</sup> and H<sub>2</sub>O<sup></sup>": "x^2^ and H~2~O",
        "<b>bold</b> <i>it</i> `<b>code</b>`": "**bold** *it* `<b>code</b>`",
        "one\n\ntwo": "one\n\ntwo",
        "<h2>Head</h2>": "## Head",
        "<ul><li>a</li><li>b</li></ul>": "* a\n* b",
        "<table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td>2</td></tr></table>": "| h | i |\n| --- | --- |\n| 1 | 2 |",
        '<img src="s.png" alt="a">': "![a](s.png)",
        '<a href="u">t</a> <span>un</span>wrapped 3 a*b_c': "[t](u) unwrapped 3 a*b_c",
        "": "",
    }
    assert {k: html.to_markdown(k) for k in cases} == cases
    assert html.to_markdown(None) is None
    assert html.to_markdown("<p>open <b>never closed") == "open **never closed**"


def test_formats(spark):
    names = ["a.JPG", "b.tar.gz", ".hidden", "none", "x.PDF"]
    assert run(spark, formats.suffix, names) == [".jpg", ".gz", "", "", ".pdf"]
    assert run(spark, formats.stem, names) == ["a", "b.tar", ".hidden", "none", "x"]
    row = spark.range(1).select(formats.duration(F.lit(59.4)), formats.duration(F.lit(90.0)), formats.thousands(F.lit(1234567)), formats.padded(F.lit(12345), 3)).first()
    assert list(row) == ["59s", "1.5 min", "1,234,567", "12345"]


def test_digit_table():
    assert all(unicodedata.decimal(c) == int(v) for c, v in zip(pages._DIGITS, pages._VALUES, strict=True))


def test_seconds_round_as_python_does(spark):
    r = random.Random(7)
    values = [0.0, -0.0, 0.125, 0.375, 1.005, 2.675, 0.0005, 0.9995, 0.995, 0.005, -0.125, 1e-9, 5e-324, 4503599627370495.5, 1.5e15]
    values += [r.randrange(60_000) / 100 * k for k in (0.125, 0.75, 1) for _ in range(500)] + [r.random() * 10 ** r.randint(-9, 9) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    for digits in (1, 2, 3):
        assert [x[0] for x in df.select(formats.seconds(F.col("v"), digits)).collect()] == [f"{v:.{digits}f}s" for v in values]


def test_report_has_a_row_of_every_page(spark):
    from quire.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    want = []
    for e in spark.read.parquet(f"{sf}/events.parquet").collect():
        i, v = e["event_id"], e["value"]
        ok = f"{v * 0.75:.2f}s | {v * 0.125:.3f}s | {v:.2f}s | {i % 3000:,} | {'fallback' if i % 10 == 0 else ''}"
        want.append((i, f"| e{i} | {'— | — | — | ERROR | ' if e['event_type'] == 'error' else ok} |"))
    assert sorted(map(tuple, QUERIES["report_rows"](spark, sf).collect())) == sorted(want)
