"""A query for each operator over the driver's tables, and its DuckDB SQL where that can say it.

`documents` holds few of the artefacts that page rules look for, so most queries first add some to each text by doc_id; the same
expression, in SQL that both engines know, does so on either side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.config import Config
from quire.functions import clean, epub, html, markup, math, pages
from quire.functions.formats import duration, fixed, thousands
from quire.operators import figures, order, stats
from quire.operators import pages as page_ops
from quire.sources import extract

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Artefacts by doc_id, in SQL of both engines.
ARTEFACTS = """concat(text, chr(10), chr(10), case when doc_id % 3 = 0 then cast(doc_id % 2000 as varchar(9)) else 'on page' end, chr(160), chr(10), chr(10),
 'condi-', chr(10), 'tion and hyphe-', chr(10), chr(10), case when doc_id % 2 = 0 then 'nated' else 'Title' end, ' x- y first part,', chr(10), chr(10),
 case when doc_id % 5 < 3 then 'second part' else 'Second part' end, chr(10), chr(10), chr(10), chr(10), '(end)', chr(10), ' ')"""
TAGS = """concat('<table border=0 style=''a:b'' id=q><td style=''x''>', cast(doc_id as varchar(20)), '</td><th class=u style=''''>h</th></table><div style=''t''>', chr(10),
 '<img alt="a" src="imgs/f', cast(doc_id % 7 as varchar(9)), '.png" />', chr(10), '</div>', case when doc_id % 2 = 0 then '<div><img src="imgs/g.png"> caption</div>' else '' end,
 '![al](figures/p/imgs/h', cast(doc_id % 5 as varchar(9)), '.png)', chr(10), '![logo](https://e.org/l.png)', chr(10), text)"""
FORMULAS = """concat(replace(text, '$', ' '), case when doc_id % 2 = 0 then ' $  x^a^b^c + y_{i}_j $ q^a^b $z^{a}^{b}$' else ' $$ x_a_b^c $$ q_a_b $$k^' end, case when doc_id % 2 = 1 then concat(chr(92), 'pi^2$$') else '' end)"""
NUMBERS = """concat(case when doc_id % 4 = 0 then concat(cast(doc_id % 990 + 1 as varchar(9)), chr(10), cast(doc_id % 990 + case when doc_id % 8 = 0 then 2 else 5 end as varchar(9)), chr(10)) else '' end, text,
 case when doc_id % 6 = 0 then concat(chr(10), ' 07 ', chr(10), 'foot') else '' end)"""
HEADINGS = """concat('Chapter ', cast(doc_id % 30 as varchar(9)), chr(10), '  Section ', cast(doc_id % 9 as varchar(9)), ' ', chr(10), 'Chapter 1,', chr(10), '# Chapter 2', chr(10), '<!-- Chapter 3 -->', chr(10), text, chr(10))"""
PATTERNS = (("Chapter [0-9]+", 1), ("Section [0-9]+", 2))

#: Regular expressions of the SQL side.
S = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
W = r"[\p{L}\p{N}_]"
L = "a-zéèêëàâîïôùûüçœ"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str, artefacts: str = ARTEFACTS) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "source", F.expr(artefacts).alias("text"))


def _each(spark: SparkSession, sf_dir: str, artefacts: str, f) -> DataFrame:
    return _docs(spark, sf_dir, artefacts).select("doc_id", f(F.col("text")).alias("text"))


def _sql(artefacts: str, expression: str) -> str:
    return f"with d as (select doc_id, source, {artefacts} as text from documents) select doc_id, {expression} as text from d"


def re_(text: str, *rules: tuple[str, str]) -> str:
    for pattern, replacement in rules:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return text


NUMBER_LINES = (rf"(?m)^{S}*\p{{Nd}}{{1,3}}{S}*$", "")
HYPHENS = ((rf"({W})-\n({W})", r"\1\2"), (rf"({W})-\n\n([{L}])", r"\1\2"))
INLINE = (rf"({W})- ({W})", r"\1\2")
PARAGRAPHS = (rf"([{L},])\n\n(\(|[{L}\p{{Nd}}])", r"\1 \2")
BLANKS = (r"\n{3,}", "\n\n".replace("\n", "' || chr(10) || '"))
STRIP = (rf"\A{S}+|{S}+\z", "")
CLEANED = re_("text", NUMBER_LINES, *HYPHENS, INLINE, PARAGRAPHS, BLANKS, STRIP)
TABLES = ((r"<table\b[^>]*\bstyle=''[^'']*''", '<table align="center" border=1'), (r"<(t[dh])\b[^>]*\bstyle=''[^'']*''>", r"<\1>"))
ONLY_LINK = (rf"<div\b[^>]*>{S}*(!\[\[[^\]]+\]\]){S}*</div>", r"\1")


@query(_sql(ARTEFACTS, re_("text", NUMBER_LINES)))
def strip_page_numbers(spark, sf_dir):
    return _each(spark, sf_dir, ARTEFACTS, clean.remove_page_numbers)


@query(_sql(ARTEFACTS, re_("text", *HYPHENS, INLINE)))
def rejoin_hyphens(spark, sf_dir):
    return _each(spark, sf_dir, ARTEFACTS, lambda t: clean.rejoin_inline_hyphens(clean.rejoin_paragraph_hyphens(clean.rejoin_line_hyphens(t))))


@query(_sql(ARTEFACTS, re_("text", PARAGRAPHS)))
def join_paragraphs(spark, sf_dir):
    return _each(spark, sf_dir, ARTEFACTS, clean.join_paragraphs)


@query(_sql(ARTEFACTS, re_("text", BLANKS)))
def collapse_blanks(spark, sf_dir):
    return _each(spark, sf_dir, ARTEFACTS, clean.collapse_blank_lines)


@query(_sql(ARTEFACTS, CLEANED))
def clean_page(spark, sf_dir):
    return _each(spark, sf_dir, ARTEFACTS, clean.clean_page)


@query()  # a backreference
def collapse_loops(spark, sf_dir):
    return _each(spark, sf_dir, "text", clean.collapse_loops)


_LOOP_UNIT = "source || '-' || lpad(doc_id::varchar, 12, '0') || lang"


@query(f"""with d as (select doc_id, {_LOOP_UNIT} as unit, doc_id % 7 as times, doc_id % 5 as rest, lang from documents)
select doc_id, 'Start: ' || (case when times >= 3 then unit else repeat(unit, times::int) end) || '|' || left(unit, rest::int) || chr(10) || repeat('=', case when doc_id % 3 = 0 then 15 else 44 end) || chr(10) || upper(lang) as text from d""")
def planted_loops(spark, sf_dir):
    """Repeats of known length in every row: none to six times a part, and lines of one character below and above what counts."""
    d, unit = F.col("doc_id"), F.concat("source", F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), "lang")
    rule = F.expr("repeat('=', if(doc_id % 3 = 0, 60, 44))")
    text = F.concat(F.lit("Start: "), F.call_function("repeat", unit, (d % 7).cast("int")), F.lit("|"), F.left(unit, (d % 5).cast("int")), F.lit("\n"), rule, F.lit("\n"), F.upper("lang"))
    return _table(spark, sf_dir, "documents").select("doc_id", clean.collapse_loops(text).alias("text"))


@query(_sql(TAGS, re_("text", *TABLES)))
def strip_table_styles(spark, sf_dir):
    return _each(spark, sf_dir, TAGS, markup.strip_table_styles)


@query(_sql(TAGS, "replace(text, 'src=\"imgs/', 'src=\"figures/p' || doc_id || '/imgs/')"))
def fix_image_paths(spark, sf_dir):
    docs = _docs(spark, sf_dir, TAGS)
    return docs.select("doc_id", markup.fix_image_paths(F.col("text"), F.concat(F.lit("p"), F.col("doc_id").cast("string")), "figures").alias("text"))


@query(_sql(TAGS, re_("text", (r'<img\b[^>]*\bsrc="imgs/([^"]+)"[^>]*/?\s*>', r"![[Vault/Fig/\1]]"), ONLY_LINK)))
def wikilinks_html(spark, sf_dir):
    return _each(spark, sf_dir, TAGS, lambda t: markup.wikilinks_html(t, "Vault\\Fig/"))


_MARKED = re_("text", (r"(!\[.*?\]\()(https?://)", r"\1' || chr(1) || '\2"))
_LINKED = f"regexp_replace({_MARKED}, '!\\[.*?\\]\\((?:[^)' || chr(1) || ']*/)?([^/)' || chr(1) || ']+)\\)', '![[Vault/Fig/\\1]]', 'g')"


@query(_sql(TAGS, f"replace({_LINKED}, chr(1), '')"))
def wikilinks_md(spark, sf_dir):
    return _each(spark, sf_dir, TAGS, lambda t: markup.wikilinks_markdown(t, "Vault/Fig"))


@query(f"""
with d as (select doc_id, {FORMULAS} as text from documents),
t as (select doc_id, unnest(regexp_extract_all(text, '\\$+|[^$]+')) as tok, generate_subscripts(regexp_extract_all(text, '\\$+|[^$]+'), 1) as i from d),
k as (select *, sum((tok = '$')::int) over (partition by doc_id order by i) as kk, sum((tok = '$')::int) over (partition by doc_id) as n,
  lag(tok) over (partition by doc_id order by i) as before, lead(tok) over (partition by doc_id order by i) as behind from t),
m as (select doc_id, i, case when tok not like '$%' and kk % 2 = 1 and kk < n then
  case when before = '$' and behind = '$' then regexp_replace(tok, '\\A{S}+|{S}+\\z', '', 'g') when before = '$' then regexp_replace(tok, '\\A{S}+', '')
  when behind = '$' then regexp_replace(tok, '{S}+\\z', '') else tok end else tok end as tok from k)
select doc_id, string_agg(tok, '' order by i) as text from m group by doc_id""")
def strip_math_spacing(spark, sf_dir):
    return _each(spark, sf_dir, FORMULAS, math.strip_math_spacing)


_BODY = r"(?:\{([^{}]*)\}|([a-zA-Z0-9]+|\\[a-zA-Z]+))"
_SCRIPTS = [(rf"\^{_BODY}\^{_BODY}", r"^{\1\2^\3\4}")] * 10 + [(rf"_{_BODY}_{_BODY}", r"_{\1\2_\3\4}")] * 10


@query(f"""
with d as (select doc_id, {FORMULAS} as text from documents),
p as (select doc_id, unnest(string_split(text, '$')) as piece, generate_subscripts(string_split(text, '$'), 1) - 1 as i from d),
m as (select doc_id, i, case when (doc_id % 2 = 0 and i % 2 = 1) or (doc_id % 2 = 1 and i % 4 = 2) then {re_("piece", *_SCRIPTS)} else piece end as piece from p)
select doc_id, string_agg(piece, '$' order by i) as text from m group by doc_id""")
def fix_double_scripts(spark, sf_dir):
    return _each(spark, sf_dir, FORMULAS, math.fix_double_scripts)


_LINES = "string_split_regex(text, '\\r\\n|[\\n\\r\\x{0b}\\x{0c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]')"
_NUMBERED = f"""
with d as (select doc_id, {NUMBERS} as text from documents),
l as (select doc_id, text, unnest({_LINES}) as line, generate_subscripts({_LINES}, 1) as i, len({_LINES}) as n from d),
c as (select * replace (case when line = '' and i = n then null else line end as line), n - (last_value(line) over (partition by doc_id order by i rows between unbounded preceding and unbounded following) = '')::int as m from l),
f as (select *, case when line is not null and (i <= 5 or i > m - 5) then nullif(regexp_extract(line, '\\A{S}*(\\p{{Nd}}{{1,3}}){S}*\\z', 1), '') end as num from c),
g as (select doc_id, any_value(text) as whole, list(num::int order by i) filter (where num is not null) as nums, string_agg(line, chr(10) order by i) filter (where num is null and line is not null) as rest from f group by doc_id),
r as (select doc_id, case when nums is null then null when nums[2] = nums[1] + 1 then nums[1] || '-' || nums[2] else nums[1]::varchar end as label, case when nums is null then whole else coalesce(rest, '') end as text from g)
"""


@query(_NUMBERED + "select doc_id, label, text from r")
def page_numbers(spark, sf_dir):
    docs = _docs(spark, sf_dir, NUMBERS).select("doc_id", pages.page_number(F.col("text")).alias("n"))
    return docs.select("doc_id", "n.label", "n.text")


@query(_NUMBERED + "select doc_id, chr(10) || chr(10) || '<!-- Page p' || doc_id || case when label is null then '' else ' (p. ' || label || ')' end || ' -->' || chr(10) || chr(10) || text || chr(10) as block from r")
def page_blocks(spark, sf_dir):
    docs = page_numbers(spark, sf_dir)
    return docs.select("doc_id", pages.page_block(F.concat(F.lit("p"), F.col("doc_id").cast("string")), F.col("text"), F.col("label")).alias("block"))


@query(_NUMBERED + "select doc_id, coalesce(label, (doc_id + 1)::varchar) as page_label, length(text)::bigint as chars, 'ok' as status from r")
def text_page_parts(spark, sf_dir):
    return page_ops.text_parts(_raw(_docs(spark, sf_dir, NUMBERS), ord=F.col("doc_id") + 1)).select(F.col("doc_id").cast("long"), "page_label", "chars", "status")


@query("select event_id, chr(10) || chr(10) || '<!-- Page ' || user_id || ' — ERROR: ' || event_type || ' -->' || chr(10) as block from events")
def error_blocks(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", pages.error_block(F.col("user_id").cast("string"), F.col("event_type")).alias("block"))


def _head(line: str) -> str:
    bare = f"regexp_replace({line}, '\\A{S}+|{S}+\\z', '', 'g')"
    cases = " ".join(f"when regexp_matches({bare}, '\\A(?:{p})') then '{'#' * n} ' || {bare}" for p, n in PATTERNS)
    return f"case when {bare} = '' or {bare}[1] = '#' or starts_with({bare}, '<!--') or length({bare}) > 120 or {bare}[-1] in (',', ';', ':') then {line} {cases} else {line} end"


@query(f"""with d as (select doc_id, {HEADINGS} as text from documents), l as (select doc_id, {_LINES} as lines from d),
k as (select doc_id, case when lines[-1] = '' then lines[:-2] else lines end as lines from l)
select doc_id, array_to_string(list_transform(lines, lambda x: {_head("x")}), chr(10)) as text from k""")
def header_detection(spark, sf_dir):
    return _each(spark, sf_dir, HEADINGS, lambda t: pages.header_detection(t, list(PATTERNS)))


@query("""with b as (select source, doc_id // 500 as volume, string_agg('<!-- Page ' || case when doc_id % 9 = 0 then 'x y' else 'p' || doc_id end || ' -->', ' ' order by doc_id) as text from documents group by all)
select distinct source, volume::bigint as volume, unnest(regexp_extract_all(text, '<!-- Page ([^\\s]+)', 1)) as page_id from b""")
def done_pages(spark, sf_dir):
    mark = F.expr("concat('<!-- Page ', case when doc_id % 9 = 0 then 'x y' else concat('p', cast(doc_id as string)) end, ' -->')")
    books = _table(spark, sf_dir, "documents").groupBy("source", F.expr("doc_id div 500").alias("volume")).agg(F.listagg(mark, F.lit(" ")).alias("text"))
    return books.select("source", "volume", F.explode(pages.done_pages(F.col("text"))).alias("page_id"))


def _raw(docs: DataFrame, ord=None, doc=None) -> DataFrame:
    return docs.select(
        (F.col("doc_id").cast("string") if doc is None else doc).alias("doc_id"),
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("page_id"),
        (F.col("doc_id") if ord is None else ord).alias("ord"),
        F.col("text").alias("raw_text"),
        F.lit(None).cast("string").alias("error"),
        F.lit(False).alias("no_layout"),
    )


_VOLUME = "source || '-' || (doc_id // 500)"


@query(f"""with b as (select {_VOLUME} as book, doc_id, doc_id % 50 = 7 as failed, text from documents),
p as (select book, doc_id, failed, case when failed then chr(10) || chr(10) || '<!-- Page p' || doc_id || ' — ERROR: timeout -->' || chr(10) else chr(10) || chr(10) || '<!-- Page p' || doc_id || ' -->' || chr(10) || chr(10) || text || chr(10) end as block from b)
select book, '# OCR Book' || chr(10) || chr(10) || '<!-- Generated with text -->' || chr(10) || string_agg(block, '' order by doc_id) as markdown, count(*) as n_pages, count(*) filter (where failed) as n_errors from p group by book""")
def assemble_books(spark, sf_dir):
    """Volumes of 500 documents of a source at most: a book is as long as it is, but a source has no bound."""
    docs = _table(spark, sf_dir, "documents").withColumn("book", F.expr("concat(source, '-', cast(doc_id div 500 as string))"))
    page_id = F.concat(F.lit("p"), F.col("doc_id").cast("string"))
    rows = docs.select(F.col("book").alias("doc_id"), page_id.alias("page_id"), F.col("doc_id").alias("ord"), "text", (F.col("doc_id") % 50 == 7).alias("failed"))
    block = F.when(F.col("failed"), pages.error_block(F.col("page_id"), F.lit("timeout"))).otherwise(pages.page_block(F.col("page_id"), F.col("text"), F.lit(None).cast("string")))
    parts = rows.select("doc_id", "page_id", block.alias("block"), F.when(F.col("failed"), "error").otherwise("ok").alias("status"))
    return page_ops.assemble(rows.select("doc_id", "page_id", "ord"), parts, "text").withColumnRenamed("doc_id", "book")


@query("""select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as transcript, count(*) as turns from conversations group by conv_id""")
def assemble_conversations(spark, sf_dir):
    line = F.expr("listagg(concat(role, ': ', text), chr(10)) within group (order by turn)")
    return _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(line.alias("transcript"), F.count(F.lit(1)).alias("turns"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def resume_anti_join(spark, sf_dir):
    return page_ops.todo(_table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels"), ("doc_id",))


@query("select count(*) as skipped from documents where doc_id in (select doc_id from labels)")
def skipped_semi_join(spark, sf_dir):
    done = page_ops.skipped(_table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels"), ("doc_id",))
    return done.agg(F.count(F.lit(1)).alias("skipped"))


ASKED = ["src3", "src11", "nowhere", "src0"]


@query("""with a as (select unnest(['src3', 'src11', 'nowhere', 'src0']) as folder, unnest([0, 1, 2, 3])::bigint as ord) select a.ord, folder, doc_id from a join documents d on d.source = a.folder""")
def chapter_join(spark, sf_dir):
    return order.requested(_table(spark, sf_dir, "documents").select(F.col("source").alias("folder"), "doc_id"), ASKED).select("ord", "folder", "doc_id")


@query("""with a as (select unnest(['src3', 'src11', 'nowhere', 'src0']) as folder, unnest([0, 1, 2, 3])::bigint as ord) select ord, folder from a where folder not in (select source from documents)""")
def chapters_missing(spark, sf_dir):
    return order.not_found(_table(spark, sf_dir, "documents").select(F.col("source").alias("folder")), ASKED)


def _metrics(spark, sf_dir) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").cast("string").alias("doc_id"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("name"),
        F.col("event_id").alias("ord"),
        F.lit(0.0).alias("t_pre"),
        (F.col("value") * 0.75).alias("t_ocr"),
        (F.col("value") * 0.125).alias("t_post"),
        F.col("value").alias("total"),
        (F.col("event_id") % 3000).alias("chars"),
        (F.col("event_id") % 17 == 0).alias("looped"),
        (F.col("event_id") % 10 == 0).alias("no_layout"),
        failed.alias("error"),
    )


_METRICS = """with m as (select user_id::varchar as doc_id, 'e' || event_id as name, event_id as ord, value * 0.75 as t_ocr, value * 0.125 as t_post, value as total, event_id % 3000 as chars,
 event_id % 17 = 0 as looped, event_id % 10 = 0 as no_layout, event_type = 'error' as error from events)"""


def _exact(t: str, only: str = "") -> str:
    """SQL for the sum of doubles in any order: floors and two integers of 52 bits, put together at the end."""
    k = 2**52
    whole, part = f"floor({t})", f"(({t} - floor({t})) * {k}.0::double)"
    a, h, b = (f"sum({x}::hugeint) {only}" for x in (whole, f"floor({part})", f"floor(({part} - floor({part})) * {k}.0::double)"))
    h = f"({h} + {b} // {k})"
    return f"(({a} + {h} // {k})::double + (({h} % {k})::double + ({b} % {k})::double / {k}.0::double) / {k}.0::double)"


_DONE = "filter (where not error)"
_STATS = f"""count(*) filter (where not error) as done, count(*) filter (where error) as errors, count(*) filter (where not error and looped) as loop_stops, count(*) filter (where not error and no_layout) as fallbacks,
 coalesce(sum(chars) filter (where not error), 0)::bigint as total_chars, coalesce({_exact("total", _DONE)} / count(*) {_DONE}, 0) as avg_time, coalesce(sum(chars) filter (where not error) // nullif(count(*) filter (where not error), 0), 0)::bigint as avg_chars"""


@query(f"{_METRICS} select doc_id, {_STATS} from m group by doc_id")
def run_stats(spark, sf_dir):
    return stats.run_stats(_metrics(spark, sf_dir), "doc_id")


@query(f"{_METRICS} select doc_id, {_STATS} from m group by rollup (doc_id)")
def stats_by_document(spark, sf_dir):
    from quire.plans.runs import by_document

    return by_document(_metrics(spark, sf_dir))


@query(f"""{_METRICS}, s as (select unnest(['t_ocr', 't_post', 'total']) as step, unnest([t_ocr, t_post, total]) as t, total as whole from m where not error)
select step, {_exact("t")} / count(*) as avg, min(t) as min, max(t) as max, {_exact("t")} as sum, 100 * {_exact("t")} / {_exact("whole")} as percent from s group by step""")
def step_breakdown(spark, sf_dir):
    return stats.step_breakdown(_metrics(spark, sf_dir))


@query(f"{_METRICS}, s as (select doc_id, {_STATS} from m group by doc_id) select doc_id, case when avg_time <> 0 and 200 - done - 5 - errors > 0 then avg_time * (200 - done - 5 - errors) end as eta_s from s")
def eta(spark, sf_dir):
    return stats.with_eta(run_stats(spark, sf_dir), F.lit(200), F.lit(5)).select("doc_id", "eta_s")


@query("select event_id, case when value < 60 then printf('%.0fs', value) else printf('%.1f min', value / 60) end as shown, printf('%.0fs', event_id % 60 + 0.5) as half, printf('%.1f min', (event_id % 400 * 15)::double / 60) as quarters from events")
def durations(spark, sf_dir):
    """Times as the report writes them, many of them on a tie."""
    e = _table(spark, sf_dir, "events")
    quarters = F.concat(fixed((F.col("event_id") % 400 * 15).cast("double") / 60, 1), F.lit(" min"))
    return e.select("event_id", duration(F.col("value")).alias("shown"), duration(F.col("event_id") % 60 + F.lit(0.5)).alias("half"), quarters.alias("quarters"))


@query(f"{_METRICS} select name from m where not error and no_layout")
def fallback_pages(spark, sf_dir):
    return stats.fallback_pages(_metrics(spark, sf_dir))


@query(f"""{_METRICS} select ord, case when error then '| ' || name || ' | — | — | — | ERROR |  |' else '| ' || name || ' | ' || printf('%.2fs', t_ocr) || ' | ' || printf('%.3fs', t_post) || ' | ' || printf('%.2fs', total) || ' | ' || format('{{:,}}', chars) || ' | ' || case when no_layout then 'fallback' else '' end || ' |' end as line from m""")
def report_rows(spark, sf_dir):
    return stats.detail_rows(_metrics(spark, sf_dir))


def _cells(step: str, wide: int, less: int) -> str:
    numbers = " || ' | ' || ".join([f"printf('%.{wide}fs', {x})" for x in (f"{_exact(step)} / count(*)", f"min({step})", f"max({step})")] + [f"printf('%.{less}fs', {_exact(step)})"])
    return f"'| {stats.STEP_LABELS[step]} | ' || {numbers} || ' | ' || printf('%.1f%%', 100 * {_exact(step)} / {_exact('total')}) || ' |'"


def _quoted(lines: list[str]) -> list[str]:
    return [f"'{x}'" for x in lines]


_VALUES = [
    "12000", "count(*)", "5", "(select count(*) from m where error)", "count(*) filter (where no_layout)", "'1.0s'", "'1.2 min'",
    "format('{:,}', sum(chars)::bigint)", "format('{:,}', (sum(chars) // count(*))::bigint)",
]
_REPORT = [
    "'# Run Report'", "''", "'**Method** : text  '", "''", *_quoted(stats.SUMMARY), *[f"'| {k} | ' || {v} || ' |'" for k, v in zip(stats.CELLS, _VALUES, strict=True)], "''",
    *_quoted(stats.BREAKDOWN), _cells("t_ocr", 2, 1), _cells("t_post", 3, 2),
    f"'| {stats.STEP_LABELS['total']} | **' || printf('%.2fs', {_exact('total')} / count(*)) || '** | **' || printf('%.2fs', min(total)) || '** | **' || printf('%.2fs', max(total)) || '** | **' || printf('%.1fs', {_exact('total')}) || '** | — |'", "''",
]
_ROWS = ORACLE_SQL["report_rows"].removeprefix(_METRICS)


def _listed(part: int, lines: list[str]) -> str:
    return f"select {part} as part, unnest(range({len(lines)}))::bigint as ord, unnest([{', '.join(lines)}]) as line"


@query(f"""{_METRICS}, d as ({_ROWS}) {_listed(0, _REPORT)} from m where not error
union all {_listed(1, _quoted(stats.REVIEW))} union all select 2, ord, '- ' || name from m where not error and no_layout union all select 3, 0, ''
union all {_listed(4, _quoted(stats.DETAIL))} union all select 5, ord, line from d union all select 6, 0, ''""")
def run_report(spark, sf_dir):
    return stats.report(_metrics(spark, sf_dir), total=12_000, skipped=5, title="Run Report", facts={"Method": "text"}, load_s=1.0, elapsed_s=75.0)


_NAMES = "case when doc_id % 4 = 0 then 'page_' || doc_id when doc_id % 4 = 1 then doc_id || '-a' when doc_id % 4 = 2 then 'page' || lpad(doc_id::varchar, 6, '0') || 'b' else 'IMG_' || (doc_id // 100) || '_' || (doc_id % 100) end || case when doc_id % 10 = 0 then '.PDF' when doc_id % 10 = 1 then '.epub' when doc_id % 3 = 0 then '.JPG' else '.png' end"


def _files(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("page_"), d)).when(F.col("doc_id") % 4 == 1, F.concat(d, F.lit("-a"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("page"), F.lpad(d, 6, "0"), F.lit("b")))
    name = name.otherwise(F.expr("concat('IMG_', cast(doc_id div 100 as string), '_', cast(doc_id % 100 as string))"))
    end = F.when(F.col("doc_id") % 10 == 0, ".PDF").when(F.col("doc_id") % 10 == 1, ".epub").when(F.col("doc_id") % 3 == 0, ".JPG").otherwise(".png")
    return _table(spark, sf_dir, "documents").select("doc_id", F.concat(name, end).alias("name"))


_ORDERED = f"""with f as (select doc_id, {_NAMES} as name from documents),
k as (select *, list_transform(list_zip(regexp_extract_all(name, '([^0-9]*)([0-9]*)', 1), regexp_extract_all(name, '([^0-9]*)([0-9]*)', 2)), lambda x: {{'s': x[1], 'n': coalesce(try_cast(x[2] as bigint), -1)}}) as key from f)"""


@query(f"{_ORDERED} select doc_id, name, row_number() over (order by key, name) as ord from k")
def natural_order(spark, sf_dir):
    return order.with_position(_files(spark, sf_dir), order.natural_key(F.col("name")), F.col("name"))


@query(f"{_ORDERED} select doc_id, 'scan_' || lpad((6 + row_number() over (order by key, name))::varchar, greatest(3, length((6 + count(*) over ())::varchar))::int, '0') || lower(regexp_extract(name, '\\.[^.]*$')) as new_name from k")
def page_renumber(spark, sf_dir):
    return order.numbered(_files(spark, sf_dir), order.natural_key(F.col("name")), F.col("name"), prefix="scan", start=7).select("doc_id", "new_name")


@query("with f as (select 'img_' || (doc_id // 3) as stem from documents) select stem, count(*) as files from f group by stem having count(*) > 1")
def duplicate_names(spark, sf_dir):
    files = _table(spark, sf_dir, "documents").select(F.expr("concat('img_', cast(doc_id div 3 as string), case when doc_id % 3 = 0 then '.jpg' when doc_id % 3 = 1 then '.png' else '.webp' end)").alias("name"))
    return order.duplicate_stems(files)


@query(f"""{_ORDERED}, c as (select *, case when lower(name) like '%.pdf' then 'pdf' when lower(name) like '%.epub' then 'epub' else 'image' end as kind from k),
r as (select *, row_number() over (partition by kind order by key, name) as k from c)
select kind, count(*) as files, string_agg(name, ' ' order by k) filter (where k <= 5) as preview, 'mixed kinds' as problem from r group by kind""")
def kind_gate(spark, sf_dir):
    return order.kind_gate(_files(spark, sf_dir)).withColumn("preview", F.array_join("preview", " "))


_PAGED = "select source, row_number() over (partition by source order by doc_id) - 1 as k, count(*) over (partition by source) as n_pages, text from documents"


@query("with n as (select source, count(*) as n from documents group by source) select source, n::bigint as n_pages, array_to_string(case when n <= 5 then range(n) else list_transform(range(5), lambda i: i * (n - 1) // 4) end, ',') as looked_at from n")
def sample_pages(spark, sf_dir):
    counts = _table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"))
    return counts.select("source", "n_pages", F.array_join(extract.sample_pages(F.col("n_pages")).cast("array<string>"), ",").alias("looked_at"))


@query(f"""with p as (select doc_id // 40 as book, row_number() over (partition by doc_id // 40 order by doc_id) - 1 as k, count(*) over (partition by doc_id // 40) as n, text from documents),
w as (select book, len(list_filter(string_split_regex(text, '{S}+'), lambda w: w <> '')) as words from p where n <= 5 or k in (0, (n - 1) // 4, 2 * (n - 1) // 4, 3 * (n - 1) // 4, n - 1))
select book::bigint as book, round(avg(words), 4) as avg_words, case when avg(words) >= 20 then 'text' else 'image' end as class from w group by book""")
def classify_docs(spark, sf_dir):
    book = Window.partitionBy("book")  # 40 pages at most
    docs = _table(spark, sf_dir, "documents").withColumn("book", F.expr("doc_id div 40"))
    docs = docs.withColumn("at", F.row_number().over(book.orderBy("doc_id")) - 1).withColumn("n_pages", F.count(F.lit(1)).over(book))
    found = extract.classify(docs, "book")
    return found.withColumn("avg_words", F.round("avg_words", 4))


@query("""with l as (select doc_id, ['paddleocrvl', 'text', 'docling'][doc_id % 3 + 1] as asked, case when quality = 1 then 'text' else 'image' end as class, toxic = 1 as force from labels)
select doc_id, case when force or asked = 'paddleocrvl' or class = 'image' then 'paddleocrvl' when asked = 'docling' then 'text' else asked end as method from l""")
def pdf_method(spark, sf_dir):
    asked = F.when(F.col("doc_id") % 3 == 0, "paddleocrvl").when(F.col("doc_id") % 3 == 1, "text").otherwise("docling")
    return _table(spark, sf_dir, "labels").select("doc_id", extract.resolve_method(asked, F.when(F.col("quality") == 1, "text").otherwise("image"), F.col("toxic") == 1).alias("method"))


EPUB_LINES = """concat(case when doc_id % 3 = 0 then concat('a<svg w="1">', chr(10), '<g/></svg>b<svg><image xlink:href="i.png"/></svg>c', chr(10)) else '' end, '![al](../i/p', cast(doc_id % 5 as varchar(9)), '.png){w=1} [] ![](z.png) [](e) see [[in]] and [plain] [l](u) [r][s] ![[keep]]', chr(10), '`<!-- c -->` x', chr(10), '::: {.x}', chr(10), '> ::: y', chr(10), 'a  b{.c}   d [/] e', chr(92), ', f', chr(92), '! end', chr(92), chr(10), chr(10), chr(10), '# [1.', cast(doc_id % 9 as varchar(9)), '] Popular', chr(10), '<!-- gone -->', chr(10), '[[site]](http://e.org)', chr(10), '## [[2] ][LLMs ]', chr(10), text)"""


_STEP = re_("x", (rf"{S}*\{{[^{{}}]+\}}", ""))
_STEP = f"replace({_STEP}, '[/]', '/')"
_STEP = re_(_STEP, (r"\[\[([^\]]+)\]\]\(([^)]+)\)", r"[\1](\2)"), (r"\\([,;.!?])", r"\1"), (r"\\\z", ""), ("  +", " "), (rf"{S}+\z", ""))


@query(f"""with d as (select doc_id, {EPUB_LINES} as text from documents), l as (select doc_id, {_LINES} as lines from d),
k as (select doc_id, list_filter(case when lines[-1] = '' then lines[:-2] else lines end, lambda x: not regexp_matches(x, '\\A{S}*(?:>{S}*)?:{{3,}}')) as lines from l)
select doc_id, array_to_string(list_transform(lines, lambda x: {_STEP}), chr(10)) as text from k""")
def epub_line_steps(spark, sf_dir):
    """The steps of the EPUB clean-up that need no lookaround."""
    from quire.functions.regex import chain, split_lines

    def run(text):
        lines = F.filter(split_lines(text), lambda line: ~line.rlike(epub.FENCE))
        step = lambda line: chain(F.replace(chain(line, [epub.ATTRIBUTES]), F.lit("[/]"), F.lit("/")), [epub.DOUBLED_LINK, *epub.ESCAPES, *epub.SPACES])
        return F.array_join(F.transform(lines, step), "\n")

    return _each(spark, sf_dir, EPUB_LINES, run)


def _put(text: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        text = f"replace({text}, {a}, {b})"
    return text


# marks stand for brackets that a lookaround spares: 2 for one behind an exclamation mark, 3 for what ends a link's text, 4 for what ends a reference's
_CELL = _put(re_("x", (r"!\[([^\]]*)\]\((?:[^()]*/)?([^/()]+)\)", r"![\1](figures/\2)")), ("'[/]'", "'/'"))
_CELL = _put(re_(_CELL, (rf"{S}*\{{[^{{}}]+\}}", "")), ("'![]'", "'!' || chr(2)"), ("'[]('", "chr(3) || '('"), ("'[]'", "''"), ("'!' || chr(2)", "'![]'"), ("chr(3) || '('", "'[]('"))
_CELL = re_(_CELL, (rf"\A({S}*#{{1,6}}{S}*)\[\[?{S}*(\p{{Nd}}+(?:\.\p{{Nd}}+)*){S}*\]?{S}*\](?:\[{S}*([^\]]*?){S}*\])?", r"\1\2 \3"))
_CELL = _put(_CELL, ("'!['", "'!' || chr(2)"), ("']]('", "chr(3) || '('"))
_CELL = _put(re_(_CELL, (r"\[\[([^\]\x03]+)\]\]", r"\1")), ("chr(3) || '('", "']]('"))
_CELL = _put(re_(_CELL, (r"\[\[([^\]]+)\]\]\(([^)]+)\)", r"[\1](\2)")), ("']('", "chr(3) || '('"), ("']['", "chr(4) || '['"))
_CELL = _put(re_(_CELL, (r"\[([^\]\x03\x04]+)\]", r"\1")), ("chr(2)", "'['"), ("chr(3)", "']'"), ("chr(4)", "']'"))
_CELL = re_(_CELL, (r"\\([,;.!?])", r"\1"), (r"\\\z", ""))
_SVGS = "regexp_replace(regexp_replace(text, '<svg><image xlink:href=[^>]*></svg>', '', 'g'), '<svg\\b.*?</svg>', chr(10) || chr(10) || '![](figures/inline_svg_001.svg)' || chr(10) || chr(10), 's')"
_EPUB = f"""with w as (select doc_id, {EPUB_LINES} as raw from documents), d as (select doc_id, raw, {_SVGS.replace("(text,", "(raw,")} as text from w), l as (select doc_id, raw, {_LINES} as lines from d),
k as (select doc_id, raw, list_filter(case when lines[-1] = '' then lines[:-2] else lines end, lambda x: not regexp_matches(x, '\\A{S}*(?:>{S}*)?:{{3,}}')) as lines from l),
c as (select doc_id, raw, list_filter(list_transform(lines, lambda x: {_CELL}), lambda x: not regexp_matches(x, '\\A{S}*(?:<!--.*?-->|`<!--.*?-->`)')) as lines from k),
t as (select doc_id, raw, list_transform(lines, lambda x: {re_("x", ("  +", " "), (rf"{S}+" + r"\z", ""))}) as lines from c),
b as (select doc_id, raw, array_to_string(list_filter(lines, lambda x, i: x <> '' or (i > 1 and lines[i - 1] <> '')), chr(10)) as text from t),
e as (select doc_id, raw, {re_("text", BLANKS, STRIP)} as text from b)"""


@query(_EPUB + " select doc_id, text from e")
def epub_clean(spark, sf_dir):
    return _each(spark, sf_dir, EPUB_LINES, epub.clean_markdown)


@query("""with r as (select doc_id, case when doc_id % 3 = 0 then 'OEBPS/img/' || doc_id || '.png' when doc_id % 3 = 1 then 'img' || chr(92) || doc_id || '.png' else 'x/y' || doc_id || '.gif' end as src from documents)
select doc_id, '![a](figures/' || case when doc_id % 3 = 0 then 'saved' || doc_id || '.png' when doc_id % 3 = 1 then 'norm.png' else 'y' || doc_id || '.gif' end || ') z' as text from r""")
def epub_image_refs(spark, sf_dir):
    source = F.expr("case when doc_id % 3 = 0 then concat('OEBPS/img/', cast(doc_id as string), '.png') when doc_id % 3 = 1 then concat('img', chr(92), cast(doc_id as string), '.png') else concat('x/y', cast(doc_id as string), '.gif') end")
    names = F.create_map(F.expr("concat('OEBPS/img/', cast(doc_id as string), '.png')"), F.expr("concat('saved', cast(doc_id as string), '.png')"), F.expr("concat('img/', cast(doc_id as string), '.png')"), F.lit("norm.png"))
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", epub.image_refs(F.concat(F.lit("![a]("), source, F.lit(") z")), names).alias("text"))


@query(_EPUB + """ select doc_id, length(raw)::bigint as raw_chars, length(text)::bigint as clean_chars, (length(text) - length(replace(text, chr(10), '')))::bigint as lines, len(regexp_extract_all(text, '!\\[[^\\[]'))::bigint as images from e""")
def epub_metrics(spark, sf_dir):
    docs = _docs(spark, sf_dir, EPUB_LINES).select("doc_id", "text", epub.clean_markdown(F.col("text")).alias("clean"))
    docs = docs.select("doc_id", epub.metrics(F.col("text"), F.col("clean"), F.regexp_count("clean", F.lit(r"!\[[^\[]"))).alias("m")).select("doc_id", "m.*")
    return docs.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("raw_chars", "clean_chars", "lines", "images")])


@query()  # a converter of its own
def html_to_markdown(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", html.html_to_markdown(F.col("html")).alias("markdown"))


BOOK = TAGS.replace('src="imgs/f', 'src="figures/p/imgs/f')
_BOOKED = re_(re_(CLEANED, *TABLES), (r'<img\b[^>]*\bsrc="[^"]*/imgs/([^"]+)"[^>]*/?\s*>', r"![[Files/OCR/\1]]"), ONLY_LINK)


@query(_sql(BOOK, _BOOKED))
def postprocess_file(spark, sf_dir):
    books = _docs(spark, sf_dir, BOOK).select("doc_id", F.col("text").alias("markdown"))
    return page_ops.postprocess_books(books, Config(mode="obsidian")).withColumnRenamed("markdown", "text")


_PIPED = f"replace({re_(CLEANED, *TABLES)}, 'src=\"imgs/', 'src=\"figures/p' || doc_id || '/imgs/')"


@query(_NUMBERED.replace(NUMBERS, NUMBERS.replace(", text,", f", {TAGS},")) + f"select doc_id::varchar as doc_id, label as page_label, {_PIPED} as clean_text, 'ok' as status from r")
def page_pipeline(spark, sf_dir):
    """All steps of a page but the conversion of HTML."""
    raw = _raw(_docs(spark, sf_dir, NUMBERS.replace(", text,", f", {TAGS},")))
    return page_ops.page_parts(raw, Config(keep_html=True)).select("doc_id", "page_label", "clean_text", "status")


@query()
def page_pipeline_markdown(spark, sf_dir):
    """All steps of a page, HTML to Markdown included."""
    return page_ops.page_parts(_raw(_docs(spark, sf_dir, TAGS)), Config())


@query("""with b as (select event_id, ['image', 'text', 'table', 'chart', 'footer'][event_id % 5 + 1] as label, value / 100 as score from events)
select event_id, (label in ('image', 'table', 'chart') and score > 0.5)::bigint as n_figures, case when label in ('image', 'table', 'chart') and score > 0.5 then '<img src="imgs/figure_0.png" />' else '' end as tags from b""")
def figure_boxes(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, ("image", "text", "table", "chart", "footer"))), (F.col("event_id") % 5 + 1).cast("int"))
    box = F.struct(label.alias("label"), (F.col("value") / 100).alias("score"), F.array(F.lit(0.0)).alias("bbox"))
    layout = F.to_json(F.struct(F.struct(F.array(box).alias("boxes")).alias("res")))
    found = _table(spark, sf_dir, "events").select("event_id", figures.figure_boxes(figures.parse_boxes(layout)).alias("boxes"))
    return found.select("event_id", F.size("boxes").cast("long").alias("n_figures"), markup.figure_tags(F.size("boxes")).alias("tags"))


@query("""with f as (select 'p' || doc_id || '/' || (doc_id % 700) || '.png' as path, (doc_id % 700) || '.png' as name, doc_id from documents), e as (select distinct (doc_id % 90) || '.png' as name from labels),
n as (select * from f where doc_id in (select doc_id from labels) and name not in (select name from e)) select name, min(path) as path from n group by name""")
def figure_migration(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    found = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.concat((F.col("doc_id") % 700).cast("string"), F.lit(".png")).alias("name"), d.alias("d"))
    found = found.select("page_id", "name", F.concat(F.lit("p"), "d", F.lit("/"), "name").alias("path"))
    labels = _table(spark, sf_dir, "labels")
    there = labels.select(F.concat((F.col("doc_id") % 90).cast("string"), F.lit(".png")).alias("name"))
    return figures.migration_plan(found, there, labels.select(F.col("doc_id").alias("page_id"))).select("name", "path")


_CLASHING = "case doc_id % 7 when 0 then 'x.png' when 1 then 'x_1.png' when 2 then 'x.png' when 3 then 'y.t.png' when 4 then 'x_2.png' when 5 then 'y.t.png' else 'x_1_1.png' end"


@query(f"""with recursive f as (select doc_id // 50 as book, row_number() over (partition by doc_id // 50 order by doc_id) as k, lpad(doc_id::varchar, 9, '0') as path, {_CLASHING} as name from documents),
r as (select distinct book, 0::bigint as k, '' as path, []::varchar[] as used from f
 union all select f.book, f.k, f.path, list_append(r.used, case when not list_contains(r.used, f.name) then f.name
  else list_filter(list_transform(range(1, len(r.used) + 2), lambda n: f.name[:-5] || '_' || n || '.png'), lambda c: not list_contains(r.used, c))[1] end) from r join f on f.book = r.book and f.k = r.k + 1)
select path, used[-1] as saved from r where k > 0""")
def collision_names(spark, sf_dir):
    """Files whose names clash with one another and with numbered ones, 50 a book."""
    d = _table(spark, sf_dir, "documents").select(F.expr("doc_id div 50").alias("doc_id"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.expr(_CLASHING).alias("name"))
    return figures.collision_names(d).select("path", "saved")


@query("select event_id, case when event_id % 3 = 0 then '<fcel>' || event_type || '<nl>' else '' end as text from events")
def table_recovery(spark, sf_dir):
    message = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("bad otsl: <fcel>"), "event_type", F.lit("<nl>"))).otherwise(F.col("event_type"))
    return _table(spark, sf_dir, "events").select("event_id", markup.recovered_table(message).alias("text"))


@query("select doc_id, 'book_p' || lpad(doc_id::varchar, greatest(3, length(doc_id::varchar))::int, '0') as page_id, format('{:,}', n_chars) as shown from documents")
def pdf_page_ids(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", pages.pdf_page_id(F.lit("book"), F.col("doc_id")).alias("page_id"), thousands(F.col("n_chars")).alias("shown"))


@query(_NUMBERED.replace(NUMBERS, "text") + f"select doc_id::varchar as doc_id, 'p' || doc_id as page_id, length({re_(CLEANED, *TABLES)})::bigint as chars, 'ok' as status from r")
def stream_ingest(spark, sf_dir):
    """documents as a stream of page files: parts as the batches leave them."""
    from quire.operators.keep import scratch
    from quire.sources import files
    from quire.streaming import ingest

    folder = scratch(spark, "stream")
    raw = _raw(_docs(spark, sf_dir, "text"), ord=F.col("doc_id").cast("int"))
    raw = raw.select("doc_id", "page_id", "ord", F.lit("s").alias("source"), F.lit("text").alias("method"), "raw_text", F.lit(0.5).alias("t_ocr"), "error", "no_layout")
    raw.write.parquet(f"{folder}/in")
    ingest.write_parts(ingest.page_stream(spark, f"{folder}/in"), Config(keep_html=True), f"{folder}/parts", f"{folder}/state").awaitTermination()
    return files.read_parts(spark, f"{folder}/parts").select("doc_id", "page_id", "chars", "status")


@query(ORACLE_SQL["assemble_books"])
def stream_books(spark, sf_dir):
    """assemble_books from a stream of pages that come in any order, in several batches."""
    from quire.operators.keep import scratch
    from quire.streaming import assembly

    folder = scratch(spark, "books")
    docs = _table(spark, sf_dir, "documents").withColumn("failed", F.col("doc_id") % 50 == 7)
    page_id = F.concat(F.lit("p"), F.col("doc_id").cast("string"))
    block = F.when(F.col("failed"), pages.error_block(page_id, F.lit("timeout"))).otherwise(pages.page_block(page_id, F.col("text"), F.lit(None).cast("string")))
    rows = docs.select(F.expr("concat(source, '-', cast(doc_id div 500 as string))").alias("doc_id"), page_id.alias("page_id"), F.col("doc_id").alias("ord"), block.alias("block"), F.when(F.col("failed"), "error").otherwise("ok").alias("status"))
    # a book has 500 pages at most, or 999 about 0, whose places follow from their numbers: only these are counted, and blocks go straight to their files
    rows = rows.withColumn("place", (F.col("ord") % 500 + 499).cast("int")).join(F.broadcast(rows.groupBy("doc_id").agg(F.count_distinct("ord").alias("n_pages"))), "doc_id")
    rows.repartition(4, F.xxhash64("page_id")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    assembly.write_books(stream, "text", f"{folder}/out", f"{folder}/state").awaitTermination()
    return assembly.read_books(spark, f"{folder}/out").withColumnRenamed("doc_id", "book")


@query("""select (doc_id // 100)::varchar as file, row_number() over (partition by doc_id // 100 order by doc_id) as page, count(*) over (partition by doc_id // 100) as n_pages, md5(replace(coalesce(text, ''), chr(12), ' ')) as text_md5 from documents""")
def paged_files(spark, sf_dir):
    """documents written as files of 100 pages, and read as pages again by the tasks that open the files."""
    from quire.operators.keep import scratch
    from quire.sources import extract, filesink, paged

    folder = scratch(spark, "paged")
    rows = _table(spark, sf_dir, "documents").select(F.expr("doc_id div 100").alias("file"), "doc_id", F.translate(F.coalesce("text", F.lit("")), "\f", " ").alias("text"))
    text = rows.groupBy("file").agg(F.expr("listagg(text, '\f') within group (order by doc_id)").alias("text"))
    filesink.write_files(text.select(F.concat(F.col("file").cast("string"), F.lit(".pages")).alias("name"), F.encode("text", "utf-8").alias("content")), folder)
    found = paged.read_files(spark, folder, extract.PlainText, "native", suffix=".pages", rangeBytes=1 << 20)
    return found.select(F.regexp_extract("path", r"([0-9]+)\.pages\z", 1).alias("file"), F.col("page").cast("long").alias("page"), F.col("n_pages").cast("long").alias("n_pages"), F.md5("text").alias("text_md5"))


@query("""select doc_id, case doc_id % 5 when 0 then 'image' when 1 then 'chart' when 3 then 'table' when 4 then null else '' end as labels,
 case when doc_id % 5 in (0, 1, 3) then doc_id + 0.5 end::double as x from documents""")
def layout_results(spark, sf_dir):
    """Figures of layout results as they come: plain, with more fields, without boxes, as a text within JSON, and no JSON at all."""
    d = F.col("doc_id").cast("string")
    box = lambda label, score, more="": F.concat(F.lit(f'{{"label":"{label}",{more}"score":{score},"bbox":['), d, F.lit(".5,1,2,3]}"))
    plain = F.concat(F.lit('{"res":{"boxes":['), box("image", "0.9"), F.lit(","), box("text", "0.9"), F.lit("]}}"))
    more = F.concat(F.lit('{"page":7,"res":{"own":{"a":[1]},"boxes":['), box("chart", "0.6", '"cls":3,'), F.lit(","), box("chart", "0.5"), F.lit(',{"label":8}]}}'))
    none = F.when(F.col("doc_id") % 2 == 0, '{"res":{}}').otherwise('{"boxes":[1]}')
    text = F.concat(F.lit('{"res":"'), F.replace(F.concat(F.lit('{"boxes":['), box("table", '"0.75"'), F.lit(',{"label":"image"}]}')), F.lit('"'), F.lit('\\"')), F.lit('"}'))
    result = F.when(d.isNull(), None)
    for k, shape in enumerate((plain, more, none, text, F.concat(F.lit('{"res":'), d))):
        result = result.when(F.col("doc_id") % 5 == k, shape)
    found = figures.figure_boxes(figures.parse_boxes(result))
    return _table(spark, sf_dir, "documents").select("doc_id", found.alias("f")).select("doc_id", F.array_join(F.transform("f", lambda b: b["label"]), " ").alias("labels"), F.try_element_at("f", F.lit(1))["bbox"][0].alias("x"))
