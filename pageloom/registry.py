"""Queries of all operators over the given tables, and the same in SQL.

``documents`` stand for pages: a source is a book, its documents in order of doc_id its
pages. Where raw texts would leave an operator without work, both sides enrich them alike,
by page number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalar, text
from .functions.pystr import SPACES
from .operators import accuracy, chapters, clean, headers, joiner, ocr, ordered, quality, resume, review, running
from .plans import book
from .sources import epub, readers, writers
from .streaming import incremental, progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str, enriched: str | None = None) -> DataFrame:
    """(book_id, page_no, doc_id, text, n_chars), the text as the SQL expression gives it."""
    docs = table(spark, sf_dir, "documents")
    numbers = ordered.numbered(docs.select(F.col("source").alias("book_id"), "doc_id"), [F.col("doc_id")], "page_no")  # without the texts
    texts = docs.select(F.col("source").alias("book_id"), "doc_id", "text", "n_chars")
    cores = spark.sparkContext.defaultParallelism
    if texts.rdd.getNumPartitions() < cores:  # a table of one small file would be one task's work; a large one is not shuffled
        texts = texts.repartition(cores)
    rows = ordered.with_numbers(texts, numbers, "doc_id", "page_no").select("book_id", "page_no", "doc_id", "text", "n_chars")
    return rows.withColumn("text", F.expr(enriched)) if enriched else rows


def defective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with DEFECTS, and in each book a short and an empty page more."""
    books = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id")).distinct()
    more = books.select("book_id", F.explode(F.expr(f"array({', '.join(f'struct({n} as page_no, {t!r} as text)' for n, t in SHORT_PAGES)})")).alias("x")).select("book_id", "x.*")
    return pages(spark, sf_dir, DEFECTS).select("book_id", "page_no", "text").unionByName(more)


# SQL of the enriched pages; the same text serves both engines
NL = "chr(10)"
BREAKS = "regexp_replace(text, '([a-z]{3})([a-z]{3,}) ', concat('\\\\1-', chr(10), '\\\\2 '), 'g')"
BREAKS_SPARK = "regexp_replace(text, '([a-z]{3})([a-z]{3,}) ', concat('$1-', chr(10), '$2 '))"
RUNNING = f"case when page_no % 10 < 4 then concat('# Running ', cast(floor(page_no / 10) as int), {NL}, text) when page_no % 10 = 4 then concat('## ', doc_id, ' Unique', {NL}, text) else text end"
DEFECTS = f"""case page_no % 5 when 0 then concat(text, repeat('■', cast(floor(n_chars / 40) as int))) when 1 then concat(text, repeat(' O0O IlI vvx aaaaaa', 5))
 when 2 then concat(text, ' ((( [[[ \"\"\" ') when 3 then concat(text, repeat('!?', cast(floor(n_chars / 8) as int))) else text end"""
SHORT_PAGES = ((1000000, "Too short a page."), (1000001, ""))
LETTERS = "case when page_no % 2 = 0 then concat(text, repeat(' a b c', cast(floor(n_chars / 2) as int))) else text end"
PARAGRAPHS = f"replace(text, concat('.', {NL}), concat('.', {NL}, {NL}))"
ENDINGS = f"""case when page_no % 10 = 0 then concat('Chapter ', doc_id, {NL}, {NL}, text) when page_no % 10 in (2, 7) then lower(text) when page_no % 10 = 4 then ''
 when page_no % 10 in (1, 6) then concat(text, ' etc.') when page_no % 10 = 8 then concat(text, ' hyph-') else text end"""
REPEATS = "case when page_no % 4 = 0 then concat(text, repeat(substr(text, 1, 20), 12 + cast(floor(n_chars / 20) as int))) else text end"
EDGES = f"concat(case when page_no % 2 = 0 then concat(upper(book_id), {NL}) else '' end, text, case when page_no % 3 = 0 then concat({NL}, 'Printed edition') else '' end)"
BOTH = f"concat(case when page_no % 2 = 0 then concat(upper(book_id), {NL}) else '' end, case when page_no % 10 < 4 then concat('# Running ', cast(floor(page_no / 10) as int), {NL}) else '' end, text)"
SCRAPS = f"""case page_no % 3 when 0 then concat('[{{"text": "', replace(replace(replace(text, '\\\\', ''), '"', ''), {NL}, concat(chr(92), 'n')), '", "category": "Text"}}, {{"text": "short"}}, {{"text": "', replace(replace(text, '"', ''), {NL}, ' '), ' said ', chr(92), '"yes', chr(92), '"", "bb')
 when 1 then concat('not json "text": "', replace(text, '"', ''), '"') else text end"""


def p_sql(enriched: str = "text", more: str = "") -> str:
    enriched = enriched.replace("\\\\", "\\")
    return f"p as (select book_id, page_no, doc_id, {enriched} as text, n_chars from (select source book_id, cast(row_number() over (partition by source order by doc_id) - 1 as int) page_no, doc_id, text, n_chars from documents){more})"


WS = "concat(" + ", ".join(f"chr({ord(c)})" for c in SPACES) + ")"


def strip_sql(x: str) -> str:
    return f"trim({x}, {WS})"


def unwrap_macro(x: str) -> str:
    # runs of two and more line ends as chr(3) per line end, then the single ones, then back
    marked = f"regexp_replace({x}, '\\n\\n', chr(3) || chr(3), 'g')"
    marked = f"regexp_replace({marked}, chr(3) || '\\n', chr(3) || chr(3), 'g')"
    return strip_sql(f"regexp_replace(replace(replace({marked}, chr(10), ' '), chr(3), chr(10)), '  +', ' ', 'g')")


# boundaries and books
CLASSES = f"""
s as (select book_id, page_no, {strip_sql('text')} t, text from p),
b as (select *, lag(t) over w prev, lag(page_no) over w before_page from s window w as (partition by book_id order by page_no)),
c as (select *, right(prev, 200) tail, left(t, 100) head from b),
f as (select *, rtrim(tail, {WS}) tl, regexp_extract(rtrim(tail, {WS}), '(\\S+)$', 1) word from c),
j as (select *,
  regexp_matches(tl, '[.!?;:]["''\\)\\]]*$|[。！？；：」』）】]$') and lower(rtrim(word, '."'')]')) not in ({', '.join("'" + a + "'" for a in joiner.ABBREVIATIONS)}) complete,
  regexp_matches(ltrim(head, {WS}), '^[a-z,;:\\-–—]') goes_on, regexp_matches(tl, '[\\p{{L}}\\p{{N}}_]-$') hyph,
  regexp_matches(t, '(?i)^(chapter|part|section|#{{1,6}}\\s+|\\d+\\.\\s+[A-Z]|[IVXLCDM]+\\.\\s*[A-Z])') marker from f),
d as (select *,
  case when before_page is null then null when prev = '' or t = '' then 'paragraph' when marker then 'section' when complete and goes_on then 'direct' when complete then 'paragraph' when goes_on or hyph then 'direct' else 'paragraph' end decision,
  case when before_page is null then null when prev = '' or t = '' then 'Empty page' when marker then 'New section/chapter detected' when complete and goes_on then 'Lowercase continuation after sentence'
   when complete then 'Complete sentence at page boundary' when goes_on then 'Sentence continues across page' when hyph then 'Hyphenated word across page' else 'Ambiguous boundary, defaulting to paragraph' end reason from j)"""


@query(f"with {p_sql(ENDINGS)}, {CLASSES} select book_id, before_page page_before, page_no page_after, decision, reason from d where before_page is not null")
def page_boundaries(spark, sf_dir):
    return joiner.boundaries(pages(spark, sf_dir, ENDINGS))


@query(f"with {p_sql(ENDINGS)}, {CLASSES} select book_id, count(*) n_boundaries, count_if(decision = 'direct')::bigint n_direct, count_if(decision = 'paragraph')::bigint n_paragraph, count_if(decision = 'section')::bigint n_section from d where before_page is not null group by book_id")
def boundary_counts(spark, sf_dir):
    return joiner.decision_counts(joiner.boundaries(pages(spark, sf_dir, ENDINGS)))


def pieces_sql(markers: bool) -> str:
    mark = "'<!-- page ' || page_no || ' -->'" if markers else "''"
    section = f"chr(10) || chr(10) || {mark} || chr(10) || chr(10)" if markers else "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
    paragraph = f"chr(10) || chr(10) || {mark}" + (" || chr(10)" if markers else "")
    return f"x as (select book_id, page_no, case when before_page is null then t when t = '' then '' when decision = 'direct' then ' ' || {mark} || t when decision = 'paragraph' then {paragraph} || t else {section} || t end piece from d)"


@query(f"with {p_sql(ENDINGS)}, {CLASSES}, {pieces_sql(True)} select * from x")
def joined_pieces(spark, sf_dir):
    return joiner.joined_pages(pages(spark, sf_dir, ENDINGS))


def books_sql(enriched: str, markers: bool) -> str:
    return f"with {p_sql(enriched)}, {CLASSES}, {pieces_sql(markers)}, k as (select book_id, count(*) n_pages, string_agg(piece, '' order by page_no) content from x group by book_id)"


@query(books_sql(ENDINGS, True) + " select book_id, n_pages, cast(length(content) as int) n_chars, md5(content) digest from k")
def book_texts(spark, sf_dir):
    found = joiner.books(pages(spark, sf_dir, ENDINGS))
    return found.select("book_id", "n_pages", F.length("content").alias("n_chars"), F.md5(F.encode("content", "UTF-8")).alias("digest"))


@query(books_sql(ENDINGS, False) + " select book_id, n_pages, cast(length(content) as int) n_chars, md5(content) digest from k")
def book_texts_unmarked(spark, sf_dir):
    found = joiner.books(pages(spark, sf_dir, ENDINGS), markers=False)
    return found.select("book_id", "n_pages", F.length("content").alias("n_chars"), F.md5(F.encode("content", "UTF-8")).alias("digest"))


def without_running_sql(source: str) -> str:
    """CTEs up to ``rr`` (book_id, n_pages, content): the source's books without running headers."""
    ws = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
    header = f"'(?m)^#+{ws}+.+$'"
    plain = lambda x: strip_sql(f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')")
    unquoted = lambda x: strip_sql(f"regexp_replace({x}, '(?m)^>{ws}*', '', 'g')")
    chapter = lambda x: strip_sql(f"regexp_replace({x}, '(?i)\\*?Chapter\\*?{ws}*\\p{{Nd}}+\\*?', '', 'g')")
    guarded = lambda x: f"regexp_replace({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(joiner.ABBREVIATIONS)})\\.', '\\1\\2' || chr(2), 'g')"
    stops = lambda x: f"regexp_replace({guarded(x)}, '([.!?][\"'')\\]]*){ws}+([\"''(\\[]?[A-Z])', '\\1' || chr(1) || '\\2', 'g')"
    parts = lambda x: f"string_split(replace({stops(x)}, chr(2), '.'), chr(1))"
    fresh = f"'^(?:\\*\\*[^*]+\\*\\*{ws}*$|\\*{ws}+|\\p{{Nd}}+\\.{ws}+|>{ws}*[A-Z\"—]|—)'"
    return f"""ra as (select book_id, n_pages, content, regexp_extract_all(content, {header}) hs, regexp_split_to_array(content, {header}) gs from {source}),
 rb as (select book_id, hs, gs, unnest(range(1, len(hs) + 1)) i from ra),
 rc as (select book_id, i, hs[i] h, gs[i + 1] g, {strip_sql("array_to_string(list_transform(range(1, i + 1), lambda j: gs[j] || case when j < i then hs[j] else '' end), '')")} before_,
  {strip_sql("array_to_string(list_transform(range(i, len(hs) + 1), lambda j: case when j > i then hs[j] else '' end || gs[j + 1]), '')")} behind from rb),
 rd as (select *, {plain('left(behind, 300)')} ahead, {unquoted(chapter(plain('right(before_, 300)')))} tail from rc),
 re as (select *, {unquoted('ahead')} head, regexp_matches({strip_sql("string_split(ahead, chr(10))[1]")}, {fresh}) fresh from rd),
 rf as (select *, {parts('head')}[1] first_, {parts('tail')}[-1] last_ from re),
 rg as (select *, before_ = '' leads, case when before_ = '' or behind = '' or head = '' or tail = '' or fresh or regexp_matches(tail, '[.!?"][\\p{{Nd}}⁰¹²³⁴⁵⁶⁷⁸⁹]*$') then false when regexp_matches(head, '^\\p{{Ll}}') then true
  else length(first_) > 20 and not (regexp_matches(first_, '\\p{{Lu}}') and not regexp_matches(first_, '\\p{{Ll}}')) and not contains({stops("last_ || ' ' || first_")}, chr(1)) end breaks, upper({strip_sql(f"regexp_replace(h, '^#+{ws}+', '')")}) name from rf),
 rh as (select *, leads or (not breaks and row_number() over (partition by book_id, name, leads or not breaks order by i) = 1) stays from rg),
 ri as (select book_id, string_agg(case when stays then h else '' end || g, '' order by i) rest from rh group by book_id),
 rr as (select book_id, n_pages, case when content = '' then '' else {strip_sql("regexp_replace(gs[1] || coalesce(rest, ''), '\\n{3,}', chr(10) || chr(10), 'g')")} end content from ra left join ri using (book_id))"""


@query(books_sql(RUNNING, True) + ", " + without_running_sql("k") + " select book_id, n_pages, cast(length(content) as int) n_chars, md5(content) digest from rr")
def books_without_running_headers(spark, sf_dir):
    return book_digests(running.drop_running_headers(joiner.blocks(pages(spark, sf_dir, RUNNING))))


def book_digests(blocks: DataFrame) -> DataFrame:
    """Of books as rows the pages, the length and the digest of the whole text."""
    counted = blocks.groupBy("book_id").agg(F.sum("n_pages").alias("n_pages"))
    found = writers.digests(blocks, ["book_id"], ["block"]).withColumn("n_chars", F.col("n_chars").cast("int"))
    return found.join(counted, "book_id").select("book_id", "n_pages", "n_chars", "digest")


CHAPTERS = (
    books_sql(ENDINGS, False)
    + """,
 l as (select book_id, content, unnest(string_split(content, chr(10))) line, generate_subscripts(string_split(content, chr(10)), 1) i from k),
 m as (select *, regexp_matches(line, '^(#{1,2}\\s+[^\\n]+|(?i:chapter|part)\\s+\\d+[^\\n]*)$') marker, sum(length(line) + 1) over (partition by book_id order by i) - length(line) - 1 at_ from l),
 g as (select *, sum(cast(marker as int)) over (partition by book_id order by i) part from m),
 h as (select book_id, part, min(at_) at_, """
    + strip_sql("ltrim(" + strip_sql("arg_min(line, i)") + ", '#')")
    + " title, "
    + strip_sql("string_agg(line, chr(10) order by i)")
    + """ content from g group by book_id, part),
 good as (select * from h where part > 0 and length(content) > 100),
 first_ as (select book_id, min(at_) at_ from h where part > 0 group by book_id),
 every as (
  select book_id, part, title, content from good
  union all select h.book_id, 0, 'Introduction', h.content from h join first_ f using (book_id) where h.part = 0 and f.at_ > 100 and h.content <> '' and book_id in (select book_id from good)
  union all select book_id, 0, 'Content', content from k where book_id not in (select book_id from good))
 select book_id, cast(row_number() over (partition by book_id order by part) - 1 as int) chapter_no, title, cast(length(content) as int) n_chars, md5(content) digest from every"""
)


@query(CHAPTERS)
def book_chapters(spark, sf_dir):
    found = chapters.of_blocks(joiner.blocks(pages(spark, sf_dir, ENDINGS), markers=False))
    made = writers.digests(found, ["book_id", "chapter_no", "title"], ["block", "part"])
    return made.select("book_id", F.col("chapter_no").cast("int").alias("chapter_no"), "title", F.col("n_chars").cast("int").alias("n_chars"), "digest")


# quality
def q_sql(enriched: str, more: str = "") -> str:
    same = " and ".join(f"coalesce(a[i + {k}], '') = a[i]" for k in range(1, 5))
    runs = f"list_transform(list_filter(range(1, len(a) + 1), lambda i: a[i] not in ('', chr(10)) and (i = 1 or a[i - 1] <> a[i]) and {same}), lambda i: a[i])"
    rn = "(length(text) - length(replace(text, 'rn', ''))) // 2 - cast(not regexp_matches(text, 'x^') and regexp_matches(text, 'rn$') as int) - len(regexp_extract_all(text, 'rn[^\\p{L}\\p{N}_]'))"
    vv = "len(regexp_extract_all(regexp_replace(text, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g'), '(?:^|[^\\p{L}\\p{N}_])vv[\\p{L}\\p{N}_]'))"
    count = "(length(text) - length(replace(text, {0}, '')))"
    ws = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
    no_ws = ws.replace("[", "[^", 1)
    special = ws.replace("[", "[^\\p{L}\\p{N}", 1)
    brackets = ", ".join(f"{count.format(repr(a))} o{k}, {count.format(repr(z))} z{k}" for k, (a, z) in enumerate(quality.BRACKETS))
    found = [
        ("0", "case when size = 0 then 'error' else 'warning' end", "SHORT_PAGE", "short", "short < 50", "'Page has only ' || short || ' characters'", "left(text, 50)"),
        ("1", "'warning'", "GARBAGE_CHARS", "garbage", "size > 0 and garbage / size > 0.01", "'Found ' || garbage || ' suspicious characters (' || printf('%.1f', garbage / size * 100) || '%)'", f"array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[{quality.GARBAGE}]'))), '')"),
        ("2", "'warning'", "REPEATED_CHARS", "len(runs)", "len(runs) > 0", "'Found ' || len(runs) || ' instances of repeated characters'", "'[' || array_to_string(list_transform(runs[:5], lambda c: chr(39) || c || chr(39)), ', ') || ']'"),
    ]
    found += [(str(3 + k), "'info'", "OCR_CONFUSION", f"c{k}", f"c{k} > 3", f"{sql_text(said + ': found ')} || c{k} || ' instances'", "''") for k, (_, said) in enumerate(quality.CONFUSIONS)]
    found += [("7", "'warning'", "SHORT_WORDS", "words", "words > 0 and solid / words < 2.0", "'Average word length is ' || printf('%.1f', solid / words) || ' (expected >2.0)'", "''")]
    found += [(str(8 + k), "'info'", "UNBALANCED_BRACKETS", f"abs(o{k} - z{k})", f"abs(o{k} - z{k}) > 2", f"'Unbalanced {pair}: ' || o{k} || ' open, ' || z{k} || ' close'", "''") for k, pair in enumerate(quality.BRACKETS)]
    found += [(str(11 + k), "'info'", "UNBALANCED_QUOTES", f"q{k}", f"q{k} % 2 <> 0 and q{k} > 2", sql_text(f"Odd number of {shown} characters: ") + f" || q{k}", "''") for k, shown in enumerate(("'\"'", '"\'"'))]
    found += [("13", "'warning'", "HIGH_SPECIAL_CHAR_RATIO", "special", "size > 0 and special / size > 0.15", "'Special character ratio is ' || printf('%.1f', special / size * 100) || '% (threshold: 15.0%)'", "''")]
    union = "\n  union all ".join(f"select book_id, page_no, {seq} seq, {severity} severity, '{kind}' error_type, {n} n, {message} message, {context} context from n where {where}" for seq, severity, kind, n, where, message, context in found)
    return f"""{p_sql(enriched, more)},
 n as (select book_id, page_no, text, length({strip_sql('text')}) short, length(text) size, len(regexp_extract_all(text, '[{quality.GARBAGE}]')) garbage, {runs} runs,
  len(regexp_extract_all(text, '[0O][0O][0O]')) c0, len(regexp_extract_all(text, '[1Il][1Il][1Il]')) c1, {rn} c2, {vv} c3,
  len(regexp_extract_all(text, '{no_ws}+')) words, length(regexp_replace(text, '{ws}', '', 'g')) solid,
  {brackets}, {count.format("'\"'")} q0, {count.format("chr(39)")} q1, len(regexp_extract_all(text, '{special}')) special from (select *, string_split(text, '') a from p)),
 found as ({union})"""


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SHORT = "".join(f" union all select distinct source, {n}, null, {sql_text(t)}, null from documents" for n, t in SHORT_PAGES)


@query(f"with {q_sql(DEFECTS, SHORT)} select book_id, page_no, seq, severity, error_type, cast(n as bigint) n from found")
def page_findings(spark, sf_dir):
    return quality.findings(defective(spark, sf_dir)).select("book_id", "page_no", "seq", "severity", "error_type", "n")


@query(f"with {q_sql(LETTERS)} select book_id, page_no, seq, severity, error_type, cast(n as bigint) n from found where error_type = 'SHORT_WORDS'")
def short_words(spark, sf_dir):
    return quality.findings(pages(spark, sf_dir, LETTERS), kinds=["SHORT_WORDS"]).select("book_id", "page_no", "seq", "severity", "error_type", "n")


REPORT = f"""with {q_sql(DEFECTS, SHORT)}, every as (select book_id, severity from found union all select book_id, 'error' from p where page_no % 7 = 3),
 e as (select book_id, count_if(severity = 'error') n_errors, count_if(severity = 'warning') n_warnings, count_if(severity = 'info') n_infos from every group by book_id)
 select book_id, t.total_pages, t.successful_pages, coalesce(n_errors, 0)::bigint n_errors, coalesce(n_warnings, 0)::bigint n_warnings, coalesce(n_infos, 0)::bigint n_infos, coalesce(n_errors, 0) > 0 has_critical_errors
 from (select book_id, count(*) total_pages, (count(*) - count_if(page_no % 7 = 3))::bigint successful_pages from p group by book_id) t left join e using (book_id)"""


@query(REPORT)
def book_reports(spark, sf_dir):
    return quality.report(defective(spark, sf_dir).withColumn("ok", F.col("page_no") % 7 != 3), success="ok")


@query(f"""with {q_sql(DEFECTS, SHORT)} select book_id, page_no, severity, seq, cast(row_number() over (partition by book_id order by page_no, severity, seq) as int) place from found""")
def findings_in_report_order(spark, sf_dir):
    found = quality.report_lines(quality.findings(defective(spark, sf_dir)))
    return found.select("book_id", "page_no", "severity", "seq", F.row_number().over(Window.partitionBy("book_id").orderBy("page_no", "severity", "seq")).alias("place"))


MARKER = "case severity when 'error' then '[ERROR]' when 'warning' then '[WARN] ' else '[INFO] ' end"
ERROR_REPORTS = f"""with {q_sql(DEFECTS, SHORT)},
 shown as (select *, case when length(context) > 100 then left(context, 100) || '...' else context end c from found),
 lines_ as (select book_id, page_no, severity, seq, 'Page ' || lpad(cast(page_no as varchar), cast(greatest(4, length(cast(page_no as varchar))) as int), ' ') || ' ' || {MARKER} || ' ' || error_type || chr(10) || repeat(' ', 11) || message
  || case when c <> '' then chr(10) || repeat(' ', 11) || 'Context: ' || chr(39) || replace(c, chr(10), chr(92) || 'n') || chr(39) else '' end line from shown),
 per as (select book_id, count_if(severity = 'error') e, count_if(severity = 'warning') w, count_if(severity = 'info') i, string_agg(line, chr(10) || chr(10) order by page_no, severity, seq) issues from lines_ group by book_id),
 t as (select book_id, count(*) n from p group by book_id)
 select book_id, 'OCR Error Report' || chr(10) || '================' || chr(10) || 'Total pages: ' || n || chr(10) || 'Successful: ' || n || chr(10) || 'Errors: ' || coalesce(e, 0) || chr(10) || 'Warnings: ' || coalesce(w, 0) || chr(10)
  || case when issues is null then '' else chr(10) || 'Issues by page:' || chr(10) || repeat('-', 40) || chr(10) || issues || chr(10) end report from t left join per using (book_id)"""


@query(ERROR_REPORTS)
def error_reports(spark, sf_dir):
    return quality.report_text(defective(spark, sf_dir))


# cleaning
WORDS = "select distinct w word from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) w from documents) where length(w) % 2 = 0"


def even_words(spark, sf_dir) -> DataFrame:
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")).distinct()
    return found.where(F.length("word") % 2 == 0)


def mend_sql(source: str, key: str = "book_id, page_no") -> str:
    """CTEs up to ``mended`` (key, text): the source's texts with broken words mended by ``dict``."""
    return f"""mt as (select {key}, string_split(regexp_replace(text, '([\\p{{L}}\\p{{N}}_]+)-\\n([a-z][\\p{{L}}\\p{{N}}_]*)', chr(1) || '\\1' || chr(2) || '\\2' || chr(1), 'g'), chr(1)) parts from {source}),
 mu as (select {key}, unnest(parts) part, generate_subscripts(parts, 1) part_no from mt),
 mended as (select {key}, string_agg(case when not contains(part, chr(2)) then part when d.word is not null then replace(part, chr(2), '') else replace(part, chr(2), '-') end, '' order by part_no) text
  from mu left join dict d on contains(part, chr(2)) and d.word = lower(replace(part, chr(2), '')) group by {key})"""


def cut_sql(source: str, key: str = "book_id, page_no") -> str:
    """CTEs up to ``cut`` (key, text, phrase): the source's texts with the runs of their repeated phrase cut to one; the phrase is the shortest with ten repeats at a sampled start."""
    return f"""cs as (select *, length(text) n, least(50, length(text) // 15) samples from {source} where length(text) >= 160),
 cl as (select *, unnest(range(15, least(100, n // 10))) size from cs),
 ck as (select *, greatest(1, (n - size * 10) // samples) step from cl),
 cc as (select *, unnest(range(0, samples)) * step start_ from ck),
 ch as (select {key}, size, start_, substr(text, start_ + 1, size) phrase from cc where start_ + size * 10 <= n and substr(text, start_ + 1, 1) = substr(text, start_ + 1 + size, 1) and substr(text, start_ + 1, 9 * size) = substr(text, start_ + 1 + size, 9 * size)),
 cg as (select {key}, arg_min(phrase, size * 1000000000 + start_) phrase from ch where length({strip_sql('phrase')}) >= 7 group by {key}),
 cut as (select {key}, case when phrase is null then text else regexp_replace(text, '(?:' || regexp_escape(phrase) || '){{2,}}', replace(phrase, chr(92), chr(92) || chr(92)), 'g') end text, phrase from {source} left join cg using ({key}))"""


def blocks_sql(source: str, name: str, key: str = "book_id, page_no") -> str:
    """A CTE ``name`` (book_id, page_no, text): the texts of a source's blocks (``block_no``) cleaned and joined as paragraphs."""
    return f"{name} as (select book_id, page_no, coalesce(string_agg(t, chr(10) || chr(10) order by block_no) filter (where t <> ''), '') text from (select book_id, page_no, block_no, {unwrap_macro('text')} t from {source}) group by book_id, page_no)"


MENDED = f"with {p_sql(BREAKS)}, dict as ({WORDS}), {mend_sql('p')} select book_id, page_no, {unwrap_macro('text')} cleaned from mended"


@query(MENDED)
def clean_text_blocks(spark, sf_dir):
    return clean.clean_texts(pages(spark, sf_dir, BREAKS_SPARK), even_words(spark, sf_dir)).select("book_id", "page_no", "cleaned")


@query(f"with {p_sql(BREAKS)} select book_id, page_no, " + unwrap_macro("regexp_replace(text, '([\\p{L}\\p{N}_]+)-\\n([a-z][\\p{L}\\p{N}_]*)', '\\1-\\2', 'g')") + " cleaned from p")
def clean_without_dictionary(spark, sf_dir):
    return clean.clean_texts(pages(spark, sf_dir, BREAKS_SPARK)).select("book_id", "page_no", "cleaned")


@query(f"""with {p_sql(BREAKS)}, dict as ({WORDS}), b as (select distinct book_id, page_no, unnest(regexp_extract_all(text, '([\\p{{L}}\\p{{N}}_]+-\\n[a-z][\\p{{L}}\\p{{N}}_]*)', 1)) w from p),
 j as (select book_id, page_no, lower(replace(w, '-' || chr(10), '')) word from b)
 select book_id, page_no, count(distinct word) n_known from j where word in (select word from dict) group by book_id, page_no""")
def known_broken_words(spark, sf_dir):
    """The join that stands in for the broadcast where the dictionary is large."""
    found = clean.known_words(pages(spark, sf_dir, BREAKS_SPARK), even_words(spark, sf_dir), F.array("text"), ["book_id", "page_no"])
    return found.select("book_id", "page_no", F.size("known").cast("bigint").alias("n_known"))


BLOCKS = "transform(split(text, '\\n'), (x, i) -> named_struct('bbox', array(0D), 'category', case i when 0 then 'Page-header' when 1 then 'Page-number' when 2 then null else 'Text' end, 'text', x))"


@query(f"with {p_sql()}, l as (select book_id, page_no, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from p), c as (select book_id, page_no, i, {unwrap_macro('line')} t from l where i > 2) select p.book_id, p.page_no, coalesce(string_agg(t, chr(10) || chr(10) order by i) filter (where t <> ''), '') cleaned from p left join c using (book_id, page_no) group by p.book_id, p.page_no")
def clean_layout_blocks(spark, sf_dir):
    return clean.clean_blocks(pages(spark, sf_dir).withColumn("blocks", F.expr(BLOCKS)), repetition=False).select("book_id", "page_no", "cleaned")


BLOCK = "book_id, page_no, block_no"


@query(f"""with {p_sql(REPEATS)}, dict as ({WORDS}), bl as (select book_id, page_no, unnest(string_split(text, chr(10))) text, generate_subscripts(string_split(text, chr(10)), 1) block_no from p), b as (select * from bl where block_no > 2),
 {cut_sql('b', BLOCK)}, {mend_sql('cut', BLOCK)}, {blocks_sql('mended', 'done')} select p.book_id, p.page_no, coalesce(done.text, '') cleaned from p left join done using (book_id, page_no)""")
def clean_layout_blocks_fully(spark, sf_dir):
    rows = pages(spark, sf_dir, REPEATS).withColumn("blocks", F.expr(BLOCKS))
    return clean.clean_blocks(rows, even_words(spark, sf_dir)).select("book_id", "page_no", "cleaned")


SIMPLE = "regexp_replace(replace(replace(text, '\\\\', ''), '\"', ''), '[\\n\\r\\t]', ' '{g})"
RAW = "case page_no % 4 when 0 then concat('[{\"category\":\"Page-header\",\"text\":\"top\"},{\"category\":\"Text\",\"text\":\"', " + SIMPLE + ", '\"}]') when 1 then '[]' when 2 then '{\"raw_response\": \"x\"}' else null end"


@query(
    f"with {p_sql()}, r as (select *, {SIMPLE.replace('{g}', ', ' + chr(39) + 'g' + chr(39)).replace(chr(92) * 2, chr(92))} simple from p), m as (select book_id, page_no, unnest(regexp_split_to_array(text, '\\n\\n+')) part, generate_subscripts(regexp_split_to_array(text, '\\n\\n+'), 1) i from r where page_no % 4 <> 0), c as (select book_id, page_no, i, {unwrap_macro('part')} t from m) select book_id, page_no, {strip_sql(chr(114) + 'egexp_replace(simple, ' + chr(39) + '  +' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} cleaned from r where page_no % 4 = 0 union all select book_id, page_no, coalesce(string_agg(t, chr(10) || chr(10) order by i) filter (where t <> ''), '') from c group by book_id, page_no"
)
def clean_raw_layouts(spark, sf_dir):
    rows = pages(spark, sf_dir).withColumn("raw", F.expr(RAW.replace("{g}", "").replace("\\n\\r\\t", "\\\\n\\\\r\\\\t")))
    return clean.clean_raw(rows, repetition=False).select("book_id", "page_no", "cleaned")


@query(f"with {p_sql(PARAGRAPHS)}, m as (select book_id, page_no, unnest(regexp_split_to_array(text, '\\n\\n+')) part, generate_subscripts(regexp_split_to_array(text, '\\n\\n+'), 1) i from p), c as (select book_id, page_no, i, {unwrap_macro('part')} t from m) select book_id, page_no, coalesce(string_agg(t, chr(10) || chr(10) order by i) filter (where t <> ''), '') cleaned from c group by book_id, page_no")
def clean_markdown_pages(spark, sf_dir):
    return clean.clean_markdown(pages(spark, sf_dir, PARAGRAPHS)).select("book_id", "page_no", "cleaned")


@query(f"""with {p_sql(SCRAPS)}, m as (select book_id, page_no, contains(text, '"text":') looks, unnest(regexp_extract_all(text, '"text"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)(?:"|\\z)', 1)) x, generate_subscripts(regexp_extract_all(text, '"text"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)(?:"|\\z)', 1), 1) i from p),
 u as (select book_id, page_no, i, replace(replace(replace(x, chr(92) || '"', '"'), chr(92) || 'n', chr(10)), chr(92) || chr(92), chr(92)) x from m where looks)
 select p.book_id, p.page_no, string_agg(u.x, chr(10) || chr(10) order by i) filter (where length(u.x) > 50) salvaged from p left join u using (book_id, page_no) group by p.book_id, p.page_no""")
def salvaged_fragments(spark, sf_dir):
    return pages(spark, sf_dir, SCRAPS.replace("'\\\\'", "'\\\\\\\\'")).select("book_id", "page_no", text.fragments(F.col("text")).alias("salvaged"))


PHRASES = f"with {p_sql(REPEATS)}, {cut_sql('p')} select book_id, page_no, phrase from cut"


@query(PHRASES)
def repeated_phrases(spark, sf_dir):
    return clean.repetitions(pages(spark, sf_dir, REPEATS)).select("book_id", "page_no", "phrase")


@query(f"with {p_sql(REPEATS)}, {cut_sql('p')} select book_id, page_no, cut.text <> p.text changed, cast(length(cut.text) as int) n_chars from cut join p using (book_id, page_no)")
def pages_without_repetition(spark, sf_dir):
    return clean.repetitions(pages(spark, sf_dir, REPEATS)).select("book_id", "page_no", (F.col("cleaned") != F.col("text")).alias("changed"), F.length("cleaned").alias("n_chars"))


# headers
HEADER_LINES = """l as (select book_id, page_no, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 i from p),
 hl as (select book_id, page_no, i, upper(trim(regexp_extract(line, '^#+\\s+(.+)$', 1))) header from l where regexp_matches(line, '^#+\\s+.+$')),
 w as (select *, count(*) over (partition by book_id, header order by page_no range between current row and 19 following) n from hl where length(header) < 50),
 rep as (select distinct book_id, header from w where n >= 3)"""


@query(f"with {p_sql(RUNNING)}, {HEADER_LINES} select * from rep")
def repeated_section_headers(spark, sf_dir):
    return headers.repeated_section_headers(pages(spark, sf_dir, RUNNING))


ONCE = """o as (select hl.*, row_number() over (partition by book_id, header order by page_no, i) k from hl join rep using (book_id, header)),
 once as (select l.book_id, l.page_no, string_agg(l.line, chr(10) order by l.i) text from l left join o on o.book_id = l.book_id and o.page_no = l.page_no and o.i = l.i and o.k > 1 where o.k is null group by l.book_id, l.page_no)"""


@query(f"with {p_sql(RUNNING)}, {HEADER_LINES}, {ONCE} select book_id, page_no, text from once")
def pages_with_headers_once(spark, sf_dir):
    rows = pages(spark, sf_dir, RUNNING)
    return headers.drop_repeated_section_headers(rows, headers.repeated_section_headers(rows)).select("book_id", "page_no", "text")


def edges_sql(source: str) -> str:
    return f"""ends as (select book_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') a from {source}),
 sides as (select book_id, 'header' side, a[1] phrase from ends where len(a) > 0 union all select book_id, 'footer', a[-1] from ends where len(a) > 0),
 rep_edges as (select book_id, side, phrase, count(*) n from sides where length(phrase) < 80 group by all having count(*) >= 10)"""


@query(f"with {p_sql(EDGES)}, {edges_sql('p')} select * from rep_edges")
def repeated_edges(spark, sf_dir):
    return headers.repeated_edges(pages(spark, sf_dir, EDGES))


def stripped_sql(source: str) -> str:
    return f"""sets as (select book_id, list(phrase) filter (where side = 'header') hs, list(phrase) filter (where side = 'footer') fs from rep_edges group by book_id),
 ln as (select t.book_id, t.page_no, t.text, coalesce(hs, []) hs, coalesce(fs, []) fs, string_split({strip_sql('t.text')}, chr(10)) a, sets.book_id is not null has from {source} t left join sets using (book_id)),
 cut1 as (select *, coalesce(list_position(list_transform(a, lambda x: not list_contains(hs, {strip_sql('x')})), true), 0) k from ln),
 cut2 as (select *, case when k = 0 then [] else a[k:] end b from cut1),
 cut3 as (select *, coalesce(list_position(list_transform(list_reverse(b), lambda x: not list_contains(fs, {strip_sql('x')})), true), 0) m from cut2),
 stripped as (select book_id, page_no, case when not has or {strip_sql('text')} = '' then text else {strip_sql("array_to_string(case when m = 0 then [] else b[:len(b) - m + 1] end, chr(10))")} end text from cut3)"""


@query(f"with {p_sql(EDGES)}, {edges_sql('p')}, {stripped_sql('p')} select book_id, page_no, text from stripped")
def pages_without_edges(spark, sf_dir):
    rows = pages(spark, sf_dir, EDGES)
    return headers.drop_edges(rows, headers.repeated_edges(rows)).select("book_id", "page_no", "text")


@query(f"with {p_sql(BOTH)}, {HEADER_LINES}, {ONCE}, {edges_sql('once')}, {stripped_sql('once')} select book_id, page_no, text from stripped")
def clean_book_pages(spark, sf_dir):
    return headers.clean_book_pages(pages(spark, sf_dir, BOTH)).select("book_id", "page_no", "text")


# scalar rules
@query("select event_id, left(replace(trim(regexp_replace(concat(' ', event_type, '/', props, ' é: x_', event_id, ' '), '[^\\p{L}\\p{N} _\\-]', '_', 'g'), " + WS + "), ' ', '_'), 100) file_name from events")
def safe_filenames(spark, sf_dir):
    title = F.concat(F.lit(" "), "event_type", F.lit("/"), "props", F.lit(" é: x_"), "event_id", F.lit(" "))
    return table(spark, sf_dir, "events").select("event_id", scalar.safe_filename(title).alias("file_name"))


@query("select event_id, replace(replace(replace(replace(replace(concat(props, ' <a> & ''b'''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&apos;') escaped from events")
def escaped_xml(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.escape_xml(F.concat("props", F.lit(" <a> & 'b'"))).alias("escaped"))


@query("""with h as (select page_id, concat(html, '<br><hr class="a"><img src="b"> & &amp; &#12; &x', chr(7)) x from pages),
 a as (select page_id, regexp_replace(regexp_replace(x, '<(br|hr|img)([^/>]*)>', '<\\1\\2/>', 'g'), '<img([^>]*[^/>])>', '<img\\1/>', 'g') x from h),
 b as (select page_id, replace(replace(regexp_replace(x, '&(#?[\\p{L}\\p{N}_]+;)', chr(2) || '\\1', 'g'), '&', '&amp;'), chr(2), '&') x from a)
 select page_id, regexp_replace(x, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') xhtml from b""")
def sanitised_xhtml(spark, sf_dir):
    html = F.concat("html", F.lit('<br><hr class="a"><img src="b"> & &amp; &#12; &x\x07'))
    return table(spark, sf_dir, "pages").select("page_id", scalar.to_xhtml(html).alias("xhtml"))


NAME = "concat(case event_id % 4 when 0 then 'IMG_' when 1 then 'x' when 2 then 'PXL_' else 'at ' end, case when event_id % 4 = 3 then {dash} when event_id % 5 = 0 then '20241399_250000' else {plain} end, '.jpg')"


@query(f"select event_id, case when event_id % 4 <> 3 and event_id % 5 = 0 then null else date_trunc('second', ts) end captured from events")
def captured_from_names(spark, sf_dir):
    name = F.expr(NAME.format(dash="date_format(ts, 'yyyy-MM-dd_HH-mm-ss')", plain="date_format(ts, 'yyyyMMdd_HHmmss')"))
    return table(spark, sf_dir, "events").select("event_id", scalar.name_time(name).alias("captured"))


@query("select event_id, case when event_id % 3 = 0 then null else date_trunc('second', ts) end captured from events")
def captured_from_exif(spark, sf_dir):
    value = F.when(F.col("event_id") % 3 == 0, "2024:13:40 99:00:00").otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", scalar.exif_time(value).alias("captured"))


@query("select event_id, cast(row_number() over (partition by event_type order by case when event_id % 9 = 0 then null else date_trunc('second', ts) end nulls first, path) - 1 as int) page_no from (select *, concat('/scan/', lpad(cast(event_id as varchar), 9, '0'), '.jpg') path from events)")
def images_by_time(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("book_id"), F.concat(F.lit("/scan/"), F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit(".jpg")).alias("path"), F.when(F.col("event_id") % 9 != 0, F.date_trunc("second", "ts")).alias("captured"))
    return ocr.ordered(rows).select("event_id", "page_no")


@query("select event_id, cast(row_number() over (partition by event_type order by concat('IMG_', event_id, '.jpg')) - 1 as int) page_no from events")
def images_by_name(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("book_id"), F.concat(F.lit("IMG_"), "event_id", F.lit(".jpg")).alias("name")).withColumn("path", F.col("name"))
    return ocr.ordered(rows, by_time=False).select("event_id", "page_no")


@query("select event_id, regexp_matches(path, '\\.(jpg|jpeg|png|webp|JPG|JPEG|PNG|WEBP)$') supported from (select event_id, concat('/a/', event_id, case event_id % 5 when 0 then '.jpg' when 1 then '.JPG' when 2 then '.Jpg' when 3 then '.webp' else '.txt' end) path from events)")
def supported_images(spark, sf_dir):
    path = F.expr("concat('/a/', event_id, case event_id % 5 when 0 then '.jpg' when 1 then '.JPG' when 2 then '.Jpg' when 3 then '.webp' else '.txt' end)")
    return table(spark, sf_dir, "events").select("event_id", ocr.supported(path).alias("supported"))


@query("select event_id, cast(case when least(w, h) <= 1150 then w else trunc(w * (1150.0::double / least(w, h))) end as int) width, cast(case when least(w, h) <= 1150 then h else trunc(h * (1150.0::double / least(w, h))) end as int) height, cast(trunc(w * 0.35::double) as int) scaled from (select event_id, cast(600 + event_id * 37 % 4000 as int) w, cast(500 + event_id * 91 % 4000 as int) h from events)")
def image_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (600 + F.col("event_id") * 37 % 4000).cast("int").alias("w"), (500 + F.col("event_id") * 91 % 4000).cast("int").alias("h"))
    width, height = scalar.resized(F.col("w"), F.col("h"), 1150)
    return rows.select("event_id", width.alias("width"), height.alias("height"), scalar.scaled(F.col("w"), F.lit(0.35)).alias("scaled"))


CONFIDENCE = "cast(regexp_extract(props, '(\\d+)', 1) as double) / 100.0"


@query(f"select event_id, case when c > 0.8 then 'high' when c > 0.5 then 'medium' else 'low' end severity, replace(event_type, '_', ' ') label from (select *, {CONFIDENCE} c from events)")
def severities(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.severity_of(F.get_json_object("props", "$.k").cast("double") / F.lit(100.0)).alias("severity"), scalar.label(F.col("event_type")).alias("label"))


@query("""select event_id, case when s is null then '--:--' when s < 60 then concat(cast(round_even(s, 0) as bigint), 's') when s < 3600 then concat(cast(floor(s / 60) as bigint), 'm ', cast(floor(s - 60 * floor(s / 60)) as bigint), 's')
 else concat(cast(floor(s / 3600) as bigint), 'h ', cast(floor((s - 3600 * floor(s / 3600)) / 60) as bigint), 'm') end elapsed from (select event_id, case when event_id % 11 = 0 then null else cast(event_id % 7919 as double) + (event_id % 4) * 0.25 end s from events)""")
def durations(spark, sf_dir):
    s = F.when(F.col("event_id") % 11 != 0, (F.col("event_id") % 7919).cast("double") + F.col("event_id") % 4 * 0.25)
    return table(spark, sf_dir, "events").select("event_id", scalar.duration(s).alias("elapsed"))


@query("""with l as (select event_type run_id, 500000 total, 1 n, event_id % 5 <> 0 success, cast(event_id % 3000 as double) elapsed from events),
 s as (select run_id, max(total) total, sum(n) "current", sum(case when success then n else 0 end) successful, sum(case when success then 0 else n end) failed, max(elapsed) elapsed from l group by run_id)
 select run_id, total, cast("current" as bigint) "current", cast(successful as bigint) successful, cast(failed as bigint) failed, "current" / elapsed rate, (total - "current") / ("current" / elapsed) eta, "current" / total * 100 percent,
 concat(cast(floor(elapsed / 60) as bigint), 'm ', cast(floor(elapsed - 60 * floor(elapsed / 60)) as bigint), 's') elapsed_text from s""")
def run_progress(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("run_id"), F.lit(500000).alias("total"), F.lit(1).alias("n"), (F.col("event_id") % 5 != 0).alias("success"), (F.col("event_id") % 3000).cast("double").alias("elapsed"))
    return progress.log_summary(log)


# review
@query("select doc_id, case when doc_id % 3 = 0 then text else concat(left(text, cast(doc_id % 20 as int)), 'FIX', substr(text, cast(doc_id % 20 + doc_id % 7 + 1 as int))) end fixed, substr(text, cast(doc_id % 20 + 1 as int), cast(doc_id % 7 as int)) removed from documents")
def spliced_texts(spark, sf_dir):
    start = (F.col("doc_id") % 20).cast("int")
    end = (F.col("doc_id") % 20 + F.col("doc_id") % 7).cast("int")
    fix = F.when(F.col("doc_id") % 3 == 0, "").otherwise("FIX")
    return table(spark, sf_dir, "documents").select("doc_id", review.with_fix(F.col("text"), start, end, fix).alias("fixed"), scalar.sliced(F.col("text"), start, end).alias("removed"))


def responses(spark, sf_dir) -> DataFrame:
    """Responses that call a tool, some another one and some with arguments that aren't JSON."""
    rows = table(spark, sf_dir, "events")
    confidence = F.get_json_object("props", "$.k").cast("double") / F.lit(100.0)
    good = F.to_json(F.struct(F.col("event_type").alias("issue_type"), (F.col("event_id") % 90).alias("start_offset"), confidence.alias("confidence")))
    call = F.struct(F.when(F.col("event_id") % 6 == 0, "other").otherwise("suggest_fix").alias("name"), F.when(F.col("event_id") % 7 == 0, "not json").otherwise(good).alias("arguments"))
    message = F.struct(F.struct(F.array(F.struct(call.alias("function"))).alias("tool_calls")).alias("message"))
    return rows.select("event_id", F.to_json(F.struct(F.array(message).alias("choices"))).alias("response"))


@query(f"select event_id, event_type \"type\", case when c > 0.8 then 'high' when c > 0.5 then 'medium' else 'low' end severity, '' description, cast(event_id % 90 as int) start_offset, 0 end_offset, '' suggestion, case when event_id % 4 = 0 then 'accepted' else 'pending' end status from (select *, {CONFIDENCE} c from events) where event_id % 6 <> 0 and event_id % 7 <> 0")
def review_issues(spark, sf_dir):
    found = review.issues(responses(spark, sf_dir), key=("event_id",))
    decided = found.where(F.col("event_id") % 4 == 0).select("id", F.lit("accepted").alias("status"))
    return review.with_status(found, decided).drop("id")


@query("select event_type, count(*) n_pending from events where event_id % 6 <> 0 and event_id % 7 <> 0 and event_id % 4 <> 0 group by event_type")
def pending_issues(spark, sf_dir):
    found = review_issues(spark, sf_dir)
    return review.pending(found).groupBy(F.col("type").alias("event_type")).agg(F.count("*").alias("n_pending"))


@query(f"with {p_sql()} select book_id, page_no, case when page_no % 5 = 0 then concat('edited ', doc_id) else text end text from p")
def pages_with_edits(spark, sf_dir):
    rows = pages(spark, sf_dir).select("book_id", "page_no", "doc_id", "text")
    edits = rows.where(F.col("page_no") % 5 == 0).select("book_id", "page_no", F.concat(F.lit("edited "), "doc_id").alias("text"))
    unknown = spark.createDataFrame([("nobody", 0, "x")], "book_id string, page_no int, text string")
    return review.upsert(rows, edits.unionByName(unknown)).select("book_id", "page_no", "text")


@query("select event_id, cast(case when event_id % 3 = 0 then 1 when event_id % 3 = 1 then 0 else 0 end as int) n_blocks from events")
def parsed_page_json(spark, sf_dir):
    raw = F.expr("case event_id % 3 when 0 then '[{\"category\":\"Text\",\"text\":\"a\",\"bbox\":[0,0,1,1]}]' when 1 then '{\"raw_response\": \"a\"}' else '[{\"category\": ' end")
    return table(spark, sf_dir, "events").select("event_id", F.size(review.parsed_blocks(raw)).alias("n_blocks"))


def page_names(spark, sf_dir) -> DataFrame:
    """Files of an imagined folder for each event type."""
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("/b/"), "event_type").alias("base"))
    stem = F.format_string("page_%04d", F.col("event_id").cast("int"))
    bare = F.format_string("page_%d", F.col("event_id").cast("int"))
    third = F.col("event_id") % 3

    def file(folder: str, name: Column, suffix: str) -> Column:
        return F.struct(F.concat("base", F.lit(folder)).alias("folder"), F.concat(name, F.lit(suffix)).alias("name"))

    kinds = F.array(
        file("/ocr_pages", stem, ".md"),
        file("/ocr_pages", stem, "_nohf.md"),
        F.when(F.col("event_id") % 2 == 0, file("/ocr_pages", stem, ".json")),
        F.when(third == 0, file("/ocr_pages", stem, ".jpg")),
        F.when(third == 1, file("/processed_images", stem, ".jpg")),
        F.when(third == 2, file("/processed_images", bare, ".jpg")),
    )
    return rows.select(F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("f")).select("f.*")


@query("select concat('/b/', event_type, '/ocr_pages') folder, cast(event_id as int) page_no, concat(s, '.md') markdown, case when event_id % 2 = 0 then concat(s, '.json') end json, case when event_id % 3 < 2 then concat(s, '.jpg') else concat('page_', event_id, '.jpg') end image from (select *, concat('page_', case when event_id > 9999 then cast(event_id as varchar) else lpad(cast(event_id as varchar), 4, '0') end) s from events)")
def page_listing(spark, sf_dir):
    return review.listing(page_names(spark, sf_dir))


@query("select 'page_N' pattern")
def page_naming(spark, sf_dir):
    return readers.naming(page_names(spark, sf_dir))


@query("select page_no, name, cast(row_number() over (order by name) as int) by_path, cast(row_number() over (order by page_no) as int) by_number from (select cast(event_id as int) page_no, concat('page_', case when event_id > 9999 then cast(event_id as varchar) else lpad(cast(event_id as varchar), 4, '0') end, '.md') name from events)")
def page_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.lit("/b").alias("book_id"), F.col("event_id").cast("int").alias("page_no"))
    rows = rows.withColumn("name", F.concat(F.lit("page_"), F.when(F.col("page_no") > 9999, F.col("page_no").cast("string")).otherwise(F.lpad(F.col("page_no").cast("string"), 4, "0")), F.lit(".md")))
    rows = ordered.numbered(ordered.numbered(rows, [F.col("name")], "by_path"), [review.page_number(F.col("name"))], "by_number")
    return rows.select("page_no", "name", (F.col("by_path") + 1).alias("by_path"), (F.col("by_number") + 1).alias("by_number"))


@query("select concat('/b/', event_type, '/ocr_pages') folder, cast(event_id as int) page_no, concat('page_', lpad(cast(event_id as varchar), 4, '0'), '.jpg') image from events where event_id = 1234")
def page_image(spark, sf_dir):
    return review.image_of(page_listing(spark, sf_dir), 1234)


@query("select event_id, cast(greatest(least(50 + event_id % 200 + event_id % 3 * 25, 200), 50) as bigint) zoom, (event_id + 1) / 10000 * 100 progress from events")
def reading_state(spark, sf_dir):
    zoom = scalar.zoomed(50 + F.col("event_id") % 200, F.col("event_id") % 3 * 25)
    return table(spark, sf_dir, "events").select("event_id", zoom.alias("zoom"), scalar.page_progress(F.col("event_id"), F.lit(10000)).alias("progress"))


# resume
OUTPUTS = "outputs as (select l_orderkey, max(l_shipdate) modified from lineitem where l_orderkey % 10 <> 3 group by l_orderkey)"


def order_outputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_no"), F.col("o_orderdate").alias("modified"))
    made = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_no")).agg(F.max("l_shipdate").alias("modified"))
    flags = made.withColumn("has_json", F.lit(True)).withColumn("has_nohf", F.lit(True)).withColumn("json_valid", F.col("page_no") % 10 != 3)
    return images, resume.valid_output(flags)


@query(f"with {OUTPUTS} select o_orderkey page_no from orders left join outputs on o_orderkey = l_orderkey and modified >= o_orderdate where l_orderkey is null")
def pages_to_process(spark, sf_dir):
    return resume.to_process(*order_outputs(spark, sf_dir), key=("page_no",)).select("page_no")


@query(f"with {OUTPUTS} select o_orderkey page_no from orders join outputs on o_orderkey = l_orderkey and modified >= o_orderdate")
def pages_cached(spark, sf_dir):
    return resume.cached(*order_outputs(spark, sf_dir), key=("page_no",)).select("page_no")


@query(f"with {p_sql()} select book_id, page_no, case when page_no % 6 = 0 then null else text end text, page_no % 6 <> 0 and page_no % 6 <> 1 success, case when page_no % 6 = 0 then 'Processing failed or was interrupted' when page_no % 6 = 1 then 'bad image' end error_message from p")
def results_with_gaps_filled(spark, sf_dir):
    return results(spark, sf_dir)


def results(spark, sf_dir) -> DataFrame:
    images = pages(spark, sf_dir).drop("text")  # numbered without the texts, which join by document
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = images.where("page_no % 6 <> 0").join(texts, "doc_id").select("book_id", "page_no", "text", (F.col("page_no") % 6 != 1).alias("success"), F.when(F.col("page_no") % 6 == 1, "bad image").alias("error_message"))
    return resume.filled(images, done)


@query(f"with {p_sql()} select book_id, count(*) n_pages, count_if(page_no % 6 > 1)::bigint n_success, (count(*) - count_if(page_no % 6 > 1))::bigint n_failed, true ready from p group by book_id")
def run_outcomes(spark, sf_dir):
    return resume.outcome(results(spark, sf_dir))


# accuracy
RUNS = "runs as (select source image, (doc_id // 20) % 4 * 90 rotation, text, n_chars / 100.0::double ocr_time from documents)"


def runs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("image"), (F.floor(F.col("doc_id") / 20) % 4 * 90).alias("rotation"), "text", (F.col("n_chars") / F.lit(100.0)).alias("ocr_time"), "doc_id")


@query(f"with {RUNS}, m as (select rotation, avg(ocr_time) avg_time from runs group by rotation) select m.rotation, round(m.avg_time, 6) avg_time, round(b.avg_time / m.avg_time, 6) speedup from m, m b where b.rotation = 0")
def accuracy_speedups(spark, sf_dir):
    found = accuracy.speedups(runs(spark, sf_dir), "rotation", 0)
    return found.select("rotation", F.round("avg_time", 6).alias("avg_time"), F.round("speedup", 6).alias("speedup"))


def own_runs(spark, sf_dir) -> DataFrame:
    """Every run with an image of its own: an image's four runs are documents 20 apart; its key is the doc_id of its baseline."""
    return runs(spark, sf_dir).withColumn("image", F.col("doc_id") - (F.col("rotation") / 90 * 20).cast("bigint"))


@query("with r as (select doc_id - doc_id // 20 % 4 * 20 image, doc_id // 20 % 4 * 90 rotation, text, n_chars / 100.0::double ocr_time from documents) select r.image, r.rotation, length(r.text) - length(b.text) length_difference, b.ocr_time base_time from r join r b on r.image = b.image and b.rotation = 0")
def runs_with_baseline(spark, sf_dir):
    return accuracy.with_baseline(own_runs(spark, sf_dir)).select("image", "rotation", (F.length("text") - F.length("base_text")).cast("bigint").alias("length_difference"), "base_time")


@query()
def accuracy_averages(spark, sf_dir):
    return accuracy.averages(accuracy.with_similarity(own_runs(spark, sf_dir)))


@query("select distinct source image from documents order by 1 limit 5")
def first_images(spark, sf_dir):
    return accuracy.first_images(table(spark, sf_dir, "documents").select(F.col("source").alias("image")).distinct(), 5)


# sources, sinks and the whole plan
@query("select distinct lower(trim(w)) word from (select unnest(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) w from benchmark) where trim(w) <> ''")
def dictionary_words(spark, sf_dir):
    lines = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("value"))
    return readers.words(lines)


def own_folder(spark) -> str:
    """A fresh folder that driver and executors share."""
    return f"{ordered.shared_folder(spark)}/files-{uuid.uuid4().hex}"


def written(files: DataFrame) -> None:
    files.write.format("noop").mode("overwrite").save()


#: Files that a query has written and not read yet, about; more are written, read and deleted in several goes.
STANDING = 200_000


@query(f"with {p_sql()} select book_id, page_no, 'markdown' kind, cast(length(text) as int) n_chars, md5(text) digest from p")
def page_files(spark, sf_dir):
    """Pages written as files, each in a folder of its book, and read again."""
    folder = own_folder(spark)
    rows = pages(spark, sf_dir).select("book_id", "page_no", "text", F.col("text").alias("text_nohf"), F.when(F.col("page_no") % 2 == 0, "[]").alias("raw"))
    written(writers.page_files(rows, folder))
    return readers.page_texts(spark, folder, readers.TIERS["analyze"]).select("book_id", "page_no", "kind", F.length("text").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query(f"""with {p_sql()}, j as (select *, '[' || chr(10) || '  "' || doc_id || '"' || chr(10) || ']' raw from p)
 select 'join' tiers, 'json' kind, book_id, page_no, md5(raw) digest from j where page_no % 3 <> 1
 union all select 'join', 'markdown', book_id || '-md', page_no, md5(text) from j
 union all select 'join_only', 'json', book_id, page_no, md5(raw) from j where page_no % 3 <> 1
 union all select 'join_only', 'markdown', book_id || '-nohf', page_no, md5(text || '.') from j""".replace("book_id, page_no, md5(raw) digest from j where page_no % 3 <> 1", "book_id, cast(row_number() over (partition by book_id order by page_no) - 1 as int) page_no, md5(raw) digest from j where page_no % 3 <> 1").replace("book_id, page_no, md5(raw) from j where page_no % 3 <> 1", "book_id, cast(row_number() over (partition by book_id order by page_no) - 1 as int), md5(raw) from j where page_no % 3 <> 1"))
def page_file_tiers(spark, sf_dir):
    """Folders of page files read by what they hold: JSON of some pages goes before all markdown, then the text without headers, then any. Books are written, read and deleted some at a time."""
    source, out = own_folder(spark), own_folder(spark)
    spark.createDataFrame([], schema := "tiers string, kind string, book_id string, page_no int, digest string").write.parquet(out)
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)  # a row for each book
    books = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n"))
    goes = books.select("of", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / (STANDING // 10)).alias("go"))
    rows = pages(spark, sf_dir).join(F.broadcast(goes), F.col("book_id").eqNullSafe(F.col("of"))).select("go", "book_id", "page_no", "doc_id", "text")
    rows.write.option("compression", "zstd").partitionBy("go").parquet(source)
    none = F.lit(None).cast("string")
    for (go,) in goes.select("go").distinct().orderBy("go").collect():
        some = spark.read.schema("book_id string, page_no int, doc_id bigint, text string").parquet(f"{source}/go={go}")
        some = some.select("book_id", "page_no", "text", F.concat("text", F.lit(".")).alias("text_nohf"), F.when(F.col("page_no") % 3 != 1, F.to_json(F.array(F.col("doc_id").cast("string")))).alias("raw"))
        made = {"": (some, ("join", "join_only")), "-nohf": (some.withColumns({"raw": none, "text": none}), ("join_only",)), "-md": (some.withColumns({"raw": none, "text_nohf": none}), ("join",))}
        for name, (own, read) in made.items():
            folder = own_folder(spark)
            with ordered.fleeting(spark):
                written(writers.page_files(own.withColumn("book_id", F.concat("book_id", F.lit(name))), folder))
                for tiers in read:
                    found = readers.page_texts(spark, folder, readers.TIERS[tiers])
                    found.select(F.lit(tiers).alias("tiers"), "kind", "book_id", "page_no", F.md5(F.encode("text", "UTF-8")).alias("digest")).write.mode("append").parquet(out)
                readers.removed(spark, folder, True)
        ordered.delete(spark, f"{source}/go={go}")
    return spark.read.schema(schema).parquet(out)


@query("select cast(row_number() over (order by doc_id) - 1 as int) page_no, md5(coalesce(text, '')) digest, 'pages' folder from documents")
def found_page_folder(spark, sf_dir):
    """A book's pages in one of the usual folders below the given one."""
    base = own_folder(spark)
    none = F.lit(None).cast("string")
    number = ordered.numbered(table(spark, sf_dir, "documents").select(F.lit("pages").alias("book_id"), "doc_id"), [F.col("doc_id")], "page_no")
    rows = ordered.with_numbers(table(spark, sf_dir, "documents").select(F.lit("pages").alias("book_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text")), number, "doc_id", "page_no")
    written(writers.page_files(rows.withColumns({"text_nohf": none, "raw": none}), base))
    found = readers.whole_files(spark, readers.pages_folder(spark, base), "page_*.md")
    return found.select(review.page_number(readers.name_of(F.col("path"))).alias("page_no"), F.md5(F.encode("text", "UTF-8")).alias("digest"), readers.book_of(F.col("path")).alias("folder"))


@query("select cast(doc_id as int) page_no, doc_id % 3 <> 0 has_json, doc_id % 5 <> 0 has_nohf, case when doc_id % 3 = 0 then null else doc_id % 3 = 1 end json_valid from documents where doc_id % 3 <> 0 or doc_id % 5 <> 0")
def earlier_outputs(spark, sf_dir):
    """What an earlier run left in a folder: some pages without JSON or with a broken one, some without their text."""
    folder = own_folder(spark)
    n = F.col("doc_id")
    raw = F.when(n % 3 == 1, F.to_json(F.array("source"))).when(n % 3 == 2, "[broken")
    rows = table(spark, sf_dir, "documents").select(F.lit("all").alias("book_id"), n.cast("int").alias("page_no"), F.lit(None).cast("string").alias("text"), F.when(n % 5 != 0, F.col("text")).alias("text_nohf"), raw.alias("raw"))
    written(writers.page_files(rows, folder))
    return readers.outputs(spark, f"{folder}/all").select("page_no", "has_json", "has_nohf", "json_valid")


@query(books_sql(ENDINGS, True) + " select book_id, cast(length(content) as int) n_chars, md5(content) digest from k")
def book_files(spark, sf_dir):
    """Books written as markdown files and read again."""
    folder = own_folder(spark)
    written(writers.text_files(joiner.blocks(pages(spark, sf_dir, ENDINGS)), folder))
    return readers.markdown(spark, folder).select("book_id", F.length("content").alias("n_chars"), F.md5(F.encode("content", "UTF-8")).alias("digest"))


@query("with f as (select 'IMG_' || page_id || case page_id % 3 when 0 then '.jpg' when 1 then '.PNG' else '.txt' end as name from pages) select name, case when name like '%.jpg' then cast(row_number() over (partition by name like '%.jpg' order by name) - 1 as int) end page_no from f where not name like '%.txt'")
def image_files(spark, sf_dir):
    """Images of a folder among other files, and the jpg files as pages by path."""
    folder = own_folder(spark)
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("IMG_"), "page_id").alias("book_id"), "page_id", F.encode("url", "UTF-8").alias("content"))
    for k, suffix in enumerate((".jpg", ".PNG", ".txt")):
        written(writers.files(rows.where(F.col("page_id") % 3 == k), folder, "content", suffix))
    numbers = readers.processed_images(spark, folder).select("name", "page_no")
    return readers.images(spark, folder).select("name").join(numbers, "name", "left")


#: The bytes of a JPEG file with EXIF data, by event: in either byte order, the time stamp in the main directory, in the EXIF directory or, unreadable, in both; a directory that is cut, one that points to itself, none.
def jpeg(stamp: Column, kind: Column) -> Column:
    big = kind % 2 == 1
    number = lambda x, n: F.when(big, F.lit(x.to_bytes(n, "big").hex())).otherwise(F.lit(x.to_bytes(n, "little").hex()))
    entry = lambda tag, type_, count, value: F.concat(number(tag, 2), number(type_, 2), number(count, 4), number(value, 4))
    said, unread = F.hex(F.encode(stamp, "UTF-8")), F.lit(b"0000:00:00 unread!!".hex())
    last = number(0, 4)
    main = F.concat(number(1, 2), entry(36867, 2, 20, 26), last, said, F.lit("00"))
    below = F.concat(number(1, 2), entry(0x8769, 4, 1, 26), last, number(1, 2), entry(36867, 2, 20, 44), last, said, F.lit("00"))
    both = F.concat(number(2, 2), entry(36867, 2, 20, 38), entry(0x8769, 4, 1, 58), last, unread, F.lit("00"), number(1, 2), entry(36867, 2, 20, 76), last, said, F.lit("00"))
    cut = F.concat(number(9, 2), entry(36867, 2, 20, 26), said)
    loop = F.concat(number(1, 2), entry(0x8769, 4, 1, 8), last)
    inner = F.when(kind < 2, main).when(kind < 4, below).when(kind < 6, both).when(kind < 8, cut).otherwise(loop)
    tiff = F.concat(F.when(big, F.lit(b"MM\0*".hex())).otherwise(F.lit(b"II*\0".hex())), number(8, 4), inner)
    size = F.lpad(F.hex((F.length(tiff) / 2).cast("int") + 8), 4, "0")
    exif = F.when(kind < 10, F.concat(F.lit("ffe1"), size, F.lit(b"Exif\0\0".hex()), tiff)).otherwise("")
    return F.unhex(F.concat(F.lit("ffd8ffe00004"), F.lit("0000"), exif, F.lit("ffda0002"), F.hex(F.encode(F.repeat(F.lit("pixels"), 50), "UTF-8")), F.lit("ffd9")))


@query("select 'IMG_20240102_030405_' || event_id || '.jpg' name, case when event_id % 12 < 6 then date_trunc('second', ts) else timestamp '2024-01-02 03:04:05' end captured from events")
def captured_files(spark, sf_dir):
    """Image files with EXIF data of all kinds, written and read for their time stamps, some at a time; the name counts where there is none."""
    out = own_folder(spark)
    spark.createDataFrame([], schema := "name string, captured timestamp_ntz").write.parquet(out)
    events = table(spark, sf_dir, "events")
    n = -(-events.count() // STANDING)
    for go in range(n):
        folder = own_folder(spark)
        some = events.where(F.pmod(F.hash("event_id"), F.lit(n)) == go)
        rows = some.select(F.concat(F.lit("IMG_20240102_030405_"), "event_id").alias("book_id"), jpeg(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.col("event_id") % 12).alias("content"))
        with ordered.fleeting(spark):
            written(writers.files(rows, folder, "content", ".jpg"))
            readers.captured_images(spark, folder).select("name", "captured").write.mode("append").parquet(out)
            readers.removed(spark, folder)
    return spark.read.schema(schema).parquet(out)


@query(f"with {p_sql()} select book_id, page_no, md5(case when book_id like '%3' and page_no % 5 = 0 then concat('edited ', doc_id, chr(10), text) else text end) digest, book_id like '%3' rewritten from p")
def saved_edits(spark, sf_dir):
    """Pages written, some edited and saved, and read again: of each whether its file is a new one. Edits of pages that aren't there touch no file."""
    folder, columns = own_folder(spark), "page_no int, doc_id bigint, text string"
    writers.pages(pages(spark, sf_dir).select("book_id", "page_no", "doc_id", "text"), folder)
    stood = ordered.stored(writers.read_pages(spark, folder, columns).select(F.col("_metadata.file_name").alias("was")).distinct())
    before = writers.read_pages(spark, folder, columns)
    edits = before.where("book_id like '%3' and page_no % 5 = 0").select("book_id", "page_no", F.concat(F.lit("edited "), "doc_id", F.lit("\n"), "text").alias("text"))
    unknown = before.where("book_id like '%4'").select("book_id", (-1 - F.col("page_no")).alias("page_no"), F.lit("x").alias("text"))
    edits = ordered.stored(edits.unionByName(unknown))
    for _ in range(2):  # saving again changes nothing
        writers.save_edits(spark, folder, edits, columns)
    after = writers.read_pages(spark, folder, columns).select("book_id", "page_no", F.md5(F.encode("text", "UTF-8")).alias("digest"), F.col("_metadata.file_name").alias("file"))
    return after.join(stood, F.col("file") == F.col("was"), "left").select("book_id", "page_no", "digest", F.col("was").isNull().alias("rewritten"))


#: Three blocks of a page, by its number: their boxes, one of them from its lower right corner, and their categories, one of them unknown.
LAYOUT = "concat('[{\"bbox\":[', page_no, ',10,', page_no + 200, ',40],\"category\":\"Title\",\"text\":\"t\"},{\"bbox\":[300.5,', page_no + 99, ',20.25,50],\"category\":\"', case when page_no % 2 = 0 then 'Text' else 'A & B' end, '\"},{\"bbox\":[1,2],\"category\":\"Text\"}', case when page_no % 7 = 3 then '' else ']' end)"


@query(f"""with {p_sql()}, good as (select * from p where page_no % 7 <> 3)
 select book_id, page_no, 0 place, 'Title' category, page_no::double x, 10::double y, 200::double width, 30::double height, '{writers.COLOURS["Title"]}' colour from good
 union all select book_id, page_no, 1, case when page_no % 2 = 0 then 'Text' else 'A &amp; B' end, 20.25::double, least(50, page_no + 99)::double, 280.25::double, abs(page_no + 49)::double, case when page_no % 2 = 0 then '{writers.COLOURS["Text"]}' else '{writers.COLOURS[None]}' end from good""")
def drawn_layouts(spark, sf_dir):
    """Layouts drawn beside the pages' files, and the boxes as the files have them; a layout that can't be read is not drawn."""
    folder = own_folder(spark)
    rows = pages(spark, sf_dir).select("book_id", "page_no", "text", F.lit(None).cast("string").alias("text_nohf"), F.expr(LAYOUT).alias("raw"))
    written(writers.page_files(rows, folder, drawn=True))
    found = readers.whole_files(spark, folder, "page_*.svg", True)
    box = r'<rect x="([^"]*)" y="([^"]*)" width="([^"]*)" height="([^"]*)" fill="none" stroke="([^"]*)"><title>([^<]*)</title></rect>'
    each = found.select(readers.book_of(F.col("path")).alias("book_id"), F.regexp_extract(readers.name_of(F.col("path")), r"page_(\d+)\.svg", 1).cast("int").alias("page_no"), F.posexplode(F.regexp_extract_all("text", F.lit(f"({box})"), F.lit(1))).alias("place", "rect"))
    part = lambda k: F.regexp_extract("rect", box, k)
    return each.select("book_id", "page_no", "place", part(6).alias("category"), *(part(k + 1).cast("double").alias(c) for k, c in enumerate(("x", "y", "width", "height"))), part(5).alias("colour"))


EPUB_FILES = "mimetype META-INF/container.xml OEBPS/content.opf OEBPS/toc.ncx OEBPS/nav.xhtml OEBPS/stylesheet.css".split()


@query(CHAPTERS.rpartition(" select book_id, cast(row_number()")[0] + f" select book_id, cast(count(*) as int) n_chapters, cast(count(*) + {len(EPUB_FILES)} as int) n_files, string_agg(title, chr(10) order by part) titles from every group by book_id")
def book_epubs(spark, sf_dir):
    """The chapters as the files themselves have them."""
    folder = own_folder(spark)
    made = ordered.stored(writers.epub_files(chapters.of_blocks(joiner.blocks(pages(spark, sf_dir, ENDINGS), markers=False)), folder))
    listed = F.pandas_udf(epub.listing, "struct<n_files: int, titles: array<string>>")("content")
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_replace(readers.name_of(F.col("path")), r"\.epub\z", "").alias("book_id"), listed.alias("x"))
    return made.join(files, "book_id").select("book_id", "n_chapters", "x.n_files", F.array_join("x.titles", "\n").alias("titles"))


#: The page's whole text in letters, digits, commas and full stops, in one line; then markdown around it and what it becomes.
PLAIN = "concat('P ', regexp_replace(text, '[^A-Za-z0-9,.]', ' '{g}))"
MARKED = """concat('# Head *', doc_id, '* & more\n\n', {plain}, '\n\n- one ', doc_id, '\n- **two**\n    - inner `x<y & **z**`\n    - second\n- three\n\n4. first\n5. second & last\n\n> said ', doc_id, '\n> # Quoted\n\n',
 '| a | b |\n|:--|--:|\n| ', doc_id, ' | __x__ |\n| only |\n\n```sql\nselect "', doc_id, '" < 3;\n\n# no head\n```\n\n---\n\n[link](http://x/', doc_id, ') ![pic](p.png)\n<div class="c">raw</div>\n\n## Head\n\n## Head\nlast line<br>end')"""
BODY = """concat('<h1 id="head-', doc_id, '-more">Head <em>', doc_id, '</em> &amp; more</h1>\n<p>', {plain}, '</p>\n<ul><li>one ', doc_id, '</li><li><strong>two</strong><ul><li>inner <code>x&lt;y &amp; **z**</code></li><li>second</li></ul></li><li>three</li></ul>\n<ol><li>first</li><li>second &amp; last</li></ol>\n',
 '<blockquote>\n<p>said ', doc_id, '</p>\n<h1 id="quoted">Quoted</h1>\n</blockquote>\n<table><thead><tr><th style="text-align: left;">a</th><th style="text-align: right;">b</th></tr></thead><tbody><tr><td style="text-align: left;">', doc_id, '</td><td style="text-align: right;"><strong>x</strong></td></tr><tr><td style="text-align: left;">only</td><td style="text-align: right;"></td></tr></tbody></table>\n',
 '<pre><code class="language-sql">select &quot;', doc_id, '&quot; &lt; 3;\n\n# no head\n</code></pre>\n<hr/>\n<p><a href="http://x/', doc_id, '">link</a> <img alt="pic" src="p.png"/>\n<div class="c">raw</div></p>\n<h2 id="head">Head</h2>\n<h2 id="head_1">Head</h2>\n<p>last line<br/>end</p>')"""


@query(f"with {p_sql()} select book_id, page_no, md5({BODY.format(plain=PLAIN.format(g=', ' + repr('g')))}) digest from p")
def chapter_bodies(spark, sf_dir):
    """Chapters of markdown of all kinds, as their EPUB files have them."""
    folder = own_folder(spark)
    sql = MARKED.format(plain=PLAIN.format(g=""))
    rows = pages(spark, sf_dir).select("book_id", F.col("page_no").cast("bigint").alias("chapter_no"), F.lit("t").alias("title"), F.lit(0).cast("bigint").alias("block"), F.lit(0).alias("part"), F.expr(sql).alias("text"))
    written(writers.epub_files(rows, folder))
    name = F.regexp_replace(readers.name_of(F.col("path")), r"\.epub\z", "")
    return readers.epub_bodies(spark, folder).select(name.alias("book_id"), F.col("chapter_no").alias("page_no"), F.md5(F.encode("body", "UTF-8")).alias("digest"))


#: From ``cleaned`` (book_id, page_no, text) to books: headers and footers, joining, running headers.
FROM_CLEANED = f"""final as (with p as (select * from cleaned), {HEADER_LINES}, {ONCE}, {edges_sql('once')}, {stripped_sql('once')} select book_id, page_no, text from stripped),
 whole as (with p as (select * from final), {CLASSES}, {pieces_sql(True)}, k as (select book_id, count(*) n_pages, string_agg(piece, '' order by page_no) content from x group by book_id), {without_running_sql('k')} select * from rr)
 select book_id, n_pages, cast(length(content) as int) n_chars, md5(content) digest from whole"""
FULL_RUN = f"""with {p_sql(BOTH)}, dict as ({WORDS}),
 raws as (select book_id, page_no, 1 block_no, {SIMPLE.replace('{g}', ", 'g'").replace(chr(92) * 2, chr(92))} text from p where page_no % 4 = 0),
 by_blocks as (with {cut_sql('raws', BLOCK)}, {mend_sql('cut', BLOCK)}, {blocks_sql('mended', 'done')} select * from done),
 marks as (select book_id, page_no, text from p where page_no % 4 <> 0),
 by_text as (with {cut_sql('marks')}, {mend_sql('cut')}, parts as (select book_id, page_no, unnest(regexp_split_to_array(text, '\\n\\n+')) text, generate_subscripts(regexp_split_to_array(text, '\\n\\n+'), 1) block_no from mended), {blocks_sql('parts', 'done')} select * from done),
 cleaned as (select * from by_blocks union all select * from by_text),
{FROM_CLEANED}"""


@query(FULL_RUN)
def full_run(spark, sf_dir):
    """From recognised pages, each fourth with its layout as JSON, to books."""
    raw = f"case when page_no % 4 = 0 then concat('[{{\"category\":\"Page-header\",\"text\":\"top\"}},{{\"category\":\"Text\",\"text\":\"', {SIMPLE}, '\"}}]') end"
    rows = pages(spark, sf_dir, BOTH).select("book_id", "page_no", F.expr(raw.replace("{g}", "").replace("\\n\\r\\t", "\\\\n\\\\r\\\\t")).alias("raw"), F.col("text").alias("text_nohf"), F.lit(True).alias("success"))
    return book_digests(book.run(rows, even_words(spark, sf_dir), formats=("md",)).books)


PAGE_JSON = f"case when page_no % 4 = 3 then concat('[{{\"category\": ', text) when page_no % 4 = 2 then '{{\"raw_response\": \"x\"}}' else concat('[{{\"category\":\"Page-footer\",\"text\":\"end\"}},{{\"category\":\"Text\",\"text\":\"', {SIMPLE}, '\"}}]') end"


@query(f"""with {p_sql(BOTH)}, dict as ({WORDS}),
 raws as (select book_id, page_no, 1 block_no, {SIMPLE.replace('{g}', ", 'g'").replace(chr(92) * 2, chr(92))} text from p where page_no % 4 < 2),
 by_blocks as (with {cut_sql('raws', BLOCK)}, {mend_sql('cut', BLOCK)}, {blocks_sql('mended', 'done')} select * from done),
 cleaned as (select * from by_blocks union all select book_id, page_no, '' from p where page_no % 4 >= 2),
 {FROM_CLEANED}""")
def books_from_page_json(spark, sf_dir):
    """Books from the layout JSON of pages alone; what isn't a list of blocks is an empty page."""
    json = PAGE_JSON.replace("{g}", "").replace("\\n\\r\\t", "\\\\n\\\\r\\\\t")
    return book_digests(book.join_only(pages(spark, sf_dir, BOTH).select("book_id", "page_no", F.expr(json).alias("text")), "json", even_words(spark, sf_dir)))


def stub_model():
    """Stands in for a recogniser: the path's number decides whether it fails."""

    def read(path: str, content: bytes) -> dict:
        if int(path) % 7 == 0:
            raise ValueError(f"unreadable {path}")
        said = content.decode()
        return {"text": f"# {path}\n{said}", "text_nohf": said, "layout": [{"category": "Text", "text": path}]}

    return read


@query("""select 'web' book_id, cast(page_id as int) page_no, cast(page_id as varchar) path, case when page_id % 7 = 0 then '' else '# ' || page_id || chr(10) || url end text, case when page_id % 7 = 0 then '' else url end text_nohf,
 case when page_id % 7 <> 0 then '[{"category": "Text", "text": "' || page_id || '"}]' end raw, page_id % 7 <> 0 success, case when page_id % 7 = 0 then 'unreadable ' || page_id end error_message from pages""")
def recognised_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.lit("web").alias("book_id"), F.col("page_id").cast("int").alias("page_no"), F.col("page_id").cast("string").alias("path"), F.encode("url", "UTF-8").alias("content"))
    return ocr.recognised(rows, stub_model, pause=0)


def stub_reviewer():
    def ask(text: str) -> str:
        if "/de/" in text:
            raise ConnectionError("no answer")
        return f"{len(text)} characters"

    return ask


@query("select 'web' book_id, cast(page_id as int) page_no, case when not contains(url, '/de/') then length(url) || ' characters' end response, not contains(url, '/de/') success, case when contains(url, '/de/') then 'LLM request failed: no answer' end error_message from pages")
def reviewed_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.lit("web").alias("book_id"), F.col("page_id").cast("int").alias("page_no"), F.col("url").alias("text"))
    return ocr.reviewed(rows, stub_reviewer)


@query(f"with {p_sql(PARAGRAPHS)}, n as ({q_sql(PARAGRAPHS).partition(' n as (')[2]}, {cut_sql('p')}, m as (select book_id, page_no, unnest(regexp_split_to_array(text, '\\n\\n+')) text, generate_subscripts(regexp_split_to_array(text, '\\n\\n+'), 1) block_no from cut), {blocks_sql('m', 'done')}, e as (select book_id, page_no, count_if(severity = 'error') e, count_if(severity = 'warning') w, count_if(severity = 'info') i from found group by all) select done.book_id, done.page_no, md5(done.text) digest, cast(coalesce(e, 0) as int) n_errors, cast(coalesce(w, 0) as int) n_warnings, cast(coalesce(i, 0) as int) n_infos from done left join e using (book_id, page_no)")
def streamed_pages(spark, sf_dir):
    """Pages that arrive in files in two goes, taken up by a stream."""
    folder = own_folder(spark)
    rows = pages(spark, sf_dir, PARAGRAPHS).select("book_id", "page_no", F.lit(None).cast("string").alias("raw"), F.col("text").alias("text_nohf"), F.lit(True).alias("success"))
    for half in (0, 1):
        rows.where(F.col("page_no") % 2 == half).write.mode("append").parquet(f"{folder}/in")
        incremental.run(incremental.stream(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/state").awaitTermination()
    done = spark.read.parquet(f"{folder}/out")
    return done.select("book_id", "page_no", F.md5(F.encode("text", "UTF-8")).alias("digest"), "n_errors", "n_warnings", "n_infos")


@query(f"with {p_sql(BOTH)}, {HEADER_LINES}, {ONCE}, {edges_sql('once')}, {stripped_sql('once')} select book_id, page_no, text from stripped")
def streamed_books(spark, sf_dir):
    """Pages that arrive in three goes, the last ones first; what repeats in a book is dropped from all its pages in the end."""
    folder = own_folder(spark)
    rows = pages(spark, sf_dir, BOTH).select("book_id", "page_no", "text")
    for go in (2, 0, 1):
        rows.where(F.col("page_no") % 3 == go).write.mode("append").parquet(f"{folder}/in")
        incremental.run_books(incremental.stream(spark, f"{folder}/in", incremental.TEXTS), f"{folder}/out", f"{folder}/state").awaitTermination()
    return incremental.books(spark, f"{folder}/out")


@query("select n % 3 go, count(*) n_pages from (select row_number() over (order by doc_id) - 1 n from documents) group by 1")
def stream_progress(spark, sf_dir):
    """Pages that arrive in three goes, counted by what Spark reports of each."""
    folder = own_folder(spark)
    numbers = ordered.numbered(table(spark, sf_dir, "documents").select(F.lit("b").alias("book_id"), "doc_id"), [F.col("doc_id")], "page_no")
    met = ordered.with_numbers(table(spark, sf_dir, "documents").select(F.lit("b").alias("book_id"), "doc_id", "text"), numbers, "doc_id", "page_no")
    rows = met.select("book_id", "page_no", F.lit(None).cast("string").alias("raw"), F.col("text").alias("text_nohf"), F.lit(True).alias("success"))
    counts = []
    for go in range(3):
        rows.where(F.col("page_no") % 3 == go).write.mode("append").parquet(f"{folder}/in")
        shown = progress.Progress(0)
        progress.followed(spark, shown, lambda: incremental.run(incremental.stream(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/state"))
        counts.append((go, shown.current))
    return spark.createDataFrame(counts, "go bigint, n_pages bigint")


@query(f"with {RUNS}, m as (select rotation, avg(ocr_time) avg_time from runs group by rotation) select m.rotation, round(m.avg_time, 6) avg_time, round(b.avg_time / m.avg_time, 6) speedup from m, m b where b.rotation = 0")
def study_files(spark, sf_dir):
    """A study's results written as JSON lines and read again."""
    folder = own_folder(spark)
    writers.study(accuracy.speedups(runs(spark, sf_dir), "rotation", 0), folder)
    return spark.read.schema("rotation bigint, avg_time double, speedup double").json(folder).select("rotation", F.round("avg_time", 6).alias("avg_time"), F.round("speedup", 6).alias("speedup"))
