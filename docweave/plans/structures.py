"""Queries on the structure of source documents, and their chunks by greedy packing, with SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import structure
from docweave.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_documents").where("id is not null").groupBy("id").agg(F.max("content").alias("content"), F.max("file_type").alias("file_type"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return structure.lines(_docs(spark, d), "id", "content", "file_type")


def _headings(spark: SparkSession, d: str) -> DataFrame:
    return structure.headings(_lines(spark, d), F.coalesce(F.col("file_type") == "md", F.lit(False)))


def structure_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of source documents: place, rows, header, text."""
    return structure.tables(_lines(spark, d)).select("id", "first_line", "start", "end", "n_rows", "has_header", F.md5("text").alias("md5"))


def structure_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings of source documents with level, place and confidence."""
    return _headings(spark, d).select("id", "start", "kind", "level", "title", "confidence")


def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    """The headings above every heading of source documents."""
    return structure.heading_paths(_headings(spark, d)).select("id", "line_no", "level", F.array_join("path", " > ").alias("path"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    sizes = _docs(spark, d).where("content is not null").select("id", F.length("content").cast("long").alias("size"))
    return structure.section_spans(_headings(spark, d), sizes)


def section_spans(spark: SparkSession, d: str) -> DataFrame:
    """Sections of source documents from heading to heading."""
    return _spans(spark, d)


def structure_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Page breaks, headings and blank runs of source documents."""
    return structure.boundaries(_lines(spark, d), _headings(spark, d))


def table_sections(spark: SparkSession, d: str) -> DataFrame:
    """The section that every table of source documents stands in."""
    points = structure.tables(_lines(spark, d)).select("id", F.col("start").alias("at"), "n_rows")
    return structure.within_spans(points, _spans(spark, d), "at").select("id", "at", "n_rows", "span_start", "span_title")


def scanned_texts(spark: SparkSession, d: str) -> DataFrame:
    """Source documents whose first pages have so little text that they must be scans."""
    found = structure.thin_pages(_docs(spark, d), "id", "content")
    return found.select("id", "n_pages", F.round("mean_chars", 6).alias("mean_chars"), "scanned")


_LINES = r"""
with docs as (select id, max(content) as content, max(file_type) as file_type from source_documents where id is not null group by id),
l as (select id, file_type, string_split(content, chr(10)) as ls from docs where content is not null),
e as (select id, file_type, unnest(ls) as raw, unnest(range(len(ls))) as line_no from l),
o as (select *, sum(length(raw) + 1) over (partition by id order by line_no) - length(raw) - 1 as start, regexp_replace(raw, '^[ \t\r\f]+|[ \t\r\f]+$', '', 'g') as line from e),
k as (select *, length(line) as n, len(regexp_extract_all(line, '[^ \t]+')) as words from o),
tr as (select *, line_no - row_number() over (partition by id order by line_no) as island from k
  where greatest(n - length(replace(line, '|', '')), n - length(replace(line, chr(9), ''))) >= 2 and length(regexp_replace(line, '[| \t]', '', 'g')) > 0
  or words >= 3 and len(regexp_extract_all(line, '[^ \t] {2,}')) >= 2 and length(regexp_replace(line, '[ \t]', '', 'g')) <= 12 * words),
tb as (select id, min(line_no) as first_line, max(line_no) as last_line, min(start) as start, max(start + length(raw)) as stop, count(*) as n_rows, list(raw order by line_no) as rows from tr group by id, island having count(*) > 1),
hk as (select *, case when regexp_matches(line, '^(#{1,6})[ \t]+(.+)$') then 'markdown'
    when regexp_matches(line, '(?i)^(chapter|section|part)[ \t]+([0-9]+|[IVXLC]+)([^\p{L}\p{N}].*)?$') and n <= 80 and not regexp_matches(line, '[.;,]$') then 'chapter'
    when regexp_matches(line, '^([0-9]+(\.[0-9]+){0,3})\.?[ \t]+[^ \t].*$') and n <= 80 and not regexp_matches(line, '[.;,]$') then 'numbered'
    when regexp_matches(line, '\p{Lu}') and not regexp_matches(line, '\p{Ll}') and n between 5 and 80 and words <= 12 and n - length(replace(line, ':', '')) <= 2
      and not regexp_matches(line, '\.$') and not contains(line, '|') then 'capitals' end as kind from k),
h as (select id, line_no, start, kind,
    cast(case kind when 'markdown' then length(regexp_extract(line, '^(#{1,6})[ \t]+(.+)$', 1)) when 'chapter' then 1 when 'capitals' then 2
      else least(4, 1 + length(regexp_extract(line, '^([0-9]+(\.[0-9]+){0,3})\.?[ \t]+[^ \t].*$', 1)) - length(replace(regexp_extract(line, '^([0-9]+(\.[0-9]+){0,3})\.?[ \t]+[^ \t].*$', 1), '.', ''))) end as integer) as level,
    case kind when 'markdown' then regexp_extract(line, '^(#{1,6})[ \t]+(.+)$', 2) else line end as title,
    case kind when 'markdown' then 1.0 when 'chapter' then 0.95 when 'numbered' then 0.9 else 0.6 end as confidence
  from hk where kind is not null and (kind = 'markdown' or coalesce(file_type, '') <> 'md')
  and not exists (select 1 from tb where tb.id = hk.id and hk.line_no between tb.first_line and tb.last_line)),
sz as (select id, length(content) as size from docs where content is not null),
fh as (select sz.id, min(h.start) as first, any_value(size) as size from sz left join h using (id) group by sz.id),
sp as (select id, 0 as start, coalesce(first, size) as stop, cast(null as integer) as level, cast(null as varchar) as title from fh where coalesce(first, size) > 200 or first is null and size > 0
  union all select id, start, coalesce(lead(start) over (partition by id order by start), size), level, title from h join sz using (id))
"""
STRUCTURE_TABLES = _LINES + r"""select id, cast(first_line as integer) as first_line, cast(start as bigint) as start, cast(stop as bigint) as "end", n_rows,
  regexp_matches(rows[2], '^[ |:+-]*-[ |:+-]*$') as has_header, md5(array_to_string(rows, chr(10))) as md5 from tb"""
STRUCTURE_HEADINGS = _LINES + "select id, cast(start as bigint) as start, kind, level, title, cast(confidence as double) as confidence from h"
_AT = ", ".join(f"max(case when level = {k} then line_no end) over w as a{k}, last_value(case when level = {k} then title end ignore nulls) over w as t{k}" for k in range(1, 7))
_ABOVE = ", ".join("case when level > {k} and a{k} > greatest(-1{lesser}) then t{k} end".format(k=k, lesser="".join(f", coalesce(a{j}, -1)" for j in range(1, k))) for k in range(1, 7))
HEADING_PATHS = _LINES + f""", a as (select id, line_no, level, title, {_AT} from h window w as (partition by id order by line_no))
select id, cast(line_no as integer) as line_no, level, concat_ws(' > ', {_ABOVE}, title) as path from a"""
SECTION_SPANS = _LINES + 'select id, cast(start as bigint) as start, cast(stop as bigint) as "end", level, title from sp'
STRUCTURE_BOUNDARIES = _LINES + """, bl as (select *, line_no - row_number() over (partition by id order by line_no) as island from k where line = ''),
b as (select id, start, 'page' as kind, '' as label from k where contains(raw, chr(12)) union all select id, start, 'heading', title from h
  union all select id, min(start), 'blank', '' from bl group by id, island having count(*) >= 3)
select id, cast(min(start) as bigint) as start, kind, label from b group by id, start // 50, kind, label"""
TABLE_SECTIONS = _LINES + """select tb.id, cast(tb.start as bigint) as at, n_rows, cast(sp.start as bigint) as span_start, title as span_title
from tb left join sp on tb.id = sp.id and tb.start >= sp.start and tb.start < sp.stop"""
SCANNED_TEXTS = r"""
with docs as (select id, max(content) as content from source_documents where id is not null group by id),
p as (select id, string_split(coalesce(content, ''), chr(12))[1:5] as ps from docs),
m as (select id, len(ps) as n_pages, list_sum(list_transform(ps, lambda x: length(regexp_replace(x, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')))) / len(ps) as mean from p)
select id, cast(n_pages as integer) as n_pages, round(mean, 6) as mean_chars, mean < 50 as scanned from m
"""

QUERIES = {
    "structure_tables": (structure_tables, STRUCTURE_TABLES),
    "structure_headings": (structure_headings, STRUCTURE_HEADINGS),
    "heading_paths": (heading_paths, HEADING_PATHS),
    "section_spans": (section_spans, SECTION_SPANS),
    "structure_boundaries": (structure_boundaries, STRUCTURE_BOUNDARIES),
    "table_sections": (table_sections, TABLE_SECTIONS),
    "scanned_texts": (scanned_texts, SCANNED_TEXTS),
}
