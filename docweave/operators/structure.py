"""Structure of texts: lines with offsets, tables, headings with their paths, sections, boundaries.

All are windows and islands over a document's lines; a window holds the lines of one document.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Heading patterns, with their confidence.
CHAPTER = r"(?i)^(chapter|section|part)[ \t]+([0-9]+|[IVXLC]+)([^\p{L}\p{N}].*)?$"
NUMBERED = r"^([0-9]+(\.[0-9]+){0,3})\.?[ \t]+[^ \t].*$"
MARKDOWN = r"^(#{1,6})[ \t]+(.+)$"
CONFIDENCE = {"markdown": 1.0, "chapter": 0.95, "numbered": 0.9, "capitals": 0.6}


def lines(docs: DataFrame, id_col: str, text_col: str, *kept: str) -> DataFrame:
    """(id, *kept, line_no, start, raw, line): every line from 0 with its offset, and without spaces around; none for null."""
    parts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), *kept, F.posexplode(F.split(text_col, "\n")).alias("line_no", "raw"))
    start = F.sum(F.length("raw") + 1).over(Window.partitionBy("id").orderBy("line_no")) - F.length("raw") - 1
    return parts.select("id", *kept, "line_no", start.alias("start"), "raw", F.regexp_replace("raw", r"^[ \t\r\f]+|[ \t\r\f]+$", "").alias("line"))


def looks_tabular(line: Column | str) -> Column:
    """Two bars or tabs beside text, or three or more short tokens with two or more wide gaps."""
    c = F.col(line) if isinstance(line, str) else line
    signs = F.greatest(F.length(c) - F.length(F.translate(c, "|", "")), F.length(c) - F.length(F.translate(c, "\t", "")))
    said = F.translate(c, "| \t", "")
    tokens = F.size(F.regexp_extract_all(c, F.lit(r"([^ \t]+)"), 1))
    gaps = F.size(F.regexp_extract_all(c, F.lit(r"([^ \t] {2,})"), 1))
    return (signs >= 2) & (F.length(said) > 0) | (tokens >= 3) & (gaps >= 2) & (F.length(F.translate(c, " \t", "")) <= 12 * tokens)


def tables(all_lines: DataFrame) -> DataFrame:
    """(id, first_line, last_line, start, end, n_rows, has_header, text) of runs of two or more table lines."""
    rows = all_lines.where(looks_tabular("line"))
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("id").orderBy("line_no"))
    g = rows.withColumn("island", island).groupBy("id", "island")
    listed = F.array_sort(F.collect_list(F.struct("line_no", "raw")))
    found = g.agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.min("start").alias("start"), F.max(F.col("start") + F.length("raw")).alias("end"),
        F.count("*").alias("n_rows"), listed.alias("rows"),
    )
    header = F.coalesce(F.element_at("rows", 2)["raw"].rlike(r"^[ |:+-]*-[ |:+-]*$"), F.lit(False))
    text = F.array_join(F.transform("rows", lambda r: r["raw"]), "\n")
    return found.where("n_rows > 1").select("id", "first_line", "last_line", "start", "end", "n_rows", header.alias("has_header"), text.alias("text"))


def heading_of(line: Column) -> tuple[Column, Column, Column]:
    """(kind, level, title) of a line that is a heading; nulls else."""
    short = F.length(line) <= 80
    chapter = line.rlike(CHAPTER) & short & ~line.rlike(r"[.;,]$")
    numbered = line.rlike(NUMBERED) & short & ~line.rlike(r"[.;,]$")
    words = F.size(F.regexp_extract_all(line, F.lit(r"([^ \t]+)"), 1))
    colons = F.length(line) - F.length(F.translate(line, ":", ""))
    capitals = line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}") & F.length(line).between(5, 80) & (words <= 12) & (colons <= 2) & ~line.rlike(r"\.$") & ~line.contains("|")
    kind = F.when(line.rlike(MARKDOWN), "markdown").when(chapter, "chapter").when(numbered, "numbered").when(capitals, "capitals")
    number = F.regexp_extract(line, NUMBERED, 1)
    dots = F.length(number) - F.length(F.translate(number, ".", ""))
    level = F.when(kind == "markdown", F.length(F.regexp_extract(line, MARKDOWN, 1))).when(kind == "chapter", 1).when(kind == "numbered", F.least(dots + 1, F.lit(4))).when(kind == "capitals", 2)
    return kind, level.cast("int"), F.when(kind == "markdown", F.regexp_extract(line, MARKDOWN, 2)).otherwise(line)


def headings(all_lines: DataFrame, markdown: Column) -> DataFrame:
    """(id, line_no, start, kind, level, title, confidence). Of documents where `markdown` holds only # headings; none within tables."""
    inside = tables(all_lines).select("id", F.explode(F.sequence("first_line", "last_line")).alias("line_no"))
    kind, level, title = heading_of(F.col("line"))
    found = all_lines.withColumns({"kind": kind, "level": level, "title": title}).where(F.col("kind").isNotNull() & (~markdown | (F.col("kind") == "markdown")))
    confidence = F.create_map(*(F.lit(x) for pair in CONFIDENCE.items() for x in pair))[F.col("kind")]
    return found.join(inside, ["id", "line_no"], "left_anti").select("id", "line_no", "start", "kind", "level", "title", confidence.alias("confidence"))


def heading_paths(found: DataFrame) -> DataFrame:
    """(id, line_no, level, path): the titles above a heading, outermost first, and its own.

    A heading stands above while no heading of its level or a lesser one has come after it.
    """
    w = Window.partitionBy("id").orderBy("line_no")
    last = {k: F.last(F.when(F.col("level") == k, F.struct("line_no", "title")), ignorenulls=True).over(w) for k in range(1, 7)}
    rows = found.select("id", "line_no", "level", "title", *(c.alias(f"at{k}") for k, c in last.items()))
    parts = []
    for k in range(1, 7):
        lesser = F.greatest(F.lit(-1), *(F.coalesce(F.col(f"at{j}.line_no"), F.lit(-1)) for j in range(1, k))) if k > 1 else F.lit(-1)
        parts.append(F.when((F.col("level") > k) & (F.col(f"at{k}.line_no") > lesser), F.col(f"at{k}.title")))
    return rows.select("id", "line_no", "level", F.array_append(F.filter(F.array(*parts), lambda x: x.isNotNull()), F.col("title")).alias("path"))


def section_spans(found: DataFrame, sizes: DataFrame, keep_preamble: int = 200) -> DataFrame:
    """(id, start, end, level, title): from each heading to the next, the last to the end of the text.

    `sizes` has (id, size). What stands before a first heading is a section without a title if it
    has more than `keep_preamble` characters; a text without headings is one such section.
    """
    following = F.lead("start").over(Window.partitionBy("id").orderBy("start"))
    spans = found.select("id", "start", following.alias("end"), "level", "title").join(sizes, "id").withColumn("end", F.coalesce("end", "size"))
    first = sizes.join(found.groupBy("id").agg(F.min("start").alias("first")), "id", "left").withColumn("end", F.coalesce("first", "size"))
    before = first.where((F.col("end") > keep_preamble) | F.col("first").isNull() & (F.col("end") > 0))
    before = before.select("id", F.lit(0).cast("long").alias("start"), "end", F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("title"))
    return before.unionByName(spans.select("id", "start", "end", "level", "title"))


def boundaries(all_lines: DataFrame, found: DataFrame) -> DataFrame:
    """(id, start, kind, label): page breaks, headings and runs of three or more blank lines; of equal ones within 50 characters the first."""
    pages = all_lines.where(F.col("raw").contains("\f")).select("id", "start", F.lit("page").alias("kind"), F.lit("").alias("label"))
    heads = found.select("id", "start", F.lit("heading").alias("kind"), F.col("title").alias("label"))
    blank = all_lines.where("line = ''").withColumn("island", F.col("line_no") - F.row_number().over(Window.partitionBy("id").orderBy("line_no")))
    gaps = blank.groupBy("id", "island").agg(F.min("start").alias("start"), F.count("*").alias("n")).where("n >= 3").select("id", "start", F.lit("blank").alias("kind"), F.lit("").alias("label"))
    every = pages.unionByName(heads).unionByName(gaps)
    return every.groupBy("id", F.floor(F.col("start") / 50).alias("near"), "kind", "label").agg(F.min("start").alias("start")).select("id", "start", "kind", "label")


def within_spans(points: DataFrame, spans: DataFrame, at: str) -> DataFrame:
    """Rows of `points` with the span (start, end, level, title) of their document that holds their offset; nulls where none does."""
    s = spans.select("id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("level").alias("span_level"), F.col("title").alias("span_title"))
    return points.join(s, (points["id"] == s["id"]) & (points[at] >= s["span_start"]) & (points[at] < s["span_end"]), "left").drop(s["id"])


def thin_pages(docs: DataFrame, id_col: str, text_col: str, pages: int = 5, least: int = 50) -> DataFrame:
    """(id, n_pages, mean_chars, scanned): mean length of the first pages (parted by form feeds), and whether it is so
    small that the text must be a scan without text; a null text counts as one empty page."""
    parts = F.slice(F.split(F.coalesce(text_col, F.lit("")), "\f"), 1, pages)
    total = F.aggregate(parts, F.lit(0), lambda a, p: a + F.length(F.regexp_replace(p, r"^[ \t\r\n]+|[ \t\r\n]+$", "")))
    mean = total / F.size(parts)
    return docs.select(F.col(id_col).alias("id"), F.size(parts).alias("n_pages"), mean.alias("mean_chars"), (mean < least).alias("scanned"))
