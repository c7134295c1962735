"""Cutting documents into chunks: one document row to many chunk rows.

The strategies that are sums over rows (Markdown sections, row groups) are DataFrame operations.
Those that pack greedily, where each cut depends on the last, run per document in Arrow batches.
"""

from __future__ import annotations

import ast
import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    import yaml
except ImportError:  # only YAML files need it
    yaml = None

from docweave.functions.text import is_numeric_piece, is_table_row, token_count
from docweave.session import staged

Span = tuple[str, int, int]

#: Suffix -> strategy; others get `semantic`.
STRATEGIES = {
    ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".csv": "row_group", ".json": "json", ".yaml": "yaml", ".yml": "yaml",
    ".ipynb": "notebook", ".py": "code", ".js": "code", ".ts": "code", ".java": "code", ".cs": "code", ".cpp": "code", ".c": "code", ".go": "code", ".rs": "code",
}


def tokens(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def packed(parts: list[str], glue: str, limit: int, size: Callable[[str], int], repeat: Callable[[int], int] | None = None) -> list[Span]:
    """Parts joined greedily while their sizes fit `limit`; `repeat` says how many parts of a chunk begin the next."""
    out: list[Span] = []
    starts, at = [], 0
    for p in parts:
        starts.append(at)
        at += len(p) + len(glue)
    first, total = 0, 0
    for i, p in enumerate(parts):
        n = size(p)
        if total + n > limit and i > first:
            out.append((glue.join(parts[first:i]), starts[first], starts[i] - len(glue)))
            first = i - (repeat(i - first) if repeat else 0)
            total = sum(size(q) for q in parts[first:i])
        total += n
    if len(parts) > first:
        out.append((glue.join(parts[first:]), starts[first], at - len(glue)))
    return out


def fixed(text: str, limit: int = 500) -> list[Span]:
    """Lines packed with half of the lines before repeated; words without repeats where there are no lines."""
    if not text:
        return []
    if "\n" in text:
        return packed(text.split("\n"), "\n", limit, lambda line: tokens(line + "\n"), lambda n: max(1, n // 2))
    return packed(text.split(), " ", limit, lambda word: max(1, (len(word) + 1) // 4))


def sliding(text: str, limit: int = 500, overlap: int = 50) -> list[Span]:
    """Windows of words of at least `limit` estimated tokens; each next one repeats the share `overlap` of the words."""
    words = (text or "").split()
    sizes = [len(w) // 4 + 1 for w in words]
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    out: list[Span] = []
    first, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= limit:
            out.append((" ".join(words[first : i + 1]), starts[first], starts[i + 1] - 1))
            following = max(first + 1, i - (i + 1 - first) * overlap // limit + 1)
            total -= sum(sizes[first:following])
            first = following
    if first < len(words):
        out.append((" ".join(words[first:]), starts[first], starts[-1] - 1))
    return out


def paragraphs(text: str, limit: int = 500) -> list[Span]:
    return packed(text.split("\n\n"), "\n\n", limit, tokens) if text else []


_HEADING = re.compile(r"^(?:(?P<chapter>(?:chapter|section|part)\s+[\dIVXLC]+.*)|(?P<number>\d+(?:\.\d+){0,3})\.?\s+\S.*|(?P<md>#{1,6})\s+(?P<title>.+))$", re.I)


def heading_level(line: str) -> int:
    """Level of a heading line, 0 for other lines: chapters 1, numbered ones by their dots, capitals 2, # signs."""
    s = line.strip()
    m = _HEADING.match(s)
    if m and m["md"]:
        return len(m["md"])
    if m and len(s) <= 80 and not s.endswith((".", ";", ",")):
        return 1 if m["chapter"] else min(4, m["number"].count(".") + 1)
    capitals = 5 <= len(s) <= 80 and s.upper() == s and any(c.isalpha() for c in s) and len(s.split()) <= 12
    return 2 if capitals and not s.endswith(".") and s.count(":") <= 2 and "|" not in s else 0


def table_line(line: str) -> bool:
    s = line.strip()
    return s.count("|") >= 2 or line.count("\t") >= 2 or (len(re.findall(r"\S {2,}\S", s)) >= 2 and len(s.split()) >= 3)


def blocks(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, heading, start, end) of the tables (two or more rows) and texts of each section."""
    out: list[tuple[str, str, int, int]] = []
    heading, at, lines = "", 0, text.split("\n")
    kinds = [table_line(x) for x in lines]
    for i, line in enumerate(lines):
        end = at + len(line)
        table = kinds[i] and (i > 0 and kinds[i - 1] or i + 1 < len(lines) and kinds[i + 1])
        level = 0 if table else heading_level(line)
        if level:
            heading = line.strip().lstrip("# ")
        kind = "table" if table else "text"
        if out and not level and out[-1][0] == kind and out[-1][1] == heading:
            out[-1] = (*out[-1][:3], end)
        else:
            out.append((kind, heading, at, end))
        at = end + 1
    return out


def semantic(text: str, limit: int = 500, share: float = 0.15) -> list[Span]:
    """Sections whole where they fit; long ones packed by sentences with a repeated share; tables never cut, never repeated."""
    out: list[Span] = []
    for kind, _, start, end in blocks(text or ""):
        body = text[start:end]
        if not body.strip():
            continue
        if kind == "table" or tokens(body) <= limit:
            out.append((body, start, end))
            continue
        parts = [m.span() for m in re.finditer(r"\S.*?(?:[.!?](?=\s)|\Z)", body, re.S)]
        first, total = 0, 0
        for i, (a, b) in enumerate(parts):
            n = tokens(body[a:b])
            if total + n > limit and i > first:
                out.append((body[parts[first][0] : parts[i - 1][1]], start + parts[first][0], start + parts[i - 1][1]))
                kept, back = 0, i
                while back - 1 > first and kept + tokens(body[slice(*parts[back - 1])]) <= share * limit:
                    back -= 1
                    kept += tokens(body[slice(*parts[back])])
                first, total = back, kept
            total += n
        out.append((body[parts[first][0] : parts[-1][1]], start + parts[first][0], start + parts[-1][1]))
    return out


class _Blocks(HTMLParser):
    """Texts of headings, paragraphs and containers in document order; nested ones again in their parents."""

    KEPT = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "div", "article", "section"}
    SKIPPED = {"script", "style", "nav", "footer", "header", "aside"}
    EMPTY = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.texts: list[tuple[str, list[str]]] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.EMPTY:
            return
        if tag in self.SKIPPED:
            self.skip += 1
        number = -1
        if tag in self.KEPT and not self.skip:
            number = len(self.texts)
            self.texts.append((tag, []))
        self.open.append((tag, number))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open:
                t, _ = self.open.pop()
                if t in self.SKIPPED:
                    self.skip -= 1
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.skip and data.strip():
            for _, number in self.open:
                if number >= 0:
                    self.texts[number][1].append(data.strip())


def html(text: str, limit: int = 500) -> list[Span]:
    parser = _Blocks()
    parser.feed(text or "")
    parser.close()
    return packed(["".join(parts) for _, parts in parser.texts if parts], "\n\n", limit, tokens)


_DECLARATION = re.compile(r"^[ \t]*(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|pub|unsafe|extern|inline|virtual|template\s*<[^>]*>)\s+)*(?:(?:class|interface|struct|enum|trait|impl|namespace|func|fn|function)\b[^{};]*|[\w<>\[\],:*&.\s]+\([^;{}]*\)[^;{}]*|(?:const|let|var)\s+\w+\s*=[^;{}]*)$")


def braced(text: str) -> list[tuple[int, int]]:
    """Places of the outermost classes and functions of a language with braces."""
    out, depth, begun, from_ = [], 0, None, 0
    for m in re.finditer(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[{};]", text, re.S):
        sign = m.group()
        if sign == "{":
            if depth == 0:
                head = text[from_ : m.start()]
                begun = from_ + len(head) - len(head.lstrip()) if head.strip() and _DECLARATION.match(head.strip()) else None
            depth += 1
        elif sign == "}" and depth:
            depth -= 1
            if depth == 0:
                if begun is not None:
                    out.append((begun, m.end()))
                from_ = m.end()
        elif depth == 0 and (sign == ";" or sign[:2] in ("//", "/*")):
            from_ = m.end()
    return out


def code(text: str, suffix: str = ".py", limit: int = 500) -> list[Span]:
    """Top-level functions and classes of Python, outermost ones of languages with braces; fixed-size chunks where there are none."""
    out: list[Span] = []
    text = text or ""
    if suffix == ".py":
        try:
            lines = text.split("\n")
            starts = [0]
            for line in lines:
                starts.append(starts[-1] + len(line) + 1)
            for node in ast.parse(text).body:
                if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    a, b = starts[node.lineno - 1], starts[node.end_lineno] - 1
                    out.append((text[a:b], a, b))
        except (SyntaxError, ValueError, MemoryError, RecursionError):  # also too deep to parse
            out = []
    else:
        out = [(text[a:b], a, b) for a, b in braced(text)]
    return out or fixed(text, limit)


def key_paths(value: object, path: str = "") -> list[tuple[str, str]]:
    """(path, text) of all leaves of a JSON value: a.b, a[0]."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in key_paths(v, f"{path}.{k}" if path else str(k))]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in key_paths(v, f"{path}[{i}]")]
    return [(path, str(value))]


def _by_key(value: object) -> list[Span]:
    parts = value.items() if isinstance(value, dict) else [(f"[{i}]", v) for i, v in enumerate(value)] if isinstance(value, list) else []
    found = ["\n".join(f"{p}: {v}" for p, v in key_paths(part, str(key))) for key, part in parts]
    return packed(found, "\n\n", 0, lambda _: 1)


def json_keys(text: str) -> list[Span]:
    """One chunk per top-level key or item, with the paths of its leaves; none for bare values and broken JSON."""
    try:
        return _by_key(json.loads(text or ""))
    except (ValueError, RecursionError):
        return []


def yaml_keys(text: str) -> list[Span]:
    """The same of YAML; fixed-size chunks for bare values, broken YAML, and where no YAML reader is installed."""
    try:
        return (_by_key(yaml.safe_load(text or "")) if yaml else []) or fixed(text)
    except (yaml.YAMLError, ValueError, RecursionError):
        return fixed(text)


def markdown(text: str, limit: int = 500) -> list[Span]:
    """Header sections; those over the limit are packed by paragraphs."""
    heads = [m.start() for m in re.finditer(r"^#{1,6}[ \t]+[^ \t\r\n]", text or "", re.M)]
    out: list[Span] = []
    for a, b in zip([0, *heads], [*heads, len(text or "")]):
        out += [(t, a + x, a + y) for t, x, y in packed(text[a:b].split("\n\n"), "\n\n", limit, tokens) if t.strip()] if a < b else []
    return out


def delimiter_of(line: str) -> str:
    """The first of tab, bar, semicolon and comma that is there twice; else a comma."""
    return next((d for d in "\t|;," if line.count(d) >= 2), ",")


def text_columns(columns: list[str]) -> tuple[str | None, str | None]:
    """The question and the answer column of a table, by their names."""
    ask = next((c for c in columns if re.search(r"question|query|prompt", c, re.I)), None)
    say = next((c for c in columns if re.search(r"answer|response|reply", c, re.I)), None)
    return ask, say


def csv_rows(text: str, size: int = 50, most_value: int = 2000) -> list[Span]:
    """One chunk per row of a table of questions and answers, else groups of `size` rows as `column: value`.

    Rows with another number of cells are left out; long values end with an ellipsis.
    """
    rows = list(csv.reader(io.StringIO(text or ""), delimiter=delimiter_of((text or "").split("\n", 1)[0])))
    if len(rows) < 2:
        return []
    names, body = rows[0], [r for r in rows[1:] if len(r) == len(rows[0])]
    ask, say = text_columns(names)
    if ask and say:
        a, b = names.index(ask), names.index(say)
        return packed([f"Question: {r[a]}\nAnswer: {r[b]}" for r in body if r[a].strip() and r[b].strip()], "\n\n", 0, lambda _: 1)
    said = [" | ".join(f"{n}: {v if len(v) <= most_value else v[:most_value] + '...'}" for n, v in zip(names, r) if v.strip()) for r in body]
    return packed(["\n".join(said[i : i + size]) for i in range(0, len(said), size)], "\n\n", 0, lambda _: 1)


def notebook(text: str, limit: int = 500) -> list[Span]:
    """Code cells as code, Markdown cells whole; outputs and raw cells are left out."""
    try:
        cells = json.loads(text or "").get("cells", [])
    except (ValueError, AttributeError):
        return []
    out: list[str] = []
    for cell in cells:
        source = cell.get("source", "")
        source = "".join(source) if isinstance(source, list) else source
        if cell.get("cell_type") == "code":
            out += [t for t, *_ in code(source, ".py", limit)]
        elif cell.get("cell_type") == "markdown" and source.strip():
            out.append(source)
    return packed(out, "\n\n", 0, lambda _: 1)


CHUNKERS: dict[str, Callable[[str], list[Span]]] = {
    "fixed": fixed, "sliding": sliding, "paragraph": paragraphs, "semantic": semantic, "html": html, "code": code, "json": json_keys, "yaml": yaml_keys,
    "notebook": notebook, "markdown": markdown, "row_group": csv_rows,
}


def chunks(docs: DataFrame, id_col: str, text_col: str, strategy: str, least_chars: int = 50, **options: object) -> DataFrame:
    """(id, chunk_id, chunk_index, text, start_char, end_char, token_count, strategy) of every document.

    Chunks of fewer than `least_chars` characters (trimmed) are left out, and leave a gap in
    chunk_index. Null and empty texts have none. A repeated id gives its chunks again. Other
    columns are not looked at.
    """
    return _cut(docs, id_col, text_col, F.lit(strategy), F.lit(".py"), least_chars, options)


def routed_chunks(docs: DataFrame, id_col: str, text_col: str, name_col: str, least_chars: int = 50) -> DataFrame:
    """The same, each document by the strategy of its file name."""
    return _cut(docs, id_col, text_col, strategy_of(F.col(name_col)), F.lower(F.regexp_extract(name_col, r"(\.[^.]*)$", 1)), least_chars, {})


def _cut(docs: DataFrame, id_col: str, text_col: str, strategy: F.Column, suffix: F.Column, least_chars: int, options: dict) -> DataFrame:
    kind = docs.schema[id_col].dataType
    names = ["id", "strategy", "chunk_index", "text", "start_char", "end_char"]
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(n, T.StringType() if n in ("strategy", "text") else T.IntegerType()) for n in names[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (text, how, ending) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                cut = CHUNKERS[how](text or "", ending, **options) if how == "code" else CHUNKERS[how](text or "", **options)
                rows += [(i, how, n, *span) for n, span in enumerate(cut) if len(span[0].strip()) >= least_chars]
            column = lambda j, kind: pa.array([r[j] for r in rows], kind)
            ids = batch.column(0).take(column(0, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, column(1, pa.string()), column(2, pa.int32()), column(3, pa.string()), column(4, pa.int32()), column(5, pa.int32())], names)

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), strategy.alias("strategy"), suffix.alias("suffix")).mapInArrow(run, schema)
    name = F.concat(F.col("id").cast("string"), F.lit("_chunk_"), F.lpad(F.col("chunk_index").cast("string"), 5, "0"))
    return found.select(F.col("id").alias(id_col), name.alias("chunk_id"), "chunk_index", "text", "start_char", "end_char", token_count("text").alias("token_count"), "strategy")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line): one row per line, from 0, without line ends; none for null."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\r?\n")).alias("line_no", "line"))


def markdown_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section_no, title, level, n_lines, text): one row per header section; the part before the first has number 0.

    Sections are running counts of headers over a document's lines. Ids must be unique.
    """
    lines = lines_of(docs, id_col, text_col).withColumn("marks", F.regexp_extract("line", r"^(#{1,6})\s+.+$", 1))
    number = F.sum(F.when(F.col("marks") != "", 1).otherwise(0)).over(Window.partitionBy(id_col).orderBy("line_no"))
    parts = lines.withColumn("section_no", number).groupBy(id_col, "section_no")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    title = F.trim(F.max(F.when(F.col("marks") != "", F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1))))
    return parts.agg(title.alias("title"), F.max(F.length("marks")).cast("int").alias("level"), F.count("*").alias("n_lines"), body.alias("text"))


def table_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, first_line, n_rows): runs of two or more table rows, as islands of line numbers."""
    rows = lines_of(docs, id_col, text_col).where(is_table_row("line"))
    island = F.col("line_no") - F.row_number().over(Window.partitionBy(id_col).orderBy("line_no"))
    return rows.withColumn("island", island).groupBy(id_col, "island").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_rows")).where("n_rows > 1").drop("island")


def rendered_rows(rows: DataFrame, columns: list[str]) -> F.Column:
    """A row as `column: value` parts, null values left out."""
    return F.concat_ws(" | ", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns))


def numbered_within(rows: DataFrame, order: str, within: str, parts: int | None = None) -> DataFrame:
    """Adds `place`, from 0: a row's number in its key by `order`, whatever the keys' sizes.

    Rows are sorted by key and order in ranges, so a hot key spreads over many tasks; a row's number
    is its number in its range and the rows of its key in the ranges before, which are counted first.
    """
    ranged = rows.repartitionByRange(*([parts] if parts else []), within, order).withColumn("__range", F.spark_partition_id())
    ranged = staged(ranged, "ranges")
    before = Window.partitionBy(within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(within, "__range").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    here = F.row_number().over(Window.partitionBy(within, "__range").orderBy(order)) - 1
    key = F.col(within).eqNullSafe(F.col("__key"))
    counts = counts.withColumnsRenamed({within: "__key", "__range": "__its"})
    return ranged.withColumn("__here", here).join(counts, key & (F.col("__range") == F.col("__its"))).withColumn("place", F.col("__here") + F.col("__before")).drop("__range", "__its", "__key", "__here", "__before")


def row_groups(rows: DataFrame, order: str, columns: list[str], size: int = 50, within: str | None = None, most_chars: int = 25000) -> DataFrame:
    """(within, group_no, part_no, n_rows, text): rendered rows in groups of `size`, by `order`; figure-only groups are left out.

    `within` names the file or key whose rows are numbered together; without it `order` must be a
    dense number from 0, and gives the group. A group longer than `most_chars` is parted at rows; no
    row is left out or cut.
    """
    keys = [within] if within else []
    placed = numbered_within(rows, order, within) if within else rows.withColumn("place", F.col(order))
    numbered = placed.withColumn("group_no", F.floor(F.col("place") / size).cast("int")).withColumn("rendered", rendered_rows(rows, columns))
    upto = Window.partitionBy(*keys, "group_no").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum(F.length("rendered") + 1).over(upto), F.lit(0)) / most_chars).cast("int")
    parts = numbered.withColumn("part_no", part).groupBy(*keys, "group_no", "part_no").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "rendered"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["rendered"]), "\n")
    return parts.select(*keys, "group_no", "part_no", F.size("parts").alias("n_rows"), text.alias("text")).where(~is_numeric_piece("text") & (F.length("text") > 20))


def strategy_of(name: F.Column) -> F.Column:
    """The chunk strategy of a file name."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    out = F.lit("semantic")
    for s, strategy in STRATEGIES.items():
        out = F.when(suffix == s, strategy).otherwise(out)
    return out
