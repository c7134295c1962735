"""Text functions as Spark columns: counts, tokens, normal forms, keys, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words the index leaves out.
INDEX_STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its "
    "itself they them their theirs themselves what which who whom this that these those am is are was were be been being have "
    "has had having do does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will "
    "just don should now"
).split()

#: Words that are no keywords.
KEYWORD_STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need dare "
    "ought used to of in for on with at by from as into through during before after above below between out off over under "
    "again further then once here there when where why how all both each few more most other some such no nor not only own "
    "same so than too very just because but and or if while this that these those it its he she they them we us you your my "
    "his her their our what which who whom also about up one two three"
).split()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_count(text: Column | str) -> Column:
    """Estimated tokens: none for empty or null text, else a quarter of the characters, at least 1."""
    n = F.length(col(text))
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int")


def sentences(text: Column | str) -> Column:
    """Sentences: parts after . ! ? and white space. Null for null."""
    return F.split(col(text), r"(?<=[.!?])\s+")


def index_tokens(text: Column | str) -> Column:
    """Lower-cased words of two or more characters without stop words, repeats kept; empty for null."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{N}_\s]", " "), r"\s+")
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(INDEX_STOPWORDS))


def keyword_tokens(text: Column | str) -> Column:
    """Runs of three or more Latin letters, lower-cased, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(r"([a-z]{3,})"), 1)
    return F.filter(found, lambda t: ~t.isin(KEYWORD_STOPWORDS))


def normal_query(query: Column | str) -> Column:
    """A query lower-cased, trimmed, with single spaces."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(query)), r"\s+", " "), r"^ | $", "")


def cache_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by colons; null parts are left out."""
    return F.sha2(F.concat_ws(":", *(col(p).cast("string") for p in parts)), 256)


def without_thoughts(answer: Column | str) -> Column:
    """An answer without its <think> blocks, trimmed."""
    return F.trim(F.regexp_replace(col(answer), r"(?s)<think>.*?</think>", ""))


def without_fence(answer: Column | str) -> Column:
    """A model's JSON answer without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(col(answer)), r"(?s)^```[a-zA-Z]*\s*", ""), r"(?s)\s*```$", ""))


def is_numeric_piece(text: Column | str) -> Column:
    """Whether the first 100 characters are digits only, apart from separators and `nan`."""
    head = F.regexp_replace(F.translate(F.lower(F.substring(col(text), 1, 100)), "|,\n .-", ""), "nan", "")
    return head.rlike("^[0-9]+$")


def is_table_row(line: Column | str) -> Column:
    """Whether a line looks like a table row: two bars, two tabs, or two wide gaps between words."""
    c = col(line)
    bars = F.length(c) - F.length(F.translate(c, "|", ""))
    tabs = F.length(c) - F.length(F.translate(c, "\t", ""))
    gaps = F.size(F.regexp_extract_all(F.trim(c), F.lit(r"(\S {2,})"), 1))
    words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return (bars >= 2) | (tabs >= 2) | ((gaps >= 2) & (words >= 3))


def file_hash(content: Column | str, end: int = 32768) -> Column:
    """MD5 of a binary column's size and its two ends."""
    c, n = col(content), F.length(col(content))
    return F.md5(F.concat(n.cast("string").cast("binary"), F.substring(c, 1, end), F.when(n > end, F.substring(c, -end, end)).otherwise(F.lit(b""))))


def unit(vector: Column | str) -> Column:
    """A vector scaled to length 1; a zero vector stays as it is."""
    v = F.transform(col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def safe_double(value: Column | str) -> Column:
    return F.coalesce(F.expr(f"try_cast({value} as double)") if isinstance(value, str) else value.try_cast("double"), F.lit(0.0))


def resolved_score(**scores: Column | str) -> Column:
    """First of similarity, score, reranker and rrf that is there; else 1 - distance for a distance of 0 to 1; else 0."""
    named = [col(scores[n]) for n in ("similarity", "score", "reranker", "rrf") if n in scores]
    d = col(scores["distance"]) if "distance" in scores else F.lit(None).cast("double")
    return F.coalesce(*named, F.when(d.between(0, 1), 1 - d), F.lit(0.0))


def query_error(query: Column | str, least: int = 3, most: int = 5000) -> Column:
    """Why a query is refused: `empty`, `too_short`, `too_long`; null if it isn't."""
    n = F.length(F.trim(F.coalesce(col(query), F.lit(""))))
    return F.when(n == 0, "empty").when(n < least, "too_short").when(n > most, "too_long")


def shortened(text: Column | str, most: int, mark: str = "...") -> Column:
    """A text of more than `most` characters cut there, with a mark; for display and prompts, never for stored texts."""
    c = col(text)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def question_lines(answer: Column | str, most: int) -> Column:
    """Lines that end with a question mark, without bullets and numbers before them; the first `most`."""
    bare = F.transform(F.split(col(answer), "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^[ \t]*([-*•]|[0-9]+[.)])?[ \t]*", ""), r"[ \t\r]+$", ""))
    return F.slice(F.filter(bare, lambda x: x.endswith("?")), 1, most)


def summary_parts(answer: Column | str, n: int) -> Column:
    """An answer parted at lines of three dashes, trimmed, as exactly `n` parts: missing ones empty, others left out."""
    parts = F.transform(F.split(col(answer), r"---"), lambda x: F.regexp_replace(x, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(""), n)), 1, n)


def session_hash(content: Column | str, end: int = 8192) -> Column:
    """16 hex digits of the SHA-256 of a binary column's size and its two ends."""
    c, n = col(content), F.length(col(content))
    return F.substring(F.sha2(F.concat(n.cast("string").cast("binary"), F.substring(c, 1, end), F.when(n > end, F.substring(c, -end, end)).otherwise(F.lit(b""))), 256), 1, 16)


def verdict(answer: Column | str) -> Column:
    """(relevance, faithfulness, completeness) of a model's JSON answer, within 0..1; 0.5 where missing or broken."""
    parsed = F.from_json(without_fence(answer), "relevance double, faithfulness double, completeness double")
    part = lambda n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(parsed[n], F.lit(0.5)))).alias(n)
    return F.struct(part("relevance"), part("faithfulness"), part("completeness"))


def first_of(*columns: Column | str) -> Column:
    """The first of some columns that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(col(c)) != "", col(c)) for c in columns))
