"""Understanding queries: classes, routes, follow-ups, sensitivity, escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions.text import col

#: Phrases of the query classes, in the order in which they are tried.
PROCEDURAL = ["step by step", "process", "procedure", "how to file", "how do i"]
AMBIGUOUS = ["my rights", "what are rights", "help me", "what should i do"]
COMPARATIVE = ["compare", "versus", "vs", "difference between", "better than", "worse than"]
SUMMARIZATION = ["summarize", "summary", "overview", "recap", "tldr"]
ANALYTICAL = ["why", "how does", "explain", "analyze", "evaluate", "what causes"]
FOLLOW_UP = r"(?i)^(what about|how about|and what about|in that case|then what|what if|and|also|so)\b"
TRIVIAL = (
    r"(?i)^((hi|hello|hey|greetings|good\s+(morning|afternoon|evening))[\s!.]*|(thanks|thank\s+you|bye|goodbye|cheers)[\s!.]*|"
    r"(yes|no|ok|okay|sure|alright)[\s!.]*|what\s+is\s+(a|an)\s+\w+\??|who\s+are\s+you\??)$"
)
SENSITIVE = (
    r"(?i)salary|compensation|pay\s*grade|password|secret|api.?key|credentials|private.?key|ignore\s+(all\s+)?previous\s+instructions|"
    r"internal\s+only|confidential|restricted|classified|personal\s+data|employee\s+record|social\s+security|bank\s+account|credit\s+card|"
    r"routing\s+number|system\s+prompt|reveal\s+your\s+instructions|pretend\s+(you\s+are|to\s+be)|act\s+as\s+if"
)
#: Class, decision, top k (null: as asked), pool multiplier, rerank by force, reranked rows, style.
ROUTES = [
    ("trivial", "direct_llm", None, None, False, None, None),
    ("factual", "single_agent", None, 2, False, None, None),
    ("follow_up", "single_agent", 6, 3, True, None, None),
    ("summarization", "single_agent", 10, 3, False, None, None),
    ("procedural", "single_agent", 8, 4, True, 8, None),
    ("ambiguous", "single_agent", 12, 4, True, 12, "structured_scenarios"),
    ("analytical", "multi_agent", 6, 4, True, None, None),
    ("comparative", "multi_agent", 4, 4, True, None, None),
    ("multi_hop", "multi_agent", 4, 4, True, None, None),
]
FOLLOW_UP_STARTS = r"(?i)^(what about|how about|and|also|then|in that case|what if)"


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\s+"), lambda w: w != ""))


def query_class(query: Column | str) -> Column:
    """The class of a query by its phrases, looked for anywhere in it; factual if none fits, null for null."""
    q = F.lower(F.trim(col(query)))
    words = word_count(query)

    def any_of(phrases: list[str]) -> Column:
        found = F.lit(False)
        for p in phrases:
            found = found | q.contains(p)
        return found

    return (
        F.when(col(query).isNull(), None)
        .when(F.trim(col(query)).rlike(TRIVIAL), "trivial")
        .when((words <= 7) & q.rlike(FOLLOW_UP), "follow_up")
        .when(any_of(PROCEDURAL), "procedural")
        .when((words <= 8) & any_of(AMBIGUOUS), "ambiguous")
        .when(any_of(COMPARATIVE), "comparative")
        .when(any_of(SUMMARIZATION), "summarization")
        .when(any_of(ANALYTICAL), "analytical")
        .otherwise("factual")
    )


def route_rules(spark: SparkSession) -> DataFrame:
    """The nine routing rules, one row per class."""
    return spark.createDataFrame(ROUTES, "query_class string, decision string, top_k int, pool int, force_rerank boolean, rerank_k int, style string")


def routed(queries: DataFrame, class_col: str = "query_class") -> DataFrame:
    """Queries with their route; an unknown class is taken as factual."""
    rules = route_rules(queries.sparkSession)
    known = F.when(F.col(class_col).isin([r[0] for r in ROUTES]), F.col(class_col)).otherwise("factual")
    return queries.withColumn(class_col, known).join(F.broadcast(rules.withColumnRenamed("query_class", class_col)), class_col, "left")


def is_sensitive(query: Column | str) -> Column:
    return F.coalesce(col(query).rlike(SENSITIVE), F.lit(False))


def escalation(query: Column | str, grounded: Column, confidence: Column, least: float = 0.4) -> Column:
    """Why an answer goes to a human: sensitive query, not grounded, low confidence; null if it doesn't."""
    return F.when(is_sensitive(query), "sensitive").when(grounded == F.lit(False), "not_grounded").when(confidence < least, "low_confidence")


def expanded_follow_up(turns: DataFrame, session: str, order: list[str], query: str) -> DataFrame:
    """Adds `expanded`: a short follow-up preceded by the session's query before it (400 characters of it)."""
    before = F.lag(F.trim(query)).over(Window.partitionBy(session).orderBy(*order))
    q = F.trim(query)
    short = (word_count(query) <= 12) & q.rlike(FOLLOW_UP_STARTS)
    return turns.withColumn("expanded", F.when(short & (F.length(before) > 0), F.concat(F.substring(before, 1, 400), F.lit(" | Follow-up: "), q)).otherwise(q))


def last_turns(turns: DataFrame, session: str, order: list[Column], n: int) -> DataFrame:
    """The last `n` turns of every session."""
    return turns.withColumn("back", F.row_number().over(Window.partitionBy(session).orderBy(*order))).where(F.col("back") <= n)


def fan_out(top_k: Column, sub_queries: Column, cap: int = 6, most: int = 8) -> tuple[Column, Column]:
    """(sub-queries asked, rows for each): at most `most` sub-queries; more rows in all than `cap` are shared out, at least 2 each."""
    n = F.least(sub_queries, F.lit(most))
    return n, F.when(n * top_k > cap, F.greatest(F.lit(2), F.floor(cap / n).cast("int"))).otherwise(top_k)
