"""Quality metrics over query logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.chunking import numbered_within


def latency_summary(rows: DataFrame, key: str, value: str, share: float = 0.95) -> DataFrame:
    """(key, n, mean, least, most, p95) per key; null values are left out.

    The percentile is the value at index floor(n * share), counted from 0. Rows are numbered in
    sorted ranges, so few or hot keys spread over many tasks.
    """
    kept = rows.where(F.col(value).isNotNull()).select(key, value)
    sums = kept.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    placed = numbered_within(kept, value, key).join(F.broadcast(sums.select(F.col(key).alias("__of"), "n")), F.col(key).eqNullSafe(F.col("__of")))
    found = placed.where(F.col("place") == F.floor(F.col("n") * share)).select("__of", F.col(value).alias("p95"))
    return sums.join(found, F.col(key).eqNullSafe(F.col("__of"))).drop("__of")


def newest(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The newest `n` rows: a top-n, not a global window."""
    return rows.orderBy(*order).limit(n)


def judged(relevance: Column, faithfulness: Column, completeness: Column) -> Column:
    """Overall score: 0.3, 0.5 and 0.2 of the three, each clamped to 0..1 and 0.5 where missing."""
    part = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.5))))
    return 0.3 * part(relevance) + 0.5 * part(faithfulness) + 0.2 * part(completeness)


def grounded_rate(rows: DataFrame, key: str, grounded: Column) -> DataFrame:
    """(key, rate): grounded among those known to be or not to be; null where none is known."""
    yes, no = F.count_if(grounded), F.count_if(~grounded)
    return rows.groupBy(key).agg(F.when(yes + no > 0, yes / (yes + no)).alias("rate"))


def ranking_quality(ranked: DataFrame, relevant: DataFrame, query_id: str, id_col: str, k: int) -> DataFrame:
    """(query, hits, precision, recall, reciprocal_rank) at `k` per query of `relevant`."""
    marked = relevant.select(query_id, id_col).distinct().join(ranked.where(F.col("rank") <= k).select(query_id, id_col, "rank"), [query_id, id_col], "left")
    g = marked.groupBy(query_id).agg(F.count("rank").alias("hits"), F.count("*").alias("relevant"), F.min("rank").alias("best"))
    return g.select(query_id, "hits", (F.col("hits") / k).alias("precision"), (F.col("hits") / F.col("relevant")).alias("recall"), F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("reciprocal_rank"))


def log_summary(rows: DataFrame, key: str, tokens: str, scores: str, route: str) -> DataFrame:
    """(key, n, mean_tokens, mean_score, best_score, no_scores, routes): tokens over the rows that have some, scores
    over all values of all lists, how many rows have none, and the rows by route as a map."""
    kept = F.filter(F.coalesce(F.col(scores), F.array().cast("array<double>")), lambda x: x.isNotNull())
    listed = rows.select(key, tokens, route, kept.alias("__s"), F.aggregate(kept, F.lit(0.0), lambda a, x: a + x).alias("__sum"))
    by_route = listed.groupBy(key, route).agg(
        F.count("*").alias("n"), F.count(F.when(F.col(tokens) > 0, 1)).alias("with_tokens"), F.sum(F.when(F.col(tokens) > 0, F.col(tokens))).alias("tokens"),
        F.sum("__sum").alias("total"), F.sum(F.size("__s")).alias("scores"), F.max(F.array_max("__s")).alias("best"), F.count_if(F.size("__s") == 0).alias("bare"),
    )
    total = by_route.groupBy(key)
    out = total.agg(
        F.sum("n").alias("n"), (F.sum("tokens") / F.sum("with_tokens")).alias("mean_tokens"), (F.sum("total") / F.sum("scores")).alias("mean_score"), F.max("best").alias("best_score"),
        F.sum("bare").alias("no_scores"), F.array_sort(F.collect_list(F.struct(F.coalesce(route, F.lit("none")).alias("route"), "n"))).alias("__routes"),
    )
    return out.select("*", F.array_join(F.transform("__routes", lambda r: F.concat(r["route"], F.lit(":"), r["n"].cast("string"))), ",").alias("routes")).drop("__routes")
