"""Keyed state as tables: latest rows, expiry, quotas, rate limits, cache entries, status counts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The latest row of each key, as an upsert leaves it. `order` must decide ties."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` with the rows of `new` in place of those with the same keys. `new` must hold each key once."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def expired(sessions: DataFrame, now: Column, idle: str = "1 hour", total: str = "2 hours") -> DataFrame:
    """Sessions whose last access or creation is longer ago than allowed; those without either time never expire."""
    return sessions.where((F.col("last_accessed") < now - F.expr(f"interval {idle}")) | (F.col("created_at") < now - F.expr(f"interval {total}")))


def quota(rows: DataFrame, key: str, order: list[str], most: int = 15) -> DataFrame:
    """Adds `place` in the key's order and whether the row is `admitted` (the first `most`)."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("place", place).withColumn("admitted", F.col("place") <= most)


def cache_entries(rows: DataFrame, key: Column, at: str, now: Column, ttl_seconds: int) -> DataFrame:
    """(key, at, live): the newest entry of each key, live while younger than the ttl; a ttl of 0 never ends."""
    newest = rows.select(key.alias("key"), F.col(at).alias("at")).groupBy("key").agg(F.max("at").alias("at"))
    live = F.lit(True) if ttl_seconds <= 0 else F.col("at") + F.make_interval(secs=F.lit(ttl_seconds)) > now
    return newest.select("key", "at", live.alias("live"))


def rate_limited(events: DataFrame, key: str, at: str, id_col: str, seconds: int = 60, most: int = 120) -> DataFrame:
    """(key, id, allowed): an event is allowed if fewer than `most` allowed ones came in the last `seconds`.

    Events without a time are left out. Refused events don't count, so each decision depends on those before: a fold over the events of
    a key. Keys are spread over tasks and each key's events come sorted, as a stream, so a hot key
    needs no memory but its last `most` allowed times.
    """
    kinds = events.schema
    schema = T.StructType([T.StructField(key, kinds[key].dataType), T.StructField(id_col, kinds[id_col].dataType), T.StructField("allowed", T.BooleanType())])
    rows = events.where(F.col(at).isNotNull()).select(key, id_col, F.unix_micros(F.col(at).cast("timestamp")).alias("micros")).repartition(F.col(key)).sortWithinPartitions(key, "micros", id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, log = object(), deque()
        for batch in batches:
            allowed = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != current:
                    current, log = k, deque()
                while log and log[0] <= t - seconds * 1_000_000:
                    log.popleft()
                allowed.append(len(log) < most)
                if allowed[-1]:
                    log.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_())], [key, id_col, "allowed"])

    return rows.mapInArrow(run, schema)


def status_counts(rows: DataFrame, key: str, status: str = "status") -> DataFrame:
    """(key, total, ready, failed, pending, processed) per key; loaded counts as ready, null as pending."""
    s = F.lower(F.coalesce(F.col(status), F.lit("pending")))
    ready, failed = s.isin("ready", "loaded"), s.isin("failed", "error")
    counts = rows.groupBy(key).agg(F.count("*").alias("total"), F.count_if(ready).alias("ready"), F.count_if(failed).alias("failed"), F.count_if(~ready & ~failed).alias("pending"))
    return counts.withColumn("processed", F.col("ready") + F.col("failed"))


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Cascade delete: the rows whose keys are not among the `gone`."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def free_names(files: DataFrame, folder: str, name: str, order: list[str]) -> DataFrame:
    """Adds `free_name`: the second and later files of one name in a folder get ` (2)`, ` (3)` before the suffix."""
    n = F.row_number().over(Window.partitionBy(folder, name).orderBy(*order))
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return files.withColumn("free_name", F.when(n == 1, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), suffix)))
