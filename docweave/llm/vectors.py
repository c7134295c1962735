"""Most similar vectors for every vector.

Method: balanced posting lists. Centroids are fitted on a bounded sample and split until the lists
are of like size; where the sample bounds their number, lists that are too long are split again, each
by its own vectors, and are found by way of the list that they come of; vectors near a boundary are kept in several lists; a query reads the lists whose centroid is
not much farther than its nearest (distance-ratio pruning). Neighbouring lists form shards, so that a vector travels once per shard that it is kept or asked in. Every vector is
indexed and every vector is a query.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.session import staged

#: Scores held at once in a task.
SCORES = 4_000_000
#: Up to so many sets of equal vectors, and so many ids of copies, go to every task; more are shuffled.
BROADCAST_SETS, BROADCAST_COPIES = 20_000, 1_000_000


def split_centroids(x: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """About `lists` centroids of unit vectors with like numbers of them: the largest cluster is split in two
    again and again, then all are refined together."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while len(parts) < lists:
        parts.sort(key=len)
        big = parts.pop()
        if len(big) < 4:
            parts.append(big)
            break
        y = x[big]
        c = y[rng.choice(len(y), 2, replace=False)]
        for _ in range(6):
            side = y @ (c[1] - c[0]) > 0
            if side.all() or not side.any():
                side = np.arange(len(y)) % 2 == 0  # equal vectors: any half will do
            c = np.stack([y[~side].mean(axis=0), y[side].mean(axis=0)])
        lean = y @ (c[1] - c[0])
        low, high = np.quantile(lean, [0.25, 0.75])
        side = lean > min(max(0.0, low), high)  # neither half gets less than a quarter
        if side.all() or not side.any():
            side = np.arange(len(y)) % 2 == 0
        parts += [big[side], big[~side]]
    c = np.stack([x[p].mean(axis=0) for p in parts])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    for _ in range(2):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        some = np.bincount(near, minlength=len(c)) > 0
        c[some] = total[some] / np.maximum(np.linalg.norm(total[some], axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def shards_of(c: np.ndarray, shards: int) -> np.ndarray:
    """A shard number for every centroid: halves along the widest direction, again and again."""
    out = np.zeros(len(c), np.int32)
    parts = [np.arange(len(c))]
    while len(parts) < min(shards, len(c)):
        parts.sort(key=len)
        big = parts.pop()
        y = c[big] - c[big].mean(axis=0)
        axis = np.linalg.svd(y, full_matrices=False)[2][0]
        order = big[np.argsort(y @ axis, kind="stable")]
        parts += [order[: len(order) // 2], order[len(order) // 2 :]]
    for i, p in enumerate(parts):
        out[p] = i
    return out


@dataclass
class Centroids:
    """The centroids of a group's lists with the shard of each, and the coarse centroids that lead to them.

    Coarse centroids are those fitted on the sample, which bounds their number. The lists of the
    coarse centroid i are numbers `first[i]` to `first[i + 1]`; where no list was split each is one.
    """

    coarse: np.ndarray
    centroids: np.ndarray
    first: np.ndarray
    shards: np.ndarray

    @classmethod
    def build(cls, coarse: np.ndarray, shards: int, split: dict[int, np.ndarray] | None = None) -> "Centroids":
        parts = [split[i] if split and i in split else coarse[i : i + 1] for i in range(len(coarse))]
        first = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return cls(coarse, np.concatenate(parts), first, np.repeat(shards_of(coarse, shards), np.diff(first)))

    def search(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The up to `most` nearest lists of each vector, nearest first, and the cosines of their centroids.

        All coarse centroids are compared; where lists were split, the lists of the `most` nearest
        coarse ones are, and -1 stands where there are less than `most`.
        """
        k = len(self.coarse)
        many = min(most, k)
        split = len(self.centroids) > k
        wide = most if split else many
        near = np.zeros((len(x), wide), np.int64)
        cosine = np.zeros((len(x), wide), np.float32)
        step = max(1, SCORES // k)
        for i in range(0, len(x), step):
            s = x[i : i + step] @ self.coarse.T
            top = np.argpartition(-s, many - 1, axis=1)[:, :many]
            v = np.take_along_axis(s, top, axis=1)
            order = np.argsort(-v, axis=1)
            ids, values = np.take_along_axis(top, order, axis=1), np.take_along_axis(v, order, axis=1)
            near[i : i + step], cosine[i : i + step] = self._lists(x[i : i + step], ids, most) if split else (ids, values)
        return near, cosine

    def _lists(self, x: np.ndarray, coarse: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The best lists among those of the coarse centroids found."""
        best = np.full((len(x), most), -1, np.int64)
        value = np.full((len(x), most), -2, np.float32)
        for at in range(coarse.shape[1]):
            for c in np.unique(coarse[:, at]):
                rows = np.flatnonzero(coarse[:, at] == c)
                lists = np.arange(self.first[c], self.first[c + 1])
                s = np.concatenate([value[rows], x[rows] @ self.centroids[lists].T], axis=1)
                ids = np.concatenate([best[rows], np.broadcast_to(lists, (len(rows), len(lists)))], axis=1)
                order = np.argsort(-s, axis=1, kind="stable")[:, :most]
                best[rows], value[rows] = np.take_along_axis(ids, order, axis=1), np.take_along_axis(s, order, axis=1)
        return best, value


def unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that hold `dim` finite values, not all zero, and these scaled to length 1."""
    column = column.cast(pa.large_list(pa.float32())) if not pa.types.is_large_list(column.type) else column
    sizes = np.diff(column.offsets.to_numpy())
    right = np.flatnonzero((sizes == dim) & ~column.is_null().to_numpy(zero_copy_only=False))
    if not len(right):
        return right, np.zeros((0, dim), np.float32)
    picked = column.take(pa.array(right)).flatten()
    x = picked.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # null values become NaN
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    x = x[good]
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return right[good], x.astype(np.float32)


def fit(items: DataFrame, dim: int, per_list: int, sample: int, shards: int) -> dict[str, Centroids]:
    """The centroids per group, on at most `sample` vectors over all groups (a documented bound)."""
    counts = {r[0]: r[1] for r in items.groupBy("group").count().collect()}
    rows = sum(counts.values())
    share = min(1.0, sample / max(rows, 1))
    chosen = items.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("group", "vector").toArrow()
    groups, graphs = np.array(chosen.column("group").to_pylist(), dtype=object), {}
    right, x = unit_vectors(chosen.column("vector").combine_chunks(), dim)
    groups = groups[right]
    for group, n in counts.items():
        own = x[groups == group] if len(x) else x
        if not len(own):
            own = np.eye(1, dim, dtype=np.float32)
        lists = int(np.clip(n // per_list, 1, max(1, len(own) // 16)))
        graphs[group] = Centroids.build(split_centroids(own, lists), max(1, -(-shards * n // max(rows, 1))))
    if any(n // per_list > 2 * len(graphs[g].coarse) for g, n in counts.items()):
        return _split_again(items, graphs, counts, dim, per_list, shards)
    return graphs


def _split_again(items: DataFrame, graphs: dict[str, Centroids], counts: dict[str, int], dim: int, per_list: int, shards: int, each: int = 16) -> dict[str, Centroids]:
    """Lists that hold more than twice `per_list` vectors, as counted over all of them, are split by about `each`
    of their own vectors for every list that comes of it; a list's part of the work is one small task."""
    spark = items.sparkSession
    shared = spark.sparkContext.broadcast(graphs)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right, x = unit_vectors(batch.column(2), dim)
            names, ids = np.array(batch.column(1).take(pa.array(right)).to_pylist(), dtype=object).astype(str), batch.column(0).take(pa.array(right))
            lists = np.zeros(len(right), np.int32)
            for group in np.unique(names) if len(names) else []:
                own = np.flatnonzero(names == group)
                for i in range(0, len(own), 8192):
                    lists[own[i : i + 8192]] = shared.value[group].search(x[own[i : i + 8192]], 1)[0][:, 0]
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(lists), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float32()))], ["id", "group", "list", "vector"])

    placed = items.select("id", "group", "vector").mapInArrow(nearest, "id long, group string, list int, vector array<float>")
    full = placed.groupBy("group", "list").agg(F.count("*").alias("n")).where(F.col("n") > 2 * per_list)
    drawn = placed.join(F.broadcast(full), ["group", "list"]).where(F.pmod(F.xxhash64("id"), F.lit(per_list)) < each)  # a list's share follows its size

    def split(key: tuple, table: pa.Table) -> pa.Table:
        x = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        n = table.column("n")[0].as_py()
        c = split_centroids(x, max(1, min(n // per_list, len(x) // 4)))
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([c.tobytes()], pa.binary())], names=["group", "list", "centroids"])

    parts: dict[str, dict[int, np.ndarray]] = {}
    for group, number, data in drawn.groupBy("group", "list").applyInArrow(split, "group string, list int, centroids binary").collect():  # centroids only
        parts.setdefault(group, {})[number] = np.frombuffer(data, np.float32).reshape(-1, dim)
    total = max(sum(counts.values()), 1)
    return {g: Centroids.build(c.coarse, max(1, -(-shards * counts[g] // total)), parts.get(g)) for g, c in graphs.items()}


def equal_vectors(rows: DataFrame, dim: int) -> tuple[DataFrame, int]:
    """(rep, id, tie) of every vector that others of its group equal once scaled to length 1, where rep is
    the least id of them; and how many such sets there are."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right, x = unit_vectors(batch.column(3), dim)
            codes = [int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8).digest(), "little", signed=True) for v in x + np.float32(0)]  # -0 is 0
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(right)) for i in range(3)), pa.array(codes, pa.int64())], ["id", "group", "tie", "code"])

    schema = T.StructType([rows.schema["id"], rows.schema["group"], rows.schema["tie"], T.StructField("code", T.LongType())])
    coded = rows.select("id", "group", "tie", "vector").mapInArrow(code, schema)
    sets = staged(coded.groupBy("group", "code").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").drop("last"), "equal-sets")
    n = sets.count()
    members = coded.join(F.broadcast(sets) if n <= BROADCAST_SETS else sets, ["group", "code"]).groupBy("rep", "id").agg(F.min("tie").alias("tie"))
    return staged(members, "equal"), n


def with_copies(best: DataFrame, members: DataFrame, sets: int, k: int) -> DataFrame:
    """(id, neighbour, cosine, rank) of all items, from those of single vectors and of one of each set of
    equal ones. Of a set, the first `k` in order of tie that are not the item itself can be its neighbours."""
    some = lambda df: F.broadcast(df) if sets <= BROADCAST_SETS else df
    place = F.row_number().over(Window.partitionBy("rep").orderBy("tie", "id"))
    first = members.withColumn("place", place).where(F.col("place") <= k + 1)
    first = staged(first.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("tie", F.col("id").alias("neighbour")))).alias("set")), "equal-first")
    alone = F.array(F.struct(F.lit(None).cast(members.schema["tie"].dataType).alias("tie"), F.col("neighbour")))
    others = best.join(some(first.withColumnRenamed("rep", "neighbour")), "neighbour", "left").select("id", "cosine", F.lit(1).alias("far"), F.explode(F.coalesce("set", alone)).alias("n"))
    own = first.select(F.col("rep").alias("id"), F.lit(1.0).cast("float").alias("cosine"), F.lit(0).alias("far"), F.explode("set").alias("n"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "far", "n.tie", "n.neighbour"))
    ranked = others.unionByName(own).withColumn("rank", rank).where(F.col("rank") <= k + 1).select("id", "n.neighbour", "cosine", "rank")
    ranked = staged(ranked, "equal-ranked")
    reps = some(first.select(F.col("rep").alias("id")))
    single = ranked.join(reps, "id", "left_anti").where(F.col("rank") <= k)
    lists = ranked.join(reps, "id", "left_semi").groupBy(F.col("id").alias("rep")).agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour", "cosine"))).alias("found"))
    kept = F.slice(F.filter("found", lambda f: f["neighbour"] != F.col("id")), 1, k)
    each = members.select("rep", "id").join(some(lists), "rep").select("id", F.posexplode(kept).alias("at", "f"))
    return single.unionByName(each.select("id", "f.neighbour", "f.cosine", (F.col("at") + 1).alias("rank")))


def most_similar(
    items: DataFrame,
    id_col: str = "id",
    group_col: str = "group",
    vector_col: str = "vector",
    k: int = 10,
    dim: int = 64,
    least: float = -1.0,
    per_list: int = 400,
    sample: int = 60_000,
    kept_in: int = 4,
    asked: int = 10,
    kept_ratio: float = 1.15,
    asked_ratio: float = 1.3,
    shards: int | None = None,
    tie_col: str | None = None,
) -> DataFrame:
    """(id, neighbour, cosine, rank): the `k` most similar vectors of the same group of every vector.

    Only neighbours with a cosine of at least `least` come out. Ids are longs; a repeated id must
    repeat its vector and group and counts once. Vectors that are null, not of `dim` values, with a value that
    is null or not finite, or with zeros only are left out; a null group is a group. Of equal vectors those
    with the smaller `tie_col` (the id, where none is named) come first; other ties go to the smaller id.

    Approximate: `kept_in` lists at most keep a vector, those at most `kept_ratio` times as far as
    its nearest; a query reads at most `asked` lists by `asked_ratio`. Recall grows with each.
    """
    spark = items.sparkSession
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(group_col).cast("string"), F.lit("")).alias("group"), F.col(vector_col).alias("vector"), F.col(tie_col or id_col).alias("tie")).where("id is not null")
    if shards is None:
        shards = max(2 * spark.sparkContext.defaultParallelism, -(-rows.count() // 40_000))
    members, sets = equal_vectors(rows, dim)
    copies = members.where("id <> rep").select("id")
    known = np.empty(0, np.int64)
    if sets and copies.count() <= BROADCAST_COPIES:
        known = copies.toArrow().column("id").to_numpy()
    elif sets:
        rows = rows.join(copies, "id", "left_anti")
    left_out = spark.sparkContext.broadcast(np.sort(known))
    graphs = spark.sparkContext.broadcast(fit(rows, dim, per_list, sample, shards))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple]] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for (group, shard), parts in held.items():
                cols = [np.concatenate(c).tobytes() for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([shard], pa.int32()), *(pa.array([c], pa.binary()) for c in cols)], ["group", "shard", "ids", "vectors", "kept", "asked"])
            held.clear()

        count = 0
        for batch in batches:
            batch = batch.filter(pa.array(~np.isin(batch.column(0).to_numpy(zero_copy_only=False), left_out.value)))
            right, x = unit_vectors(batch.column(2), dim)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[right]
            names = np.array(batch.column(1).take(pa.array(right)).to_pylist(), dtype=object)
            for group in np.unique(names.astype(str)) if len(names) else []:
                graph = graphs.value[group]
                own = np.flatnonzero(names == group)
                near, cosine = graph.search(x[own], asked)
                far = np.sqrt(np.maximum(2 - 2 * cosine, 0))
                ask = (far <= far[:, :1] * asked_ratio + 1e-6) & (near >= 0)
                keep = ask & (far <= far[:, :1] * kept_ratio + 1e-6) & (np.arange(near.shape[1]) < kept_in)
                shard = graph.shards[near]
                for s in np.unique(shard[ask]):
                    here = ask & (shard == s)
                    r = np.flatnonzero(here.any(axis=1))
                    lists = np.where(here[r], near[r], -1).astype(np.int32)
                    pad = np.full((len(r), asked), -1, np.int32)
                    pad[:, : lists.shape[1]] = lists
                    kept = np.where(np.pad(keep[r] & here[r], ((0, 0), (0, asked - near.shape[1]))), pad, -1)[:, :kept_in]
                    held.setdefault((group, int(s)), []).append((ids[own[r]], x[own[r]], kept.astype(np.int32), pad))
            count += batch.num_rows
            if count >= 50_000:
                yield from send()
                count = 0
        yield from send()

    placed = rows.select("id", "group", "vector").mapInArrow(place, "group string, shard int, ids binary, vectors binary, kept binary, asked binary")

    def answer(table: pa.Table) -> pa.Table:
        wide = {"ids": (np.int64, 1), "vectors": (np.float32, dim), "kept": (np.int32, kept_in), "asked": (np.int32, asked)}
        ids, x, kept, ask = (np.concatenate([np.frombuffer(b, t).reshape(-1, w) for b in table.column(c).to_pylist()]) for c, (t, w) in wide.items())
        ids, one = np.unique(ids[:, 0], return_index=True)
        x, kept, ask = x[one], kept[one], ask[one]

        def by_list(lists: np.ndarray) -> dict[int, np.ndarray]:
            row, col = np.nonzero(lists >= 0)
            value = lists[row, col]
            order = np.argsort(value, kind="stable")
            cuts = np.flatnonzero(np.diff(value[order])) + 1
            return {int(value[p[0]]): row[p] for p in np.split(order, cuts) if len(p)}

        members, queries, found = by_list(kept), by_list(ask), []
        for number, m in members.items():
            q = queries.get(number)
            if q is None:
                continue
            target = np.ascontiguousarray(x[m].T)
            for i in range(0, len(q), max(1, SCORES // len(m))):
                part = q[i : i + max(1, SCORES // len(m))]
                s = np.minimum(x[part] @ target, np.float32(1))
                good = s >= least
                many = np.flatnonzero(good.sum(axis=1) > k + 1)
                if len(many):  # only the best of a list can be among the best of all; members are in order of id
                    top = np.argpartition(-s[many], k, axis=1)[:, : k + 1]
                    last = np.take_along_axis(s[many], top, axis=1).min(axis=1)
                    tied = np.flatnonzero((s[many] >= last[:, None]).sum(axis=1) > k + 1)
                    top[tied] = np.argsort(-s[many[tied]], axis=1, kind="stable")[:, : k + 1]
                    good[many] = False
                    good[many[:, None], top] = True
                r, c = np.nonzero(good)
                other = part[r] != m[c]
                r, c = r[other], c[other]
                found.append((part[r], m[c], s[r, c]))
        if not found:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float32())], names=["id", "neighbour", "cosine"])
        a, b, s = (np.concatenate(f) for f in zip(*found))
        order = np.lexsort((ids[b], -s, a))
        a, b, s = a[order], b[order], s[order]
        fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, bool)
        a, b, s = a[fresh], b[fresh], s[fresh]
        first = np.concatenate(([True], a[1:] != a[:-1])) if len(a) else np.empty(0, bool)
        rank = np.arange(len(a)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(a) else np.empty(0, np.int64)
        top = rank < 2 * k  # equal neighbours found twice with other rounding still leave k
        return pa.table([pa.array(ids[a[top]]), pa.array(ids[b[top]]), pa.array(s[top], pa.float32())], names=["id", "neighbour", "cosine"])

    answers = placed.groupBy("group", "shard").applyInArrow(answer, "id long, neighbour long, cosine float")
    best = answers.groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return with_copies(best, members, sets, k) if sets else best


def mutual(similar: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs with a cosine of at least `least` where each is among the other's most similar."""
    pairs = similar.where(F.col("cosine") >= F.lit(least).cast("float"))
    return pairs.groupBy(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).agg(F.count("*").alias("n")).where("n = 2").select("a", "b")
