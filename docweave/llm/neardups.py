"""Near-duplicate records with small edits.

Method: an exact set-similarity join that uses relations between sets. Records become sets of word
sequences. Equal sets are one set, whose answers its copies share. Sets meet in index lists of the
sequences in their prefix, rarest first; a list is sorted by set size and position and skipped in
blocks: for each set only those blocks of sizes, and of each block only those positions, that leave
room for enough overlap. A parity bitmap bounds the overlap of what is left from above, and only
pairs it can't refuse are verified. Each set has an anchor, the least set it is paired with, and is
compared with that one in full; the answers of sets that differ little from the same anchor are
derived from the anchor's by these differences alone, which are all that is sent. Answers of a set
are then carried to all records that have it.

The order of sequences comes from a sketch of their counts over all records. The sketch has a fixed
size and its errors change the work, never the result, as any one order gives the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.history import shared_grams
from docweave.llm.words import arrow_word_codes, gram_codes, mix
from docweave.session import staged

BITS = 256
#: Sets larger than the first number also carry a bitmap of the second number of bits, as a narrow one is full.
WIDER = ((150, 2048), (700, 8192))
#: Pairs looked at together in a task.
STEP = 1_000_000
#: Postings that a bucket should have; one with more than twice as many is split into a grid of cells.
BUCKET_POSTINGS = 2_000_000
#: Buckets that are counted on a sample of one in SAMPLE records, to size and split them. It changes the work, never the result.
FINE, SAMPLE = 1 << 14, 8
#: Keys up to this many go to every task that rereads the records; beyond, both sides are shuffled.
BROADCAST_KEYS = 500_000


def record_sets(texts: pa.Array, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(record number, 48-bit hash) of the distinct `size`-word sequences of each record, sorted."""
    codes, lengths = arrow_word_codes(texts)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    grams = gram_codes(codes, size)
    n = len(grams)
    keep = (owner[:n] == owner[size - 1 :]) & (lengths[owner[:n]] >= least) if n else np.empty(0, bool)
    both = np.sort((owner[:n][keep].astype(np.uint64) << np.uint64(48)) | (grams[keep] >> np.uint64(16)))
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    return (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1)


def set_keys(owner: np.ndarray, grams: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key (two columns) and the size of each record's set; equal sets have equal keys."""
    sizes = np.bincount(owner, minlength=count)
    keys = np.zeros((count, 2), np.uint64)
    used = np.flatnonzero(sizes)
    if len(used):
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))[used]
        for i in range(2):
            keys[used, i] = mix(np.add.reduceat(mix(grams * np.uint64(2 * i + 1) + np.uint64(i + 11)), starts))
    return keys, sizes


def parity_bitmaps(owner: np.ndarray, grams: np.ndarray, count: int, bits: int = BITS) -> np.ndarray:
    """For each record the parity of its hashes over `bits` slots, packed in 64-bit words."""
    slots = (mix(grams + np.uint64(77)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(owner * bits + slots, minlength=count * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(count, bits), axis=1).view(np.uint64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 4000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _keys_as_binary(keys: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())]).cast(pa.binary())


def _narrow(x: np.ndarray) -> bytes:
    """Non-negative integers as 16 bits each if all fit, else 32."""
    return x.astype(np.uint16 if not len(x) or x.max() < 65536 else np.uint32).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.uint32).astype(np.int64)


def _members_and_counts(size: int, least: int, slots: int, block: int):
    """(key, text) -> one row per record with its set key and size, and the task's share of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.uint32)
        kind = pa.string()
        for batch in _slices(batches):
            kind = batch.column(0).type
            owner, grams = record_sets(batch.column(1), size, least)
            counts += np.bincount((grams % np.uint64(slots)).astype(np.int64), minlength=slots).astype(np.uint32)
            keys, sizes = set_keys(owner, grams, batch.num_rows)
            has = np.flatnonzero(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(has)), _keys_as_binary(keys[has]), pa.array(sizes[has].astype(np.int32)), pa.nulls(len(has), pa.int32()), pa.nulls(len(has), pa.binary())],
                ["id", "set_key", "n", "block", "counts"],
            )
        parts = [(i // block, np.minimum(counts[i : i + block], 65535).astype(np.uint16).tobytes()) for i in range(0, slots, block) if counts[i : i + block].any()]
        m = len(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(m, kind), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())],
            ["id", "set_key", "n", "block", "counts"],
        )

    return run


def _sum_counts(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, np.uint16).astype(np.uint32) for c in table.column("counts").to_pylist())
    return pa.table([table.column("block").slice(0, 1), pa.array([np.minimum(total, 65535).astype(np.uint16).tobytes()], pa.binary())], names=["block", "counts"])


def _prefixes(owner: np.ndarray, grams: np.ndarray, sizes: np.ndarray, counts: np.ndarray, least_likeness: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by rarity within each record, place in it, whether it is in the prefix and not sure to be the only one)."""
    count = counts[(grams % np.uint64(len(counts))).astype(np.int64)].astype(np.uint64)
    rank = np.argsort((owner.astype(np.uint64) << np.uint64(50)) | (count << np.uint64(34)) | (grams & np.uint64((1 << 34) - 1)))
    starts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(sizes)))))
    pos = np.arange(len(owner)) - starts[owner]
    s = sizes[owner]
    prefix = s - np.ceil(least_likeness * s - 1e-9).astype(np.int64) + 1
    return rank, pos, (pos < prefix) & (count[rank] > 1)


def _posting_counts(size: int, least: int, least_likeness: float, sketch):
    """text -> postings by fine bucket, one row per task and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FINE, np.int64)
        for batch in _slices(batches):
            owner, grams = record_sets(batch.column(0), size, least)
            sizes = np.bincount(owner, minlength=batch.num_rows)
            if len(owner):
                rank, _, sent = _prefixes(owner, grams, sizes, sketch.value, least_likeness)
                total += np.bincount((grams[rank][sent] % np.uint64(FINE)).astype(np.int64), minlength=FINE)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["fine", "n"])

    return run


def bucket_grid(fine: np.ndarray, least: int, postings: int) -> np.ndarray:
    """In how many parts each bucket's records are dealt, from postings by fine bucket. The number of buckets is a
    power of two, at least `least`, and enough for `postings` in each; a bucket still too full by a hot sequence has several parts."""
    buckets = 1 << max(0, (least - 1).bit_length())
    while buckets < len(fine) and fine.sum() > buckets * postings:
        buckets *= 2
    load = np.zeros(buckets, np.int64)
    np.add.at(load, np.arange(len(fine)) % buckets, fine)
    return np.where(load > 2 * postings, np.ceil(2 * load / postings).astype(np.int64), 1)


def _postings(size: int, least: int, least_likeness: float, sketch, grid: np.ndarray, flush: int = 60_000):
    """text -> for each bucket of hashes, the prefix postings of the task's records and the records' own data.

    The records of a bucket dealt in p parts go to the p cells (i, j), i <= j, that hold their part.
    """
    buckets = len(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        seen: set[bytes] = set()
        held: list[tuple[np.ndarray, ...]] = []

        def send() -> Iterator[pa.RecordBatch]:
            base, recs = 0, []
            keys, sizes, bitmaps = (np.concatenate([h[i] for h in held]) for i in range(3))
            wider = [(np.cumsum(sizes > above) - 1, np.concatenate([h[6][i] for h in held])) for i, (above, _) in enumerate(WIDER)]
            for h in held:
                recs.append(h[3] + base)
                base += len(h[0])
            rec, gram, pos = np.concatenate(recs), np.concatenate([h[4] for h in held]), np.concatenate([h[5] for h in held])
            where = (gram % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            ends = np.searchsorted(where[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(ends)):
                at, parts = order[ends[b] : ends[b + 1]], int(grid[b])
                part = (keys[rec[at], 0] % np.uint64(parts)).astype(np.int64)
                cells = [(i, j) for i in range(parts) for j in range(i, parts)]
                for i, j in cells:
                    here = at[(part == i) | (part == j)]
                    if not len(here):
                        continue
                    used, local = np.unique(rec[here], return_inverse=True)
                    row = [
                        keys[used].tobytes(), _narrow(sizes[used]), bitmaps[used].tobytes(), *(w[at_row[used[sizes[used] > above]]].tobytes() for (at_row, w), (above, _) in zip(wider, WIDER)), _narrow(np.bincount(local)),
                        (gram[here] // np.uint64(buckets)).astype(np.uint32).tobytes(), _narrow(pos[here]),
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (b, i, j, parts)] + [pa.array([x], pa.binary()) for x in row], names)

        total = 0
        for batch in _slices(batches):
            n = batch.num_rows
            owner, grams = record_sets(batch.column(0), size, least)
            keys, sizes = set_keys(owner, grams, n)
            fresh = np.zeros(n, bool)
            for i in np.flatnonzero(sizes):  # copies within the task go once
                k = keys[i].tobytes()
                if k not in seen:
                    seen.add(k)
                    fresh[i] = True
            if len(seen) > 2_000_000:
                seen.clear()
            keep = fresh[owner]
            owner, grams = owner[keep], grams[keep]
            if not len(owner):
                continue
            rank, pos, sent = _prefixes(owner, grams, sizes, counts, least_likeness)
            new = np.cumsum(fresh) - 1
            wide = []
            for above, bits in WIDER:
                large = fresh & (sizes > above)
                theirs = large[owner]
                wide.append(parity_bitmaps((np.cumsum(large) - 1)[owner[theirs]], grams[theirs], int(large.sum()), bits))
            held.append((keys[fresh], sizes[fresh], parity_bitmaps(new[owner], grams, int(fresh.sum())), new[owner][sent], grams[rank][sent], pos[sent], wide))
            total += int(fresh.sum())
            if total >= flush:
                yield from send()
                held, total = [], 0
        if held:
            yield from send()

    names = ["bucket", "part_a", "part_b", "parts", "keys", "sizes", "bitmaps", *(f"wide{bits}" for _, bits in WIDER), "per_record", "grams", "positions"]
    return run


def _join_bucket(least_likeness: float):
    """All postings of a cell of a bucket -> pairs of set keys that may be alike, each once; in a cell of two parts only pairs of both."""

    def run(table: pa.Table) -> pa.Table:
        part_a, part_b, parts = (table.column(c)[0].as_py() for c in ("part_a", "part_b", "parts"))
        cols = {c: table.column(c).to_pylist() for c in table.column_names if c not in ("bucket", "part_a", "part_b", "parts")}
        keys = np.concatenate([np.frombuffer(k, np.uint64).reshape(-1, 2) for k in cols["keys"]])
        m = [len(k) // 16 for k in cols["keys"]]
        size = np.concatenate([_wide(s, n) for s, n in zip(cols["sizes"], m)])
        bitmaps = np.concatenate([np.frombuffer(b, np.uint64).reshape(-1, BITS // 64) for b in cols["bitmaps"]])
        wider = [(above, np.cumsum(size > above) - 1, np.concatenate([np.frombuffer(b, np.uint64).reshape(-1, bits // 64) for b in cols[f"wide{bits}"]])) for above, bits in WIDER]
        per = np.concatenate([_wide(p, n) for p, n in zip(cols["per_record"], m)])
        gram = np.concatenate([np.frombuffer(g, np.uint32) for g in cols["grams"]])
        pos = np.concatenate([_wide(p, len(g) // 4) for p, g in zip(cols["positions"], cols["grams"])])
        cols.clear()
        part = (keys[:, 0] % np.uint64(parts)).astype(np.int32)
        first, same = np.unique(keys, axis=0, return_index=True, return_inverse=True)[1:]
        kept = np.zeros(len(keys), bool)
        kept[first] = True
        rec = np.repeat(np.arange(len(keys)), per)
        keep = kept[rec]
        rec, gram, pos = rec[keep], gram[keep], pos[keep]
        t = least_likeness
        # Index lists by hash, size and position; a block is the entries of one size in a list.
        order = np.lexsort((pos, size[rec], gram))
        rec, gram, pos = rec[order], gram[order], pos[order]
        n = size[rec]
        change = np.concatenate(([True], (gram[1:] != gram[:-1]) | (n[1:] != n[:-1]))) if len(gram) else np.empty(0, bool)
        block = np.cumsum(change) - 1
        start = np.flatnonzero(change)
        end = np.concatenate((start[1:], [len(gram)]))
        block_n, block_gram = n[start], gram[start]
        list_change = np.concatenate(([True], block_gram[1:] != block_gram[:-1])) if len(start) else np.empty(0, bool)
        # Blocks too small for a set are skipped whole.
        sort_key = (np.cumsum(list_change).astype(np.uint64) << np.uint64(32)) | block_n.astype(np.uint64)
        low = np.searchsorted(sort_key, (np.cumsum(list_change).astype(np.uint64)[block] << np.uint64(32)) | np.ceil(t * n - 1e-9).astype(np.uint64)) if len(start) else np.empty(0, np.int64)
        blocks = block - low + 1
        out: list[np.ndarray] = []
        pos_key = (block.astype(np.uint64) << np.uint64(32)) | pos.astype(np.uint64)
        edges = np.searchsorted(np.cumsum(blocks), np.arange(STEP, int(blocks.sum()) + STEP, STEP)) if len(blocks) else []
        a = 0
        for z in [*edges, len(blocks)]:
            z = min(max(int(z) + 1, a), len(blocks))
            entry = np.repeat(np.arange(a, z), blocks[a:z])
            if not len(entry):
                continue
            other = low[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(blocks[a:z]) - blocks[a:z], blocks[a:z])
            a = z
            need = np.ceil((n[entry] + block_n[other]) * (t / (1 + t)) - 1e-9).astype(np.int64)
            limit = block_n[other] - need  # positions beyond leave too little room
            good = (pos[entry] <= n[entry] - need) & (limit >= 0)
            entry, other, limit, need = entry[good], other[good], limit[good], need[good]
            upto = np.searchsorted(pos_key, (other.astype(np.uint64) << np.uint64(32)) | limit.astype(np.uint64), side="right")
            upto = np.minimum(np.minimum(upto, end[other]), entry)  # of the own block only what comes before
            width = np.maximum(upto - start[other], 0)
            steps = np.searchsorted(np.cumsum(width), np.arange(STEP, int(width.sum()) + STEP, STEP)) if len(width) else []
            i = 0
            for j in [*steps, len(width)]:
                j = min(max(int(j) + 1, i), len(width))
                w = width[i:j]
                x = np.repeat(entry[i:j], w)
                if len(x):
                    y = np.repeat(start[other[i:j]], w) + np.arange(len(x)) - np.repeat(np.cumsum(w) - w, w)
                    o = np.repeat(need[i:j], w)
                    differ = np.bitwise_count(bitmaps[rec[x]] ^ bitmaps[rec[y]]).sum(axis=1, dtype=np.int64)
                    ok = (n[x] + n[y] - differ >= 2 * o) & (rec[x] != rec[y])
                    if part_a != part_b:
                        ok &= part[rec[x]] != part[rec[y]]
                    x, y, o = x[ok], y[ok], o[ok]
                    for above, row, wide in wider:
                        fine = np.ones(len(x), bool)
                        both = np.flatnonzero((n[x] > above) & (n[y] > above))
                        for c in range(0, len(both), STEP // 16):
                            h = both[c : c + STEP // 16]
                            differ = np.bitwise_count(wide[row[rec[x[h]]]] ^ wide[row[rec[y[h]]]]).sum(axis=1, dtype=np.int64)
                            fine[h] = n[x[h]] + n[y[h]] - differ >= 2 * o[h]
                        x, y, o = x[fine], y[fine], o[fine]
                    p, q = rec[x].astype(np.uint64), rec[y].astype(np.uint64)
                    out.append(np.unique((np.minimum(p, q) << np.uint64(32)) | np.maximum(p, q)))
                i = j
        found = np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)
        p, q = (found >> np.uint64(32)).astype(np.int64), (found & np.uint64(0xFFFFFFFF)).astype(np.int64)
        swap = (keys[p, 0] > keys[q, 0]) | (keys[p, 0] == keys[q, 0]) & (keys[p, 1] > keys[q, 1])
        p, q = np.where(swap, q, p), np.where(swap, p, q)
        return pa.table([_keys_as_binary(keys[p]), _keys_as_binary(keys[q])], names=["key_a", "key_b"])

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Adds the size and the named columns of both sets of each pair."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("set_key").alias(f"key_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("n", *columns))), f"key_{side}")
    return pairs


def _against_anchor(pairs: DataFrame, most_change: float) -> DataFrame:
    """(pair, n and grams of both) -> how many hashes they share and, where few, those that only one has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, changes = [], []
            for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                change = np.setxor1d(a, b, assume_unique=True)
                shared.append((len(a) + len(b) - len(change)) // 2)
                changes.append(change.tobytes() if len(change) <= most_change * len(b) else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(shared, pa.int32()), pa.array(changes, pa.binary())], ["key_a", "key_b", "n_a", "n_b", "shared", "change"])

    return pairs.select("key_a", "key_b", "n_a", "n_b", "grams_a", "grams_b").mapInArrow(run, "key_a binary, key_b binary, n_a int, n_b int, shared int, change binary")


def near_duplicates(
    records: DataFrame,
    id_col: str = "chunk_id",
    text_col: str = "text",
    least_likeness: float = 0.5,
    gram_words: int = 3,
    least_words: int = 20,
    sketch_bits: int = 21,
    buckets: int | None = None,
    most_change: float = 0.5,
) -> tuple[DataFrame, DataFrame]:
    """All links between records whose word-sequence sets have a Jaccard likeness of `least_likeness`.

    Returns (members, links). members: (id, set_key, n), each id once; ids with the same set_key are
    copies of each other in likeness. links: (key_a, key_b, likeness), each pair of different sets
    once. No link is lost, whatever the number of partners. Answers are derived for sets that differ from
    their anchor in at most `most_change` times their size; it changes the work, not the result. Null texts, and those of fewer than
    `least_words` words, are in neither. A repeated id must repeat its text; a null id is left out.
    Other columns are not looked at.
    """
    spark = records.sparkSession
    slots = 1 << sketch_bits
    kind = records.schema[id_col].dataType
    rows = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    schema = T.StructType([T.StructField("id", kind), T.StructField("set_key", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    first = staged(rows.mapInArrow(_members_and_counts(gram_words, least_words, slots, slots // 64), schema), "sets")
    members = first.where("set_key is not null").select("id", "set_key", "n").dropDuplicates(["id"])
    total = np.zeros(slots, np.uint16)
    summed = first.where("counts is not null").select("block", "counts").groupBy("block").applyInArrow(_sum_counts, "block int, counts binary")
    for block, counts in summed.collect():  # a fixed number of blocks of fixed size
        total[block * (slots // 64) : (block + 1) * (slots // 64)] = np.frombuffer(counts, np.uint16)
    sketch = spark.sparkContext.broadcast(total)

    # a sample shows how many postings there will be, and which sequences are hot
    fine = np.zeros(FINE, np.int64)
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_posting_counts(gram_words, least_words, least_likeness, sketch), "fine int, n long")
    for at, n in some.groupBy("fine").agg(F.sum("n")).collect():  # at most FINE rows
        fine[at] = n * SAMPLE
    grid = bucket_grid(fine, buckets or spark.sparkContext.defaultParallelism, BUCKET_POSTINGS)
    posted = "bucket int, part_a int, part_b int, parts int, keys binary, sizes binary, bitmaps binary, " + "".join(f"wide{bits} binary, " for _, bits in WIDER) + "per_record binary, grams binary, positions binary"
    postings = rows.select("text").mapInArrow(_postings(gram_words, least_words, least_likeness, sketch, grid), posted)
    pairs = staged(postings.groupBy("bucket", "part_a", "part_b").applyInArrow(_join_bucket(least_likeness), "key_a binary, key_b binary").distinct(), "pairs")

    needed = pairs.select(F.col("key_a").alias("set_key")).unionByName(pairs.select(F.col("key_b").alias("set_key"))).distinct()
    carriers = staged(first.where("set_key is not null").select("set_key", "id").join(needed, "set_key", "left_semi").groupBy("set_key").agg(F.min("id").alias("id")), "carriers")
    some = carriers.select("id")
    texts = rows.join(F.broadcast(some) if carriers.count() <= BROADCAST_KEYS else some, "id", "left_semi").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            owner, grams = record_sets(batch.column(0), gram_words, least_words)
            keys, sizes = set_keys(owner, grams, batch.num_rows)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            has = np.flatnonzero(sizes)
            packed = [grams[ends[i] : ends[i + 1]].tobytes() for i in has]
            yield pa.RecordBatch.from_arrays([_keys_as_binary(keys[has]), pa.array(sizes[has].astype(np.int32)), pa.array(packed, pa.binary())], ["set_key", "n", "grams"])

    whole = staged(texts.mapInArrow(sets, "set_key binary, n int, grams binary").dropDuplicates(["set_key"]), "whole")
    anchored = pairs.groupBy("key_b").agg(F.min("key_a").alias("key_a"))
    answers = staged(_against_anchor(_with_sets(anchored, whole, "grams"), most_change), "answers")
    near = [answers.select(F.col("key_b").alias(f"key_{s}"), F.col("key_a").alias(f"anchor_{s}"), F.col("change").isNotNull().alias(f"close_{s}")) for s in "ab"]
    rest = pairs.join(near[1], "key_b").where("key_a <> anchor_b").join(near[0], "key_a", "left")
    derivable = F.coalesce((F.col("anchor_a") == F.col("anchor_b")) & F.col("close_a") & F.col("close_b"), F.lit(False))
    rest = staged(rest.select("key_a", "key_b", derivable.alias("derivable")), "rest")
    full = shared_grams(_with_sets(rest.where("not derivable").drop("derivable"), whole, "grams"), "grams_a", "grams_b")
    # |s & x| = |s & r| + |x & r| - |r| + |(s ^ r) & (x ^ r)| for sets s, x and their anchor r
    changes = answers.select(F.col("key_b").alias("set_key"), F.col("n_b").alias("n"), (F.col("shared") - F.col("n_a")).alias("less"), F.col("shared").alias("kept"), "change")
    derived = shared_grams(_with_sets(rest.where("derivable").drop("derivable"), changes, "change", "less", "kept"), "change_a", "change_b", "both")
    derived = derived.withColumn("shared", F.col("less_a") + F.col("kept_b") + F.col("both"))
    columns = ["key_a", "key_b", "n_a", "n_b", "shared"]
    links = answers.select(columns).unionByName(derived.select(columns)).unionByName(full.select(columns))
    likeness = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    links = links.withColumn("likeness", likeness).where(F.col("likeness") >= least_likeness)
    return members, links.select("key_a", "key_b", "likeness")


def expanded(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b) of all alike records, id_a < id_b: a set's answers carried to all its records."""
    a, b = (members.select(F.col("set_key").alias(f"key_{s}"), F.col("id").alias(f"id_{s}")) for s in "ab")
    copies = a.join(b, F.col("key_a") == F.col("key_b")).where("id_a < id_b").select("id_a", "id_b")
    others = links.select("key_a", "key_b").join(a, "key_a").join(b, "key_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return copies.unionByName(others)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node of `nodes` (node) over `edges` (a, b).

    Each round a node takes the least label among its neighbours' and then its label's label, so
    chains shorten by half; every round is a written table.
    """
    label = staged(nodes.select("node", F.col("node").alias("component")).distinct(), "labels")
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    if both.isEmpty():
        return label
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("new"))
        over = label.select(F.col("node").alias("new"), F.col("component").alias("over"))
        following = staged(step.join(over, "new", "left").select("node", F.least("new", "over").alias("component"), (F.least("new", "over") != F.col("component")).alias("moved")), "labels")
        label = following.select("node", "component")
        if following.where("moved").isEmpty():
            return label
