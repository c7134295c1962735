"""Evaluation texts leaking into training text.

Method: spaced-seed hashing. Fixed masks over a window of word positions ignore some of them; the
masked hashes of the test items are joined with those of the corpus, and around each hit the two
word sequences are compared, tolerating single substituted words. A window of `run` equal words
hits under every mask, so equal runs of that length are never missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.words import mix, plain_words_of, signed, word_codes
from docweave.session import staged

#: Fixed masks of 13 positions; 1 counts, 0 is ignored.
MASKS = ("1110110111011", "1011011101111", "1111101011011")

#: Test hashes up to this many are sent to every task (8 bytes each); beyond, they are joined by a shuffle.
BROADCAST_HASHES = 4_000_000
#: Pairs with a hit up to this many go to the tasks that reread the corpus; beyond, both sides are shuffled.
BROADCAST_PAIRS = 50_000


def masked(codes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of every window of the codes under a mask."""
    n = len(codes) - len(mask) + 1
    out = np.full(max(n, 0), int(mask, 2), dtype=np.uint64)
    for i, c in enumerate(mask):
        if c == "1" and n > 0:
            out = mix(out * np.uint64(31) + codes[i : i + n])
    return out


def _windows(masks: tuple[str, ...], only: np.ndarray | None = None):
    """(key, text) -> rows of (key, hash, at) for every window and mask, or those in `only`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(masks[0])
        for batch in batches:
            keys = batch.column(0)
            lists = [plain_words_of(t) for t in batch.column(1).to_pylist()]
            codes, lengths = word_codes(lists)
            owner = np.repeat(np.arange(len(lists)), lengths)
            first = np.cumsum(lengths) - lengths
            n = max(len(codes) - width + 1, 0)
            whole = np.flatnonzero(owner[:n] == owner[width - 1 :]) if n else np.empty(0, np.int64)
            rows, hashes = [], []
            for mask in masks:
                found = signed(masked(codes, mask)[whole]) if len(whole) else np.empty(0, np.int64)
                hit = np.ones(len(found), bool)
                if only is not None and len(only):
                    at = np.minimum(np.searchsorted(only, found), len(only) - 1)
                    hit = only[at] == found
                elif only is not None:
                    hit[:] = False
                rows.append(whole[hit])
                hashes.append(found[hit])
            at, value = np.concatenate(rows), np.concatenate(hashes)
            who = owner[at] if len(at) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(who)), pa.array(value), pa.array((at - first[who]).astype(np.int32) if len(at) else np.empty(0, np.int32))],
                ["key", "hash", "at"],
            )

    return run


def _overlap(doc: list[str], item: list[str], shifts: np.ndarray, mismatches: int) -> tuple[int, int, int, int]:
    """Along the given diagonals (document position minus item position) the longest run of equal
    words and its start in the document, and the same for a stretch with at most `mismatches`
    substituted words: (run, run start, stretch, stretch start)."""
    vocabulary = {w: i for i, w in enumerate({*doc, *item})}
    d = np.array([vocabulary[w] for w in doc])
    b = np.array([vocabulary[w] for w in item])
    best = (0, 0, 0, 0)
    for shift in np.unique(shifts):
        lo, hi = max(0, shift), min(len(d), len(b) + shift)
        if hi <= lo:
            continue
        same = d[lo:hi] == b[lo - shift : hi - shift]
        breaks = np.concatenate(([-1], np.flatnonzero(~same), [len(same)]))
        runs = np.diff(breaks) - 1
        k = int(runs.argmax())
        skip = min(mismatches + 1, len(breaks) - 1)
        stretch = breaks[skip:] - breaks[:-skip] - 1
        j = int(stretch.argmax())
        best = (
            *max(best[:2], (int(runs[k]), int(lo + breaks[k] + 1)), key=lambda x: (x[0], -x[1])),
            *max(best[2:], (int(stretch[j]), int(lo + breaks[j] + 1)), key=lambda x: (x[0], -x[1])),
        )
    return best


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    masks: tuple[str, ...] = MASKS,
    mismatches: int = 1,
    broadcast_hashes: int = BROADCAST_HASHES,
) -> DataFrame:
    """Every (document, item) whose word windows agree under a mask.

    Columns: the two ids; equal_words, the longest run of equal words in a row, and equal_at, its
    first word in the document; near_words, near_at, the same for a stretch with at most
    `mismatches` substituted words. Words are lower-cased runs of letters and digits without
    accents and invisible characters. Texts shorter than a mask match nothing; null and empty
    texts neither. Rows that repeat an id are looked at once each and the longest overlap is kept.
    Rows with a null id match nothing.

    The test hashes prescreen the corpus inside the tasks if there are at most
    `broadcast_hashes` of them (a checked count), else the hashes of both sides meet in a shuffle.
    Their places in the items go to every task only while these are no more either, as items that
    share passages repeat a hash. A document and an item have no more shifts than words together.
    """
    spark = docs.sparkSession
    width = {len(m) for m in masks}
    if len(width) != 1:
        raise ValueError("masks must have one length")
    hash_schema = lambda frame, key: T.StructType(
        [T.StructField("key", frame.schema[key].dataType), T.StructField("hash", T.LongType()), T.StructField("at", T.IntegerType())]
    )
    corpus = docs.select(F.col(doc_id).alias("key"), F.col(doc_text).alias("text"))
    tests = items.select(F.col(item_id).alias("key"), F.col(item_text).alias("text")).dropDuplicates()
    test_hits = tests.mapInArrow(_windows(masks), hash_schema(items, item_id)).select(F.col("key").alias("item"), "hash", F.col("at").alias("item_at"))
    distinct = test_hits.select("hash").distinct().limit(broadcast_hashes + 1).toArrow().column(0).to_numpy()
    small = len(distinct) <= broadcast_hashes
    only = np.sort(distinct) if small else None
    doc_hits = corpus.mapInArrow(_windows(masks, only), hash_schema(docs, doc_id)).select(F.col("key").alias("doc"), "hash", F.col("at").alias("doc_at"))
    pairs = staged(
        doc_hits.join(F.broadcast(test_hits) if small and test_hits.count() <= broadcast_hashes else test_hits, "hash")
        .select("doc", "item", (F.col("doc_at") - F.col("item_at")).alias("shift"))
        .groupBy("doc", "item")
        .agg(F.collect_set("shift").alias("shifts")),
        "hits",
    )
    # The texts come back only for documents with a hit, which are sent to the corpus if they are few.
    with_items = pairs.join(tests.select(F.col("key").alias("item"), F.col("text").alias("item_text")), "item")
    few = pairs.count() <= BROADCAST_PAIRS
    with_texts = corpus.select(F.col("key").alias("doc"), F.col("text").alias("doc_text")).join(F.broadcast(with_items) if few else with_items, "doc")

    out = T.StructType(
        [
            T.StructField(doc_id, docs.schema[doc_id].dataType),
            T.StructField(item_id, items.schema[item_id].dataType),
            T.StructField("equal_words", T.IntegerType()),
            T.StructField("equal_at", T.IntegerType()),
            T.StructField("near_words", T.IntegerType()),
            T.StructField("near_at", T.IntegerType()),
        ]
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, item, shifts, item_texts, doc_texts = (batch.column(i) for i in range(5))
            found, words = [], {}
            for s, b, d in zip(shifts.to_pylist(), item_texts.to_pylist(), doc_texts.to_pylist()):
                if b not in words:
                    words[b] = plain_words_of(b)
                found.append(_overlap(plain_words_of(d), words[b], np.array(s), mismatches))
            columns = list(zip(*found)) if found else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([doc, item, *(pa.array(c, pa.int32()) for c in columns)], [f.name for f in out.fields])

    best = with_texts.select("doc", "item", "shifts", "item_text", "doc_text").mapInArrow(verify, out)
    return best.groupBy(doc_id, item_id).agg(
        F.max(F.struct("equal_words", (-F.col("equal_at")).alias("p"))).alias("e"), F.max(F.struct("near_words", (-F.col("near_at")).alias("p"))).alias("n")
    ).select(doc_id, item_id, F.col("e.equal_words"), (-F.col("e.p")).alias("equal_at"), F.col("n.near_words"), (-F.col("n.p")).alias("near_at"))
