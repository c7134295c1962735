"""Encoding a corpus with a public byte-level BPE vocabulary.

Method: global distinct-word shuffle. Texts are cut into pre-tokens with their positions; each
distinct pre-token of the corpus is encoded once; ids are joined back and put together by position.

Occurrences travel packed: a task handles its documents in groups of bounded size, and sends for
each group one row per distinct pre-token with the positions as a binary array. So a frequent
pre-token costs one row per group, not one per occurrence, and adaptive skew handling splits the
rest.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = os.environ.get("DOCWEAVE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"

#: Fixed value: the published pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str = TOKENIZERS, name: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes and their ids; tens of thousands of entries, whatever the corpus."""
    with open(os.path.join(path, f"{name}.tiktoken"), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _occurrences(group_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(PATTERN).findall
        first, seq = TaskContext.get().partitionId() << 32, 0

        def emit(ids: list, texts: list) -> pa.RecordBatch:
            nonlocal seq
            group, seq = first + seq, seq + 1
            numbers: dict[str, int] = {}
            lengths, flat = [], []
            for text in texts:
                found = find(text) if text else []
                lengths.append(len(found))
                flat += [numbers.setdefault(w, len(numbers)) for w in found]
            code = np.array(flat, dtype=np.int32)
            at = np.argsort(code, kind="stable").astype(np.int32)
            ends = np.cumsum(np.bincount(code, minlength=len(numbers))) if len(numbers) else []
            places = [a.tobytes() for a in np.split(at, ends[:-1])] if len(numbers) else []
            n = len(numbers)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([group] * (n + 1), pa.int64()),
                    pa.array([*numbers, None], pa.string()),
                    pa.array([*places, np.array(lengths, dtype=np.int32).tobytes()], pa.binary()),
                    pa.array([None] * n + [ids], pa.list_(id_type)),
                ],
                ["group", "word", "at", "keys"],
            )

        ids, texts, size = [], [], 0
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(key)
                texts.append(text)
                size += len(text or "") + 16
                if size >= group_chars:
                    yield emit(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield emit(ids, texts)

    return run


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks: dict[bytes, int] | None = None,
    group_chars: int = 2_000_000,
) -> DataFrame:
    """(id_col, ids array<int>) for every row of `docs`, without special tokens.

    Texts are not changed before. Null and empty texts give an empty list; a repeated id gives a
    row each time; a null id stays null. Other columns of `docs` are not looked at.
    """
    spark = docs.sparkSession
    ranks_b = spark.sparkContext.broadcast(ranks if ranks is not None else read_ranks())
    id_type = docs.schema[id_col].dataType
    occurrences = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(
        _occurrences(group_chars),
        T.StructType(
            [
                T.StructField("group", T.LongType()),
                T.StructField("word", T.StringType()),
                T.StructField("at", T.BinaryType()),
                T.StructField("keys", T.ArrayType(id_type)),
            ]
        ),
    )

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        bpe = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks_b.value, special_tokens={})
        for batch in batches:
            words = batch.column(0)
            ids = [np.array(bpe._encode_single_piece(w.encode()), dtype=np.int32).tobytes() for w in words.to_pylist()]
            yield pa.RecordBatch.from_arrays([words, pa.array(ids, pa.binary())], ["word", "word_ids"])

    encoded = occurrences.where("word is not null").select("word").distinct().mapInArrow(encode_words, "word string, word_ids binary")
    joined = occurrences.join(encoded, "word", "left").select("group", "at", "keys", "word_ids")

    def assemble(table: pa.Table) -> pa.Table:
        at, keys, word_ids = (table.column(c).to_pylist() for c in ("at", "keys", "word_ids"))
        head = next(i for i, w in enumerate(word_ids) if w is None)
        body = [i for i in range(len(at)) if i != head]
        counts = np.frombuffer(at[head], dtype=np.int32)
        places = [np.frombuffer(at[i], dtype=np.int32) for i in body]
        values = [np.frombuffer(word_ids[i], dtype=np.int32) for i in body]
        slot = np.zeros(int(counts.sum()), dtype=np.int64)
        if body:
            slot[np.concatenate(places)] = np.repeat(np.arange(len(body)), [len(p) for p in places])
            sizes = np.array([len(v) for v in values])
            starts = np.cumsum(sizes) - sizes
            each = sizes[slot]
            shift = np.cumsum(each) - each
            flat = np.concatenate(values)[np.repeat(starts[slot] - shift, each) + np.arange(int(each.sum()))]
            ends = np.concatenate(([0], np.cumsum(each)))
        else:
            flat, ends = np.empty(0, np.int32), np.zeros(1, np.int64)
        offsets = ends[np.concatenate(([0], np.cumsum(counts)))]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
        return pa.table([pa.array(keys[head], table.schema.field("keys").type.value_type), lists], names=[id_col, "ids"])

    out = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return joined.groupBy("group").applyInArrow(assemble, out)


def token_bytes(spark: SparkSession, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """The token-byte table of a vocabulary: (token_id, token_hex)."""
    ranks = ranks if ranks is not None else read_ranks()
    return spark.createDataFrame([(i, b.hex()) for b, i in ranks.items()], "token_id int, token_hex string")


def decode(encoded: DataFrame, tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) of token id lists, by a join with the token-byte table.

    The table has one row per vocabulary entry, so it is broadcast. An empty or null list gives
    the empty text; an id outside the vocabulary gives U+FFFD. Keys must be unique.
    """
    hexes = (
        encoded.select(id_col, F.posexplode(ids_col).alias("pos", "token_id"))
        .join(F.broadcast(tokens), "token_id", "left")
        .groupBy(id_col)
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("token_hex", F.lit("efbfbd")).alias("hex")))).alias("parts"))
        .select(id_col, F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), "")), "UTF-8").alias("text"))
    )
    empty = encoded.where(F.coalesce(F.size(ids_col), F.lit(0)) <= 0).select(id_col, F.lit("").alias("text"))
    return hexes.unionByName(empty)
