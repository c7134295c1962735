"""Words, word sequences and their hashes, shared by the operators of this package."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: A word is a run of letters and digits.
WORD = re.compile(r"[^\W_]+")

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_of(text: str | None) -> list[str]:
    """Lower-cased words of a text; none for null."""
    return WORD.findall(text.lower()) if text else []


def plain_words_of(text: str | None) -> list[str]:
    """Words without accents and invisible characters (zero-width ones, soft hyphens)."""
    if not text:
        return []
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) not in ("Mn", "Cf"))
    return WORD.findall(text.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; bijective, so different inputs stay different."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def word_codes(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the lists, end to end, and the lists' lengths.

    Each distinct word of the batch is hashed once; the hash has a fixed key, so it is the
    same in every task.
    """
    lengths = np.fromiter((len(w) for w in lists), dtype=np.int64, count=len(lists))
    flat = [w for ws in lists for w in ws]
    if not flat:
        return np.empty(0, np.uint64), lengths
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    return pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False)[codes], lengths


def arrow_word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """`word_codes` of the words of an Arrow column of texts, without a Python object per word."""
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), pattern=r"[^\p{L}\p{N}]+")
    ends, values = parts.offsets.to_numpy(), parts.flatten()
    ends = ends - ends[0]
    coded = values.dictionary_encode()
    distinct = coded.dictionary.to_pandas().to_numpy(dtype=object)
    index = coded.indices.to_numpy()
    if not len(distinct):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    blank = np.flatnonzero(distinct == "")
    if len(blank):
        kept = index != blank[0]
        ends, index = np.concatenate(([0], np.cumsum(kept)))[ends], index[kept]
    return pd.util.hash_array(distinct, categorize=False)[index], np.diff(ends)


def gram_codes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` codes; len(codes) - size + 1 values (none if shorter)."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mix(out * _M1 + codes[i : i + n] + np.uint64(i + 1))
    return out


def gram_table(lists: list[list[str]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of `size` words of every list: (list number, start word, hash), in order."""
    codes, lengths = word_codes(lists)
    grams = gram_codes(codes, size)
    owner = np.repeat(np.arange(len(lists)), lengths)
    first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    if not len(grams):
        return np.empty(0, np.int64), np.empty(0, np.int64), grams
    keep = owner[: len(grams)] == owner[size - 1 :]
    owner, grams = owner[: len(grams)][keep], grams[keep]
    return owner, np.flatnonzero(keep) - first[owner], grams


def gram_sets(lists: list[list[str]], size: int = 3, least: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of `size` words of every list of at least `least` words.

    Returns (list number, hash), sorted by both.
    """
    owner, _, grams = gram_table([w if len(w) >= least else [] for w in lists], size)
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    return owner[fresh], grams[fresh]


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's signed longs."""
    return x.view(np.int64)
