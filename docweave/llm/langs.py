"""Missing or wrong document language labels, and mixed-language segments.

Method: string-kernel classification. A blended-spectrum presence kernel compares texts by the
character n-grams (1 to `order`) of their words; Nystroem landmarks give it finite coordinates, and
one-versus-rest kernel ridge regression is fitted on them. As the kernel is linear in gram
presence, the fitted model folds into one weight row per gram, so a batch of distinct words is
scored by one sparse-dense matrix product. A pass over each document's words then finds the
stretches of one language: changing language costs, and costs less at the end of a sentence.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.words import WORD, mix

#: Usual codes and names of the seven languages.
NAMES = {
    "en": ["en", "eng", "english", "englisch", "anglais"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais", "französisch"],
    "es": ["es", "spa", "esp", "spanish", "español", "espanol", "castellano", "castilian"],
    "it": ["it", "ita", "italian", "italiano", "italienisch"],
    "pt": ["pt", "por", "portuguese", "português", "portugues", "portugiesisch"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands", "flemish"],
}

_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
#: What counts for no language: fenced code, log entries, table cells.
_NO_LANGUAGE = re.compile(
    r"```.*?(?:```|\Z)"
    r"|\d{4}-\d\d-\d\d[t ]\d\d:\d\d:\d\d[\d.,:]*z?\s+(?:trace|debug|info|warn|warning|error|fatal|critical)\b[^\n]*?(?:\S+=\S+|(?=\n)|\Z)"
    r"|(?:\|[^|\n]*){2,}\|"
    r"|\{[^{}\n]*(?:\{[^{}\n]*\}[^{}\n]*)*\}",
    re.S | re.I,
)
#: References such as AB-1234 are words of no language; the mark makes their letters neutral.
_REFERENCE = re.compile(r"\b([^\W\d_]{1,4})-(?=\d)")
_SENTENCE_END = re.compile(r"[.!?:;\n\r“”\"»«>()\[\]]")


def label_code(label: Column) -> Column:
    """The language code a label names, with or without region and capitals; null if it names none."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}]+)(?:[-_ (/,;].*)?$", 1)
    code = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        code = F.when(base.isin(names), lang).otherwise(code)
    return code


def _grams(word: str, order: int) -> set[str]:
    marked = f"^{word}$"
    return {marked[i : i + n] for n in range(1, order + 1) for i in range(len(marked) - n + 1)} - {"^", "$"}


def _gram_rows(words: list[str], order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, gram slot) of the grams present in each word."""
    rows, grams = [], []
    for i, w in enumerate(words):
        found = _grams(w, order)
        rows += [i] * len(found)
        grams += found
    if not grams:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes, distinct = pd.factorize(np.array(grams, dtype=object))
    slots = mix(pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False)) >> np.uint64(64 - bits)
    return np.array(rows), slots.astype(np.int64)[codes]


@dataclass
class LanguageModel:
    """Weights of each gram slot by language (the folded kernel expansion)."""

    langs: list[str]
    weights: np.ndarray
    order: int
    bits: int

    def word_scores(self, words: list[str]) -> np.ndarray:
        """One row of language scores per word; words with digits score 0."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        rows, slots = _gram_rows(words, self.order, self.bits)
        if len(rows):
            starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            sums = np.add.reduceat(self.weights[slots], starts, axis=0)
            sizes = np.diff(np.concatenate((starts, [len(rows)])))
            out[rows[starts]] = sums / np.sqrt(sizes)[:, None]
        out -= out.mean(axis=1, keepdims=True)
        out[np.array([any(c.isdigit() for c in w) for w in words], bool)] = 0
        return out


def words_with_ends(text: str | None) -> tuple[list[str], list[bool]]:
    """Lower-cased words that count for a language, and whether a sentence may end after each."""
    if not text:
        return [], []
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFC", text))
    text = _REFERENCE.sub(r"0\1-", _NO_LANGUAGE.sub("\n", text)).lower()
    words, ends, last = [], [], None
    for m in WORD.finditer(text):
        if last is not None:
            ends.append(_SENTENCE_END.search(text, last, m.start()) is not None)
        words.append(m.group())
        last = m.end()
    if words:
        ends.append(True)
    return words, ends


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def fit(texts: list[str], langs: list[str], order: int = 4, bits: int = 16, landmarks: int = 600, ridge: float = 0.3, seed: int = 7) -> LanguageModel:
    """Kernel ridge regression on Nystroem coordinates of windows of the labelled texts.

    Windows of 1 to 8 words, as written and without accents, are the examples, so that the model
    serves short stretches too. The number of landmarks bounds all matrices.
    """
    kinds = sorted(set(langs))
    examples, target = [], []
    for text, lang in zip(texts, langs):
        for t in dict.fromkeys((text, plain(text))):
            words, _ = words_with_ends(t)
            words = [w for w in words if not any(c.isdigit() for c in w)]
            for size in (1, 2, 4, 8):
                for i in range(0, len(words), size):
                    examples.append(words[i : i + size])
                    target.append(kinds.index(lang))
    target = np.array(target)
    flat = sorted({w for e in examples for w in e})
    number = {w: i for i, w in enumerate(flat)}
    rows, slots = _gram_rows(flat, order, bits)
    used, local = np.unique(slots, return_inverse=True)
    first = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(flat)))))
    word_slots = [local[first[i] : first[i + 1]] for i in range(len(flat))]

    def presence(block: list[list[str]]) -> np.ndarray:
        """Normalised gram presence of some examples."""
        x = np.zeros((len(block), len(used)), np.float32)
        for i, e in enumerate(block):
            for w in e:
                x[i, word_slots[number[w]]] = 1
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    rng = np.random.default_rng(seed)
    chosen = np.sort(rng.choice(len(examples), min(landmarks, len(examples)), replace=False))
    base = presence([examples[i] for i in chosen])
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    good = values > values.max() * 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.concatenate([(presence(examples[i : i + 500]) @ base.T).astype(np.float64) @ root for i in range(0, len(examples), 500)])
    y = np.where(target[:, None] == np.arange(len(kinds)), 1.0, -1.0)
    weight = 1 / np.bincount(target, minlength=len(kinds))[target]
    weight *= len(target) / weight.sum()
    gram = (phi * weight[:, None]).T @ phi
    beta = np.linalg.solve(gram + ridge * np.eye(gram.shape[0]), (phi * weight[:, None]).T @ y)
    table = np.zeros((1 << bits, len(kinds)), np.float32)
    table[used] = base.T @ (root @ beta).astype(np.float32)
    return LanguageModel(kinds, table, order, bits)


def stretches(scores: list[np.ndarray], ends: list[np.ndarray], inside: float, at_end: float) -> list[np.ndarray]:
    """Best language of each word of every document, all documents of a batch side by side.

    A change of language costs `inside`, or `at_end` after the end of a sentence.
    """
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    out: list[np.ndarray] = [np.empty(0, np.int8)] * len(scores)
    lens = np.array([len(scores[i]) for i in order])
    block = 0
    while block < len(order):
        longest = int(lens[block])
        if not longest:
            break
        stop = min(len(order), block + max(1, 2_000_000 // longest))
        rows = [order[i] for i in range(block, stop) if lens[i]]
        k = scores[rows[0]].shape[1]
        size = np.array([len(scores[i]) for i in rows])
        emit = np.zeros((longest, len(rows), k), np.float32)
        cost = np.zeros((longest, len(rows)), np.float32)
        for c, i in enumerate(rows):
            emit[: size[c], c] = scores[i]
            cost[1 : size[c], c] = np.where(ends[i][:-1], at_end, inside)
        total = emit[0].copy()
        back = np.zeros((longest, len(rows), k), np.int8)
        for t in range(1, longest):
            n = int(np.searchsorted(-size, -t, side="left"))  # documents longer than t words
            if not n:
                break
            now = total[:n]
            best = now.argmax(axis=1)
            jump = now[np.arange(n), best] - cost[t, :n]
            stay = now >= jump[:, None]
            back[t, :n] = np.where(stay, np.arange(k), best[:, None])
            total[:n] = np.where(stay, now, jump[:, None]) + emit[t, :n]
        for c, i in enumerate(rows):
            path = np.empty(size[c], np.int8)
            state = int(total[c].argmax())
            for t in range(size[c] - 1, -1, -1):
                path[t] = state
                state = int(back[t, c, state])
            out[i] = path
        block = stop
    return out


def segments_of(path: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(language, first word, end word, confidence) of each stretch of one language."""
    if not len(path):
        return []
    cuts = np.concatenate(([0], np.flatnonzero(path[1:] != path[:-1]) + 1, [len(path)]))
    out = []
    for a, b in zip(cuts, cuts[1:]):
        mean = scores[a:b].mean(axis=0, dtype=np.float64)
        lead = mean[path[a]] - np.delete(mean, path[a]).max(initial=-np.inf)
        out.append((int(path[a]), int(a), int(b), float(1 / (1 + np.exp(-np.clip(lead * np.sqrt(b - a), -30, 30))))))
    return out


def train(samples: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "sample_id", most: int = 2000) -> LanguageModel:
    """Fit on at most `most` labelled rows, a documented bound for the classifier only: as many of each language, by hash."""
    known = samples.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    share = max(1, most // max(1, known.select(lang_col).distinct().count()))
    place = F.row_number().over(Window.partitionBy(lang_col).orderBy(F.xxhash64(text_col), id_col))
    rows = known.withColumn("__place", place).where(F.col("__place") <= share).orderBy(id_col).select(lang_col, text_col).collect()
    return fit([r[1] for r in rows], [r[0] for r in rows])


def language_segments(
    docs: DataFrame,
    model: LanguageModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    beta: float = 4.0,
    most: float = 2.5,
    inside: float = 10.0,
    at_end: float = 5.0,
) -> DataFrame:
    """(id_col, the columns `keep`, segments) for every row: its stretches of one language.

    A segment has lang, first_word, end_word and confidence. Word numbers count the words that may
    have a language (code, log entries and table cells are left out). A word counts at most `most`
    for a language, so a few words alike in two languages don't split a stretch; `beta` scales the
    scores; `inside` and `at_end` are the costs of a change of language. Null, blank and
    figure-only texts have an empty list. Repeated ids give a row each.
    """
    kept = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("body"), *(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    seg_type = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known: dict[str, int] = {}
        table = np.zeros((1024, len(model.langs)), np.float32)
        for batch in batches:
            found = [words_with_ends(t) for t in batch.column(1).to_pylist()]
            if len(known) > 400_000:  # bounds the memory of a task; words are scored again
                known.clear()
            fresh = list(dict.fromkeys(w for ws, _ in found for w in ws if w not in known))
            if fresh:
                at = len(known)
                while at + len(fresh) > len(table):
                    table = np.concatenate((table, np.zeros_like(table)))
                table[at : at + len(fresh)] = np.clip(model.word_scores(fresh) * beta, -most, most)
                known.update((w, at + i) for i, w in enumerate(fresh))
            scores = [table[[known[w] for w in ws]] if ws else table[:0] for ws, _ in found]
            paths = stretches(scores, [np.array(e, bool) for _, e in found], inside, at_end)
            out = []
            for s, p in zip(scores, paths):
                bears = bool(len(p)) and bool(np.abs(s).max() > 0)
                out.append([{"lang": model.langs[g], "first_word": a, "end_word": b, "confidence": c} for g, a, b, c in segments_of(p, s)] if bears else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(batch.column(2 + i) for i in range(len(keep))), pa.array(out, seg_type)], [f.name for f in schema.fields]
            )

    segment = T.StructType().add("lang", "string").add("first_word", "integer").add("end_word", "integer").add("confidence", "double")
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in (id_col, *keep)]).add("segments", T.ArrayType(segment))
    return kept.mapInArrow(run, schema)


def document_languages(segments: DataFrame) -> DataFrame:
    """The rows with main_lang, words and confidence: the language most words of a document are in.

    Documents without words of a language are left out; ties go to the language that comes first
    in the document.
    """
    langs = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    words = lambda lang: F.aggregate(
        F.filter("segments", lambda s: s["lang"] == lang), F.lit(0), lambda n, s: n + s["end_word"] - s["first_word"]
    )
    sure = lambda lang: F.array_max(F.transform(F.filter("segments", lambda s: s["lang"] == lang), lambda s: s["confidence"]))
    ranked = F.array_sort(
        F.transform(langs, lambda lang, i: F.struct((-words(lang)).alias("minus"), i.alias("place"), lang.alias("lang"), sure(lang).alias("confidence")))
    )
    return (
        segments.where(F.size("segments") > 0)
        .select("*", ranked[0].alias("top"))
        .select(*(c for c in segments.columns), F.col("top.lang").alias("main_lang"), (-F.col("top.minus")).alias("words"), F.col("top.confidence").alias("confidence"))
    )
