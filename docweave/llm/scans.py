"""Noise in text from scanned pages: furniture, hyphenation, misread characters.

Page headers, footers and page numbers are found by perceptrons with page-position features
(`furniture`). Misread words and words split at a line's end are decided by an averaged-perceptron
character editor (`editor`) that predicts keep, replace, delete, insert and line-join operations.
All of them learn from the corpus itself, and from all of it: what is counted is counted by Spark, and
perceptrons are fitted on equal shares of the examples, each by one task, and their weights averaged.

Every different text is read once, by one Arrow pass; copies share its result. Word counts cover
all texts. Words are decided once each and meet the lines they stand in by a join.
"""

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm import furniture as pages
from docweave.llm.editor import Editor, Spoiler, join_features, lasting
from docweave.llm.furniture import MARKS, Furniture, Lines
from docweave.llm.perceptron import Perceptron, yes_no
from docweave.session import staged

#: Signs around a word that don't belong to it.
EDGES = ".,;:?!()\"“”„«»[]{}¿¡…*\f"


def words_of(line: str) -> list[str]:
    """The words of a line in small letters, without the signs around them; one that starts with an
    open bracket also with it, one that ends with an apostrophe also without it."""
    out = []
    for raw in line.lower().split():
        word = raw.strip(EDGES)
        if len(word) < 2 or 2 * sum(map(str.isdigit, word)) >= len(word) or not any(map(str.isalpha, word)):
            continue
        out.append(word)
        if word[-1] == "'":
            out.append(word[:-1])
        if raw[0] == "(" and ")" not in raw:
            out.append("(" + word)
    return out


def line_ends(body: list[tuple[int, str]]) -> list[tuple[int, str, str, str, int]]:
    """(line number, last part, mark, first part of the next line, its number) where a line ends with a mark."""
    out = []
    for (number, text), (following, rest) in zip(body, body[1:]):
        text = text.rstrip()
        if len(text) < 2 or text[-1] not in MARKS or not (text[-2].isalnum() or text[-2] in "'|@("):
            continue
        a, b = text[:-1].split()[-1].lstrip(EDGES), rest.split()[0].strip(EDGES)
        if a and b and b[0].isalpha() | (b[0] in "@|(0156") and any(map(str.isalpha, a)) and any(map(str.isalpha, b)):
            out.append((number, a, text[-1], b, following))
    return out


def different_texts(docs: DataFrame, id_col: str, text_col: str, pages_col: str | None) -> tuple[DataFrame, DataFrame]:
    """((id, text_key), (text_key, content, pages)): ids of the rows, each once, and every different text once."""
    keyed = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.md5(text_col).alias("text_key"), F.col(text_col).alias("content"), (F.col(pages_col) if pages_col else F.lit(None)).cast("int").alias("pages")
    )
    ids = keyed.groupBy("id").agg(F.max("text_key").alias("text_key"))
    return ids, keyed.groupBy("text_key").agg(F.any_value("content").alias("content"), F.max("pages").alias("pages"))


def mixed(rows: DataFrame, by: str, shares: int, fit: Callable[[pa.Table], dict[str, Perceptron]]) -> dict[str, Perceptron]:
    """Perceptrons fitted on all rows: on each of `shares` shares of them, drawn by the column `by`, and averaged."""

    def run(share: pa.Table) -> pa.Table:
        out = [(name, f, w) for name, model in fit(share.sort_by(by)).items() for f, w in [(None, 1.0), *model.weights.items()] if w]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.float64()))], ["model", "feature", "weight"])

    shared = rows.withColumn("share", F.pmod(F.xxhash64(by), F.lit(max(1, shares))))
    fitted = shared.groupBy("share").applyInArrow(run, "model string, feature string, weight double")
    # sums of decimals are the same in any order
    sums = fitted.groupBy("model", "feature").agg(F.sum(F.col("weight").cast("decimal(28,12)")).cast("double")).collect()
    parts = {model: n for model, feature, n in sums if feature is None}
    return {m: Perceptron({f: w / n for model, f, w in sums if model == m and f is not None}) for m, n in parts.items()}


def train_furniture(texts: DataFrame, share_chars: int = 3_000_000) -> Furniture:
    """Fit on all texts, in shares of about `share_chars` characters.

    What texts tell of others is counted over all of them before.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str]] = []
            for content, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = Lines(content, said)
                out += pages.told(lines, pages.Scene(lines))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.string()) for j in range(2)], ["kind", "name"])

    parted = texts.where(F.instr("content", "\f") > 0).select("content", "pages")
    counts = parted.mapInArrow(tell, "kind string, name string").groupBy("kind", "name").agg(F.count("*").alias("n"))
    known = pages.learn({(r[0], r[1]): r[2] for r in counts.where("kind <> 'heads' or n > 1").collect()})
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def fit(share: pa.Table) -> dict[str, Perceptron]:
        model = pages.fit(list(zip(share.column("content").to_pylist(), share.column("pages").to_pylist())), shared.value)
        return {"near": model.near, "around": model.around}

    chars = texts.agg(F.sum(F.length("content"))).first()[0] or 0
    models = mixed(texts.select("text_key", "content", "pages"), "text_key", -(-chars // share_chars), fit)
    return Furniture(models.get("near", Perceptron()), models.get("around", Perceptron()), known.heads)


READ = T.StructType(
    [T.StructField("text_key", T.StringType())]
    + [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("furniture", "at", "end_line", "end_next")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("words", "counted", "end_a", "end_mark", "end_b")]
)


def read_texts(texts: DataFrame, model: Furniture) -> DataFrame:
    """One row per text: its furniture lines, its words by line, its lines that end with a mark."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def read(content: str, said: int | None) -> tuple:
        lines = Lines(content, said)
        taken = shared.value.lines_of(lines)
        body = [(n, t) for k, (n, t) in enumerate(zip(lines.numbers, lines.texts)) if k not in taken]
        ends = line_ends(body)
        cut = {e[0] for e in ends}
        words, at, counted, rest = [], [], set(), False
        for number, text in body:
            tokens = text.split()
            kept = words_of(" ".join(tokens[int(rest) : len(tokens) - (number in cut)]))
            rest = number in cut
            some = set(kept)
            words += some
            at += [number] * len(some)
            counted |= some
        counted |= {w.rpartition("-")[0] + "-" for w in counted if "-" in w}
        return (sorted({lines.numbers[k] for k in taken}), at, [e[0] for e in ends], [e[4] for e in ends], words, sorted(counted), [e[1] for e in ends], [e[2] for e in ends], [e[3] for e in ends])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read(c, p) for c, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            lists = [pa.array([r[j] for r in rows], pa.list_(pa.int32() if j < 4 else pa.string())) for j in range(9)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), *lists], READ.names)

    return texts.select("text_key", "content", "pages").mapInArrow(run, READ)


def lexicon(read: DataFrame) -> DataFrame:
    """(word, n): how many different texts hold each word, over all texts; also the heads of compounds, as `word-`."""
    return read.select(F.explode("counted").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


class Models:
    """The editor, and the perceptron that joins lines."""

    def __init__(self, editor: Editor, joiner: Perceptron):
        self.editor, self.joiner = editor, joiner


#: Words of letters, with marks only inside, as `editor.plain`.
PLAIN = r"^\p{L}([\p{L}'’-]*\p{L})?$"


def misreadings(words: DataFrame, least: float = 0.004, longest: int = 2, much: int = 20) -> dict[tuple[str, str], float]:
    """`editor.learn_units` of all words, by a join on what two words have in common around their difference."""
    top = words.agg(F.max("n")).first()[0] or 0

    def parted(some: DataFrame) -> DataFrame:
        at = some.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
        sized = at.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(longest), F.length("word") - F.col("i")))).alias("s")).where("length(word) - s >= 4")
        return sized.selectExpr("word", "n", "i", "s", "substring(word, 1, i) as before", "substring(word, i + 1, s) as middle", "substring(word, i + s + 1) as after")

    frequent = parted(words.where((F.col("n") >= much) & F.col("word").rlike(PLAIN))).selectExpr("before", "after", "middle as meant", "word as right", "n as right_n")
    rare = parted(words.where(F.col("n") * much <= top))
    ways = rare.join(frequent.hint("shuffle_hash"), ["before", "after"]).where(
        f"""middle <> meant and right_n >= n * {much} and length(middle) + length(meant) < 4
        and not (middle <> '' and meant <> '' and (left(middle, 1) = left(meant, 1) or right(middle, 1) = right(meant, 1)))"""
    )
    ways = ways.groupBy("word", "right").agg(F.min(F.struct("i", "s", "middle", "meant")).alias("way")).select("word", "right", "way.middle", "way.meant")
    ways = ways.groupBy("word").agg(F.collect_list(F.struct("right", "middle", "meant")).alias("ways"))
    ways = ways.where("size(array_distinct(transform(ways, x -> struct(x.middle, x.meant)))) <= 3")
    ways = ways.select(F.explode("ways").alias("way"), (F.lit(1.0) / F.size("ways")).cast("decimal(18,9)").alias("part")).where("way.middle <> '' and way.meant <> ''")
    found = ways.groupBy("way.middle", "way.meant").agg(F.sum("part").alias("n"), F.countDistinct("way.right").alias("places")).where("places > 1")
    found = staged(found.select("middle", "meant", F.col("n").cast("double").alias("n")), "p1-misreadings")
    total = found.agg(F.sum(F.col("n").cast("decimal(28,9)")).cast("double")).first()[0] or 0.0
    return lasting({(r[0], r[1]): r[2] for r in found.where(F.col("n") >= max(3, least * total)).collect()}, total, least)


def readings(some: DataFrame, words: DataFrame, atoms: dict[str, str]) -> DataFrame:
    """`some` with (fixed, fixed_n): the words of at least three texts that have the key of its `word`, but not itself.

    Words that may be misreadings of each other have one key.
    """
    single = {c: k for c, k in atoms.items() if len(k) == 1}

    def keyed(df: DataFrame) -> DataFrame:
        key = F.col("word")
        for c, k in sorted(atoms.items()):
            if len(k) > 1:
                key = F.replace(key, F.lit(c), F.lit(k))
        if single:
            key = F.translate(key, "".join(single), "".join(single.values()))
        return df.where(~F.col("word").endswith("-")).withColumn("key", key)

    right = keyed(words).where((F.col("n") >= 3) & F.col("word").rlike(PLAIN)).select("key", F.col("word").alias("fixed"), F.col("n").alias("fixed_n"))
    return keyed(some).join(right, "key").where("word <> fixed").drop("key")


def train(words: DataFrame, share_words: int = 100_000, much: int = 20) -> Models:
    """Fit on all words, in shares of about `share_words` examples; every count is that of all texts."""
    editor = Editor(misreadings(words, much=much), Perceptron())
    spoiler = Spoiler(editor.units)
    return Models(Editor(editor.units, _fit_editor(words, editor, spoiler, share_words, much)), _fit_joiner(words, spoiler, share_words))


def _fit_editor(words: DataFrame, editor: Editor, spoiler: Spoiler, share_words: int, much: int) -> Perceptron:
    """Fit on what words with readings teach, and on frequent words spoilt."""

    def spoil(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(token, w, n, draw, guess) for w, n in zip(*(c.to_pylist() for c in batch.columns)) for draw, (token, guess) in enumerate(spoiler.spoilt(w, n))]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["word", "right", "right_n", "draw", "guess"])

    frequent = words.where((F.col("n") >= 8) & (F.length("word") >= 3) & F.col("word").rlike(PLAIN)).select("word", "n")
    spoilt = frequent.mapInArrow(spoil, "word string, right string, right_n long, draw long, guess long").join(words.select("word", "n"), "word", "left")
    spoilt = spoilt.where(F.coalesce("n", F.lit(0)) * much <= F.col("right_n")).select("word", F.coalesce("n", "guess").alias("n"), "right", "draw")
    own = words.where(F.length("word") >= 3).select("word", "n", F.lit(None).cast("string").alias("right"), F.lit(0).cast("long").alias("draw"))
    ways = F.sort_array(F.collect_list(F.struct("fixed", "fixed_n"))).alias("ways")
    taught = readings(own.unionByName(spoilt), words, editor.atoms).groupBy("word", "n", "right", "draw").agg(ways)
    taught = staged(taught.withColumn("id", F.concat_ws("\t", "word", "draw", "right")), "p1-taught")

    def fit(share: pa.Table) -> dict[str, Perceptron]:
        rows, pool, examples = zip(*(share.column(c).to_pylist() for c in ("word", "n", "right", "ways"))), {}, []
        for word, n, right, some in rows:
            taught = editor.lessons(word, n, right, [(w["fixed"], w["fixed_n"]) for w in some], much)
            for choices, number in taught[:1]:
                # every feature is held once
                examples += [([[pool.setdefault(f, f) for f in c] for c in choices], number)] * len(taught)
        return {"editor": Perceptron.fit(examples)}

    return mixed(taught, "id", -(-taught.count() // share_words), fit).get("editor", Perceptron())


#: Words looked up for a line's end, by their part in `join_features`, of the parts `la` and `lb`.
ROLES = {"joined": "concat(la, lb)", "hyphened": "concat_ws('-', la, lb)", "first": "la", "rest": "lb", "head": "concat(la, '-')"}


def looked_up(splits: DataFrame) -> DataFrame:
    """Every split once for each of its roles, with the word of the role."""
    return splits.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("role"), F.expr(v).alias("word")) for k, v in ROLES.items()))).alias("r")).select(*splits.columns, "r.role", "r.word")


def counted(looked: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """The splits with the count of each role's word."""
    return looked.join(words, "word", "left").groupBy(by).agg(*(F.coalesce(F.max(F.when(F.col("role") == k, F.col("n"))), F.lit(0)).alias(k) for k in ROLES))


def _fit_joiner(words: DataFrame, spoiler: Spoiler, share_words: int) -> Perceptron:
    """Fit on frequent words split at any place, and on compounds split at their hyphen."""
    frequent = words.where((F.col("n") >= 5) & (F.length("word") >= 5) & F.col("word").rlike(PLAIN)).select("word")
    many, compounds = frequent.agg(F.count("*"), F.count_if(F.contains("word", F.lit("-")))).first()
    repeats = max(1, many // (2 * max(1, compounds)))
    columns = ["id", "la", "mark", "lb", "other_mark", "right"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(f"{w}\t{k}", *x) for w in batch.column(0).to_pylist() for k, x in enumerate(spoiler.splits(w, repeats))]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((*[pa.string()] * 4, pa.bool_(), pa.int32()))], columns)

    splits = frequent.mapInArrow(split, "id string, la string, mark string, lb string, other_mark boolean, right int")
    taught = staged(counted(looked_up(splits), words, columns), "p1-splits")

    def fit(share: pa.Table) -> dict[str, Perceptron]:
        rows = zip(*(share.column(c).to_pylist() for c in (*ROLES, "mark", "other_mark", "right")))
        return {"joiner": Perceptron.fit([(yes_no(["join", *join_features(*row)]), right) for *row, right in rows], epochs=4)}

    return mixed(taught, "id", -(-taught.count() // share_words), fit).get("joiner", Perceptron())


def corrections(words: DataFrame, editor: Editor) -> DataFrame:
    """(word, fixed): the words of the corpus that the editor changes.

    Every word is sent once and met by the words that may be its readings. The editor scores each
    pair; the best stays.
    """
    shared = words.sparkSession.sparkContext.broadcast(editor)
    pairs = readings(words, words, editor.atoms).select("word", "n", "fixed", "fixed_n")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.gain
        for batch in batches:
            found = [gain(*row) for row in zip(*(c.to_pylist() for c in batch.columns))]
            scores = pa.array([g if g is not None and g > 0 else None for g in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), scores], ["word", "fixed", "score"])

    scored = pairs.mapInArrow(score, "word string, fixed string, score double").where("score is not null")
    return scored.groupBy("word").agg(F.max_by("fixed", F.struct("score", "fixed")).alias("fixed"))


def defects(read: DataFrame, words: DataFrame, models: Models, fixes: DataFrame, most_broadcast: int = 300_000) -> DataFrame:
    """(text_key, line_no, kind, seen, fixed): every line with a defect, kind by kind.

    kind is `furniture`, `hyphen` (seen and fixed: the parts, and the word they make) or `char`
    (the misread word and its reading). Lines count from 1, split at line feeds.

    Corrections are broadcast while there are at most `most_broadcast` (counted before), else the
    words are shuffled to them.
    """
    spark = read.sparkSession
    if fixes.limit(most_broadcast + 1).count() <= most_broadcast:
        fixes = F.broadcast(fixes)
    ends = read.select("text_key", F.explode(F.arrays_zip("end_line", "end_next", "end_a", "end_mark", "end_b")).alias("e"), (F.size(F.array_distinct("end_mark")) > 1).alias("other_mark"))
    ends = ends.select("text_key", F.col("e.end_line").alias("line_no"), F.col("e.end_next").alias("next_no"), F.col("e.end_a").alias("a"), F.col("e.end_mark").alias("mark"), F.col("e.end_b").alias("b"), "other_mark")
    ends = ends.withColumns({"la": F.lower("a"), "lb": F.lower("b")})
    splits = ends.select("la", "mark", "lb", "other_mark").distinct()
    looked = looked_up(splits).join(fixes, "word", "left").withColumn("word", F.when(F.col("role").isin("joined", "hyphened"), F.coalesce("fixed", "word")).otherwise(F.col("word"))).drop("fixed")
    found = counted(looked, words, ["la", "mark", "lb", "other_mark"])
    joiner = spark.sparkContext.broadcast(models.joiner)

    @F.pandas_udf("boolean")
    def joins(frame: pd.DataFrame) -> pd.Series:
        names = [*ROLES, "mark", "other_mark"]
        return pd.Series([joiner.value.score(["join", *join_features(*row)]) > 0 for row in frame[names].itertuples(index=False, name=None)], dtype="bool")

    joined = found.where(joins(F.struct(*found.columns))).select("la", "mark", "lb", "other_mark")
    hyphens = ends.join(joined, ["la", "mark", "lb", "other_mark"], "left_semi")
    hyphens = hyphens.select("text_key", "line_no", F.lit("hyphen").alias("kind"), F.concat("a", "mark", "b").alias("seen"), F.concat("a", "b").alias("fixed"))

    spoken = read.select("text_key", F.explode(F.arrays_zip("at", "words")).alias("w")).select("text_key", F.col("w.at").alias("line_no"), F.col("w.words").alias("word"))
    chars = spoken.join(fixes, "word").select("text_key", "line_no", F.lit("char").alias("kind"), F.col("word").alias("seen"), "fixed")
    # In a word broken at a line's end, the line of its first difference has the defect.
    broken = ends.select("text_key", "line_no", "next_no", "la", F.explode(F.array(F.concat("la", "lb"), F.concat_ws("-", "la", "lb"))).alias("word")).join(fixes, "word")
    at = F.length(F.regexp_extract(F.concat_ws("\n", "word", "fixed"), r"^(.*).*\n\1", 1))
    broken = broken.select("text_key", F.when(at >= F.length("la"), F.col("next_no")).otherwise(F.col("line_no")).alias("line_no"), F.lit("char").alias("kind"), F.col("word").alias("seen"), "fixed")
    none = F.lit(None).cast("string")
    lines = read.select("text_key", F.explode("furniture").alias("line_no")).select("text_key", "line_no", F.lit("furniture").alias("kind"), none.alias("seen"), none.alias("fixed"))
    return lines.unionByName(hyphens).unionByName(chars).unionByName(broken)


def find(docs: DataFrame, id_col: str = "id", text_col: str = "content", pages_col: str | None = "pages") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, text_key), (text_key, content, pages) and `defects` of all texts.

    Rows without an id or a text are left out; an id with several texts stands for the one of the
    greatest key. Copies, however many, are read once. Tables between the steps are written to the
    shared folder.
    """
    ids, texts = different_texts(docs, id_col, text_col, pages_col)
    texts = staged(texts, "p1-texts")
    read = staged(read_texts(texts, train_furniture(texts)), "p1-read")
    words = staged(lexicon(read), "p1-words")
    models = train(words)
    fixes = staged(corrections(words, models.editor), "p1-fixes")
    return ids, texts, defects(read, words, models, fixes)


def _in_case_of(seen: str, fixed: str) -> str:
    return fixed.upper() if seen.isupper() and len(seen) > 1 else fixed[:1].upper() + fixed[1:] if seen[:1].isupper() else fixed


def repair_text(content: str, found: list[dict]) -> str:
    """The text as paragraphs: without furniture, words joined, misread words put right."""
    furniture = {d["line_no"] for d in found if d["kind"] == "furniture"}
    hyphens = {d["line_no"] for d in found if d["kind"] == "hyphen"}
    fixes = {d["seen"]: d["fixed"] for d in found if d["kind"] == "char"}

    def fix(token: str) -> str:
        core = token.strip(EDGES)
        for form in (core, core.rstrip("'"), "(" + core if token[:1] == "(" else core):
            if fixed := fixes.get(form.lower()):
                return token.replace(form, _in_case_of(core, fixed), 1)
        return token

    lines = Lines(content)
    paragraphs: list[list[str]] = []
    glue, new = False, True
    for k, (number, raw, body) in enumerate(zip(lines.numbers, lines.raw, lines.texts)):
        if number in furniture:
            continue
        if raw.startswith(("\t", "   ")) and not glue:
            new = True
        if number in hyphens:
            body = body[:-1]
        if new:
            paragraphs.append([body])
        elif glue:
            paragraphs[-1][-1] += body
        else:
            paragraphs[-1].append(body)
        glue = number in hyphens
        ended = body.endswith((".", "?", "!")) and len(raw) < 0.7 * lines.width
        new = not glue and (lines.after[k] and not lines.bottom[k] and not _before_furniture(lines, k, furniture) or ended)
    return "\n\n".join(" ".join(fix(t) for t in " ".join(p).split()) for p in paragraphs)


def _before_furniture(lines: Lines, k: int, furniture: set[int]) -> bool:
    return k + 1 < len(lines.numbers) and lines.numbers[k + 1] in furniture


def repair(docs: DataFrame, id_col: str = "id", text_col: str = "content", pages_col: str | None = "pages") -> DataFrame:
    """(id_col, text_col): every text as continuous paragraphs; each id once, null stays null.

    A text without defects only has its lines joined into paragraphs.
    """
    ids, texts, found = find(docs, id_col, text_col, pages_col)
    listed = found.groupBy("text_key").agg(F.collect_list(F.struct("line_no", "kind", "seen", "fixed")).alias("found"))
    rows = texts.select("text_key", "content").join(listed, "text_key", "left").select("text_key", "content", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [repair_text(c, f or []) for c, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["text_key", "text"])

    repaired = rows.mapInArrow(run, "text_key string, text string")
    all_ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    whole = all_ids.join(ids, "id", "left").join(repaired, "text_key", "left")
    return whole.select(F.col("id").alias(id_col), F.col("text").alias(text_col))
