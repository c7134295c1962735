"""Deduplicating new batches against all history.

Method: a text's fingerprints are the rarer part of its distinct word sequences (3 words each, in
one order for the whole store). Any two texts with the asked likeness share one of them, so none is
missed. Partitioned Bloom filters prescreen the fingerprints of a new batch; the positives are
looked up in a persistent store, only in its buckets that they fall into; pairs whose sizes,
positions and number of shared fingerprints leave room for the likeness are verified on their whole
sets; then filters and store take in the batch.

A new batch is first held against the accepted texts. What is alike to one of them is rejected and
met with no other rejected text. The rest meets itself and what was rejected, in one join, and is
decided in order; what is then accepted is held against the rejected texts of the store, as these
pairs are asked too. Texts of the history aren't read again.

A batch takes few jobs, as every job stays in the driver's memory for a while: fingerprints stay
packed by text until they are met, and what is small is counted and sent to where it is needed.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.words import gram_sets, mix, signed, words_of
from docweave.session import scratch_path, staged

GRAM_WORDS, LEAST_WORDS = 3, 20
BLOOM_HASHES = 4
#: Rows of keys or fingerprints that are sent to every task, counted before; more are shuffled.
SENT_ROWS = 200_000
#: Pairs of a batch, counted before, that one task decides in order; of more, rounds decide a part first.
ORDERED_PAIRS = 1_000_000
#: Fingerprints that a pair must share before its whole sets are read, where its sizes ask for so many; more drop more pairs but meet more of them.
SHARED_PRINTS = 8
#: Texts, or pairs of sets, that a Python worker takes up at once.
SLICE = 500

FRESH = "text_key binary, first_id {}, n int, grams binary, prints array<long>"
REJECTED = "text_key binary, known boolean"
#: A batch of the store is one table; `kind` says which of its columns a row has.
STORE = "print long, text_key binary, n int, pos int, grams binary, bits binary, id {}, in_store boolean, other_key binary, likeness double, batch string, kind string, accepted int, bucket int"


def shared_grams(pairs: DataFrame, left: str, right: str, name: str = "shared") -> DataFrame:
    """Adds how many hashes two packed sorted columns share; drops the two columns."""
    kept = [c for c in pairs.columns if c not in (left, right)]
    schema = T.StructType([*(pairs.schema[c] for c in kept), T.StructField(name, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                found = [
                    len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
                    for a, b in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(found, pa.int32())], [*kept, name])

    return pairs.select(*kept, left, right).mapInArrow(run, schema)


def _sets_of(texts: list[str | None]) -> list[np.ndarray]:
    owner, grams = gram_sets([words_of(t) for t in texts], GRAM_WORDS, LEAST_WORDS)
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [grams[a:b] for a, b in zip(ends, ends[1:])]


def count_sketch(texts: DataFrame, bits: int) -> np.ndarray:
    """Counts of word sequences in 2^bits slots, over all texts: the order of rarity. Its size is fixed."""
    slots, block = 1 << bits, 1 << max(bits - 6, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for grams in _sets_of(batch.column(0).slice(at, SLICE).to_pylist()):
                    counts[(grams % np.uint64(slots)).astype(np.int64)] += 1
        for i in range(0, slots, block):
            if counts[i : i + block].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // block], pa.int32()), pa.array([counts[i : i + block].tobytes()], pa.binary())], ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist())
        return pa.table([table.column("block").slice(0, 1), pa.array([np.minimum(total, 65535).astype(np.uint16).tobytes()], pa.binary())], names=["block", "counts"])

    out = np.zeros(slots, np.uint16)
    for block_no, counts in texts.mapInArrow(run, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        out[block_no * block : (block_no + 1) * block] = np.frombuffer(counts, np.uint16)
    return out


def _bits_of(prints: np.ndarray, size: int) -> np.ndarray:
    """Bit numbers of fingerprints in a filter of `size` bits, one row per hash function."""
    x = mix(prints.view(np.uint64))
    y = mix(x + np.uint64(1)) | np.uint64(1)
    return np.stack([(x + np.uint64(i) * y) % np.uint64(size) for i in range(BLOOM_HASHES)])


class History:
    """A persistent store of accepted and rejected documents in a folder all executors share.

    Open one on a new folder to begin it, or on an old one, in a later session too, to go on. Every
    batch adds a folder of its own; an entry in `batches` makes it count, so a batch that fails
    half-way leaves none. A batch has rows of five kinds, each in a folder: `print` (fingerprints, by
    decision and bucket), `set` (whole sets, by bucket), `bloom` (filters), `pair` and `document`.

    `least`, the number of buckets and the order of word sequences are fixed by the first batch.
    """

    def __init__(self, spark: SparkSession, root: str, least: float = 0.5, bucket_prints: int = 8_000_000, bits_per_print: int = 12, sketch_bits: int = 21):
        self.spark, self.root, self.least = spark, root, least
        self.bucket_prints, self.bits_per_print, self.sketch_bits = bucket_prints, bits_per_print, sketch_bits
        self.batches, self.id_type = sorted(self._names("batches")), "string"
        self.buckets, self.slots, self.sketch = 1, 64, None
        if self.batches:
            fixed = spark.read.parquet(f"{root}/fixed").first()
            self.buckets, self.slots, self.least, self.id_type = (fixed[c] for c in ("buckets", "slots", "least", "id_type"))
            self._share(np.frombuffer(fixed["counts"], np.uint16))

    def _path(self, name: str) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path, fs = self._path(name)
        return [status.getPath().getName() for status in fs.listStatus(path)] if fs.exists(path) else []

    def _share(self, sketch: np.ndarray) -> None:
        self.sketch = self.spark.sparkContext.broadcast(sketch)

    def _rows(self, kind: str, *columns: str) -> DataFrame:
        """Rows of a kind of all batches that count."""
        if not self.batches:
            return self.spark.createDataFrame([], STORE.format(self.id_type)).select(*columns)
        found = [self._path(f"store/batch={batch}/kind={kind}") for batch in self.batches]  # to list all kinds' folders takes a job
        paths = [path.toString() for path, fs in found if fs.exists(path)]
        if not paths:
            return self.spark.createDataFrame([], STORE.format(self.id_type)).select(*columns)
        return self.spark.read.schema(STORE.format(self.id_type)).option("basePath", f"{self.root}/store").parquet(*paths).select(*columns)

    def _write(self, tag: str, **kinds: DataFrame) -> None:
        """Write a batch's rows by kind and bucket."""
        parts = []
        for kind, df in kinds.items():
            for c in ("accepted", "bucket"):
                df = df if c in df.columns else df.withColumn(c, F.lit(-1))
            spread = kind in ("print", "set") and self.buckets > 1
            parts.append((df.repartition("bucket") if spread else df).withColumn("kind", F.lit(kind)))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part, allowMissingColumns=True)
        whole.write.partitionBy("kind", "accepted", "bucket").parquet(f"{self.root}/store/batch={tag}")
        path, fs = self._path(f"batches/{tag}")
        fs.mkdirs(path)  # from here on the batch counts
        self.batches.append(tag)

    def bucket(self, column: str) -> F.Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def slot(self) -> F.Column:
        return F.pmod(F.xxhash64("print"), F.lit(self.slots)).cast("int")

    def _buckets_of(self, df: DataFrame, column: str) -> list[int]:
        if self.buckets == 1:
            return [0]
        return [r[0] for r in df.select(self.bucket(column)).distinct().collect()]  # at most the number of buckets

    def prints(self, accepted: bool, buckets: list[int]) -> DataFrame:
        return self._rows("print", "print", "text_key", "n", "pos", "accepted", "bucket").where((F.col("accepted") == int(accepted)) & F.col("bucket").isin(buckets))

    def sets(self, buckets: list[int]) -> DataFrame:
        return self._rows("set", "text_key", "n", "grams", "bucket").where(F.col("bucket").isin(buckets))

    def documents(self) -> DataFrame:
        """(id, text_key, accepted) of all documents; text_key is null for texts that are alike to none."""
        return self._rows("document", "id", "text_key", F.col("in_store").alias("accepted"))

    def fingerprints(self, texts: DataFrame) -> DataFrame:
        """(text_key, first_id, n, grams, prints): distinct word sequences, packed and sorted, and the
        fingerprints, rarest first. Texts of fewer than 20 words are left out."""
        shared, least = self.sketch, self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(at, SLICE)
                    kept, sets, prints = [], [], []
                    for i, grams in enumerate(_sets_of(batch.column(2).to_pylist())):
                        if len(grams):
                            size = len(grams) - int(np.ceil(least * len(grams) - 1e-9)) + 1
                            order = np.lexsort((grams, counts[(grams % np.uint64(len(counts))).astype(np.int64)]))
                            kept.append(i)
                            sets.append(grams)
                            prints.append(signed(grams[order[:size]]))
                    part = batch.take(pa.array(kept, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(prints, pa.list_(pa.int64()))],
                        ["text_key", "first_id", "n", "grams", "prints"],
                    )

        return texts.select("text_key", "first_id", "text").mapInArrow(run, FRESH.format(self.id_type))

    def filters(self, prints: DataFrame) -> DataFrame:
        """(pos, bits) of fingerprints, pos being their slot; a filter's length follows their number."""
        per_print, names = self.bits_per_print, ["pos", "bits"]

        def fill(key: tuple, table: pa.Table) -> pa.Table:
            size = max(1 << 10, -(-table.num_rows * per_print // 8) * 8)
            bits = np.zeros(size // 8, np.uint8)
            at = _bits_of(table.column("print").to_numpy(), size).ravel()
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=names)

        return prints.select(self.slot().alias("at"), "print").groupBy("at").applyInArrow(fill, "pos int, bits binary")

    def positives(self, probes: DataFrame) -> DataFrame:
        """The rows (print, text_key, n, pos) whose fingerprint may be in the store."""
        schema = probes.schema

        def screen(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.select(schema.names)
            hit = np.zeros(left.num_rows, bool)
            prints = left.column("print").to_numpy()
            for packed in right.column("bits"):
                bits = np.frombuffer(packed.as_py(), np.uint8)
                rest = np.flatnonzero(~hit)
                at = _bits_of(prints[rest], len(bits) * 8)
                hit[rest] = ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
            return left.filter(pa.array(hit))

        filters = self._rows("bloom", F.col("pos").alias("bucket"), "bits")
        return probes.withColumn("bucket", self.slot()).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(screen, schema)

    def _candidates(self, new: DataFrame, old: DataFrame) -> DataFrame:
        """(new, old): pairs whose common fingerprints leave room for the likeness, by sizes, places and number.

        Two alike texts have at least `need` sequences in common. From the k-th of these on, in their order,
        either text has need - k + 1 or more, so the first `sure` of them are fingerprints of both. The
        first `asked` of these leave room for need - asked + 1, and a pair with fewer such fingerprints
        isn't alike. One that is stored twice only counts for more.
        """
        a = new.select("print", F.col("text_key").alias("new"), F.col("n").alias("n_new"), F.col("pos").alias("pos_new"))
        b = old.select("print", F.col("text_key").alias("old"), F.col("n").alias("n_old"), F.col("pos").alias("pos_old"), *(c for c in old.columns if c == "gone"))
        room = F.least(F.col("n_new") - F.col("pos_new"), F.col("n_old") - F.col("pos_old"))
        need = F.ceil((F.col("n_new") + F.col("n_old")) * (self.least / (1 + self.least)) - 1e-6)
        sure = need - F.ceil(F.greatest("n_new", "n_old") * self.least - 1e-9) + 1  # of the common sequences, so many are fingerprints of both
        asked = F.greatest(F.lit(1), F.least(F.lit(SHARED_PRINTS), sure))
        met = a.join(b, "print").where(room >= need - asked + 1)
        of = ["new", "old"]
        if "gone" in old.columns:
            met, of = met.where(F.col("gone") | (F.col("new") < F.col("old"))), [*of, "gone"]  # a batch with itself: each pair once
        return met.groupBy(*of).agg(F.count(F.lit(1)).alias("common"), F.max(asked).alias("asked")).where("common >= asked").select(*of)

    def _verified(self, pairs: DataFrame, new: DataFrame, old: DataFrame, *kept: str) -> DataFrame:
        """The pairs (new, old, *kept, likeness) that are alike, by their whole sets; `kept` are columns of either text or pair."""
        a = new.select(F.col("text_key").alias("new"), F.col("n").alias("n_new"), F.col("grams").alias("grams_new"), *(F.col("first_id").alias(c) for c in kept if c == "id_new"))
        b = old.select(F.col("text_key").alias("old"), F.col("n").alias("n_old"), F.col("grams").alias("grams_old"), *(F.col("first_id").alias(c) for c in kept if c == "id_old"))
        shared = shared_grams(pairs.join(b, "old").join(a, "new"), "grams_new", "grams_old")  # of the store, which is larger, only what is in pairs is shuffled
        likeness = F.col("shared") / (F.col("n_new") + F.col("n_old") - F.col("shared"))
        return shared.select("new", "old", *kept, likeness.alias("likeness")).where(F.col("likeness") >= self.least)

    def _looked_up(self, probes: DataFrame, fresh: DataFrame, accepted: bool) -> DataFrame:
        """Pairs (new, old, likeness) of a batch's texts with accepted or with rejected texts of the store, the same text among them."""
        found = self._candidates(probes, self.prints(accepted, self._buckets_of(probes, "print")))
        found = _sent(*_counted(found, "candidates"))  # the buckets of the sets are known from the candidates
        self._clean()
        return self._verified(found, fresh, self.sets(self._buckets_of(found, "old"))).distinct()  # a rejected text may be stored by several batches

    def add(self, docs: DataFrame, id_col: str = "id", text_col: str = "content") -> str:
        """Check a batch against the store and take it in; returns the batch's name in the store.

        The first batch is accepted as it is. An id must come once; rows without one are left out.
        """
        begun = bool(self.batches)
        tag = f"{len(self.batches):06d}-{uuid.uuid4().hex[:8]}"
        rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.unhex(F.md5(text_col)).alias("text_key"), F.col(text_col).alias("text"))
        texts = rows.where("text is not null").groupBy("text_key").agg(F.min("id").alias("first_id"), F.any_value("text").alias("text"))
        if not begun:
            self.id_type = docs.schema[id_col].dataType.simpleString()
            self._share(count_sketch(texts.select("text"), self.sketch_bits))
        fresh = staged(self.fingerprints(texts), "fresh")
        probes = _exploded(fresh)
        kinds = {}
        if begun:
            rejected, kinds["pair"] = self._decide(fresh)
        else:
            total = fresh.agg(F.sum(F.size("prints"))).first()[0] or 0
            self.buckets = 1 << max(0, (total // self.bucket_prints).bit_length())
            self.slots = max(64, 1 << (total // 1_000_000).bit_length())  # parts of the Bloom filter, of a million fingerprints at first
            fixed = [(bytearray(self.sketch.value.tobytes()), self.buckets, self.slots, self.least, self.id_type)]
            self.spark.createDataFrame(fixed, "counts binary, buckets int, slots int, least double, id_type string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/fixed")
            rejected = self.spark.createDataFrame([], REJECTED)
        status = fresh.join(rejected, "text_key", "left").withColumn("accepted", F.col("known").isNull().cast("int"))
        added = status.where("known is null or not known")
        kinds["print"] = _exploded(added, "accepted").select("*", self.bucket("print").alias("bucket"))
        kinds["set"] = added.select("text_key", "n", "grams", self.bucket("text_key").alias("bucket"))
        kinds["bloom"] = self.filters(probes)
        first = F.lit(True) if not begun else F.col("id") == F.col("first_id")
        decided = rows.select("id", "text_key").join(status.select("text_key", "first_id", "accepted"), "text_key", "left")
        taken_in = F.when(F.col("accepted").isNull(), True).otherwise((F.col("accepted") == 1) & first)
        kinds["document"] = decided.select("id", F.when(F.col("accepted").isNotNull(), F.col("text_key")).alias("text_key"), taken_in.alias("in_store"))
        self._write(tag, **kinds)
        self._clean()
        return tag

    def _clean(self) -> None:
        """Let Spark's cleaner drop shuffle files and broadcasts of what is done; a batch takes many small jobs."""
        self.spark.sparkContext._jvm.System.gc()

    def _decide(self, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(text_key, known) of a batch's rejected texts, and its pairs. A known text is in the store, accepted."""
        positive, n = _counted(self.positives(_exploded(fresh)), "positive")
        positive = _sent(positive, n)
        by_history = staged(self._looked_up(positive, fresh, True), "by-history")
        gone = by_history.groupBy(F.col("new").alias("text_key")).agg(F.max(F.col("new") == F.col("old")).alias("known"))
        gone = _sent(*_counted(gone, "gone"))
        # the rest meets itself, and what is gone
        marked = fresh.join(gone, "text_key", "left").withColumn("gone", F.col("known").isNotNull())
        own = self._candidates(_exploded(marked.where("not gone")), _exploded(marked, "gone"))
        within, n = _counted(self._verified(own, fresh, fresh, "gone", "id_new", "id_old"), "within")
        self._clean()
        earlier = F.col("id_new") < F.col("id_old")
        first, later = F.when(earlier, F.col("new")).otherwise(F.col("old")), F.when(earlier, F.col("old")).otherwise(F.col("new"))
        free = within.where("not gone and id_new <> id_old").select(first.alias("a"), later.alias("b"), F.greatest("id_new", "id_old").alias("id_b"), "likeness")
        late = _rejected_within(free.select("a", "b", "id_b"), n)
        rejected = _sent(*_counted(gone.unionByName(late.select(F.col("k").alias("text_key"), F.lit(False).alias("known"))), "rejected"))
        # what is newly accepted meets the rejected texts, of the store and of this batch
        keys = rejected.select("text_key")
        with_old = self._looked_up(positive.join(keys, "text_key", "left_anti"), fresh, False)
        with_new = within.where("gone").join(keys.withColumnRenamed("text_key", "new"), "new", "left_anti")
        # of a pair in order the later one is rejected if the first is accepted; else the later one may be accepted
        ins = [rejected.select(F.col("text_key").alias(c), F.lit(True).alias(f"{c}_out")) for c in ("a", "b")]
        mixed = free.join(ins[0], "a", "left").join(ins[1], "b", "left").where("a_out is null and b_out or a_out and b_out is null")
        mixed = mixed.select(F.when(F.col("b_out"), F.col("b")).otherwise(F.col("a")).alias("rejected"), F.when(F.col("b_out"), F.col("a")).otherwise(F.col("b")).alias("accepted"), "likeness")
        late_pairs = with_old.unionByName(with_new.select("new", "old", "likeness")).select(F.col("old").alias("rejected"), F.col("new").alias("accepted"), "likeness")
        alike = by_history.where("new <> old").select(F.col("new").alias("rejected"), F.col("old").alias("accepted"), "likeness").unionByName(mixed).unionByName(late_pairs)
        return rejected, alike.select(F.col("rejected").alias("text_key"), F.col("accepted").alias("other_key"), "likeness")

    def merge_filters(self) -> None:
        """Make one filter of those of all batches, from the stored fingerprints; after many small batches."""
        old, tag = list(self.batches), f"{len(self.batches):06d}-{uuid.uuid4().hex[:8]}"
        self._write(tag, bloom=self.filters(self._rows("print", "print").distinct()))
        for batch in old:
            path, fs = self._path(f"store/batch={batch}/kind=bloom")
            fs.delete(path, True)

    def pairs(self) -> DataFrame:
        """(rejected, accepted, likeness): every rejected document with each accepted one it is alike to."""
        docs = self.documents().where("text_key is not null")
        no = docs.where("not accepted").select(F.col("id").alias("rejected"), F.col("text_key").alias("key_no"))
        yes = docs.where("accepted").select(F.col("id").alias("accepted"), F.col("text_key").alias("key_yes"))
        links = self._rows("pair", F.col("text_key").alias("key_no"), F.col("other_key").alias("key_yes"), "likeness").distinct()
        same = no.join(yes, F.col("key_no") == F.col("key_yes")).select("rejected", "accepted", F.lit(1.0).alias("likeness"))
        return no.join(links, "key_no").join(yes, "key_yes").select("rejected", "accepted", "likeness").unionByName(same)


def _exploded(texts: DataFrame, *kept: str) -> DataFrame:
    """(print, text_key, n, pos, *kept): a row for each fingerprint."""
    return texts.select("text_key", "n", *kept, F.posexplode("prints").alias("pos", "print")).select("print", "text_key", "n", "pos", *kept)


def _counted(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """`staged`, and the number of rows that were written."""
    seen = Observation()
    return staged(rows.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get.get("n", 0)


def _sent(rows: DataFrame, n: int) -> DataFrame:
    """`n` rows that go to every task where there are at most SENT_ROWS of them."""
    return F.broadcast(rows) if n <= SENT_ROWS else rows


def _rejected_within(edges: DataFrame, n: int) -> DataFrame:
    """Of up to `n` pairs (a, b, id_b), a before b in the order of ids: who (k) is rejected if documents are taken in order.

    One task goes through the pairs in order. While there are more than ORDERED_PAIRS of them, rounds
    come before: documents that come before all their remaining partners are accepted and their
    partners rejected, so at least one document is decided in each, and its pairs are done with.
    """
    late: DataFrame | None = None
    while n > ORDERED_PAIRS:
        heads = edges.select(F.col("a").alias("k")).distinct().join(edges.select(F.col("b").alias("k")).distinct(), "k", "left_anti")
        out = edges.join(heads, edges["a"] == heads["k"], "left_semi").select(F.col("b").alias("k")).distinct()
        done = staged(heads.select("k", F.lit(False).alias("rejected")).unionByName(out.select("k", F.lit(True).alias("rejected"))), "decided")
        now = done.where("rejected").select("k")
        late = now if late is None else late.unionByName(now)
        edges, n = _counted(edges.join(done, edges["a"] == done["k"], "left_anti").join(done, F.col("b") == done["k"], "left_anti"), "edges")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[bytes] = set()
        for batch in batches:
            new = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if a not in out and b not in out:
                    out.add(b)
                    new.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary())], ["k"])

    # a is decided before b, as all pairs in which it is the later one come before
    rest = edges.repartition(1).sortWithinPartitions("id_b", "b").select("a", "b").mapInArrow(decide, "k binary")
    return rest if late is None else late.unionByName(rest)


def check_batches(docs: DataFrame, id_col: str = "id", text_col: str = "content", batch_col: str = "batch_no", least: float = 0.5, root: str | None = None) -> DataFrame:
    """(rejected, accepted, likeness): every rejected document with each accepted one whose likeness is `least` or more.

    The lowest batch is the accepted history, if the store at `root` (by default a new one in the
    scratch folder) has none yet. A later document is rejected if it is alike to one accepted in an
    earlier batch, or before it (by id) in its own; else it is accepted. Rejected documents are kept
    too, as later accepted ones may be alike to them. Each id must come once. Null texts and those of
    fewer than 20 words are alike to none. Rows without an id or a batch are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(id_col, text_col, batch_col).where(F.col(batch_col).isNotNull() & F.col(id_col).isNotNull())
    rows = staged(rows, "batches", [batch_col])
    numbers = [r[0] for r in rows.select(batch_col).distinct().orderBy(batch_col).collect()]  # one row per batch
    store = History(spark, root or scratch_path(spark, "history"), least)
    for number in numbers:
        store.add(rows.where(F.col(batch_col) == number), id_col, text_col)
    return store.pairs()
