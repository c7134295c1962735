"""Operators of the llm subpackage against brute force, round trips and held-out cases, and on odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import editor, furniture, history, langs, leaks, neardups, pieces, queries, scans, tokens, vectors, words

RNG = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(400)]
LONG = " ".join(RNG.choice(VOCABULARY) for _ in range(30_000))


def text(n: int) -> str:
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def edited(t: str, n: int) -> str:
    w = t.split()
    for _ in range(n):
        i = RNG.randrange(len(w))
        w[i : i + 1] = RNG.choice([[], [RNG.choice(VOCABULARY)], [w[i], RNG.choice(VOCABULARY)]])
    return " ".join(w)


def likeness(a: str, b: str) -> float:
    sets = []
    for t in (a, b):
        w = words.words_of(t)
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 20 else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] and sets[1] else 0.0


def collection(n: int) -> dict[str, str]:
    """Texts with copies, edited copies and shuffled ones; a third of them copies of one text."""
    out, hot = {}, text(60)
    for i in range(n):
        kind = i % 6
        if kind in (0, 1):
            out[f"d{i:03d}"] = hot
        elif kind == 2 and i > 6:
            out[f"d{i:03d}"] = edited(out[f"d{i - 2:03d}"] if RNG.random() < 0.5 else hot, RNG.randrange(1, 12))
        elif kind == 3 and i > 6:
            half = hot.split()
            out[f"d{i:03d}"] = " ".join(half[30:] + half[:30])
        else:
            out[f"d{i:03d}"] = text(RNG.choice([5, 25, 90, 900]))
    return out


ODD = [("a", None), ("b", ""), ("c", "  \n\t"), ("d", "tiny"), ("e", LONG), ("e", LONG), ("f", LONG + " more"), (None, "null id " * 20), ("g", "́​­�\U0001f44d \r\n\f" * 30)]


def odd(spark, id_col: str, text_col: str, **extra: str):
    """Rows with nulls, empty, blank, very long, repeated and strange texts, and columns with clashing names."""
    df = spark.createDataFrame(ODD, f"{id_col} string, {text_col} string")
    for c in ("key", "word", "group", "set_key", "n", "grams", "content_", "line_no", "kind", "piece_no", "segments", "at"):
        df = df.withColumn(c + "", F.lit("clash"))
    return df


# p1


def page_documents(n: int) -> list[tuple[str, str]]:
    """Clean pages with a running head and numbers, some with spoilt words."""
    rng, out = random.Random(9), []
    base = "every careful reader returned the narrow ledger before evening while another patient clerk counted seven wooden boxes under the station roof".split()
    for i in range(n):
        lines, title = [], f"Harbour report {i}"
        for page in range(3):
            body = [" ".join(rng.choice(base) for _ in range(9)) + "." for _ in range(8)]
            lines.append(("\f" if page else "") + title)
            lines += body
            lines.append(f"Page {page + 1} of 3")
        out.append((f"s{i}", "\n".join(lines)))
    return out


def spoilt_documents() -> tuple[list[tuple[str, str, int]], set]:
    """Page documents of which every third has misread words and a word split at a line's end; and the planted cases."""
    rng, docs, planted = random.Random(4), [], set()
    for i, t in page_documents(120):
        lines = t.split("\n")
        if i[1:].isdigit() and int(i[1:]) % 3 == 0:
            for no, (seen, true) in [((3, ("c", "e")), (5, ("0", "o")), (7, ("|", "l")))[int(i[1:]) // 3 % 3]]:
                words = lines[no - 1].split()
                at = next((k for k, w in enumerate(words) if true in w and len(w) > 4), None)
                if at is not None:
                    words[at] = words[at].replace(true, seen, 1)
                    lines[no - 1] = " ".join(words)
                    planted.add((i, no, "char"))
            lines[8] = "the patient clerk returned the narrow led-"
            lines[9] = "ger before evening."
            planted.add((i, 9, "hyphen"))
        planted |= {(i, n + 1, "furniture") for n, line in enumerate(lines) if "Harbour" in line or line.startswith("Page")}
        docs.append((i, "\n".join(lines), 3))
    rng.shuffle(docs)
    return docs, planted


def test_p1_finds_furniture_hyphens_and_misread_words(spark):
    docs, planted = spoilt_documents()
    docs += [(f"copy{i}", docs[0][1], 3) for i in range(40)]
    planted |= {(f"copy{i}", n, k) for i in range(40) for d, n, k in planted if d == docs[0][0]}
    df = spark.createDataFrame(docs, "id string, content string, pages int")
    ids, texts, found = scans.find(df)
    assert texts.count() == 120
    got = {(r["id"], r["line_no"], r["kind"]) for r in found.join(ids, "text_key").collect()}
    assert len(got & planted) >= 0.97 * len(planted) and len(got & planted) >= 0.97 * len(got)
    fixed = {r["id"]: r["content"] for r in scans.repair(df).collect()}
    assert len(fixed) == len(docs)
    assert "narrow ledger before evening" in fixed["s0"] and "Page 2" not in fixed["s0"] and "\f" not in fixed["s0"]


def test_p1_parts_pages_without_form_feeds_and_at_any_depth():
    docs = page_documents(60)
    model = furniture.fit([(t, 3) for _, t in docs])
    for i, t in docs[:20]:
        bare = t.replace("\f", "")
        lines = bare.split("\n")
        want = {n for n, x in enumerate(lines) if "Harbour" in x or x.startswith("Page")}
        for pages in (3, None):
            assert want - {0} <= model.lines_of(furniture.Lines(bare, pages))
        deep = t.replace(f"\fHarbour report {i[1:]}", "\f" + "\n".join([f"Harbour report {i[1:]}"] * 9))
        lines = deep.replace("\f", "").split("\n")
        taken = model.lines_of(furniture.Lines(deep, 3))
        assert {n for n, x in enumerate(lines) if n and "Harbour" in x} <= taken


def test_p1_learns_misreadings_from_the_corpus():
    rng = random.Random(2)
    letters = "abdeghiklmnoprstuvw"
    counts = {"".join(rng.choice(letters) for _ in range(9)): 400 for _ in range(500)}
    planted = {("cl", "d"): 60, ("c", "e"): 90, ("0", "o"): 40, ("m", "rn"): 0}
    for (seen, true), n in planted.items():
        for w in [w for w in counts if true in w and counts[w] == 400][:n]:
            counts.setdefault(w.replace(true, seen, 1), 1)
    units = editor.learn_units(counts)
    assert set(units) == {u for u, n in planted.items() if n}
    model = editor.Editor.fit(counts)
    long = "landesverwaltungsgerichtsbarkeit" * 2
    assert model.gain(long.replace("d", "cl", 1)[:-2] + "it", 1, long, 50) > 0 and model.gain("zzz", 1, "yyy", 400) is None
    w = next(w for w in counts if "e" in w and counts[w] == 400)
    assert model.gain(w.replace("e", "c", 1), 1, w, 400) > 0 > model.gain(w, 400, w.replace("e", "c", 1), 1) if model.gain(w, 400, w.replace("e", "c", 1), 1) else True


def test_p1_aligns_by_the_fewest_misreadings():
    units = {("ri", "n"): 5.0, ("c", "e"): 9.0, ("m", "rn"): 2.0}
    assert editor.align("cvcry", "every", units) == [(0, "c", "e"), (2, "c", "e")]
    assert editor.align("retumed", "returned", units) == [(4, "m", "rn")] and editor.align("word", "word", units) is None
    assert editor.align("coritract", "contract", units) == [(2, "ri", "n")] and editor.align("abc", "abd", units) is None
    assert editor.operations("coritract", [(2, "ri", "n")]) == [(2, "replace r n"), (3, "delete i")]
    atoms = editor.strokes(units)
    assert editor.key_of("coritract", atoms) == editor.key_of("contract", atoms) and editor.key_of("retumed", atoms) == editor.key_of("returned", atoms)


def test_p1_takes_odd_tables(spark):
    for df in (odd(spark, "id", "content"), odd(spark, "id", "content").limit(0)):
        ids, _, found = scans.find(df, pages_col=None)
        assert found.columns == ["text_key", "line_no", "kind", "seen", "fixed"] and found.join(ids, "text_key").count() >= 0
        fixed = {r["id"]: r["content"] for r in scans.repair(df, pages_col=None).collect()}
        assert set(fixed) == {r["id"] for r in df.collect()} - {None}
        assert not fixed or fixed["a"] is None and fixed["b"] == "" and fixed["d"] == "tiny" and fixed["e"].split() == LONG.split()


def test_p1_learns_from_all_words_and_texts(spark):
    rng = random.Random(3)
    letters = "abdeghiklmnoprstuvw"
    counts = {"".join(rng.choice(letters) for _ in range(9)): 400 for _ in range(300)}
    right = [w for w in counts if "d" in w and "e" in w][:6]
    counts |= {w.replace("e", "c", 1): 1 for w in list(counts) if "e" in w}
    counts |= {"x" + "".join(rng.choice(letters) for _ in range(8)): 2 for _ in range(40_000)}
    counts |= {w.replace("d", "cl", 1): 1 for w in right}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    models = scans.train(rows)
    assert models.editor.units == pytest.approx(editor.learn_units(counts)) and set(models.editor.units) == {("c", "e"), ("cl", "d")}
    fixes = {r["word"]: r["fixed"] for r in scans.corrections(rows, models.editor).collect()}
    assert all(fixes[w.replace("d", "cl", 1)] == w for w in right)
    for shared in (models, scans.train(rows, share_words=500)):
        f = editor.join_features(400, 0, 0, 0, 0, "-", False)
        assert shared.joiner.score(["join", *f]) > 0 and shared.editor.gain(right[0].replace("d", "cl", 1), 1, right[0], 400) > 0

    docs = [(f"{i:04d}", t, 3) for i, (_, t) in enumerate(page_documents(620))]
    for key, head, times in (("y", "Northern archive", 1), ("z", "Southern archive", 80)):
        for n in range(2):
            page = f"\n{head}\n" + "\n".join(f"the careful clerk {key}{n} counted seven boxes." for _ in range(4 * times)) + "\n\f"
            docs.append((f"{key}{n}", page * 3, 3))
    texts = spark.createDataFrame(docs, "text_key string, content string, pages int")
    for share_chars in (100_000, 3_000_000):
        model = scans.train_furniture(texts, share_chars)
        assert {furniture.fold("Northern archive"), furniture.fold("Southern archive")} <= model.heads
        bare = docs[0][1].replace("\f", "")
        want = {n for n, x in enumerate(bare.split("\n")) if "Harbour" in x or x.startswith("Page")}
        assert want - {0} <= model.lines_of(furniture.Lines(bare, 3))


# p2


def truth_of_batches(rows: list[tuple[str, str, int]]) -> set[tuple[str, str]]:
    texts, accepted, rejected = {i: t for i, t, _ in rows}, set(), set()
    for i, t, b in sorted(rows, key=lambda r: (r[2], r[0])):
        (accepted if b == 0 or not any(likeness(t, texts[j]) >= 0.5 for j in accepted) else rejected).add(i)
    return {(i, j) for i in rejected for j in accepted if likeness(texts[i], texts[j]) >= 0.5}


def test_p2_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, t, rng.randrange(0, 4)) for i, t in collection(72).items()]
    for k in range(20):  # short texts with a word replaced or put in at every seventh to tenth place
        words = text(rng.randrange(20, 41)).split()
        other, step = list(words), 7 + k % 4
        for at in range(len(words) - step // 2, 0, -step):
            other[at : at + k % 2] = [f"new{at}"]
        rows += [(f"s{k:02d}", " ".join(words), 0), (f"t{k:02d}", " ".join(other), 1 + k % 3)]
    truth = truth_of_batches(rows)
    assert sum(i.startswith("t") for i, _ in truth) > 5
    df = spark.createDataFrame(rows, "id string, content string, batch_no int")
    assert {(r["rejected"], r["accepted"]) for r in history.check_batches(df).collect()} == truth


def test_p2_goes_on_with_an_old_store_and_reads_only_buckets_it_needs(spark, tmp_path):
    rows = [(i, t, k % 3) for k, (i, t) in enumerate(collection(60).items())]
    df = spark.createDataFrame(rows, "id string, content string, batch_no int")
    root = f"file://{tmp_path}/store"
    for batch in (0, 1, 2):  # a new object each time, as in sessions of different days
        store = history.History(spark, root, bucket_prints=15, sketch_bits=12)
        store.add(df.where(F.col("batch_no") == batch))
    assert store.buckets > 4 and len(history.History(spark, root).batches) == 3
    assert {(r["rejected"], r["accepted"]) for r in store.pairs().collect()} == truth_of_batches(rows)
    store.merge_filters()
    # a batch that repeats one text needs the buckets of that text's fingerprints only
    one = spark.createDataFrame([("z", rows[0][1], 3)], "id string, content string, batch_no int")
    fresh = store.fingerprints(one.select(F.lit(b"k").alias("text_key"), F.lit("z").alias("first_id"), F.col("content").alias("text")))
    prints = fresh.select(F.explode("prints").alias("print"))
    needed = set(store._buckets_of(prints, "print"))
    for folder in (tmp_path / "store" / "store").glob("*/kind=print/*/bucket=*"):
        if int(folder.name.split("=")[1]) not in needed:
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"not to be read")
    history.History(spark, root).add(one)
    assert any(r["rejected"] == "z" for r in history.History(spark, root).pairs().collect())


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_p2_meets_no_texts_that_share_a_phrase_only(spark, tmp_path, least):
    rng = random.Random(7)
    whole = [(f"a{i:02d}", text(rng.choice([22, 60, 150]))) for i in range(24)]
    store = history.History(spark, f"file://{tmp_path}/store", least=least)
    texts = spark.createDataFrame(whole, "id string, text string")
    store._share(history.count_sketch(texts.select("text"), 16))
    # a phrase that the first texts don't have is the rarest in all, so it is among their first fingerprints
    rows = [(i, t + " not seen before this phrase here") for i, t in whole if len(t.split()) > 22]
    rows += [(f"b{k:02d}", edited(t, rng.randrange(0, 14))) for k, (_, t) in enumerate(rows + whole)]
    df = spark.createDataFrame([(i.encode(), i, t) for i, t in rows], "text_key binary, first_id string, text string")
    fresh = store.fingerprints(df).cache()
    probes = history._exploded(fresh)
    truth = {(i, j) for i, t in rows for j, u in rows if likeness(t, u) >= least}
    met = {(bytes(r["new"]).decode(), bytes(r["old"]).decode()) for r in store._candidates(probes, probes).collect()}
    found = store._verified(store._candidates(probes, probes), fresh, fresh).collect()
    assert {(bytes(r["new"]).decode(), bytes(r["old"]).decode()) for r in found} == truth and truth <= met
    assert len(truth) > 1.2 * len(rows) and len(met) < 1.5 * len(truth)


def test_p2_decides_a_chain_in_one_pass(spark, monkeypatch):
    chain = [(b"%03d" % i, b"%03d" % (i + 1), f"{i + 1:03d}") for i in range(20)]
    pairs = spark.createDataFrame(chain, "a binary, b binary, id_b string")
    truth = {b"%03d" % i for i in range(1, 21, 2)}
    spark.sparkContext.setJobGroup("chain", "")
    assert {bytes(r["k"]) for r in history._rejected_within(pairs, len(chain)).collect()} == truth
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) <= 3  # not some for each document of the chain
    monkeypatch.setattr(history, "ORDERED_PAIRS", 15)
    assert {bytes(r["k"]) for r in history._rejected_within(pairs, len(chain)).collect()} == truth


def test_p2_takes_odd_tables(spark):
    df = odd(spark, "id", "content").dropDuplicates(["id"]).withColumn("batch_no", F.when(F.col("id") == "d", None).otherwise(F.length("id") % 2))
    found = history.check_batches(df.withColumn("batch_no", F.when(F.col("id") == "f", 2).otherwise(F.col("batch_no"))))
    assert [(r["rejected"], r["accepted"]) for r in found.collect()] == [("f", "e")]
    assert history.check_batches(df.limit(0)).count() == 0


# p3


def test_p3_recall_and_mutual_pairs(spark, small):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 64))
    x = np.concatenate([c + 0.8 * rng.normal(size=(50, 64)) for c in base] + [base[:1] + 0.01 * rng.normal(size=(30, 64))])
    df = spark.createDataFrame([(i, "m" if i % 3 else "k", [float(v) for v in row]) for i, row in enumerate(x)], "id long, group string, vector array<double>")
    got = vectors.most_similar(df, per_list=50).collect()
    top: dict[int, set] = {}
    for r in got:
        top.setdefault(r["id"], set()).add(r["neighbour"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    group = np.arange(len(x)) % 3 > 0
    right = total = 0
    for i in range(0, len(x), 20):
        s = np.where((group == group[i]) & (np.arange(len(x)) != i), u @ u[i], -9)
        best = set(np.argsort(-s)[:10].tolist())
        right, total = right + len(best & top[i]), total + 10
    assert right / total >= 0.9 and all(len(t) == 10 for t in top.values())
    pairs = {(r["a"], r["b"]) for r in vectors.mutual(vectors.most_similar(df, per_list=50, least=0.9), 0.9).collect()}
    assert pairs and all(a < b and u[a] @ u[b] > 0.8999 for a, b in pairs)


def test_p3_finds_the_nearest_of_many_lists(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(400, 64)), 20, axis=0) + 0.9 * rng.normal(size=(8000, 64))
    df = spark.createDataFrame([(i, "m", [float(v) for v in row]) for i, row in enumerate(x)], "id long, group string, vector array<float>")
    lists = vectors.fit(df, 64, 16, 60_000, 4)["m"]
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)[::20]
    cosine = u @ lists.centroids.T
    near, _ = lists.search(u, 10)
    assert len(lists.centroids) > 400
    assert np.allclose(np.take_along_axis(cosine, near, axis=1), -np.sort(-cosine, axis=1)[:, :10], atol=1e-5)


def test_p3_splits_lists_that_the_sample_leaves_too_long(spark):
    rng = np.random.default_rng(6)
    base = np.concatenate([rng.normal(size=(30, 64)), np.repeat(rng.normal(size=(1, 64)), 30, axis=0) + 0.3 * rng.normal(size=(30, 64))])
    x = np.repeat(base, 100, axis=0) + 0.5 * rng.normal(size=(6000, 64))
    df = spark.createDataFrame([(i, "m", [float(v) for v in row]) for i, row in enumerate(x)], "id long, group string, vector array<float>")
    lists = vectors.fit(df, 64, 40, 600, 4)["m"]
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    sizes = np.bincount(lists.search(u, 10)[0][:, 0], minlength=len(lists.centroids))
    assert len(lists.coarse) <= 37 < 100 < len(lists.centroids) and sizes.max() < 400
    top: dict[int, set] = {}
    for r in vectors.most_similar(df, per_list=40, sample=600).collect():
        top.setdefault(r["id"], set()).add(r["neighbour"])
    right = [len(top[i] & set(np.argsort(-np.where(np.arange(6000) != i, u @ u[i], -9))[:10].tolist())) for i in range(0, 6000, 20)]
    assert sum(right) >= 0.9 * 10 * len(right)


@pytest.mark.parametrize("limit", [None, 0])
def test_p3_copies_pair_by_their_keys(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(vectors, "BROADCAST_SETS", limit)
        monkeypatch.setattr(vectors, "BROADCAST_COPIES", limit)
    rng = np.random.default_rng(6)
    base = rng.normal(size=64)
    x = [base] * 60 + [base + 0.05 * rng.normal(size=64) for _ in range(4)] + [rng.normal(size=64)] * 3
    keys = [f"k{i * 37 % 67:02d}" for i in range(67)]
    rows = [(k, "m", [float(v) for v in row]) for k, row in zip(keys, x)]
    df = spark.createDataFrame(rows, "key string, group string, vector array<double>").withColumn("id", F.xxhash64("key"))
    name = {r["id"]: r["key"] for r in df.select("id", "key").collect()}
    got: dict[str, list] = {}
    for r in sorted(vectors.most_similar(df, least=0.9, tie_col="key").collect(), key=lambda r: r["rank"]):
        got.setdefault(name[r["id"]], []).append(name[r["neighbour"]])
    copies, near, few = sorted(keys[:60]), keys[60:64], sorted(keys[64:])
    assert all(got[c] == [o for o in copies if o != c][:10] for c in copies)
    assert all(got[f] == [o for o in few if o != f] for f in few)
    assert all(len(got[n]) == 10 and [o for o in got[n] if o in copies] == copies[: 10 - sum(o in near for o in got[n])] for n in near)


def test_p3_takes_odd_vectors(spark):
    ok = [1.0] + [0.0] * 63
    rows = [(1, "g", ok), (1, "g", ok), (2, "g", ok), (3, None, ok), (4, None, ok), (5, "g", None), (6, "g", [1.0]), (7, "g", [float("nan")] * 64), (8, "g", [0.0] * 64), (None, "g", ok), (9, "g", [float("inf")] + ok[1:]), (10, "g", [None] + ok[1:])]
    df = spark.createDataFrame(rows, "id long, group string, vector array<float>").withColumn("shard", F.lit("clash"))
    assert {(r["id"], r["neighbour"]) for r in vectors.most_similar(df).collect()} == {(1, 2), (2, 1), (3, 4), (4, 3)}
    assert vectors.most_similar(df.limit(0)).count() == 0


# p4


@pytest.mark.parametrize("buckets,bits", [(None, 21), (5, 6)])
def test_p4_equals_brute_force(spark, buckets, bits):
    docs = collection(90)
    df = spark.createDataFrame([*docs.items(), next(iter(docs.items()))], "chunk_id string, text string").repartition(3)
    members, links = neardups.near_duplicates(df, buckets=buckets, sketch_bits=bits)
    got = [(r["id_a"], r["id_b"]) for r in neardups.expanded(members, links).collect()]
    ids = sorted(docs)
    truth = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if likeness(docs[a], docs[b]) >= 0.5}
    assert len(got) == len(set(got)) and set(got) == truth and truth


def test_p4_split_buckets_give_the_same_pairs(spark, monkeypatch):
    docs = collection(60)
    df = spark.createDataFrame([*docs.items()], "chunk_id string, text string").repartition(3)
    ask = lambda: sorted((bytes(r["key_a"]), bytes(r["key_b"])) for r in neardups.near_duplicates(df, buckets=2)[1].collect())
    whole = ask()
    monkeypatch.setattr(neardups, "SAMPLE", 1)
    monkeypatch.setattr(neardups, "FINE", 4)
    monkeypatch.setattr(neardups, "BUCKET_POSTINGS", 60)
    grid = neardups.bucket_grid(np.array([500, 1, 0, 90]), 2, 60)
    assert len(grid) == 4 and grid[0] > 3 and grid[1] == 1
    assert ask() == whole and whole


def test_p4_derived_answers_equal_full_ones(spark):
    base = text(120)
    docs = {f"d{i:02d}": edited(base, i % 9) for i in range(40)}
    df = spark.createDataFrame([*docs.items()], "chunk_id string, text string")
    full, derived = (sorted(tuple(map(bytes, (r["key_a"], r["key_b"]))) + (r["likeness"],) for r in neardups.near_duplicates(df, most_change=m)[1].collect()) for m in (-1.0, 1.0))
    assert full == derived and len(full) > 100


def test_p4_groups_are_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "node long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(8, 9)], "a long, b long")
    got = {r["node"]: r["component"] for r in neardups.components(nodes, edges).collect()}
    assert got == {**{i: 0 for i in range(7)}, 7: 7, 8: 8, 9: 8, 10: 10, 11: 11}


def test_p4_takes_odd_tables(spark):
    df = odd(spark, "chunk_id", "text")
    got = neardups.expanded(*neardups.near_duplicates(df)).collect()
    assert [(r["id_a"], r["id_b"]) for r in got] == [("e", "f")]
    assert neardups.expanded(*neardups.near_duplicates(df.limit(0))).count() == 0


# p5


def test_p5_pieces_fit_overlap_and_lose_nothing(spark):
    parts = [text(RNG.randrange(3, 60)) + RNG.choice([". ", "!\n", ";  ", "\n\n"]) for _ in range(120)]
    for body in ("".join(parts), text(2000), text(390) + ". " + text(399) + "\n" + text(5)):
        n, found = len(body.split()), pieces.pieces_of(body, 400, 40)
        at = 0
        for k, size, repeated, a, b, forced, t in found:
            assert size <= 400 and body[a:b] == t and len(t.split()) == size
            assert repeated <= 40 and (k == 0) == (repeated == 0 and k == 0)
            assert t.split()[repeated:] == body.split()[at : at + size - repeated]
            at += size - repeated
        assert at == n and any(p[5] for p in found) == (max(len(s.split()) for s in __import__("re").split(r"[\n.!?;]", body)) > 400)


def test_p5_takes_odd_tables(spark):
    df = odd(spark, "item", "body")
    out = pieces.split_oversized(df, ["item"], "body")
    assert out.where("item in ('a', 'b', 'c')").count() == 0 and out.where("item is null").count() == 1
    assert out.where("item = 'e' and n_words > 400").count() == 0 and pieces.split_oversized(df.limit(0), ["item"], "body").count() == 0
    with pytest.raises(ValueError):
        pieces.split_oversized(df, ["item"], "body", 10, 10)


# p6


def test_p6_equals_whole_text_encoding_and_round_trips(spark, small):
    import tiktoken

    bpe = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=tokens.read_ranks(), special_tokens={})
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    strange = spark.createDataFrame([(-i, t) for i, (_, t) in enumerate(ODD, 1)] + [(-99, "a  \n\n b\t　c 12345 don't ñandú 日本語 <|endoftext|>")], "doc_id long, text string")
    both = docs.unionByName(strange)
    encoded = tokens.encode(both, group_chars=3000)
    want = {r["doc_id"]: r["text"] or "" for r in both.collect()}
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert got == {i: bpe.encode_ordinary(t) for i, t in want.items()}
    back = {r["doc_id"]: r["text"] for r in tokens.decode(encoded, tokens.token_bytes(spark)).collect()}
    assert back == want
    assert tokens.encode(docs.limit(0)).count() == 0 and tokens.encode(odd(spark, "doc_id", "text")).count() == len(ODD)


# p7


@pytest.mark.parametrize("limit", [leaks.BROADCAST_HASHES, 3])
def test_p7_equals_brute_force(spark, small, limit):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    planted = items.where("item_id % 40 = 0").select((-F.col("item_id") - 1).alias("doc_id"), F.upper(F.regexp_replace("text", " ", " ​- ")).alias("text"))
    both = docs.unionByName(planted)
    grams: dict[tuple, set] = {}
    for r in items.collect():
        w = words.plain_words_of(r["text"])
        for i in range(len(w) - 12):
            grams.setdefault(tuple(w[i : i + 13]), set()).add(r["item_id"])
    truth = set()
    for r in both.collect():
        w = words.plain_words_of(r["text"])
        truth |= {(r["doc_id"], j) for i in range(len(w) - 12) for j in grams.get(tuple(w[i : i + 13]), ())}
    found = leaks.leaks(both, items, broadcast_hashes=limit)
    assert {(r["doc_id"], r["item_id"]) for r in found.where("equal_words >= 13").collect()} == truth and truth


def test_p7_tolerates_a_substituted_word_and_odd_tables(spark):
    item = text(30)
    changed = item.split()
    changed[4] = "other"
    docs = odd(spark, "doc_id", "text").unionByName(spark.createDataFrame([("z", "x y " + " ".join(changed[:16]))], "doc_id string, text string"), allowMissingColumns=True)
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item)], "item_id long, text string")
    got = leaks.leaks(docs, items).collect()
    assert [(r["doc_id"], r["item_id"], r["equal_words"], r["near_words"], r["near_at"]) for r in got] == [("z", 1, 11, 16, 2)]
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0


# p8


def test_p8_held_out_accuracy_and_segments(spark, small):
    samples = spark.read.parquet(f"{small}/lang_samples.parquet")
    model = langs.train(samples.where("sample_id % 3 <> 0"))
    held = samples.where("sample_id % 3 = 0").select(F.col("sample_id").alias("doc_id"), "text", F.col("lang").alias("right"))
    found = langs.document_languages(langs.language_segments(held, model, keep=("right",)))
    assert found.where("right = main_lang").count() >= 0.97 * held.count()
    by = {r["lang"]: r["texts"] for r in samples.groupBy("lang").agg(F.collect_list("text").alias("texts")).collect()}
    mixed = spark.createDataFrame([(1, " ".join(by["en"][:4]) + "\n" + " ".join(by["fr"][:2]) + "\n```\ndef les_des(a):\n```\n" + by["en"][5])], "doc_id long, text string")
    got = [(s["lang"]) for s in langs.language_segments(mixed, model).first()["segments"]]
    assert got == ["en", "fr", "en"]
    # a plain stretch is sure of itself, whatever rounding does to its mean
    sure = langs.language_segments(samples.select(F.col("sample_id").alias("doc_id"), "text"), model)
    assert sure.where(F.size("segments") == 1).where(F.col("segments")[0]["confidence"] < 0.6).count() == 0


def test_p8_confidence_is_the_lead_over_the_second_language():
    scores = np.full((30, 3), 0.1, np.float32)
    scores[:, 1] = 0.7
    (segment,) = langs.segments_of(np.ones(30, np.int8), scores)
    assert segment[:3] == (1, 0, 30) and segment[3] == pytest.approx(1 / (1 + np.exp(-0.6 * np.sqrt(30))), abs=1e-6)
    assert langs.segments_of(np.zeros(30, np.int8), scores)[0][3] < 0.5 and langs.segments_of(np.zeros(2, np.int8), scores[:2, :1])[0][3] > 0.99


def test_p8_labels_and_odd_tables(spark, small):
    names = [("EN-us", "en"), (" Deutsch ", "de"), ("pt_BR", "pt"), ("unknown", None), ("", None), (None, None), ("español", "es"), ("nl-BE", "nl"), ("French (CA)", "fr"), ("english1", None)]
    df = spark.createDataFrame(names, "label string, code string")
    assert df.where(~langs.label_code(F.col("label")).eqNullSafe(F.col("code"))).count() == 0
    model = langs.train(spark.read.parquet(f"{small}/lang_samples.parquet"))
    table = odd(spark, "doc_id", "text").unionByName(spark.createDataFrame([("n", "KB-123 4.5 QT-9")], "doc_id string, text string"), allowMissingColumns=True)
    out = langs.language_segments(table, model)
    assert out.count() == len(ODD) + 1 and out.where("doc_id in ('a', 'b', 'c', 'n') and size(segments) > 0").count() == 0
    assert langs.language_segments(table.limit(0), model).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, small, name):
    df = queries.queries()[name](spark, small)
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))
