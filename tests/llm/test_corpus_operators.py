"""Operators over the whole corpus and the pipeline, against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from siftline.llm import jaccard, neardup_vectors, ppm
from siftline.llm.components import connected_components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def roots(ids, edges):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("one_task", [-1, 1 << 20])
def test_components(spark, one_task):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 700)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(7, 7), (9, 8), (8, 9)]
    edges_between = [e for e in edges if e[0] != e[1]]
    want = roots({x for e in edges_between for x in e}, edges_between)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long"), one_task=one_task).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long"), one_task=one_task).count() == 0


def words_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def corpus():
    """Copies, chains of edits, a large group of copies of one original, short and empty texts."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(120)]
    origin = [word() for _ in range(90)]
    texts += [" ".join(word() if rng.random() < 0.03 else w for w in origin) for _ in range(150)] + [" ".join(origin).upper()]
    step = origin[:]
    for _ in range(40):
        step[rng.randrange(90)] = word()
        texts.append(" ".join(step))
    passage = " ".join(word() for _ in range(60))
    texts += [f"{' '.join(word() for _ in range(rng.randint(3, 40)))} {passage}" for _ in range(60)]
    texts += rng.choices(texts, k=40) + [None, "", " \n", " ", "one two", "One  two", "x" * 50_000 + " y"]
    rng.shuffle(texts)
    return [*enumerate(texts)]


@pytest.mark.parametrize("small", [False, True])
def test_jaccard(spark, monkeypatch, small):
    if small:  # many blocks and ranges, groups dealt to several places
        for name, value in (("BLOCK_BYTES", 4000), ("RANGE_BYTES", 9000), ("GROUP", 3), ("HUB_ROUNDS", 1)):
            monkeypatch.setattr(jaccard, name, value)
    docs = corpus()
    sets = {i: words_set(t) for i, t in docs}
    edges = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[a] and sets[b]]
    want = roots(sets, edges)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n long, c long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similarity_components(df).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "quite another text than the first"), (None, "a b c d e f"), (None, "nothing else is like it"), (4, None), (4, "")]
    got = Counter(map(tuple, jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == Counter([(1, 2, 1), (1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 1, None), (4, 0, 4), (4, 0, 4)])
    assert jaccard.similarity_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_jaccard_compares_few_pairs_of_a_shared_passage(spark, monkeypatch):
    """A passage in thousands of documents, from a tenth to nearly all of each, makes no square of pairs."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmn") for _ in range(8))
    passage = [word() for _ in range(80)]
    docs = [(i, " ".join([word() for _ in range(rng.choice([720, 80, 30, 22]))] + passage)) for i in range(3000)]
    copies = [(5000 + i, docs[i % 40][1] + " end") for i in range(400)]
    seen = []
    verify = jaccard._verify
    monkeypatch.setattr(jaccard, "_verify", lambda pairs, *a: seen.append(pairs.count()) or verify(pairs, *a))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similarity_components(spark.createDataFrame(docs + copies, "doc_id long, text string")).collect()}
    assert got == {i: i for i, _ in docs} | {i: (i - 5000) % 40 for i, _ in copies}
    assert len(seen) == jaccard.HUB_ROUNDS + 1 and sum(seen) < 2 * len(docs), seen


def test_jaccard_keeps_clashing_columns(spark):
    names = "row id chosen digest least key block rid n p c h n_shingles component_id _d _k d_text".split()
    rows = [(i, f"words that are in all of them {i // 2}", *([i] * len(names))) for i in range(8)] + [(None, None, *([None] * len(names)))] * 2
    df = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'`{x}` int' for x in names)}")
    kept = jaccard.kept_documents(df)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], r["_d"], r["row"]) for r in kept.collect()) == Counter([(i, i, i) for i in (0, 2, 4, 6)] + [(None, None, None)])


def test_filters_never_lose_a_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64))
        y = np.unique(np.where(rng.random(len(x)) < 0.15, rng.integers(0, 60, len(x)).astype(np.uint64), x))
        exact = 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))
        assert jaccard.similar(x, y) == exact
        if exact:
            p, q = x[: jaccard.prefix_length(len(x))], y[: jaccard.prefix_length(len(y))]
            assert len(np.intersect1d(p, q))
    h = np.sort(rng.integers(0, 1 << 62, 1000).astype(np.uint64))
    assert (jaccard.unpack_hashes(jaccard.pack_hashes(h)) == h).all()


def vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[rng.integers(0, 60, 300)] + rng.normal(scale=0.05, size=(300, 16)), base[rng.integers(0, 5, 300)] * rng.uniform(0.1, 9, (300, 1)), base[:3], base[:3]])
    return [(i, [float(np.float32(v)) for v in row], int(rng.integers(0, 3))) for i, row in enumerate(x)]


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(neardup_vectors, "BLOCK", block)
    rows = vectors()
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, rows[0][1], None), (905, [1.0, 2.0], 1), (906, [1.0, 2.0], 1), (907, [1e200] + [0.0] * 15, 2), (908, [float("inf")] * 16, 1), (909, [], 1)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    want = roots(range(len(rows)), np.argwhere(linked).tolist())
    got = {r["vec_id"]: r for r in neardup_vectors.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, label int, n int")).collect()}
    assert [got[i]["n_links"] for i in range(len(rows))] == linked.sum(1).tolist()
    assert {i: got[i]["component_id"] for i in want} == want
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903, 904, 907, 908, 909)) and got[906]["component_id"] == 905 and got[906]["n_links"] == 1
    assert neardup_vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_recall_of_the_query(spark):
    """op8 on a whole table against brute force: no link below the cosine, hardly any above it missed."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x = np.array([np.zeros(64) if v is None or len(v) != 64 else v for v in rows.embedding], float)
    length = np.linalg.norm(x, axis=1)
    x = x / np.where(length > 0, length, 1)[:, None]
    label = rows.label.to_numpy(float)
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    ids = rows.vec_id.to_numpy()
    want = dict(zip(ids.tolist(), linked.sum(1).tolist(), strict=True))
    got = {r["vec_id"]: r for r in neardup_vectors.op8_vectors(spark, "/root/testdata/sf0.1").collect()}
    assert got.keys() == want.keys() and all(got[i]["n_links"] <= n for i, n in want.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * sum(want.values())


def test_vectors_of_many_sizes(spark, monkeypatch):
    """Labels that are text and grids of several sizes, at recall 1."""
    monkeypatch.setattr(neardup_vectors, "PER_CELL", 4)
    rng = np.random.default_rng(14)
    rows, label = [], []
    for name, n in (("a", 3), ("b", 60), ("c", 500), ("", 12)):
        base = rng.normal(size=(max(n // 3, 1), 9))
        own = np.concatenate([base[rng.integers(0, len(base), n)] + rng.normal(scale=0.06, size=(n, 9))])
        rows += [r.tolist() for r in own]
        label += [name] * n
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = (x @ x.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(linked, False)
    want = roots(range(len(rows)), np.argwhere(linked).tolist())
    df = spark.createDataFrame([(i, v, name) for i, (v, name) in enumerate(zip(rows, label, strict=True))], "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: r for r in neardup_vectors.near_duplicates(df).collect()}
    assert [got[i]["n_links"] for i in range(len(rows))] == linked.sum(1).tolist() and {i: r["component_id"] for i, r in got.items()} == want


def test_multi_sequence_is_in_order_and_complete():
    rng = np.random.default_rng(5)
    a, b = rng.random(7), rng.random(9)
    got = [*neardup_vectors.multi_sequence(a, b, 0.9)]
    assert [s for s, *_ in got] == sorted(s for s, *_ in got) and {(i, j) for _, i, j in got} == {tuple(p) for p in np.argwhere(a[:, None] + b[None] <= 0.9).tolist()}


def test_lower_bounds_hold():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 6))
    c = neardup_vectors.codebook(x, 8)
    own, bound = neardup_vectors.nearest(x, c), neardup_vectors.lower_bounds(x, c)
    assert (bound[:, own] <= neardup_vectors.squares(x, x) + 1e-9).all()


def test_lower_target_recall_is_reached(spark):
    rows = vectors()
    x = np.array([r[1] for r in rows])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    index = neardup_vectors.MultiIndex(x, 6, 0.98, 0.95)
    cells = [*zip(*index.cells(unit), strict=True)]
    visits = [set(v) for v in index.visits(unit)]
    pairs = np.argwhere(np.triu(unit @ unit.T >= 0.98, 1))
    assert np.mean([cells[j] in visits[i] for i, j in pairs]) >= 0.9


@pytest.mark.parametrize("together", [ppm.TOGETHER, 3])
def test_ppm(spark, monkeypatch, together):
    monkeypatch.setattr(ppm, "TOGETHER", together)
    docs = [(1, "the cat sat on the mat"), (2, "The cat ate the rat"), (3, None), (4, ""), (5, "zebra xylophone the"), (6, "ça va the été"), (7, "the cat sat on the mat"), (20, "unseen words qqq the cat"), (7, "the cat sat on the mat"), (8, "a" * 3000 + " \n b"), (None, "a null id")]
    taught = {1, 2, 4, 6, 7, 8}
    df = spark.createDataFrame([(i, t, i in taught, 1.0) for i, t in docs], "doc_id long, text string, train boolean, score double")
    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in ppm.score(df).collect())
    model, counts = ppm.Adaptive(), Counter()
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [None]
    for i, t in docs:
        if i in taught:
            model.log10(t or "")
            counts.update(tokens(t))
    n, v = counts.total(), len(counts)
    want = Counter((i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6), round(model.log10(t or "", False), 6)) for i, t in docs)
    assert got == want
    for r in ppm.score(df).collect():
        assert r["score_per_token"] == pytest.approx(r["score"] / r["n_tokens"]) and r["base_per_token"] == pytest.approx(r["base_score"] / r["n_tokens"])
        assert r["bits_per_byte"] == pytest.approx(-r["score"] * np.log2(10) / (len((dict(docs)[r["doc_id"]] or "").encode()) + 1))
    assert ppm.score(df.limit(0)).count() == 0
    untaught = {r["doc_id"]: r for r in ppm.score(df.withColumn("train", df["train"] & False)).collect()}
    assert untaught[3]["score"] == pytest.approx(-np.log10(256)) and untaught[1]["n_known"] == 0


def test_ppm_probabilities_sum_to_one():
    model = ppm.Adaptive(3)
    model.log10("abracadabra abracad")
    for context in (b"", b"a", b"abr", b"zzz", b"cad"):
        assert sum(model.probability(context, s) for s in range(256)) == pytest.approx(1)
    assert ppm.Adaptive().log10("abc" * 50) > 50 * ppm.Adaptive().log10("abc")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language id", "near duplicates", "source mix", "packing"]
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "near duplicates":
            kept = {r["doc_id"]: words_set(r["text"]) for r in docs.collect()}
            assert not any(100 * len(kept[a] & kept[b]) >= 75 * len(kept[a] | kept[b]) for a, b in combinations(kept, 2))
    assert 0.5 * before < docs.select("doc_id").distinct().count() <= before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    copies = Counter(r["doc_id"] for r in docs.collect())
    by = {}
    total = {}
    for r in pieces.collect():
        by[r["doc_id"]] = r["doc_tokens"]
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {i: n * by[i] for i, n in copies.items()}
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and extra columns with names that stages use."""
    extra = ["row", "id", "digest", "copies", "size", "lang_pred", "score", "chosen", "kept", "_d", "_k", "c0", "d_text", "words", "from", "v"]
    base = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long = " ".join(f"{w}{i % 97}" for i, w in enumerate(["the", "quick", "brown", "fox"] * 40_000))
    odd = [(None, base[0][1], None, None, None), (9001, None, "en", "src0", None), (9002, "", "en", "src0", 0), (9003, long, "en", None, len(long)), (9004, long, None, "src1", len(long))]
    odd += [base[1]] * 3 + [(9005, "1234 5678 " * 60, "en", "src0", 1), (9006, base[2][1], "en", "src0", 1), (9006, base[3][1], "en", "src0", 1)]
    columns = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{c}` int" for c in extra)])
    docs = spark.createDataFrame([(*r, *([k] * len(extra))) for k, r in enumerate(base + odd)], columns)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == names, name
        rows = {r["row"]: r for r in before.collect()}
        assert all(r == rows[r["row"]] for r in docs.collect()), name  # each row is one that came, in all its columns
        ids = [r["doc_id"] for r in docs.collect()]
        if name == "quality rules":
            assert not {9001, 9002, 9005} & {*ids}
        if name == "near duplicates":
            assert ids.count(base[1][0]) <= 1 and not {9003, 9004} <= {*ids}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.agg({"length": "sum"}).first()[0] > 0
    with pytest.raises(Exception, match="doc_id"):
        corpus_pipeline.STAGES[0][1](spark, docs.drop("doc_id"), SF).collect()


def test_pipeline_run_leaves_no_tables(spark):
    import os

    from siftline.functions.layout import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = {*os.listdir(folder)} if os.path.isdir(folder) else set()
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len({*os.listdir(folder)} - before) == len(corpus_pipeline.STAGES) - 1
