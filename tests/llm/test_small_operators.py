"""Operators that work row by row or with small state, against plain Python."""

import hashlib
import html as html_lib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import chat, html, language, mixing, packing, quality, urls

PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
LONG = "word " * 30_000
TEXTS = [(1, "The quick brown fox. " * 20), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (5, LONG), (None, "a null id here"), (7, "<|endoftext|> ## *** ok\nok\nok\n" * 9), (8, "é" * 300 + "\x00\u2028 x")]


@pytest.fixture(scope="module")
def texts(spark):
    """Nulls, empty and very long texts, repeated rows, and other columns with names that the operators use themselves."""
    rows = [(i, t, None if k % 4 == 3 else "en", f"s{k % 3}" if k else None, 1, "x", 2.0, 3) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, size long")


# --- quality rules


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    rng = random.Random(1)
    rows = [t for _, t in TEXTS] + ["".join(rng.choice(["a", "b", "c d", " ", "\n", "#", "\t", "\r", "é"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame([*enumerate(rows)], "i int, text string").select("i", quality.statistics(F.col("text")).alias("s")).select("i", "s.*")
    for r in df.collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(rows[r["i"]]), rows[r["i"]]


def test_cover_finds_rules():
    rng = random.Random(2)
    cells = Counter()
    for _ in range(3000):
        b = (rng.randrange(6), rng.randrange(6), rng.randrange(6))
        cells[b, (b[0] > 3 and b[1] <= 2) or b[2] > 4] += 1
    parts = [[(b, n * bad, n * (not bad)) for (b, bad), n in cells.items()]] * 2
    rules = quality.cover(*parts, [5, 5, 5])
    for (b, bad), _ in cells.items():
        assert any(quality._covers(r, b) for r in rules) == bad


def test_quality_edges(spark, texts):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(texts, labels)
    assert got.count() == len(TEXTS) and got.filter("kept").count() == got.filter("not base_failed").count()
    assert quality.judge(texts.limit(0), labels).count() == 0
    kept = quality.kept_documents(texts, labels)
    assert kept.columns == texts.columns and kept.filter("text is null").count() == 0


def test_learned_list_rejects(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    docs = [(i, " ".join(word() + ("###" if i % 5 == 0 else "") for _ in range(80))) for i in range(600)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(d, labels).collect()}
    assert all(got[i] == (i % 5 != 0) for i in got)


# --- chat formatting


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE]"]), st.text(alphabet=st.sampled_from([*"<>/s[]INST\\ xé", "\n"]), max_size=40)), min_size=1, max_size=5))
def test_chat_round_trip(turns):
    encode, decode = packing.tokenizer(PATH), chat.decoder(PATH)
    formatted = chat.join_turns(["".join(p[0] for p in chat.segments(*t)) for t in turns])
    assert chat.split_formatted(formatted) == turns
    back = []
    for t in turns:
        ids, mask = chat.assemble(chat.segments(*t), encode)
        back += chat.parse(ids, mask, decode)
    assert [(r, x) for r, x, _ in back] == turns
    assert "".join(z for *_, z in back) == "".join(x for r, x in turns if r == "assistant")


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (1, 1, "assistant", "b</s>"), (2, 0, None, None), (None, 0, "user", "x"), (3, None, "assistant", LONG)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(df, PATH), PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == sha("user\na\nassistant\nb</s>\nassistant\nb</s>\n") and got[1]["loss_sha256"] == sha("b</s>b</s>")
    assert got[2]["turns_sha256"] == sha("\n\n") and got[2]["loss_chars"] == 0 and got[None]["n_turns"] == 1 and got[3]["loss_chars"] == len(LONG)
    assert chat.digests(chat.format_turns(df.limit(0), PATH), PATH).count() == 0


# --- url filters


def test_urls(spark):
    rng = random.Random(1)
    hosts, paths = ["com", "net", "a.com", "b.a.com", "c.b.a.com", "x.net", "", "ba.com", "a..com", "a.com:80"], ["", "/", "/e", "/en/", "/en/x", "/en/x/y", "/f"]
    rules = [(h, p, v) for (h, p), v in {(rng.choice(hosts), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(40)}.items()] + [(None, "/", "block"), ("net", None, "block")]
    rows = [(i, rng.choice(["http://", "HTTPS://", ""]) + rng.choice(hosts).upper() + rng.choice(paths) + rng.choice(["", "?a=/en/", "#x://y/"])) for i in range(800)] + [(800, None), (801, ""), (None, "http://a.com/en/")] + [(900 + i, "http://c.b.a.com/en/x/y") for i in range(400)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, rule string")
    got = urls.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    want = []
    for i, u in rows:
        h = p = ""
        if u and "://" in u:
            m = re.match(r"^([^/?#]*)([^?#]*)", u.split("://", 1)[1])
            h, p = m[1].lower(), m[2]
        fits = [(len(a + b), len(a), v == "block", a + b, v) for a, b, v in rules if a and b is not None and (h == a or h.endswith("." + a)) and p.startswith(b)]
        best = max(fits, default=None)
        want.append((i, h, p, best[3] if best else None, best[4] if best else "allow"))
    assert Counter(map(tuple, got)) == Counter(want)
    long = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "example.com/en/x"), (2, "http://a.com/" + "en/" * 20_000), (3, "://" + "." * 30_000)], "page_id long, url string")
    assert [r["rule"] for r in urls.judge(long, urls.rules_frame(spark)).orderBy("page_id").collect()] == ["example.com/en/", "com/", None]
    assert urls.judge(pages.limit(0), urls.rules_frame(spark)).count() == 0
    assert urls.judge(pages, urls.rules_frame(spark).limit(0)).filter("verdict = 'allow' and rule is null").count() == len(rows)


# --- language


def test_language(spark, texts):
    rng = random.Random(5)
    syllables = {"aa": "ka po ti mu".split(), "bb": "shr eth ond ing".split(), "cc": "äß öch ü sch".split()}
    text = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(lang := rng.choice([*syllables]), rng.randint(3, 60)), lang) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs.filter("doc_id < 400"))
    got = language.predict(docs.filter("doc_id >= 400"), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    edge = {r["text"]: r for r in language.predict(texts, model).collect()}
    assert edge[None]["lang_pred"] == edge[""]["lang_pred"] == edge[" \n\t "]["lang_pred"] == "und" and edge[LONG]["lang_pred"] in syllables
    assert language.predict(texts.limit(0), model).count() == 0
    nothing = language.learn(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}


def test_rare_language_teaches_with_all_documents(spark):
    rng = random.Random(8)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=6)) for _ in range(20))
    rows = [(i, text("abcdefghij") if i % 50 else text("klmnopqrstuvw"), "aa" if i % 50 else "bb") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.predict(docs, language.learn(docs, max_docs=60)).filter("lang = 'bb'").collect()
    assert len(got) == 10 and all(r["lang_pred"] == "bb" and r["score"] > 0.98 for r in got)
    assert language.equal_part([10, 490], 60) == 50 and language.equal_part([490, 3, 400], 60) == 28.5
    assert language.equal_part([10, 50], 60) == language.equal_part([], 60) == float("inf")


def grams_by_hand(text):
    """The 3- and 4-grams of a text's lower-cased words: of blanks one on either side of a word counts, and none between two."""
    b = [x if x > 127 or chr(x).isalpha() else 32 for x in (" " + text.lower() + "    ").encode()]
    return [bytes(b[i : i + n]) for n in (3, 4) for i in range(len(b) - n + 1) if not any(b[j] == b[j + 1] == 32 for j in range(i, i + n - 1))]


@pytest.mark.parametrize("chunk", [1 << 17, 11])
def test_language_hits_are_those_of_exact_sets(monkeypatch, chunk):
    monkeypatch.setattr(language, "CHUNK", chunk)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeéßЖ1 .") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(80)] + [None, "", "a", "12 34", "x" * 500]
    exact = {f"l{k}": {g for t in rng.sample(texts[:80], 8) for g in grams_by_hand(t)} for k in range(70)}
    number = lambda g: int.from_bytes(g, "big") | len(g) << 40
    model = language.LanguageFilter.build({x: np.array([number(g) for g in s], np.uint64) for x, s in exact.items()})
    share, count = model.hits(texts)
    for i, t in enumerate(texts):
        own = grams_by_hand(t or "")
        assert count[i] == len(own)
        for k, x in enumerate(model.languages):
            want = sum(g in exact[x] for g in own) / max(len(own), 1)
            assert want - model.rate[k] - 1e-9 <= share[i, k] <= want + 0.02 + 1 / max(len(own), 1) * 2
    assert model.predict([None]) == (["und"], [0.0])


def test_language_without_grams_and_ties(spark):
    rows = [(i, "12 345" if i % 2 else "", "digits") for i in range(10)] + [(20 + i, "kapo timu", x) for i, x in enumerate(["zz", "bb"] * 4)] + [(40, "words", None), (None, None, "zz"), (41, "kapo timu " * 30_000, None)]
    docs = spark.createDataFrame([(*r, "c0", 1, True) for r in rows], "doc_id long, text string, lang string, c0 string, score int, d_text boolean")
    model = language.learn(docs)
    assert model.languages == ("bb", "zz")
    got = {r["doc_id"]: (r["lang_pred"], r["c0"]) for r in language.predict(docs, model).collect()}
    assert got[20] == got[21] == got[41] == ("bb", "c0") and got[0] == got[1] == got[None] == ("und", "c0")
    assert language.learn(docs.filter("lang = 'digits'")).languages == ()
    kept = language.kept_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {20, 21, 41} and kept.filter("doc_id < 10").count() == 0


def test_bloom_has_no_false_negatives():
    rng = np.random.default_rng(0)
    sets = {f"l{k}": rng.integers(1, 1 << 40, 500).astype(np.uint64) for k in range(70)}
    f = language.LanguageFilter.build(sets)
    for k, lang in enumerate(f.languages):
        for at in f.places(sets[lang], f.masks.shape[1]):
            assert ((f.masks[k // 64][at] >> np.uint64(k % 64)) & np.uint64(1)).all()


# --- packing


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(PATH)
    got = packing.pack(texts, PATH).toPandas()
    for (i, t), n in Counter(TEXTS).items():
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = got[got.doc_id.isna() if i is None else got.doc_id == i].sort_values("start")
        assert own.length.sum() == n * len(ids) and (own.doc_tokens == len(ids)).all()
        for r in own.itertuples():
            assert r.ids == ids[r.start : r.start + r.length].tobytes()
    by = got.sort_values("offset").groupby("sequence_id")
    assert all(g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] for _, g in by)
    totals = by.length.sum()
    assert ((totals & (totals - 1)) == 0).all() and totals.max() <= 1024 and (got.groupby("step_group").length.sum() <= packing.STEP_TOKENS).all()
    assert packing.pack(texts.limit(0), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=60))
def test_packer_keeps_every_id(lengths):
    p = packing.Packer()
    for i, n in enumerate(lengths):
        p.add(i, np.arange(n, dtype="<u4"))
    p.drain()
    back = {}
    for d, at, n, *_, ids in p.take():
        back.setdefault(d, {})[at] = np.frombuffer(ids, "<u4")
        assert len(back[d][at]) == n
    for i, n in enumerate(lengths):
        assert (np.concatenate([back[i][k] for k in sorted(back[i])]) == np.arange(n)).all()


def test_step_groups_are_balanced():
    rng = random.Random(13)
    p = packing.Packer()
    for i in range(3000):
        p.add(i, np.arange(rng.choice([5, 40, 200, 900, 3000]), dtype="<u4"))
    p.drain()
    pieces, tokens, tier = Counter(), Counter(), {}
    for _, _, n, _, seq, _, total, group, _ in p.take():
        pieces[group] += n * n
        tokens[group] += n
        tier.setdefault(group, Counter())[total, seq] += n
    assert all(sum(c.values()) <= packing.STEP_TOKENS for c in tier.values())
    full = [g for g in tokens if {t for t, _ in tier[g]} == {1024} and tokens[g] == packing.STEP_TOKENS]
    assert len(full) > 50
    # Within those dealt together the work differs little; dealt as they come it differs by a lot.
    spread = [max(x) / min(x) for k in range(0, len(full) - 7, 8) if (x := [pieces[g] for g in sorted(full)[k : k + 8]])]
    assert np.median(spread) < 1.25, spread


# --- mixing


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped = set()
    while True:
        room = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        share = {s: room * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names if s not in capped}
        over = {s for s in share if share[s] > 2 * sizes[s]}
        if not over:
            return share | {s: 2.0 * sizes[s] for s in capped}
        capped |= over


def test_mixing(spark, texts):
    rng = random.Random(6)
    docs = [(i, "w " * rng.choice([0, 1, 3, 10, 40, 200]), rng.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(3000)]
    df = spark.createDataFrame([*docs, docs[5], docs[5], (None, "x y", "a")], "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    assert len(got) == 3003 and got.copies.between(0, 2).all()
    sizes = {s: int(g["size"].sum()) for s, g in ((k if isinstance(k, str) else None, g) for k, g in got.groupby("source", dropna=False))}
    want = targets_by_hand(sizes)
    for s, g in got.groupby("source", dropna=False):
        s = s if isinstance(s, str) else None
        # Copies are fair, so a target that no fair draw meets is missed by less than a document.
        assert g.target.iloc[0] == pytest.approx(want[s]) and abs((g["size"] * g.copies).sum() - want[s]) < 200
    again = mixing.mix(df).toPandas()
    key = ["doc_id", "source", "size", "copies"]
    assert Counter(map(str, got[key].values.tolist())) == Counter(map(str, again[key].values.tolist()))
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(texts).count() == len(TEXTS)
    many = mixing.mixed_documents(texts)
    assert many.columns == texts.columns


@settings(max_examples=200, deadline=None)
@given(st.floats(0.01, 0.99), st.floats(1, 1e4), st.floats(0.01, 0.99), st.floats(1, 1e4), st.floats(0, 0.999))
def test_pair_keeps_mass(f, s, g, t, u):
    a, b = mixing.pair(f, s, g, t, u)
    assert a * s + b * t == pytest.approx(f * s + g * t) and (a in (0.0, 1.0) or b in (0.0, 1.0)) and -1e-9 <= min(a, b) and max(a, b) <= 1 + 1e-9


def test_pair_is_fair():
    rng = random.Random(1)
    mean = np.mean([mixing.pair(0.3, 5, 0.6, 2, rng.random()) for _ in range(40_000)], axis=0)
    assert mean == pytest.approx([0.3, 0.6], abs=0.01)


def test_leaf_is_fair():
    rng = random.Random(2)
    for fraction, masses, others in ((0.37, [900, 300, 40, 40, 7, 1], 0.0), (0.8, [500, 400], 700.0), (0.4, [1000, 20, 5], 30.0), (0.5, [10], 10.0)):
        runs = [mixing.leaf(fraction, masses, [rng.random() for _ in masses], others) for _ in range(20_000)]
        copies = np.array([r[0] for r in runs])
        assert copies.mean(axis=0) == pytest.approx([fraction] * len(masses), abs=0.015)
        rest = np.array([r[1] for r in runs])
        assert rest.mean() == pytest.approx(fraction, abs=0.015) or not others
        assert copies @ masses + rest * others == pytest.approx([fraction * (sum(masses) + others)] * len(runs))
        assert (((copies > 0) & (copies < 1)).sum(axis=1) <= 1).all()


def test_mixing_is_fair_and_near(spark):
    rng = random.Random(7)
    # A source with two documents that are a good part of it, one with few, and many small ones.
    docs = [(i, "w " * n, s) for i, (n, s) in enumerate([(600, "b"), (500, "b")] + [(rng.randint(1, 40), "b") for _ in range(400)] + [(rng.randint(1, 9), "a") for _ in range(2000)] + [(100, "c"), (50, "c"), (7, None)])]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").cache()
    runs = [mixing.mix(df, seed=k).toPandas().sort_values("doc_id") for k in range(6)]
    for g in runs:
        b = g[g.source == "b"]
        assert abs((b["size"] * b.copies).sum() - b.target.iloc[0]) <= 40 and g.copies.max() <= 2
    ratio = runs[0].target.to_numpy() / runs[0].source_size.to_numpy()
    mean = np.mean([g.copies.to_numpy() for g in runs], axis=0)
    small = (runs[0].source == "b").to_numpy() & (runs[0]["size"] < 100).to_numpy()
    assert mean[small].mean() == pytest.approx(ratio[small][0], abs=0.12), (mean[small].mean(), ratio[small][0])
    assert len({tuple(g.copies) for g in runs}) > 1 and {g.copies.iloc[0] for g in runs} <= {int(ratio[0]), int(ratio[0]) + 1}


def test_targets_of_many_sources(spark):
    rng = random.Random(8)
    sizes = {f"s{k:03}": rng.choice([0, 1, 10, 500, 9000]) for k in range(200)} | {None: 300, "": 5, "\U0001f600": 40, "\uffee": 40}
    got = {r["source"]: r for r in mixing.source_targets(spark.createDataFrame([*sizes.items()], "source string, size long")).collect()}
    want = targets_by_hand(sizes)
    assert {s: r["target"] for s, r in got.items()} == pytest.approx(want)
    assert mixing.source_targets(spark.createDataFrame([("a", 0), (None, 0)], "source string, size long")).agg({"target": "sum"}).first()[0] == 0


def test_mixed_documents_keep_clashing_columns(spark):
    names = "id from words row copies size source_size target u_doc_id _copies _d _s _size _copy large block fraction whole rest s r".split()
    rows = [(i, "w " * (i % 7), ["a", "b", None][i % 3], *([i] * len(names))) for i in range(60)] + [(None, None, None, *([1] * len(names)))] * 2
    df = spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'`{n}` int' for n in names)}")
    m = mixing.mixed_documents(df)
    assert m.columns == df.columns and all(r["_copies"] == r["doc_id"] for r in m.collect() if r["doc_id"] is not None)


# --- html


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_html(spark):
    article = "<article><h1>Head &amp; more</h1><p><b>One<br>two\n  three<p>Fo&uuml;r&nbsp;five</p><ul><li>x<li>y</ul><p>Shared words.</p><!-- c --><aside>no</aside><form>no</form></article>"
    noise = '<header>top</header><nav><ul><li><a href="/">Menu</a></ul></nav><div class="ad">Buy</div><div class="cookie-notice">ok?</div><div class="box"><span>About our site</span></div>'
    tail = '<section id="comments"><article>nice!</article></section><footer>&copy; x</footer>'
    plain = "Head & more\nOne two three\nFoür five\nx\ny\nShared words."
    rows = [(i, f"http://a.com/{i}", page(noise + article.replace("One", f"One {i}") + tail)) for i in range(6)]
    # Without an article: what recurs on the host goes, what is the page's own stays.
    rows += [(10 + i, f"http://b.com/{i}", page(f'<div class="box"><span>About our site</span></div><div><p>Own text {i}</p></div>')) for i in range(6)]
    rows += [(20, None, None), (21, "http://a.com/x", ""), (22, "x", "just text &lt;p&gt; here"), (23, "http://c/", "<div>" * 3000 + "deep"), (24, "http://c/", "<p>" + LONG), (0, "http://a.com/0", rows[0][2])]
    got = html.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, template int")).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and by[3] == plain.replace("One", "One 3") and by[12] == "Own text 2", by
    assert by[20] == by[21] == "" and by[22] == "just text <p> here" and by[23] == "deep" and by[24] == LONG.strip()
    assert html_lib.unescape("&copy;") not in by[0] and html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_template_of_a_large_host(spark):
    menu = '<div class="box"><p>Markets <a href="/m">Shares</a></p></div>'
    rows = [(i, f"http://a.com/{i}", page((menu if i < 4 else "") + f"<div><p>Words of number {i} alone</p></div>")) for i in range(200)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"Words of number {i} alone" for i in range(200)}


def test_html_copies_make_no_template(spark):
    shared = [f"Paragraph {k} of the story goes on for some words." for k in range(9)]
    story = "".join(f"<p>{s}</p>" for s in shared)
    rows = [(i, f"http://a.com/{i}", page(story)) for i in range(3)]
    rows += [(10 + i, f"http://b.com/{i}", page(f"{story}<p>Seen {i} times.</p>")) for i in range(40)]
    links = "<article><p>One own article</p><div><a href='/'>See the source of it</a></div></article>"
    rows += [(60 + i, f"http://c.com/{i}", page(f"<div>{i}</div>{links}")) for i in range(4)]
    # Copies do not keep what other pages show to be template.
    box = '<section class="box">About our site and those who make it</section>'
    rows += [(70 + i, f"http://d.com/{i}", page(f"{box}{story if i < 5 else ''}<p>Page {i} has words of its own.</p>")) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and all(got[i] == "\n".join(shared) for i in range(3))
    assert all(got[10 + i] == "\n".join([*shared, f"Seen {i} times."]) for i in range(40))
    assert all(got[60 + i] == "One own article\nSee the source of it" for i in range(4))
    assert all(got[70 + i] == "\n".join([*(shared if i < 5 else []), f"Page {i} has words of its own."]) for i in range(8))


def test_html_boxes_at_the_ends_of_articles(spark):
    first, last = "<div>From our <b>desk</b></div>", "<div><p>Get the weekly letter</p></div><section>It is free</section>"
    shared = "<div>A passage that all quote</div>"
    inner = lambda i: f"<h1>Article {i}</h1>{shared}<p>Words of number {i} alone.</p>"
    texts = lambda i: f"Article {i}\nA passage that all quote\nWords of number {i} alone."
    rows = [(i, f"http://a.com/{i}", page(f"<article>{first}{inner(i)}{last}</article>")) for i in range(4)]
    rows += [(10 + i, f"http://b.com/{i}", page(f"<main><div><div>{inner(i)}</div>{last}</div></main>")) for i in range(4)]
    # A paragraph stays, and so do the boxes of copies.
    rows += [(20 + i, f"http://c.com/{i}", page(f"<article>{inner(i)}<p>The end</p></article>")) for i in range(4)]
    rows += [(30 + i, f"http://d.com/{i}", page(f"<p>{i}</p><article>{inner(7)}{last}</article>")) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert got[i] == got[10 + i] == texts(i) and got[20 + i] == texts(i) + "\nThe end"
        assert got[30 + i] == texts(7) + "\nGet the weekly letter\nIt is free"


def test_html_attributes_are_whole_names():
    text = lambda body: html.main_text(html.Page(body).reduced(), core=True)
    stay = ('href="/hidden/valley"', 'title="a hidden gem"', 'aria-hidden="false"', 'data-id="share"', "title='class=ad id=menu'", "data-x=hidden/", 'data-class = "ad"', 'data-hidden="no"', 'title="what is hidden here"', 'class="share-price"', 'class="related-work"', 'class="ad-hoc"')
    for rest in stay:
        assert text(f"<article><div {rest}>Stays</div></article>") == "Stays", rest
    for rest in ("hidden", 'title="x"hidden', 'HIDDEN=""', "id=share", 'title="a > b" class = \'x ad\'', 'style="display: none"', "role=dialog", 'class="share-buttons"', 'id="comment-list"', 'class="cookie-notice"'):
        assert text(f"<article><div {rest}>Goes</div></article>") == "", rest


def site(rng):
    """(url, html, text) of pages whose menus, adverts, notices and comments differ from page to page."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    rows = []
    for k, n in enumerate((1, 2, 9, 40)):
        wrap = rng.choice(["article", "main"])
        for i in range(n):
            menu = "".join(f'<li><a href="/{word()}">{word()}</a>' for _ in range(rng.randint(2, 7)))
            top = rng.choice([f"<div class=note-{i}>{words(2, 6)}</div>", f"<div><span>{words(1, 4)}</span></div>", "<p>Call us</p>"])
            blocks = [words(5, 60) for _ in range(rng.randint(1, 6))]
            body = "".join(f"<p>{x}" if rng.random() < 0.5 else f"<div>{x}</div>" for x in blocks)
            talk = f"<section class=comments>{''.join(f'<div><p>{words(3, 9)}</p></div>' for _ in range(rng.randint(1, 4)))}</section>"
            rows.append((f"http://h{k}.org/{i}", f"<body><ul>{menu}</ul>{top}<{wrap}><h1>{k} {i}</h1>{body}{talk}</{wrap}><div>{words(2, 8)}</div>stray<footer>{word()}</footer>", "\n".join([f"{k} {i}", *blocks])))
    return rows


@pytest.mark.parametrize("few", [html.FEW_VERDICTS, 0])
def test_html_against_counts_by_hand(spark, monkeypatch, few):
    monkeypatch.setattr(html, "FEW_VERDICTS", few)
    rows = site(random.Random(11))
    rows += [rows[5]] * 3 + [(rows[20][0], rows[20][1], rows[20][2])]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert got == {i: t for i, (*_, t) in enumerate(rows)}
    # The same sets by hand: hashes of a host that so many different texts have, and slots that fewer have.
    seen = {"exact": Counter(), "slot": Counter()}
    parsed = [html.Page(h) for _, h, _ in rows]
    trees = [html.unpacked(html.packed(p.reduced())) for p in parsed]
    met = []
    known = set()
    for (u, *_), p, t in zip(rows, parsed, trees, strict=True):
        host, own, slots = u.split("/")[2], set(), set()
        text = html.main_text(t, core=True, met=own, slots=slots)
        met.append((host, own, slots))
        if (host, text) not in known:
            known.add((host, text))
            seen["exact"].update((host, h) for h in own | p.counted())
            seen["slot"].update((host, h) for h in slots)
    often = lambda kind, host, h: seen[kind][host, h] >= html.MIN_PAGES
    want = {}
    for i, (host, own, slots) in enumerate(met):
        template = {h for h in own if often("exact", host, h)} | {h for h in slots if often("slot", host, h)}
        want[i] = template, {h for h in slots if not often("slot", host, h)}
        assert html.main_text(trees[i], *want[i]) == rows[i][2]
    keyed = html.parsed(pages.select("page_id", "url", F.split("url", "/")[2].alias("host"), F.col("page_id").alias("page"), "html"))
    assert {r["page"]: ({*r["template"]}, {*r["rare"]}) for r in html.by_page(keyed, html.verdicts(keyed)).collect()} == want
    # It is the sets that delete: without them nearly all pages keep their menus, and where they are empty nothing goes.
    assert sum(html.main_text(p) != t for p, (*_, t) in zip(trees, rows, strict=True)) == len(rows)
    assert all(want[i][0] for i in range(12, 52)) and sum(html.main_text(trees[i], want[i][0]) == rows[i][2] for i in range(12, 52)) > 30


def test_html_is_linear():
    import time

    for source in ("<div>" * 200_000 + "deep", "<article>" + "<div><p><span>" * 60_000 + "deep", "<ul><li>" * 60_000 + "deep", "<a " * 300_000 + ">deep", "<table><tr><td>" * 30_000 + "deep"):
        began = time.perf_counter()
        assert html.main_text(html.unpacked(html.packed(html.Page(source).reduced())), core=True, met=set(), slots=set()) in ("deep", "")
        assert time.perf_counter() - began < 20


def test_crc_is_of_little_endian_ids(spark):
    ids = np.array([1, 2, 50_000], "<u4").tobytes()
    assert spark.createDataFrame([(bytearray(ids),)], "b binary").select(F.crc32("b")).first()[0] == zlib.crc32(ids)


# --- registered queries over a whole table, by plain Python


SF = "/root/testdata/sf0.001"


def test_op1_of_a_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = quality.op1_quality(spark, SF).collect()
    assert {r["doc_id"] for r in got} == {*texts} and len(got) == len(texts)
    for r in got:
        want = counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["rule"] is None)


def test_op2_of_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    says = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", says), (-1, 1, "assistant", says)]
    turns = {}
    for conv, _, role, text in sorted(rows, key=lambda r: r[:2]):
        turns.setdefault(conv, []).append((role, text or ""))
    got = {r["conv_id"]: r for r in chat.op2_chat(spark, SF).collect()}
    assert got.keys() == turns.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, own in turns.items():
        r, said = got[conv], "".join(x for role, x in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in own))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), sha(said))
        formatted = chat.join_turns(["".join(p[0] for p in chat.segments(*t)) for t in own])
        assert r["formatted_chars"] == len(formatted) and chat.split_formatted(formatted) == own
