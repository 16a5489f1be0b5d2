import itertools
import random
import re
import zlib
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docsift.llm import html, language, simhash, toxicity, trees
from docsift.llm.trees import boost, isotonic

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_language_held_out(spark, docs):
    rows = language.op1_language(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_language_of_odd_rows(spark, odd, none, docs):
    model = language.fit(docs)
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in language.predict(odd, model).collect()}
    assert {(0, "und", False), (1, "und", False), (3, "und", False), (9, "und", False)} <= got and language.predict(odd, model).count() == odd.count()
    assert language.predict(none, model).count() == 0
    kept = language.keep_known(odd, model)
    assert kept.columns == odd.columns and {0, 1, 2, 3, 9}.isdisjoint({r.doc_id for r in kept.collect()})
    blank = language.fit(none)
    assert {r.lang_pred for r in language.predict(odd, blank).collect()} == {"und"}


def test_one_language(spark):
    """A table of one language keeps every text with a letter."""
    rows = spark.createDataFrame([(i, f"words of text number {i}, and more", "en") for i in range(20)] + [(20, "12 34", None), (21, None, "en"), (22, "another one", None)], "doc_id long, text string, lang string")
    kept = language.keep_known(rows, language.fit(rows))
    assert {r.doc_id for r in kept.collect()} == {*range(20), 22}


def test_repeated_ids_in_the_sample(spark, monkeypatch):
    """However often an id repeats, a label sends per_label rows at most, and other ids aren't crowded out."""
    rows = spark.createDataFrame([(7, f"copy {i} of one id", "en") for i in range(500)] + [(i, f"text {i} stands alone", "en") for i in range(100, 140)], "doc_id long, text string, lang string")
    sent, grams = [], language._distinct_grams
    monkeypatch.setattr(language, "_distinct_grams", lambda full: sent.append(grams(full)) or sent[-1])
    language.fit(rows, per_label=30, landmarks=5)
    assert sent[0].count() == 30


def test_kernel_values_against_sets(docs):
    """Two matrix products give the plain kernel sum over landmarks."""
    model = language.fit(docs.limit(120), per_label=10, landmarks=5)
    text = docs.first().text
    p = model.presence([text])[0]
    k = np.array([(p * z).sum() for z in model.landmarks.T]) / np.sqrt(p.sum())
    assert np.allclose(model.values([text])[0], k @ model.weights, atol=1e-4)
    long_ = " ".join([text] * 3)
    saved, language.SLICE = language.SLICE, 100
    cut = model.presence([long_])
    language.SLICE = saved
    assert (cut == model.presence([long_])).all()  # slices lose no n-gram


def test_values_against_sets_of_ngrams():
    """Kernels from plain sets of n-grams, the Nystroem map and the ridge regression, without the operator's presences."""
    rng = random.Random(8)
    say = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(12))
    texts, y = [say("abcde") for _ in range(9)] + [say("cdefgh") for _ in range(9)] + [say("hijka") for _ in range(9)], ["x"] * 9 + ["y"] * 9 + ["z"] * 9
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    model = language._solve([sorted({t[i : i + 3] for i in range(len(t) - 2)}) for t in texts], y, ["x", "y", "z"], 5)
    marks = [i for k in "xyz" for i in [j for j, v in enumerate(y) if v == k][:5]]
    vocabulary = set().union(*(grams(texts[i]) for i in marks))
    known = lambda t: grams(t) & vocabulary
    kernel = lambda a, b: len(known(a) & known(b)) / (len(known(a)) * len(known(b))) ** 0.5
    k_mm = np.array([[kernel(texts[i], texts[j]) for j in marks] for i in marks])
    values, vectors = np.linalg.eigh(k_mm)
    root = vectors / np.sqrt(values)
    phi = np.array([[kernel(t, texts[j]) for j in marks] for t in texts]) @ root
    w = np.linalg.solve(phi.T @ phi + language.RIDGE * len(phi) * np.eye(phi.shape[1]), phi.T @ np.array([[float(v == k) for k in "xyz"] for v in y]))
    new = [say("abcde"), say("hijka").upper(), "  ".join(say("cdefgh").split()) + " \n zzz"]
    plain = [" ".join(t.lower().split()) for t in new]
    want = np.array([[kernel(t, texts[j]) for j in marks] for t in plain]) @ root @ w
    assert np.allclose(model.values(new), want, atol=2e-3) and model.predict(new)[0] == ["x", "z", "y"]


def test_toxicity_held_out(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = toxicity.op10_toxicity(spark, DATA).join(docs.select("doc_id", "text"), "doc_id").join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    rude = [r for r in rows if re.search(r"\b(idiot|moron|scum|loser|pathetic)\b", r.text.lower())]
    assert sum(r.predicted for r in rude) > 0.9 * len(rude)
    assert sum(r.predicted for r in rows if r.toxic == 0) == 0


LABELLED = "/root/testdata/sf0.1"


def test_toxicity_held_out_of_every_language(spark):
    """All rows labelled toxic count, and their words are learned from rows that aren't held out."""
    labels, docs = (spark.read.parquet(f"{LABELLED}/{t}.parquet") for t in ("labels", "documents"))
    rows = toxicity.op10_toxicity(spark, LABELLED).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").select("lang", "toxic", "predicted").collect()
    for lang in ("en", "fr", "de", "es"):
        toxic, clean = ([r.predicted for r in rows if r.lang == lang and r.toxic == v] for v in (1, 0))
        assert sum(toxic) >= 0.85 * len(toxic) > 0 and sum(clean) <= 0.02 * len(clean)


def test_learned_lexicon():
    """Terms that toxic rows hold more often count, under another spelling too; those of a few rows or of both sides don't."""
    weights = toxicity.lexicon(["zorgl", "the ", "rare"], np.array([40, 100, 2]), np.array([20, 900, 0]), 100, 900)
    assert set(weights) == {"zorgl"}
    words = toxicity.Lexicon(weights)
    assert words["Zorgling,"] == words["z0rgl"] == words["zórglen"] == words["zoooorgl"] > 0 and not words["zorg"] and not words["the"]
    f = dict(zip(toxicity.FEATURES, toxicity.features("you zorgl and zorgling of the wood", words), strict=True))
    assert f["learned"] == pytest.approx(2 / 7) and f["learned_kinds"] == f["learned_local"] == 2 and f["learned_near_you"] == pytest.approx(2 / 7) and not f["insults"]
    assert toxicity._terms("中文字") == ["中文字 ", "中文", "文字", "中文字"]


def test_toxic_features():
    at = toxicity.FEATURES.index
    f = toxicity.features("you are an 1d1ot and a m0r0n, st*pid sc.u.m")
    assert f[at("hidden_insults")] == pytest.approx(4 / 9) and f[at("near_you")] > 0
    assert toxicity.features("i d i o t today")[at("spaced")] > 0 and toxicity.features("looooser")[at("hidden")] == 1
    assert not toxicity.features("the whorre of thing")[at("insults")] and not toxicity.features(None).any() and not toxicity.features(" \n").any()


def test_features_against_plain_counts():
    rng = random.Random(5)
    words = toxicity.Lexicon({"zorgl": 4.0, "blar ": 2.0, "quux": 1.0})
    weigh = lambda w: 4.0 if w.startswith("zorgl") else 2.0 if w == "blar" else 1.0 if w.startswith("quux") else 0.0
    for _ in range(200):
        text = [rng.choice(["you", "zorglin", "blar", "blart", "quuxen", "tree", "house", "IDIOT", "moron", "NO"]) for _ in range(rng.randint(1, 80))]
        n, w = len(text), [weigh(x) for x in text]
        near = lambda i: any(x == "you" for x in text[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1])
        hit = [x in ("IDIOT", "moron") for x in text]
        top = sorted({x: v for x, v in zip(text, w, strict=True) if v}.values(), reverse=True)
        want = {
            "insults": sum(hit) / n, "kinds": len({x for x, h in zip(text, hit, strict=True) if h}), "near_you": sum(h and near(i) for i, h in enumerate(hit)) / n, "you": text.count("you") / n,
            "local": max(sum(hit[i : i + toxicity.WINDOW]) for i in range(n)), "caps_words": sum(x.isupper() for x in text) / n, "learned": sum(v > 0 for v in w) / n, "learned_weight": sum(w) / n, "learned_kinds": len(top),
            "learned_local": max(sum(v > 0 for v in w[i : i + toxicity.WINDOW]) for i in range(n)), "learned_near_you": sum(v > 0 and near(i) for i, v in enumerate(w)) / n, "learned_most": max(w), "learned_top": sum(top[:3]),
            "learned_strong": sum(v >= 3 for v in w) / n, "learned_squares": sum(v * v for v in w) / n,
        }
        got = dict(zip(toxicity.FEATURES, toxicity.features(" ".join(text), words), strict=True))
        assert {k: got[k] for k in want} == pytest.approx(want)


def test_one_split_against_all_cuts():
    """The first node of the first tree has the best gain of all features and cuts."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 12, (400, 3)).astype(float)
    y = (x[:, 1] + rng.normal(size=400) > 7).astype(float)
    forest = boost(x, y, trees=1)
    p = y.mean()
    g, h = y - p, np.full(400, p * (1 - p))

    def gain(f, c):
        left = x[:, f] <= c
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + trees.SHRINK)
        return part(left) + part(~left) if min(left.sum(), (~left).sum()) >= trees.LEAST_ROWS else 0.0

    best = max(gain(f, c) for f in range(3) for c in range(12))
    assert gain(int(forest.feature[0][0]), forest.cut[0][0]) == pytest.approx(best)


def test_near_copies_share_a_fold():
    words = [f"w{i}" for i in range(300)]
    other = [f"x{i}" for i in range(300)]
    same = [" ".join(words), " ".join(words).upper(), " ".join(other)]
    c = np.array([toxicity.copies(t) for t in same])
    assert c[0] == c[1] != c[2] and toxicity.copies(None) == toxicity.copies(" ")
    c = np.array([4, 4, 9, 9, 6, 7, 4, 6, 7, 9])
    fold, first = toxicity._dealt(c, np.array([1, 1, 0, 0, 1, 0, 0, 0, 1, 1]))
    assert fold.tolist() == [0, 0, 1, 1, 2, 3, 0, 2, 3, 1] and first.tolist() == [True, False, True, False, True, True, True, True, True, True]
    assert set(toxicity._dealt(np.full(8, 5), np.array([0, 1] * 4))[0].tolist()) == {0, 1, 2, 3}


def test_toxicity_of_odd_rows(odd, none, docs, spark):
    labels = spark.createDataFrame([(i, 5, i % 2) for i in range(8)] + [(1, 5, 1), (None, 5, 1), (2, 5, None)], "doc_id long, text int, toxic int")
    for frame, marks in ((odd, labels), (none, labels), (odd, labels.where("false")), (odd, labels.where("toxic = 1"))):
        model = toxicity.fit(frame, marks)
        assert toxicity.score(odd, model).where("score BETWEEN 0 AND 1").count() == odd.count() and toxicity.score(none, model).count() == 0
    assert toxicity.keep_clean(odd, toxicity.fit(odd, labels)).columns == odd.columns


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    raw = boost(x, y).raw(x)
    assert ((raw > 0) == y).mean() > 0.97
    curve = isotonic(raw, y)
    s = curve(np.sort(raw))
    assert (np.diff(s) >= 0).all() and s[0] < 0.1 and s[-1] > 0.9


def test_minimum_cut_against_all_labellings():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 8)
        unary = [rng.randint(-10, 10) for _ in range(n)]
        joined = {(i, j): rng.randint(0, 8) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.4}

        def cost(label):
            return sum((x > 0) * x * (not k) + (x < 0) * -x * k for x, k in zip(unary, label, strict=True)) + sum(c for (i, j), c in joined.items() if label[i] != label[j])

        assert cost(html.min_cut(unary, joined)) == min(map(cost, itertools.product([False, True], repeat=n)))


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1><p>Best site in the world, welcome to it all.</p></header><div class="cookie-notice">We use cookies on this site. Please accept them all.</div>
<main><div class="post-content"><h1>Head &amp; line</h1><p>First para is a long one with <a href="x">a link</a> inside,\n and&nbsp;then goes on.</p><p>Short.</p><ul><li>item one<li>item two</ul><div class="ad">Buy this now. It is very good for you.</div><p>Last paragraph of the story, which ends here.</p></div>
<form>Name <input> <label>Send</label></form><section id="comments"><article class="comment"><p>Great post, I really liked reading this one a lot!</p></article></section></main><aside><p>Sidebar text goes here, with many words in it.</p></aside><script>if (a < b) "</p>"</script><footer>&copy; 2020</footer></body></html>"""


def test_pages(spark):
    assert html.main_text(PAGE) == "Head & line\nFirst para is a long one with a link inside, and then goes on.\nShort.\nitem one\nitem two\nLast paragraph of the story, which ends here."
    odd = [None, "", " ", "plain words only, of some length.", "<p>a < b and <b>more", "<div><p x='unclosed>text", "<!-- never closed", "</p></div>", "<script>var x", "<p>" * 3000 + "deep words here.", "&#x41;&bogus; <p>&lt;b&gt; is a tag."]
    pages = spark.createDataFrame([(i, h, "u", "t") for i, h in enumerate(odd)] + [(None, PAGE, None, "t"), (1, "", "u", "t")], "page_id long, html string, url string, text string")
    rows = html.extract(pages).collect()
    assert len(rows) == len(odd) + 2 and {r.page_id: r.text for r in rows}[3] == "plain words only, of some length." and all(r.text is not None for r in rows)
    assert html.extract(pages.where("false")).count() == 0


STORY = "<p>A long paragraph of the story stands here, with many words in it.</p>"


def test_comments_and_class_words():
    """Comments go without a class that says so; one class word doesn't lose a paragraph."""
    said = "<section><h2>Comments</h2><article><p>Nice post by me.</p></article></section>"
    assert html.main_text(f"<main><article><h1>Big news</h1>{STORY}{said}</article></main>") == "Big news\nA long paragraph of the story stands here, with many words in it."
    assert html.main_text(f"<article>{STORY}<h3>3 Comments</h3><div><p>I like this story very much, and more so the end of it.</p></div></article>").count("\n") == 0
    assert "comments" in html.main_text(f"<article>{STORY}<h2>What comments do</h2>{STORY}</article>")
    assert html.main_text(f"<article>{STORY}<div class='text-related'><p>And this paragraph is content too.</p></div></article>").endswith("\nAnd this paragraph is content too.")
    assert "Buy" not in html.main_text(f"<article>{STORY}<div class='ad-box'><p>Buy this now, it is very good for you.</p></div>{STORY}</article>")


def test_neighbours_decide(monkeypatch):
    """A linked word alone is content between paragraphs, and isn't without its edges."""
    page = f"<div>{STORY}<p><a href='x'>Of</a></p>{STORY}</div>"
    assert html.main_text(page).split("\n")[1] == "Of"
    monkeypatch.setattr(html, "edges", lambda page: {})
    assert len(html.main_text(page).split("\n")) == 2


def test_regression_against_plain_ascent():
    rng = np.random.default_rng(4)
    content, other = rng.integers(0, 9, len(html.PATTERNS)).astype(float), rng.integers(0, 9, len(html.PATTERNS)).astype(float)
    n, prior, w = content + other, np.array(html.PRIOR), np.zeros(len(html.PRIOR))
    scale = min(1.0, html.WEIGH / n.sum())
    for _ in range(20_000):
        w += 2e-4 * (html.PATTERNS.T @ (scale * (content - n / (1 + np.exp(-html.PATTERNS @ w)))) - html.HOLD * (w - prior))
    assert np.allclose(html.regression(content, other), w, atol=1e-4)
    assert html.regression(np.zeros(len(html.PATTERNS)), np.zeros(len(html.PATTERNS))) == html.PRIOR


def test_query_9(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in html.op9_html(spark, DATA).collect():
        body = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = re.split(r"</?p>|</?h1>", re.sub("</?b>", "", body.replace("<br>", " ")))
        assert r.text == "\n".join(p for p in (" ".join(unescape(x).split()) for x in parts) if p) and r.n_chars == len(r.text)


def test_pipeline_drops_toxic_documents_of_every_language(spark):
    """Rows labelled toxic, held-out ids included."""
    docs, labels = (spark.read.parquet(f"{LABELLED}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in corpus_pipeline.toxic(spark, docs, LABELLED).select("doc_id").collect()}
    rows = labels.join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "toxic", (toxicity.remainder() == 1).alias("held_out")).collect()
    for lang, held in itertools.product(("en", "fr", "de", "es"), (False, True)):
        toxic, clean = ([r.doc_id not in kept for r in rows if r.lang == lang and r.held_out == held and r.toxic == v] for v in (1, 0))
        assert sum(toxic) >= 0.85 * len(toxic) > 0 and sum(clean) <= 0.02 * len(clean)


def test_pipeline(spark, docs, tmp_path):
    """Each stage against the rows it was given."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash_dedup", "decontamination", "packing"]
    rude = "you are an idiot and a moron, pathetic scum. " * 4
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    clean = docs.where("lang = 'en'").orderBy("doc_id").first().text
    extra = spark.createDataFrame([(10**9, None), (10**9 + 1, "123 456"), (10**9 + 2, rude), (10**9 + 3, clean), (10**9 + 4, f"{clean[:200]} words of my own before {bench} and after it, too.")], "doc_id long, text string")
    now = docs.unionByName(extra.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0).cast("long")}))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, DATA).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = now
        assert name == "packing" or now.columns == docs.columns
    ids = {n: {r.doc_id for r in f.select("doc_id").distinct().collect()} for n, f in kept.items()}
    assert {10**9, 10**9 + 1}.isdisjoint(ids["language_id"]) and 10**9 + 2 not in ids["toxicity"] and 10**9 + 3 not in ids["simhash_dedup"] and 10**9 + 4 in ids["packing"]
    assert ids["language_id"] >= {r.doc_id for r in docs.select("doc_id").collect()}
    fps = simhash.components(kept["simhash_dedup"])
    assert fps.where("doc_id <> component_id").count() == 0
    assert bench not in kept["decontamination"].where(F.col("doc_id") == 10**9 + 4).first().text
    assert kept["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).where("n <> t").count() == 0
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_pipeline_of_nothing_and_of_clashing_names(spark, docs):
    """Empty tables run through; columns named like those of the operators come through every stage but the last."""
    extra = ("fp", "component_id", "score", "lang_pred", "held_out", "items", "spans", "n_words", "i", "t", "y", "h", "at", "u", "v", "_id", "_k", "_items", "n", "length", "ids")
    some = docs.limit(80).withColumns({n: F.lit(None).cast("string") if k % 2 else F.lit(k) for k, n in enumerate(extra)})
    for now in (docs.where("false"), some):
        few = now is some
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, now, DATA)
            assert after.count() > 0 if few else after.count() == 0
            assert name == "packing" or after.columns == now.columns
            now = after
