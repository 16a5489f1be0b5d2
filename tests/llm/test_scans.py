import hashlib
import math
import re

import pytest

from docsift.llm import decontaminate, urls

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain_report(docs, items):
    windows = {}
    for name, text in items:
        w = WORD.findall(lower(text))
        n = min(8, len(w))
        for i in range(len(w) - n + 1) if n and name is not None else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    out = []
    for name, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                if g := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= g
        out.append((name, len(w), len(hit), ",".join(sorted(found)), len(found) >= 2))
    return sorted(out, key=str)


ITEMS = [(1, "one two three four five six seven eight"), (2, "Three, FOUR five six seven eight nine ten"), (3, "the cat"), (4, ""), (5, None), (None, "number five"), (6, "Ünïcödé ß"), (1, "another text"), (7, "five six seven eight nine ten the cat sat on a mat")]


@pytest.mark.parametrize("block", [10**6, 5])
def test_report_and_clean(spark, odd, none, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    got = decontaminate.report(odd, bench).collect()
    mine = sorted(((r.doc_id, r.n_words, sum(b - a for a, b in r.spans), ",".join(r["items"]), r.contaminated) for r in got), key=str)
    assert mine == plain_report([(r.doc_id, r.text) for r in odd.collect()], ITEMS)
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == sum(not m[4] for m in mine)
    assert all(not m[2] for m in plain_report([(r.doc_id, r.text) for r in kept.collect()], ITEMS))
    assert decontaminate.report(none, bench).count() == 0 and decontaminate.clean(none, bench).count() == 0
    assert decontaminate.clean(odd, bench.where("false")).count() == odd.count()


def test_cut():
    assert decontaminate.cut("Say: One, two! three. End", [[1, 3]]) == "Say: ! three. End"


def test_digest_of_items(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.items_sha256 for r in decontaminate.op6_decontaminate(spark, DATA).where("n_items = 0").collect()} == {empty}


def plain_url(url):
    host = path = ""
    if url is not None and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url[url.index("://") + 3 :])
        host, path = lower(m[1]), m[2]
    fits = [r for r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


ODD_URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://badexample.org/en/1", "http://a.org", "http://a.org?x=/", "x://b.com/de/", "x://com/fr/", "http://É.com/DE/", "http://h/p#a/b", "http://y.example.org/en/2", "a://b://c/d", "http://bestonlinecasino.net/x", "http://example.net/casino/poker\nx"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(ODD_URLS)] + [(None, ODD_URLS[4], "x", "y"), (3, ODD_URLS[3], "x", "y")], "page_id long, url string, host string, verdict string")
    rows = urls.judged(pages).collect()
    assert len(rows) == len(ODD_URLS) + 2
    by_id = {r.page_id: r for r in rows}
    for i, u in enumerate(ODD_URLS):
        r = by_id[i]
        assert (r.host, r.path, r.rule) == plain_url(u)
        assert r.verdict == (urls.RULES[r.rule] if r.rule else "block" if r.log_odds > 0 else "allow")
    assert by_id[15].verdict == "block" and by_id[16].verdict == "block" and by_id[0].verdict == "allow"
    assert urls.judged(pages.where("false")).count() == 0


def best_split(judge, name):
    """All splits; the cheapest cost."""
    if not name:
        return 0.0
    return min((judge.cost.get(name[:i], urls.UNKNOWN + urls.LETTER * i)) + best_split(judge, name[i:]) for i in range(1, len(name) + 1))


@pytest.mark.parametrize("name", ["casinowin", "cheappills", "tionble", "freebets", "newsxq", "thecat", "adstrack"])
def test_viterbi_against_all_splits(name):
    judge = urls.Judge({"casino": 5, "the": 50})
    parts = judge.segment(name)
    cost = sum(judge.cost.get(p, urls.UNKNOWN + urls.LETTER * len(p)) for p in parts)
    assert "".join(parts) == name and cost == pytest.approx(best_split(judge, name))


def test_long_names_are_split_as_short_ones():
    """The cost of an unknown piece, and so the split, doesn't change with its length."""
    judge = urls.Judge({"casino": 5, "ads": 9})
    for n in (23, 83, 200, 5000):
        assert judge.segment("q" * n + "casino") == ("q" * n, "casino") and judge.segment("q" * n) == ("q" * n,)
        assert (len(judge.segment("q" * n + "ads")) == 2) == (len(judge.segment("q" * 83 + "ads")) == 2)


def test_bayes_against_plain_counts(spark):
    """Counts of whole rows, the lists' share, smoothing and prior, by hand."""
    said = [f"http://{h}.net/{p}" for h, p in [("casino-farm", "en"), ("casino-win", "en"), ("spam-farm", "fr"), ("blog-tree", "en"), ("tree", "en"), ("news", "en/farm"), ("house", "fr"), ("tree-house", "")] for _ in range(6)]
    judge = urls.fit(spark.createDataFrame([(u,) for u in [*said, None]], "url string"))
    counts, rows = {}, [0, 0]
    for u in said:
        words = re.findall("[a-z]+", u[7:].lower())
        c = 0 if sum((w in urls.BLOCKED) - (w in urls.ALLOWED) for w in words) > 0 else 1
        rows[c] += 1
        for w in words:
            counts.setdefault(w, [0, 0])[c] += 1
    rows[1] += 1  # the null url
    sides = [{*urls.BLOCKED}, {*urls.ALLOWED}]
    vocabulary = {*counts, *sides[0], *sides[1]}
    sizes = [sum(n[c] for n in counts.values()) for c in (0, 1)]
    more = [max(urls.SEED, *(len(sides[k]) / sizes[k] for k in (0, 1))) * sizes[c] / len(sides[c]) for c in (0, 1)]
    weight = lambda w, c: counts.get(w, [0, 0])[c] + more[c] * (w in sides[c]) + urls.ALPHA
    total = [sum(weight(w, c) for w in vocabulary) for c in (0, 1)]
    odds = {w: math.log(weight(w, 0) / total[0]) - math.log(weight(w, 1) / total[1]) for w in vocabulary}
    assert judge.odds == pytest.approx(odds) and judge.prior == pytest.approx(math.log((rows[0] + 1) / (rows[1] + 1)))
    assert len({round(x, 6) for x in odds.values()}) > 3 and judge.score("casino-farm.net", "") > 0 > judge.score("tree.net", "/en")
    assert judge.score("casino-farm.net", "") == pytest.approx(judge.prior + odds["casino"] + odds["farm"] + odds["net"])


def test_query_2(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = urls.op2_urls(spark, DATA).collect()
    assert len(rows) == len(pages) and all((r.host, r.path, r.rule) == plain_url(pages[r.page_id]) for r in rows)
    spam = [r for r in rows if r.rule is None and re.search("casino|bets|pills|ads-track|spam|adult", r.host)]
    rest = [r for r in rows if r.rule is None and r not in spam]
    assert all(r.verdict == "block" for r in spam) and all(r.verdict == "allow" for r in rest)
