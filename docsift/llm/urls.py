"""URL filters: rules first, else words of the host and path judged by naive Bayes.

Names in hosts are often words run together. Each label is split by a unigram Viterbi search: known words cost their negative
log frequency, other pieces a start-up cost and a cost a letter, so a name made of known words falls apart and another stays
whole. The frequencies are those of the dictionary's words among all delimited words of all urls.

The words found in host and path are scored by multinomial naive Bayes. No table labels urls, so the two word lists below do: a url
with more words of the blocked list than of the other is a training row of block, and every other url is taken for one of allow. All
words of a row are counted for its class, and the words of a list share so many times that class's count besides: the same share in
both classes, SEED or what it takes for each to count once. So what stands beside listed words is learned too, and a word that is as
common everywhere says little. The counts come from a bounded sample of
urls; words outside them say nothing. Verdicts of rules are no training rows: they tell places and not words.

Rules are ``host/path`` with an action; a rule fits its host and all subdomains if the url's path starts with the rule's path. Of
those that fit, the longest decides, of equal ones the first in code-point order.

Defined results: null or no ``://`` gives empty host and path, no rule and the verdict ``allow``; an even score is ``allow``;
names of any length are split as a whole; an empty table is judged by the lists alone; repeated rows each get a row; columns other
than id and url are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.llm.shared import slices, table

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Rules become one expression; more than so many (a parameter of rule_of) are refused, as they belong in a table.
MAX_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The training lists of naive Bayes.
BLOCKED = """
casino casinos bet bets betting gambling poker slot slots jackpot roulette blackjack lottery bingo win winner winning bonus pills pill viagra cialis
pharmacy pharma meds drugs tablets cheap discount free replica fake loan loans payday credit cash debt forex porn porno xxx sex sexy adult nude
cams escort escorts hookup ads ad advert adserver adclick track tracker tracking click clicks popup popups banner banners spam malware phishing
warez crack cracked keygen torrent torrents hack hacked cheats rich quick miracle diet weight
""".split()
ALLOWED = """
news blog blogs wiki docs school university college library science health recipe recipes kids sport sports weather museum history art arts
book books forum support help about contact article articles research journal travel music photo photos garden family cooking
church story stories city public data open code project projects learn lesson lessons course courses guide guides review reviews tech nature
free shop store home page media video radio film theatre world daily times post press paper magazine
""".split()
# Words that only help to split names.
OTHER = "the and of for in on at to my your our best top new online web site net live play game games now get buy sell great first one big real all day night house car land green blue red black white hot super mega club zone hub center group team world".split()
#: Smoothing of counts, and what the words of a list count more in their class at least, as a share of all its counts.
ALPHA, SEED = 0.05, 0.2
#: Urls that naive Bayes is trained on, about, those of the least hash; times that a word is counted at least; words that the driver
#: gets at most; counts that a worker holds at once.
SAMPLE, LEAST, WORDS, COUNTS = 500_000, 5, 50_000, 200_000
#: Cost of a piece that isn't a known word: for itself and for each letter.
UNKNOWN, LETTER = 9.0, 1.9
LONGEST = 24
KEPT = 200_000

_BLOCKED, _ALLOWED = frozenset(BLOCKED), frozenset(ALLOWED)
_DELIMITED = re.compile(r"[a-z]+")


def dictionary() -> list[str]:
    return sorted({*BLOCKED, *ALLOWED, *OTHER})


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path columns."""
    after = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + F.lit(3))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    return F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str], max_rules: int = MAX_RULES) -> Column:
    """The deciding rule as written, or null."""
    if len(rules) > max_rules:
        raise ValueError(f"more than {max_rules} rules")
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r), r), reverse=True):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, rule).otherwise(out)
    return out


def frequencies(urls: DataFrame, url_col: str = "url") -> dict[str, int]:
    """Counts of the dictionary's words among the delimited words of all urls; as many rows at most as the dictionary has."""
    words = urls.select(F.explode(F.split(F.translate(url_col, UPPER, LOWER), "[^a-z]+")).alias("w")).where(F.col("w").isin(dictionary()))
    return {r.w: r.n for r in words.groupBy("w").agg(F.count("*").alias("n")).collect()}


class Judge:
    """Splits names and scores words.

    ``counts``: times that rows of block and of allow hold a word; ``rows``: rows of the two classes.
    """

    def __init__(self, frequency: dict[str, int], counts: dict[str, tuple[int, int]] | None = None, rows: tuple[int, int] = (0, 0)):
        words = dictionary()
        total = sum(frequency.get(w, 0) + 1 for w in words)
        self.cost = {w: -math.log((frequency.get(w, 0) + 1) / total) for w in words}
        counts = counts or {}
        sizes = [max(1, sum(n[c] for n in counts.values())) for c in (0, 1)]
        share = max(SEED, len(_BLOCKED) / sizes[0], len(_ALLOWED) / sizes[1])
        more = [share * n / len(own) for n, own in zip(sizes, (_BLOCKED, _ALLOWED), strict=True)]
        seen = {w: [counts.get(w, (0, 0))[c] + more[c] * (w in own) for c, own in enumerate((_BLOCKED, _ALLOWED))] for w in {*counts, *_BLOCKED, *_ALLOWED}}
        sums = [sum(v[c] for v in seen.values()) + ALPHA * len(seen) for c in (0, 1)]
        self.odds = {w: math.log((v[0] + ALPHA) / sums[0]) - math.log((v[1] + ALPHA) / sums[1]) for w, v in seen.items()}
        self.prior = math.log((rows[0] + 1) / (rows[1] + 1))
        self.kept: dict[str, tuple[str, ...]] = {}

    def segment(self, name: str) -> tuple[str, ...]:
        """The cheapest split of a run of letters."""
        if (got := self.kept.get(name)) is not None:
            return got
        best: list[tuple[float, int]] = [(0.0, 0)]
        piece = (UNKNOWN, 0)  # the cheapest start of an unknown piece, its letters before the start taken off
        for j in range(1, len(name) + 1):
            known = min(((best[i][0] + self.cost[name[i:j]], i) for i in range(max(0, j - LONGEST), j) if name[i:j] in self.cost), default=(math.inf, 0))
            best.append(min(known, (piece[0] + LETTER * j, piece[1])))
            piece = min(piece, (best[j][0] + UNKNOWN - LETTER * j, j))
        out, j = [], len(name)
        while j:
            i = best[j][1]
            out.append(name[i:j])
            j = i
        if len(self.kept) >= KEPT:
            self.kept.clear()
        self.kept[name] = tuple(reversed(out))
        return self.kept[name]

    def words(self, host: str, path: str) -> list[str]:
        return [w for run in _DELIMITED.findall(f"{host} {path.lower()}") for w in self.segment(run)]

    def score(self, host: str, path: str) -> float:
        """Log-odds of block; without a word that says anything they are even."""
        odds = [self.odds[w] for w in self.words(host, path) if w in self.odds]
        return self.prior + sum(odds) if odds else 0.0


def label(words: list[str]) -> int:
    """The class that the lists give a url: 0 block, 1 allow."""
    return int(sum((w in _BLOCKED) - (w in _ALLOWED) for w in words) <= 0)


def fit(pages: DataFrame, url_col: str = "url", sample: int = SAMPLE) -> Judge:
    """Splits and counts about ``sample`` urls, those of the least hash, on the executors."""
    frequency = frequencies(pages, url_col)
    host, path = split_url(F.col(url_col))
    h = F.pmod(F.xxhash64(url_col, F.lit(3)), F.lit(1 << 30))
    bound = min(1 << 30, (1 << 30) * sample // max(1, pages.count()))
    sent = pages.sparkSession.sparkContext.broadcast(Judge(frequency))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, held = sent.value, Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in held], pa.string()), pa.array([c for _, c in held], pa.int32()), pa.array(held.values(), pa.int64())], names=["word", "c", "n"])

        for b in slices(batches):
            for host, path in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = judge.words(host, path)
                c = label(words)
                held.update((w, c) for w in ["", *words])  # the empty word counts rows
            if len(held) > COUNTS:
                yield out()
                held.clear()
        yield out()

    counted = pages.where(h < bound).select(host.alias("host"), path.alias("path")).mapInArrow(run, "word string, c int, n bigint")
    by_class = [F.sum(F.when(F.col("c") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    summed = counted.groupBy("word").agg(*by_class).where((F.col("n0") + F.col("n1") >= LEAST) | (F.col("word") == ""))
    found = {r.word: (r.n0, r.n1) for r in summed.orderBy(F.desc(F.col("word") == ""), F.desc(F.col("n0") + F.col("n1")), "word").limit(WORDS).collect()}
    rows = found.pop("", (0, 0))
    return Judge(frequency, found, rows)


def judged(pages: DataFrame, rules: dict[str, str] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, log_odds``; three passes over the urls alone, no shuffle of them."""
    rules = RULES if rules is None else rules
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    sent = pages.sparkSession.sparkContext.broadcast(fit(pages, url_col))
    schema = T.StructType([*rows.schema.fields, T.StructField("log_odds", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent.value
        for b in slices(batches):
            odds = [judge.score(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(odds, pa.float64())], names=schema.names)

    scored = rows.mapInArrow(run, schema).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    action = F.lit(None).cast("string")
    for rule, what in rules.items():
        action = F.when(F.col("rule") == rule, what).otherwise(action)
    return scored.withColumn("verdict", F.coalesce(action, F.when(F.col("log_odds") > 0, "block").otherwise("allow"))).select("page_id", "host", "path", "rule", "verdict", "log_odds")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
