"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are counted over the whole text: densities of a fixed lexicon, hits near a second person, capitals, punctuation, and
how much of the wording is obfuscated (look-alike signs, stars for letters, stretched letters, letters set apart). The fixed
list covers few words of few languages, so a second lexicon is learned from the labels: words and beginnings of words that surely
many more toxic than clean rows hold, each with a weight. A word is looked at once a worker; its flags and weight are then kept.
The trees are grown from a bounded sample of labelled rows; features of a row there come from a lexicon that was learned without
the row's fold, and calibration uses predictions for rows that the tree in question didn't see. Near copies, found by the least
hash of their five-word shingles, share a fold and count once for a term, so a text that many copied teaches no words of its own.

Defined results: null and blank texts have all features 0 and the score that the model gives to that; a null id gets a row;
several labels of one id count as toxic if one is; without labels, or with one label value only, every score is that value's
share (0 without labels); a sample of so few different texts that a fold would have none or one label to learn from is dealt by
rows; repeated rows each get a row; other columns are not read (score) or pass through (keep_clean).
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.llm.shared import discard, save, slices, table
from docsift.llm.trees import Forest, Isotonic, boost, isotonic

#: Labelled rows that a model is fitted on, those of the least hash of their id.
SAMPLE = 20_000
FOLDS = 4
#: Times as many rows as are drawn that a hash bound leaves to draw from.
SPARE, LARGEST = 4, (1 << 63) - 1
TOXIC = 0.7
#: Words on either side of a second person that count as near it, and the window of the highest local count.
NEAR, WINDOW = 5, 25
#: Words that a worker keeps the flags and weights of; beyond it all are looked at anew.
KEPT = 300_000
#: Lengths of the beginnings of words that are learned; toxic rows that a learned term is in at least; its least log odds, and the
#: standard errors by which they must differ from 0; terms that the driver gets at most, and counts that a worker holds at once.
BEGINNINGS, LEAST_ROWS, LEAST_ODDS, SURE, TERMS, COUNTS = range(4, 9), 3, 1.5, 3.0, 50_000, 200_000
#: Signs that all learned terms of a word begin with: the shortest beginning, or the word and its blank.
HEAD = BEGINNINGS[0]
#: Weight from which a learned word is a strong one, words whose weights are summed, and words of the shingles that tell near copies.
STRONG, TOP, SHINGLE = 3.0, 3, 5

# Insults and slurs against a reader, in the languages of the corpus.
INSULTS = """
idiot idiots idiotic moron morons moronic stupid dumbass imbecile imbeciles dumb loser losers scum scumbag trash garbage clown clowns
pathetic worthless disgusting filthy vermin bastard bastards bitch asshole assholes bullshit shit shitty fuck fucker fucking
crap dickhead jerk jackass retard retarded whore slut pervert freak creep coward cowards liar brainless braindead ugly
fool foolish useless lowlife degenerate parasite swine cretin halfwit dimwit nitwit dunce psycho lunatic maggot repulsive despicable
idiotisch dummkopf arschloch scheisse scheiße abschaum miststück wichser hurensohn schwachkopf trottel widerlich wertlos
idiote imbécile crétin connard connasse salaud salope merde ordure pathétique dégueulasse abruti débile
idiota imbécil estúpido estúpida basura mierda cabrón pendejo gilipollas asqueroso patético inútil payaso
""".split()
# Threats and hate.
THREATS = "kill die hang burn hurt destroy murder rape beat shoot stab töten umbringen tuer mourir crever matar morir".split()
# The second person.
YOU = "you your yours yourself youre ur u du dich dir dein deine ihr euch tu toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split()
# Signs that stand for letters.
LOOKS = str.maketrans("013457@$!|€", "oieastasiie")

INSULT, THREAT, SECOND, CAPS, LOUD, HIDDEN, LETTER = (1 << k for k in range(7))
FEATURES = ("log_words", "insults", "log_insults", "kinds", "local", "threats", "near_you", "you", "caps_words", "capitals", "loud", "punctuation", "hidden", "hidden_insults", "spaced", "digits", "signs", "beyond_ascii")
LEARNED = ("learned", "learned_weight", "log_learned", "learned_kinds", "learned_local", "learned_near_you", "learned_most", "learned_top", "learned_strong", "learned_squares")
FEATURES += LEARNED

_SIGNS = string.punctuation
#: Accented letters of Latin scripts without their accents.
_BARE = {c: b for c in range(0xC0, 0x250) if (b := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) != chr(c)}
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_RUN = re.compile(r"(.)\1+")
_STRETCH = re.compile(r"(.)\1\1")


def _core(word: str) -> str:
    """The word without the signs around it."""
    core = word.strip(_SIGNS)
    return core if core.isalnum() else _EDGE.sub("", word)


def _squeezed(w: str) -> str:
    return _RUN.sub(r"\1", w)


class _Words:
    """Flags of words by their spelling; insults also carry their number from bit 8 on."""

    def __init__(self):
        self.insults = {w: i + 1 for i, w in enumerate(INSULTS)}
        self.squeezed = {_squeezed(w): i for w, i in self.insults.items() if len(w) > 4}
        self.masked = [(re.compile("".join(f"[{re.escape(c)}*#_.-]" if 0 < i < len(w) - 1 else re.escape(c) for i, c in enumerate(w)) + r"\Z"), n) for w, n in self.insults.items() if len(w) > 3]
        self.threats, self.you = frozenset(THREATS), frozenset(YOU)

    def look(self, word: str, core: str | None = None) -> int:
        core = _core(word) if core is None else core
        low = core.lower()
        flags = (CAPS if len(core) > 1 and core.isupper() else 0) | (LOUD if "!" in word or "?!" in word else 0) | (LETTER if len(core) == 1 and core.isalpha() else 0)
        if low in self.you:
            return flags | SECOND
        if low in self.threats:
            return flags | THREAT
        if number := self.insults.get(low):
            return flags | INSULT | number << 8
        if len(low) < 3 or low.isalpha() and not _STRETCH.search(low):
            return flags
        return flags | self.unmasked(word.lower(), low)

    def unmasked(self, whole: str, low: str) -> int:
        """An insult under look-alikes, separators, stretched letters or stars."""
        plain = _INNER.sub("", low)
        for w in (plain, plain.translate(LOOKS), _EDGE.sub("", whole.translate(LOOKS)), _INNER.sub("", whole.translate(LOOKS))):
            if number := self.insults.get(w) or _STRETCH.search(w) and self.squeezed.get(_squeezed(w)):
                return INSULT | HIDDEN | number << 8
        if re.search(r"\w[*#_]+\w", whole):
            for pattern, number in self.masked:
                if pattern.match(low):
                    return INSULT | HIDDEN | number << 8
            return HIDDEN
        return HIDDEN if re.search(r"[^\W\d_][\d@$!]+[^\W\d_]", low) else 0


_WORDS = _Words()


def _folded(word: str, core: str | None = None) -> str:
    """Lower case without accents and signs around."""
    low = (_core(word) if core is None else core).lower()
    if not low.isascii():
        low = low.translate(_BARE)
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


def _terms(folded: str) -> list[str]:
    """What is learned of a word: itself, closed by a blank, its beginnings, and pairs and triples of signs of unspaced scripts."""
    out = [folded + " ", *(folded[:k] for k in BEGINNINGS if k <= len(folded))] if len(folded) > 1 else []
    if folded > "\u0e00" or not folded.isascii() and any(c > "\u0e00" for c in folded):
        out += [folded[i : i + k] for k in (2, 3) for i in range(len(folded) - k + 1)]
    return out


class Lexicon:
    """Weights of words by their spelling, 0 for those of no learned term; an obfuscated word has that of its plain spelling."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.heads = {t[:HEAD] for t in weights}
        self.seen = _Seen(self)

    def __getitem__(self, word: str) -> float:
        return self.weigh(word, _core(word))

    def weigh(self, word: str, core: str) -> float:
        if not self.weights:
            return 0.0
        folded = _folded(word, core)
        if folded.isascii() and folded.isalpha() and not _STRETCH.search(folded) and (folded + " ")[:HEAD] not in self.heads:
            return 0.0  # every term of such a word begins as it does
        spellings = [folded]
        if folded and (not folded.isalpha() or _STRETCH.search(folded)):
            plain = _INNER.sub("", folded).translate(LOOKS)
            spellings += [plain, _INNER.sub("", _folded(word.translate(LOOKS))), _squeezed(plain)]
        return max((self.weights.get(t, 0.0) for s in spellings for t in _terms(s)), default=0.0)


class _Seen(dict):
    """Numbers of the words that a worker has met, by which their flags and weights are kept; emptied between texts."""

    def __init__(self, learned: Lexicon):
        super().__init__()
        self.learned, self.size = learned, 1 << 12
        self.flags, self.weights = np.zeros(self.size, np.int32), np.zeros(self.size)

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        if k == self.size:
            self.size *= 2
            self.flags, self.weights = np.resize(self.flags, self.size), np.resize(self.weights, self.size)
        core = _core(word)
        self.flags[k], self.weights[k] = _WORDS.look(word, core), self.learned.weigh(word, core)
        return k

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self) > KEPT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


_PLAIN = Lexicon({})


def lexicon(terms: list[str], toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights of the terms that surely more toxic rows hold: the lower bound of their log odds ratio."""
    a, b = toxic + 0.5, clean + 0.5
    c, d = n_toxic - toxic + 0.5, n_clean - clean + 0.5
    odds, error = np.log(a / c) - np.log(b / d), np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    keep = np.flatnonzero((toxic >= LEAST_ROWS) & (odds > LEAST_ODDS) & (odds > SURE * error))
    return {terms[i]: float(odds[i] - error[i]) for i in keep.tolist()}


def features(text: str | None, learned: Lexicon | None = None) -> np.ndarray:
    """The dense features of one whole text, in the order of FEATURES."""
    learned = learned or _PLAIN
    out = np.zeros(len(FEATURES))
    words = (text or "").split()
    n = len(words)
    if not n:
        return out
    numbers = learned.seen.numbers(words)
    flags = learned.seen.flags[numbers]
    single = np.concatenate([[0], (flags & LETTER > 0).astype(np.int8), [0]])
    spaced = 0
    if (np.convolve(single, np.ones(4, np.int8)) == 4).any():  # letters set apart
        edge = np.flatnonzero(np.diff(single)).reshape(-1, 2)
        for a, b in edge[edge[:, 1] - edge[:, 0] >= 4].tolist():
            joined = "".join(_EDGE.sub("", w) for w in words[a:b]).lower()
            spaced += 1
            hit = next((i for w, i in _WORDS.insults.items() if len(w) > 3 and w in joined), 0)
            if hit:
                flags[a] |= INSULT | HIDDEN | hit << 8
    insult, you, hidden = flags & INSULT > 0, flags & SECOND > 0, flags & HIDDEN > 0
    hits = int(insult.sum())
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = counts.sum()
    if hits:
        c = np.concatenate([[0], np.cumsum(insult)])
        at = np.arange(n)
        out[4] = (c[np.minimum(at + WINDOW, n)] - c[at]).max()
        y = np.concatenate([[0], np.cumsum(you)])
        out[6] = (insult & (y[np.minimum(at + NEAR + 1, n)] - y[np.maximum(at - NEAR, 0)] > 0)).sum() / n
        out[3] = len(np.unique(flags[insult] >> 8))
    out[0], out[1], out[2] = np.log1p(n), hits / n, np.log1p(hits)
    out[5], out[7], out[8] = (flags & THREAT > 0).sum() / n, you.sum() / n, (flags & CAPS > 0).sum() / n
    out[9], out[10] = counts[65:91].sum() / size, (flags & LOUD > 0).sum() / n
    out[11] = counts[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum() / size
    out[12], out[13], out[14] = hidden.sum() / n, (hidden & insult).sum() / n, spaced / n
    if learned.weights:
        w = learned.seen.weights[numbers]
        toxic = w > 0
        if found := int(toxic.sum()):
            c, y, at = np.concatenate([[0], np.cumsum(toxic)]), np.concatenate([[0], np.cumsum(you)]), np.flatnonzero(toxic)
            near = y[np.minimum(at + NEAR + 1, n)] - y[np.maximum(at - NEAR, 0)] > 0
            kinds = np.sort(learned.seen.weights[np.unique(numbers[at])])[::-1]
            out[18:24] = found / n, w.sum() / n, np.log1p(found), len(kinds), (c[np.minimum(at + WINDOW, n)] - c[at]).max(), near.sum() / n
            out[24:] = kinds[0], kinds[:TOP].sum(), (w >= STRONG).sum() / n, (w**2).sum() / n
    out[15], out[16], out[17] = counts[48:58].sum() / size, counts[[35, 36, 37, 38, 42, 60, 62, 64, 95, 124, 126]].sum() / size, counts[128:].sum() / size
    return out


@dataclass
class Model:
    forest: Forest | None
    curve: Isotonic | None
    share: float
    weights: dict[str, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.forest is None:
            return np.full(len(x), self.share)
        return np.clip(self.curve(self.forest.raw(x)), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` rows of docs with a label.

    Ids are chosen from narrow columns, and the chosen texts go to the shared folder, one an id. Terms are counted and features
    made on the executors; only numbers and terms that may be learned come to the driver.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    h = F.xxhash64("i", F.lit(5)).bitwiseAND(F.lit(LARGEST))
    ids = save(docs.select(F.col(id_col).alias("i")).distinct().join(known, "i").withColumn("h", h), "toxicity-ids")
    # Hashes beyond a few times what is wanted can't be among the least, and aren't sent to the one task that picks.
    least = min(LARGEST, LARGEST * SPARE * sample // max(1, ids.count()))
    drawn = [(r.i, int(r.y > 0)) for r in ids.where(F.col("h") <= least).orderBy("h", "i").limit(sample).collect()]
    discard(docs.sparkSession, ids)
    y = np.array([v for _, v in drawn], float)
    if len(y) < 2 * FOLDS or y.min() == y.max():
        return Model(None, None, float(y.mean()) if len(y) else 0.0, {})
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    marks = spark.createDataFrame([(i, v, at) for at, (i, v) in enumerate(drawn)], f"i {kind}, y int, at int")
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(marks), "i").groupBy("at", "y").agg(F.min("t").alias("t"))
    rows = save(_with_copies(rows.repartition(max(1, len(drawn) // 500))), "toxicity-sample")
    fold, first = _dealt(rows.select("at", "copies").toPandas().sort_values("at")["copies"].to_numpy(), y)
    terms, counts = _counted(rows, y, fold, first)
    side = lambda k, v: (counts.sum(axis=1) - (0 if k is None else counts[:, k]))[:, v]
    texts = lambda k, v: int((first & (fold != k) & (y == v)).sum())
    weights = lambda k: lexicon(terms, side(k, 1), side(k, 0), texts(k, 1), texts(k, 0))
    sent = spark.sparkContext.broadcast(([weights(k) for k in range(FOLDS)], fold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, fold = [Lexicon(w) for w in sent.value[0]], sent.value[1]
        for b in slices(batches):
            x = [features(t.as_py(), learned[fold[at]]).tolist() for at, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["at", "x"])

    got = rows.select("at", "t").mapInArrow(run, "at int, x array<double>").toPandas().sort_values("at")
    discard(spark, rows)
    x = np.array(got["x"].tolist())
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        raw[fold == k] = boost(x[fold != k], y[fold != k]).raw(x[fold == k])
    return Model(boost(x, y), isotonic(raw, y), float(y.mean()), weights(None))


def copies(text: str | None) -> int:
    """The least hash of a text's shingles, which near copies most likely share."""
    from xxhash import xxh64_intdigest

    words = (text or "").lower().encode("utf-8", "replace").split()
    return min(xxh64_intdigest(b" ".join(words[i : i + SHINGLE])) for i in range(max(1, len(words) - SHINGLE + 1))) >> 1


def _with_copies(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([copies(t.as_py()) for t in b.column(2)], pa.int64())], names=["at", "y", "t", "copies"])

    return rows.mapInArrow(run, "at int, y int, t string, copies bigint")


def _dealt(copies: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fold of each row, and whether it is the first of its near copies with that label."""
    fold = copies % FOLDS
    if any(len(np.unique(y[fold != k])) < 2 for k in range(FOLDS)):
        fold = np.arange(len(y)) % FOLDS
    first = np.zeros(len(y), bool)
    first[np.unique(np.stack([copies, y.astype(np.int64)]), axis=1, return_index=True)[1]] = True
    return fold, first


def _counted(rows: DataFrame, y: np.ndarray, fold: np.ndarray, first: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Terms that some lexicon may take, and the rows that hold them by fold and label; near copies are one row."""
    sent = rows.sparkSession.sparkContext.broadcast((fold, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        fold, first = sent.value

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in held], pa.string()), pa.array([c for _, c in held], pa.int32()), pa.array(held.values(), pa.int64())], names=["term", "c", "n"])

        for b in slices(batches):
            for at, v, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if not first[at]:
                    continue
                c = int(fold[at]) * 2 + v
                held.update({(x, c) for w in {_folded(w) for w in (t.as_py() or "").split()} for x in _terms(w)})
                if len(held) > COUNTS:
                    yield out()
                    held.clear()
        yield out()

    at = [F.sum(F.when(F.col("c") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * FOLDS)]
    toxic, clean = (sum((F.col(f"c{2 * k + v}") for k in range(1, FOLDS)), F.col(f"c{v}")) for v in (1, 0))
    n = [float(max(1, (first & (y == v)).sum())) for v in (0, 1)]
    more = (toxic + 0.5) / n[1] - (clean + 0.5) / n[0]
    spread = F.sqrt((toxic + 0.5) / (n[1] * n[1]) + (clean + 0.5) / (n[0] * n[0]))
    summed = rows.select("at", "y", "t").mapInArrow(run, "term string, c int, n bigint").groupBy("term").agg(*at)
    found = summed.where((toxic >= LEAST_ROWS) & (more > 0)).orderBy((more / spread).desc(), "term").limit(TERMS).toPandas()
    return found["term"].tolist(), found.drop(columns="term").to_numpy(np.int64).reshape(-1, FOLDS, 2)


def _scored(rows: DataFrame, model: Model, text_at: int, schema, finish) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = Lexicon(sent.value.weights)
        for b in slices(batches):
            x = np.array([features(t.as_py(), learned) for t in b.column(text_at)]).reshape(-1, len(FEATURES))
            yield finish(b, sent.value.score(x))

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema[0], T.StructField("score", T.DoubleType())])
    return _scored(rows, model, 1, schema, lambda b, s: pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=schema.names))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", toxic: float = TOXIC) -> DataFrame:
    """The documents, with every column, whose score is below ``toxic``."""
    return _scored(docs, model, docs.columns.index(text_col), docs.schema, lambda b, s: b.filter(pa.array(s < toxic, pa.bool_())))


def remainder(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(remainder() != 1))
    return score(docs, model).select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
