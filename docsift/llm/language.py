"""Language identification with string kernels.

The kernel is the blended-spectrum presence kernel: two texts are as alike as the share of character n-grams (1 to 3, lower
case, runs of white space as one blank) that both hold, cosine-normalised. A bounded sample of labelled texts is drawn for
each language, some of them are landmarks of a Nyström map, and one ridge regression for each language (one against the rest)
is solved in the mapped space. A batch of texts is scored by two matrix products: presences by landmarks, then kernel values
by languages.

Characters are numbered by their frequency in the sample; those beyond the table share numbers by remainder. Presence is read
over the n-grams that the landmarks hold. A text of any length is one row of presences, so memory is bounded by the batch and
not by the text: long texts are read whole, in slices that overlap by two characters.

Defined results: ``und`` with score 0 for null or without a letter; a text whose n-grams are all unknown has equal values for
all labels and gets the first in code-point order, at the score of an even guess; so do ties; repeated rows each get a row;
with no labelled row at all every text is ``und``; other columns are not read (predict) or pass through (keep_known).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.llm.shared import slices, table

#: Labelled texts drawn for each language, the landmarks among them, and the labels beyond which fitting refuses.
PER_LABEL, LANDMARKS_PER_LABEL, MAX_LABELS = 300, 48, 200
#: Times as many rows as are drawn that a hash bound leaves to draw from.
SPARE, LARGEST = 4, (1 << 63) - 1
RIDGE = 1e-3
#: Slope of the softmax that turns regression values, near 0 and 1, into a score.
SLOPE = 6.0
#: Numbers for characters: own ones, and those shared by the rest. Number 0 is a blank.
OWN, SHARED = 96, 31
SYMBOLS = 1 + OWN + SHARED
ORDERS = 3
#: Texts scored at once, and characters looked at in one slice.
BATCH, SLICE = 64, 1 << 20
#: keep_known rejects texts whose best score is below so many times an even guess.
LEAST_GUESSES = 1.1
UND = "und"


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _symbols(text: str, number: np.ndarray) -> np.ndarray:
    """Numbers of a text's characters, blanks once in a row."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(cps < len(number), number[np.minimum(cps, len(number) - 1)], 1 + OWN + cps % SHARED)
    blank = out == 0
    return np.delete(out, np.flatnonzero(blank[1:] & blank[:-1]) + 1)


def _grams(s: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of all n-grams; orders have ranges of their own."""
    base, code = 0, np.zeros(len(s), np.int64)
    for n in range(1, ORDERS + 1):
        if len(s) < n:
            return
        code = code[: len(s) - n + 1] * SYMBOLS + s[n - 1 :]
        yield base + code
        base += SYMBOLS**n


CODES = sum(SYMBOLS**n for n in range(1, ORDERS + 1))


@dataclass
class Model:
    labels: list[str]
    number: np.ndarray
    """Numbers of the first code points."""
    column: np.ndarray
    """Presence column of each n-gram code; the last column takes what no landmark holds."""
    landmarks: np.ndarray
    """Presence columns by landmarks, each landmark of length 1."""
    weights: np.ndarray
    """Landmarks by labels: the inverse root of the Nyström map times the ridge solution."""

    def presence(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.landmarks.shape[0] + 1), np.float32)
        for row, text in zip(out, texts, strict=True):
            for at in range(0, max(1, len(text)), SLICE):
                for g in _grams(_symbols(text[max(0, at - ORDERS + 1) : at + SLICE], self.number)):
                    row[self.column[g]] = 1
        return out[:, :-1]

    def values(self, texts: list[str]) -> np.ndarray:
        """Regression values, texts by labels."""
        p = self.presence(texts)
        norm = np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))
        return (p @ self.landmarks / norm) @ self.weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        import regex

        letter = regex.compile(r"\p{L}").search
        known = [i for i, t in enumerate(texts) if t and letter(t)] if self.labels else []
        labels, scores = [UND] * len(texts), [0.0] * len(texts)
        for at in range(0, len(known), BATCH):
            rows = known[at : at + BATCH]
            v = SLOPE * self.values([texts[i] for i in rows]).astype(np.float64)
            e = np.exp(v - v.max(axis=1, keepdims=True))
            best = v.argmax(axis=1)
            for i, k, s in zip(rows, best.tolist(), (e.max(axis=1) / e.sum(axis=1)).tolist(), strict=True):
                labels[i], scores[i] = self.labels[k], s
        return labels, scores


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = PER_LABEL, landmarks: int = LANDMARKS_PER_LABEL, max_labels: int = MAX_LABELS) -> Model:
    """Learns from at most per_label rows of each label, those of the least hash of their id; refuses more than max_labels labels.

    Ids are chosen from two narrow columns; texts are then read for those alone.
    """
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    ids = rows.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).distinct().withColumn("h", F.xxhash64("i", F.lit(11)).bitwiseAND(F.lit(LARGEST)))
    counts = {r.y: r.n for r in ids.groupBy("y").agg(F.count("*").alias("n")).limit(max_labels + 1).collect()}
    labels = sorted(counts)
    if len(labels) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    # Hashes beyond a few times what is wanted can't be among the least, and aren't sent to the label's task.
    least = F.lit(LARGEST)
    for y, n in counts.items():
        least = F.when(F.col("y") == y, F.lit(min(LARGEST, LARGEST * SPARE * per_label // n))).otherwise(least)
    w = Window.partitionBy("y").orderBy("h", "i")
    chosen = ids.where(F.col("h") <= least).withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_label).select("i", "y")
    full = rows.select(F.col(id_col).alias("i"), F.col(label_col).alias("y"), F.col(text_col).alias("t")).join(F.broadcast(chosen), ["i", "y"], "left_semi")
    # One text an id and label, the least: however often an id repeats, the driver gets per_label rows of a label at most.
    sample = _distinct_grams(full.groupBy("i", "y").agg(F.min("t").alias("t"))).toPandas().sort_values(["y", "h"], kind="stable")
    return _solve(sample["chars"].tolist(), sample["y"].tolist(), labels, landmarks)


def _distinct_grams(full: DataFrame) -> DataFrame:
    """A text's distinct n-grams as strings: what the driver gets grows with the alphabet and not with the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for t in b.column(1).to_pylist():
                t = " ".join(t.lower().split())
                out.append(sorted({t[i : i + ORDERS] for i in range(max(1, len(t) - ORDERS + 1))}))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.list_(pa.string()))], names=["y", "h", "chars"])

    return full.select("y", "t", F.xxhash64("i", F.lit(11)).alias("h")).mapInArrow(run, "y string, h bigint, chars array<string>")


def _solve(texts: list, y: list[str], labels: list[str], landmarks: int) -> Model:
    number, column = np.zeros(1 << 16, np.int16), np.zeros(CODES, np.int32)
    if not texts:
        return Model([], number, column, np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    grams = [[g for g in t if g] for t in texts]
    chars = np.frombuffer("".join(g for t in grams for g in t).encode("utf-32-le", "surrogatepass"), np.uint32)
    cps, counts = np.unique(chars, return_counts=True)
    number[:] = 1 + OWN + np.arange(1 << 16) % SHARED
    frequent = [c for c in cps[np.lexsort((cps, -counts))].tolist() if c < 1 << 16 and not chr(c).isspace()][:OWN]
    number[frequent] = 1 + np.arange(len(frequent))
    number[[c for c in range(1 << 16) if chr(c).isspace()]] = 0

    def codes(t: list[str]) -> np.ndarray:
        found = [np.zeros(0, np.int64)]
        for n in {len(g) for g in t}:  # all of one length side by side
            cps = np.frombuffer("".join(g for g in t if len(g) == n).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            s = np.where(cps < len(number), number[np.minimum(cps, len(number) - 1)], 1 + OWN + cps % SHARED).astype(np.int64)
            base = 0
            for order in range(1, n + 1):
                for at in range(n - order + 1):
                    code = np.zeros(len(s), np.int64)
                    for k in range(order):
                        code = code * SYMBOLS + s[:, at + k]
                    found.append(base + code)
                base += SYMBOLS**order
        return np.unique(np.concatenate(found))

    sets = [codes(t) for t in grams]
    marks = [i for k in labels for i in [j for j, v in enumerate(y) if v == k][:landmarks]]
    vocab = np.unique(np.concatenate([sets[i] for i in marks]))
    column[:] = len(vocab)
    column[vocab] = np.arange(len(vocab))
    x = np.zeros((len(sets), len(vocab) + 1), np.float32)
    for row, s in zip(x, sets, strict=True):
        row[column[s]] = 1
    x = x[:, :-1] / np.sqrt(np.maximum(x[:, :-1].sum(axis=1, keepdims=True), 1))
    z = np.ascontiguousarray(x[marks].T)
    k_mm = (z.T @ z).astype(np.float64)
    values, vectors = np.linalg.eigh(k_mm)
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = (x @ z).astype(np.float64) @ root
    target = np.array([[float(v == k) for k in labels] for v in y])
    w = np.linalg.solve(phi.T @ phi + RIDGE * len(phi) * np.eye(phi.shape[1]), phi.T @ target)
    return Model(labels, number, column, z, (root @ w).astype(np.float32))


def _map(rows: DataFrame, model: Model, text_at: int, schema, finish: Callable) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield finish(b, *sent.value.predict(b.column(text_at).to_pylist()))

    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return _map(rows, model, 1, schema, lambda b, y, s: pa.RecordBatch.from_arrays([b.column(0), pa.array(y, pa.string()), pa.array(s, pa.float64())], names=schema.names))


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", guesses: float = LEAST_GUESSES) -> DataFrame:
    """The documents, with every column, whose language is told with a score of so many even guesses or more.

    Where one label alone was learned every score is 1, and all texts with a letter stay.
    """
    least = min(1.0, guesses / max(1, len(model.labels)))
    return _map(docs, model, docs.columns.index(text_col), docs.schema, lambda b, y, s: b.filter(pa.array([k != UND and v >= least for k, v in zip(y, s, strict=True)], pa.bool_())))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return predict(docs, fit(known)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
