"""Tiny ONNX models, written byte by byte: their results can be worked out by hand."""

import pickle
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from docsift.errors import ConfigError
from docsift.operators import fuse, vector
from docsift.operators.models import OnnxEmbedder, OnnxReranker

VOCAB = {"[PAD]": 0, "[UNK]": 1, "apple": 2, "banana": 3, "cherry": 4}
TABLE = np.array([[9, 9], [0, 0], [1, 0], [0, 1], [3, 4]], np.float32)


def number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(k, value):
    if isinstance(value, int):
        return number(k << 3) + number(value)
    value = value.encode() if isinstance(value, str) else value
    return number(k << 3 | 2) + number(len(value)) + value


def tensor(name, a):
    return b"".join(field(1, d) for d in a.shape) + field(2, 1) + field(8, name) + field(9, struct.pack(f"<{a.size}f", *a.ravel()))


def info(name, kind, *dims):
    shape = b"".join(field(1, field(2, d)) for d in dims)
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))


def save(folder, table, mean):
    """Vectors of the tokens, or their mean over the text."""
    folder.mkdir(exist_ok=True)
    nodes = [field(1, "table") + field(1, "input_ids") + field(2, "hidden") + field(4, "Gather")]
    if mean:
        axes = field(1, "axes") + field(8, 1) + field(20, 7)
        keep = field(1, "keepdims") + field(3, 0) + field(20, 2)
        nodes.append(field(1, "hidden") + field(2, "out") + field(4, "ReduceMean") + field(5, axes) + field(5, keep))
    inputs = [info("input_ids", 7, "b", "s"), info("attention_mask", 7, "b", "s")]
    output = info("out", 1, "b", "d") if mean else info("hidden", 1, "b", "s", "d")
    graph = b"".join(field(1, n) for n in nodes) + field(2, "g") + field(5, tensor("table", table)) + b"".join(field(11, i) for i in inputs) + field(12, output)
    (folder / "model.onnx").write_bytes(field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13)))
    t = Tokenizer(models.WordLevel(VOCAB, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    t.save(str(folder / "tokenizer.json"))
    return str(folder)


def test_embeddings_are_means_of_length_one(spark, tmp_path):
    model = pickle.loads(pickle.dumps(OnnxEmbedder(save(tmp_path / "e", TABLE, False), batch=2)))
    texts = ["apple", "apple banana", "cherry what", "banana banana apple cherry", "what"]
    means = np.array([[1, 0], [0.5, 0.5], [1.5, 2], [1, 1.5], [0, 0]])
    norm = np.linalg.norm(means, axis=1, keepdims=True)
    want = means / np.where(norm == 0, 1, norm)
    assert np.allclose(model.embed(texts), want, atol=1e-6)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3).select("i", vector.embed_column(F.col("t"), model).alias("v"))
    assert np.allclose([r.v for r in rows.orderBy("i").collect()], want, atol=1e-6)


def test_cross_encoder_scores(spark, tmp_path):
    model = OnnxReranker(save(tmp_path / "r", TABLE[:, :1], True))
    want = [(1 + 0) / 2, (1 + 3) / 2, (1 + 0) / 2]  # the query is "apple"
    assert np.allclose(model.score("apple", ["banana", "cherry", "what"]), want)
    rows = spark.createDataFrame([(0, "banana"), (1, "cherry"), (2, None)], "i int, p string").select("i", fuse.rerank_scores("p", "apple", model).alias("s"))
    assert np.allclose([r.s for r in rows.orderBy("i").collect()][:2], want[:2])
    two = OnnxReranker(save(tmp_path / "two", TABLE, True))
    assert np.allclose(two.score("apple", ["cherry"]), [(0 + 4) / 2 - (1 + 3) / 2])
    assert model.score("apple", []) == []


def test_folders_without_a_model(tmp_path):
    with pytest.raises(ConfigError):
        OnnxEmbedder(str(tmp_path))
