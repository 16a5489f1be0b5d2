"""Models in ONNX form: sentence encoders and cross-encoders from a folder with ``model.onnx`` and ``tokenizer.json``.

The folder may also hold the model as ``onnx/model.onnx``. Executors must see it under the same path. A model is loaded once a
worker, at its first batch; only its path and settings travel. The libraries are needed only where such a model is used.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np

from docsift.errors import ConfigError

#: Tokens of a text that a model reads, and texts in one run of it.
MAX_TOKENS, BATCH = 512, 32


class _Model:
    def __init__(self, folder: str, max_tokens: int = MAX_TOKENS, batch: int = BATCH):
        found = [p for p in (os.path.join(folder, "model.onnx"), os.path.join(folder, "onnx", "model.onnx")) if os.path.isfile(p)]
        if not found or not os.path.isfile(os.path.join(folder, "tokenizer.json")):
            raise ConfigError(f"no model.onnx with tokenizer.json in {folder}")
        self.folder, self.path, self.max_tokens, self.batch, self._loaded = folder, found[0], max_tokens, batch, None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_loaded": None}

    def _load(self):
        if self._loaded is None:
            from onnxruntime import InferenceSession, SessionOptions
            from tokenizers import Tokenizer

            options = SessionOptions()
            options.intra_op_num_threads = options.inter_op_num_threads = 1  # tasks run side by side
            tokenizer = Tokenizer.from_file(os.path.join(self.folder, "tokenizer.json"))
            tokenizer.enable_truncation(self.max_tokens)
            tokenizer.enable_padding()
            self._loaded = tokenizer, InferenceSession(self.path, options, providers=["CPUExecutionProvider"])
        return self._loaded

    def run(self, texts: Sequence) -> tuple[np.ndarray, np.ndarray]:
        """The first output for some texts, or pairs of texts, and the mask of their tokens."""
        tokenizer, session = self._load()
        encoded = tokenizer.encode_batch(list(texts))
        have = {
            "input_ids": np.array([e.ids for e in encoded], np.int64),
            "attention_mask": np.array([e.attention_mask for e in encoded], np.int64),
            "token_type_ids": np.array([e.type_ids for e in encoded], np.int64),
        }
        out = session.run(None, {i.name: have[i.name] for i in session.get_inputs()})[0]
        return np.asarray(out, np.float32), have["attention_mask"]

    def batches(self, texts: Sequence):
        for at in range(0, len(texts), self.batch):
            yield self.run(texts[at : at + self.batch])


class OnnxEmbedder(_Model):
    """Means of the token vectors that aren't padding, of length 1; an output of one vector a text is taken as it is."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for hidden, mask in self.batches([t or "" for t in texts]):
            if hidden.ndim == 3:
                weight = mask[..., None].astype(np.float32)
                hidden = (hidden * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
            norm = np.linalg.norm(hidden, axis=1, keepdims=True)
            out += (hidden / np.where(norm == 0, 1, norm)).tolist()
        return out


class OnnxReranker(_Model):
    """The logit of a query and passage read together; of two logits the second less the first."""

    def score(self, query: str, passages: list[str]) -> list[float]:
        out: list[float] = []
        for logits, _ in self.batches([(query, p or "") for p in passages]):
            logits = logits.reshape(len(logits), -1)
            out += (logits[:, 1] - logits[:, 0] if logits.shape[1] == 2 else logits[:, 0]).tolist()
        return out
