"""Packing by power-of-two decomposition.

A document of n tokens (its end id included) is cut into n // 2048 pieces of 2048 tokens and one piece for each bit set in
the rest, longest first. Every piece is a sequence of its own: its length is a power of two, so it needs no padding, and no
sequence crosses documents. Sequences of one length form a bucket, from which a trainer draws batches of one shape.

It is one pass in the scan's own stage, without a shuffle; each task numbers its sequences in a range of its own.

Defined results: null text is an empty document of the end id alone; a null id stays null; repeated rows are packed each; an
empty table gives no pieces; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.encoding import encoder
from docsift.llm.shared import slices, table

MAX_LEN = 2048
END_ID = 1
#: Rows of output in one Arrow batch.
ROWS = 8192


def lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Powers of two that sum to n, none above max_len (itself a power of two), longest first."""
    full, rest = divmod(n, max_len)
    return [max_len] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, bucket, ids`` (with_ids), ``sequence_id, offset``.

    ``ids`` holds little-endian unsigned 32-bit numbers; ``bucket`` is the base-2 logarithm of the length.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", *["ids"] * with_ids]
        for b in slices(batches):
            owner: list[int] = []
            rows: list[tuple] = []

            def batch(b=b):
                cols = [b.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, pa.int64()) for c in zip(*[r[:4] for r in rows], strict=True)), pa.array([r[1].bit_length() - 1 for r in rows], pa.int32())]
                return pa.RecordBatch.from_arrays([*cols, *[pa.array([r[4] for r in rows], pa.binary())] * with_ids], names=names)

            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(np.frombuffer(enc.encode(text or ""), enc.dtype).astype("<u4"), np.uint32(end_id)).tobytes()
                n, at = len(ids) // 4, 0
                for length in lengths(n, max_len):
                    part = ids[4 * at : 4 * (at + length)]
                    owner.append(i)
                    rows.append((at, length, zlib.crc32(part), n, part if with_ids else None))
                    at += length
                    if len(rows) >= ROWS:
                        yield batch()
                        owner, rows = [], []
            if rows:
                yield batch()

    cut = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, bucket int" + ", ids binary" * with_ids)
    return cut.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet, a folder for each length."""
    packed.write.partitionBy("bucket").parquet(path)


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    packed = pieces(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")
