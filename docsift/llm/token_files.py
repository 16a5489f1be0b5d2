"""Token files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A folder holds ``part-NNNNNN.tokens`` files in ascending order of document id. A file is a sequence of zstandard frames:

* a skippable frame with JSON about the file (width of an id in bytes, version);
* data frames of about FRAME_BYTES each, which hold whole documents: the count n, then n ids (int64), n null flags (uint8),
  n token counts (uint32), then the token ids themselves;
* a skippable frame with the index: for each data frame its documents, tokens, and first and last document id;
* the seek table of the public seekable format, a skippable frame with compressed size, size and the low 32 bits of XXH64 for
  each frame before it.

So any zstandard decoder reads a file from the front, and a reader that wants some documents reads the end of a file and
decompresses only the frames that can hold them.

Tokens are made once, in the scan's stage; only ids are shuffled, to ranges of the document id found beforehand from a random
sample of that column alone (ranges decide which file a document is in, never what is written). A document id that fills several
ranges is spread over all of them. All files are written by one job, a task a file, under a name of its own that is changed at the
end, so a lost or repeated task leaves the same file. The driver gets four numbers a file.

Defined results: null text is an empty document of the end id alone; null document ids come first; repeated ids stand in the
order of their ids' bytes within a range; an empty table writes no file; columns other than id and text are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.encoding import encoder
from docsift.llm.shared import fresh_path, slices, table, until_the_end

END_ID = 1
FRAME_BYTES = 1 << 20
#: Bytes of text for each file, and the number of files beyond which files grow instead.
FILE_BYTES, MAX_FILES = 64 << 20, 100_000
#: Ids sampled for each file's range, and in all at least.
IDS_A_FILE, LEAST_IDS = 20, 20_000
LEVEL = 3
# Fixed values of the seekable zstandard format.
SKIPPABLE, SEEK_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80


def _at(uri: str):
    """File system and path of a URI; Python's own file functions reach local paths only."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else "file://" + uri)


class Writer:
    """Documents in, one file out."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.packer = out, width, zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=True)
        self.seek: list[tuple[int, int, int]] = []
        self.index: list[list] = []
        self.held: list[tuple] = []
        self.size = self.docs = self.tokens = 0
        self._skippable(SKIPPABLE, json.dumps({"format": "token frames", "version": 1, "width": width}).encode())

    def _skippable(self, magic: int, body: bytes, listed: bool = True) -> None:
        self.out.write(struct.pack("<II", magic, len(body)) + body)
        if listed:
            self.seek.append((8 + len(body), 0, 0))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.held.append((doc_id, ids))
        self.size += len(ids)
        self.docs += 1
        self.tokens += len(ids) // self.width
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if not self.held:
            return
        names = [d for d, _ in self.held]
        counts = np.array([len(i) // self.width for _, i in self.held], "<u4")
        body = b"".join([struct.pack("<I", len(names)), np.array([d or 0 for d in names], "<i8").tobytes(), np.array([d is None for d in names], "u1").tobytes(), counts.tobytes(), *(i for _, i in self.held)])
        packed = self.packer.compress(body)
        self.out.write(packed)
        self.seek.append((len(packed), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        self.index.append([len(names), int(counts.sum(dtype=np.int64)), names[0], names[-1]])
        self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self._skippable(SKIPPABLE + 1, json.dumps(self.index).encode())
        table_ = b"".join(struct.pack("<III", *x) for x in self.seek)
        self._skippable(SEEK_TABLE, table_ + struct.pack("<IBI", len(self.seek), CHECKSUMS, SEEKABLE), listed=False)


class Reader:
    """Reads one file; ``documents`` decompresses only the frames that can hold what is asked for."""

    def __init__(self, uri: str):
        system, path = _at(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError(f"{uri}: no seek table with checksums at the end")
        start = size - 9 - 12 * n
        self.seek = np.frombuffer(self.file.read_at(12 * n, start), "<u4").reshape(n, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.seek[:, 0])])
        self.width = json.loads(self._raw(0)[8:])["width"]
        self.index = json.loads(self._raw(n - 1)[8:])
        self.decompressed = 0

    def _raw(self, k: int) -> bytes:
        return self.file.read_at(int(self.seek[k, 0]), int(self.offsets[k]))

    def _frame(self, k: int) -> tuple[list, np.ndarray, bytes]:
        import xxhash
        import zstandard

        body = zstandard.ZstdDecompressor().decompress(self._raw(k + 1), max_output_size=int(self.seek[k + 1, 1]))
        if xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != self.seek[k + 1, 2]:
            raise ValueError(f"frame {k}: checksum differs")
        self.decompressed += 1
        n = struct.unpack_from("<I", body)[0]
        ids, null = np.frombuffer(body, "<i8", n, 4), np.frombuffer(body, "u1", n, 4 + 8 * n)
        return [None if z else d for d, z in zip(ids.tolist(), null.tolist(), strict=True)], np.frombuffer(body, "<u4", n, 4 + 9 * n), body[4 + 13 * n :]

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """``(doc_id, tokens before it in this file, ids)``."""
        some = None if wanted is None else np.unique(np.fromiter(wanted, np.int64))
        before = 0
        for k, (_, tokens, first, last) in enumerate(self.index):
            if some is None or last is not None and np.searchsorted(some, -(1 << 63) if first is None else first, "left") < np.searchsorted(some, last, "right"):
                at = 0
                names, counts, ids = self._frame(k)
                for name, n in zip(names, counts.tolist(), strict=True):
                    if some is None or name is not None and (j := np.searchsorted(some, name)) < len(some) and some[j] == name:
                        yield name, before + at, ids[at * self.width : (at + n) * self.width]
                    at += n
            before += tokens


def _bounds(rows: DataFrame, n: int, count: int) -> np.ndarray:
    """Ids that part the rows into n ranges of about one size."""
    if n == 1 or not count:
        return np.zeros(0, np.int64)
    ids = rows.where("doc_id is not null").select("doc_id")
    share = max(IDS_A_FILE * n, LEAST_IDS) / count
    ids = np.sort((ids.sample(share, 1) if share < 1 else ids).toPandas()["doc_id"].to_numpy(np.int64))
    return ids[np.arange(1, n) * len(ids) // n] if len(ids) else ids


def write(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> list[dict]:
    """Writes the folder and returns its manifest, one entry a file: ``part, docs, tokens, path``."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    size, count = rows.agg(F.sum(F.octet_length("text")), F.count("doc_id")).first()
    n = max(1, min(MAX_FILES, -(-(size or 0) // file_bytes)))
    bounds = _bounds(rows, n, count)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in slices(batches):
            ids = [enc.encode(t or "") + end for t in b.column(1).to_pylist()]
            names = b.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(bounds, names, "left"), np.searchsorted(bounds, names, "right")
            spread = np.fromiter((zlib.crc32(i) for i in ids), np.int64, len(ids))
            part = low + np.where(high > low, spread % (high - low + 1), 0)
            part[np.asarray(b.column(0).is_null())] = 0
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column(0), pa.array(ids, pa.binary())], names=["part", "doc_id", "ids"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(tokenizer).width
        system, folder = _at(path)
        part = writer = out = None
        done: list[dict] = []

        def end() -> None:
            writer.close()
            out.close()
            system.move(own, final)
            done.append({"part": part, "docs": writer.docs, "tokens": writer.tokens, "path": f"{path}/part-{part:06d}.tokens"})

        for b in batches:
            for p, name, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    if writer:
                        end()
                    part, final = p, f"{folder}/part-{p:06d}.tokens"
                    own = f"{folder}/.{p}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(own)
                    writer = Writer(out, width)
                writer.add(name, ids)
        if writer:
            end()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema({"part": pa.int32(), "docs": pa.int64(), "tokens": pa.int64(), "path": pa.string()}))

    system, folder = _at(path)
    system.create_dir(folder, recursive=True)
    sent = rows.mapInArrow(encode, "part int, doc_id bigint, ids binary").repartitionById(n, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
    manifest = sorted((r.asDict() for r in sent.mapInArrow(save, "part int, docs bigint, tokens bigint, path string").collect()), key=lambda x: x["part"])
    with system.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read(spark: SparkSession, manifest: list[dict], wanted: Iterable[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) of all documents or those wanted, a task a file."""
    starts = np.concatenate([[0], np.cumsum([m["tokens"] for m in manifest], dtype=np.int64)]).tolist()
    files = spark.sparkContext.broadcast([(m["path"], s) for m, s in zip(manifest, starts, strict=False)])
    some = None if wanted is None else spark.sparkContext.broadcast(sorted({*wanted}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                path, base = files.value[k]
                r = Reader(path)
                held: list[tuple] = []
                size = 0
                for name, at, ids in r.documents(some and some.value):
                    held.append((name, base + at, len(ids) // r.width, ids if r.width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()))
                    size += len(ids)
                    if size >= 4 * FRAME_BYTES:
                        yield _rows(held)
                        held, size = [], 0
                yield _rows(held)

    return spark.range(0, len(manifest), 1, max(1, len(manifest))).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*held, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def op5_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "tokens")
    manifest = write(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), folder)
    until_the_end(spark, folder)
    return read(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
