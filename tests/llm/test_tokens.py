import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docsift.llm import packing, token_files
from docsift.llm.encoding import Encoder, encoder

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
DATA = "/root/testdata/sf0.001"


def plain(path):
    t = Tokenizer.from_file(path)  # as it is: strings of special tokens give their ids
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_give_the_library_ids(path):
    rng, e, whole = random.Random(1), Encoder(path), plain(path)
    signs = " \n\t\r\x1c\u00a0 abcXYZéÉ\u0301,.'\"$1２½日<|>😀İſKßÿ"
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(e.encode(text), e.dtype).tolist() == whole(text).tolist(), repr(text)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_strings_of_special_tokens(path):
    e, whole = Encoder(path), plain(path)
    for text in ("a <|endoftext|> b", "<|ENDOFTEXT|>x", "a<|startoftext|>b\n<|endoftext|>", "<|end", "<|endoftext|>", "words before " * 50 + "<|endoftext|> it's"):
        assert np.frombuffer(e.encode(text), e.dtype).tolist() == whole(text).tolist(), text


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr("docsift.llm.encoding.KEPT", 10)
    e = Encoder(BYTE)
    text = " ".join(str(i) for i in range(500))
    assert np.frombuffer(e.encode(text), e.dtype).tolist() == plain(BYTE)(text).tolist() and len(e.after_space) <= 10


@given(st.integers(0, 100_000))
def test_lengths(n):
    out = packing.lengths(n)
    assert sum(out) == n and out == sorted(out, reverse=True) and all(x & (x - 1) == 0 and x <= 2048 for x in out) and all(v == 1 for k, v in Counter(out).items() if k < 2048)


def check_pieces(rows, texts):
    ids = plain(BYTE)
    left = Counter()
    for name, group in rows.items():
        left[name] = 0
        want = [np.append(ids(t), np.uint32(1)) for t in texts[name]]
        at = 0
        for r in group:
            at = 0 if r.start == 0 else at
            doc = next(w for w in want if len(w) == r.doc_tokens and r.ids_crc32 == zlib.crc32(w[r.start : r.start + r.length].tobytes()))
            assert r.start == at and r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
            at += r.length
            left[name] += r.length
            assert at <= len(doc)
        assert left[name] == sum(map(len, want))


def grouped(rows, key):
    out = {}
    for r in rows:
        out.setdefault(getattr(r, key), []).append(r)
    return out


def test_packing(odd, none):
    rows = packing.pieces(odd, BYTE).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and 1 << r.bucket == r.length for r in rows)
    texts = {k: [r.text for r in v] for k, v in grouped(odd.collect(), "doc_id").items()}
    check_pieces(grouped(rows, "doc_id"), texts)
    assert packing.pieces(none, BYTE).count() == 0


def test_buckets(spark, odd, tmp_path):
    packing.write_buckets(packing.pieces(odd, BYTE), f"file://{tmp_path}/b")
    back = spark.read.parquet(f"file://{tmp_path}/b")
    assert back.where("length <> shiftleft(1, bucket)").count() == 0 and back.count() == packing.pieces(odd, BYTE).count()
    assert {int(p.name.split("=")[1]) for p in (tmp_path / "b").glob("bucket=*")} == {r.bucket for r in back.select("bucket").distinct().collect()}


def test_query_7(spark):
    rows = packing.op7_packing(spark, DATA).collect()
    texts = {r.doc_id: [r.text] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    check_pieces(grouped(rows, "doc_id"), texts)


def read_back(spark, docs, path, **options):
    manifest = token_files.write(docs, WORD, path, **options)
    return manifest, token_files.read(spark, manifest)


@pytest.mark.parametrize("file_bytes", [1 << 30, 20_000])
def test_files_round_trip(spark, odd, none, tmp_path, file_bytes, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 4096)
    ids = plain(WORD)
    manifest, back = read_back(spark, odd, f"file://{tmp_path}/t", file_bytes=file_bytes)
    rows = sorted(back.collect(), key=lambda r: r.start)
    want = Counter((r.doc_id, np.append(ids(r.text), np.uint32(1)).tobytes()) for r in odd.collect())
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == want
    names = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert names == sorted(names)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert (len(manifest) == 1) == (file_bytes > 20_000)
    assert read_back(spark, none, f"file://{tmp_path}/e")[1].count() == 0


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    docs, sc, jobs = spark.range(4000).selectExpr("id AS doc_id", "concat('word ', id) AS text"), spark.sparkContext, []
    for file_bytes in (20_000, 1500):
        sc.setJobGroup(f"files-{file_bytes}", "")
        n = len(token_files.write(docs, WORD, f"file://{tmp_path}/{file_bytes}", file_bytes=file_bytes))
        jobs.append((n, len(sc.statusTracker().getJobIdsForGroup(f"files-{file_bytes}"))))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1][0] > 8 * jobs[0][0] and jobs[1][1] <= jobs[0][1] + 1


def test_one_id_for_all(spark, tmp_path):
    docs = spark.range(4000).selectExpr("5L AS doc_id", "concat('word ', id) AS text")
    manifest, back = read_back(spark, docs, f"file://{tmp_path}/t", file_bytes=8000)
    assert len(manifest) > 2 and back.count() == 4000 and max(m["docs"] for m in manifest) < 3000


def test_readers_open_few_frames(spark, tmp_path, monkeypatch):
    import zstandard

    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat(concat('number ', id, ' '), 20) AS text")
    manifest, _ = read_back(spark, docs, f"file://{tmp_path}/t")
    path = manifest[0]["path"]
    w = tmp_path / "few.tokens"
    with open(w, "wb") as f:  # small frames
        monkeypatch.setattr(token_files, "FRAME_BYTES", 2048)
        writer = token_files.Writer(f, 2)
        for name, _, ids in token_files.Reader(path).documents():
            writer.add(name, ids)
        writer.close()
    r = token_files.Reader(str(w))
    assert [x[0] for x in r.documents([7, 1500, 99999])] == [7, 1500] and r.decompressed == 2 < len(r.index)
    assert {x.doc_id for x in token_files.read(spark, manifest, [3, 4]).collect()} == {3, 4}
    whole = zstandard.ZstdDecompressor().stream_reader(open(w, "rb"), read_across_frames=True).read()  # any decoder reads it
    assert len(whole) == int(r.seek[:, 1].sum())
    raw = bytearray(w.read_bytes())
    at = int(r.offsets[5]) + 40
    raw[at] ^= 0xFF
    w.write_bytes(raw)
    with pytest.raises(Exception, match="checksum|rror"):
        list(token_files.Reader(str(w)).documents())


def test_query_5(spark):
    ids, at = plain(WORD), 0
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    for d, r in zip(docs, token_files.op5_token_files(spark, DATA).orderBy("doc_id").collect(), strict=True):
        want = np.append(ids(d.text), np.uint32(1))
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)


def test_one_encoder_a_path():
    assert encoder(WORD) is encoder(WORD)


settings.register_profile("quick", deadline=None)
settings.load_profile("quick")
