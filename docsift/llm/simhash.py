"""SimHash near duplicates by bit-sliced comparison.

Fingerprints are made in one pass over the texts. Rows with one fingerprint are folded before anything is compared, so a
group of a billion copies is one row. Candidates are exact: two fingerprints within ``radius`` bits agree on one of the bit
masks at least (pigeonhole), and each mask's value is a bucket. Masks get wider as the table grows; a bucket beyond ``LIMIT``
is dealt again by wider masks, and what is still larger is compared block against block in separate tasks. Nothing is capped.

Within a task the bits stand vertically: plane ``b`` holds bit ``b`` of 64 rows a word. One pass at lag ``d`` compares every
row with the row ``d`` places on: the planes are XORed with themselves shifted, three words of carry-save counters add the 64
differences, and a word is abandoned as soon as all its pairs have gone past the radius.

Defined results: null or blank text has fingerprint 0 and is linked like any other; a null id gets a row, and is never the
smallest id of a group (null if the group has no id); repeated rows each get a row; an empty table gives no rows; columns
other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.llm.components import BROADCAST_KEYS, by_key, stars
from docsift.llm.shared import discard, free_name, save, slices, table

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Rows of a bucket that one task compares at once, and the mean bucket size that the masks aim at.
LIMIT, MEAN = 2048, 64
#: Times that an oversized bucket is dealt again by wider masks before it is compared block against block.
LEVELS = 3
FULL = (1 << 64) - 1


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits of one UTF-8 text, as a signed number."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return np.uint64(xxh64_intdigest(b" ".join(words), SEED)).astype(np.int64).item()
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        h = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0].item()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = [fingerprint(t.as_py(), shingle) if t.is_valid else 0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of which two fingerprints within the radius share one at least; the fewest whose mean bucket is small."""
    for blocks in range(radius + 1, radius + 4):
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
        out = [sum(c) for c in combinations(parts, blocks - radius)]
        if n <= MEAN << min(m.bit_count() for m in out):
            break
    return out


def wider(mask: int, radius: int = RADIUS) -> list[int]:
    """The mask with each of radius + 1 parts of the bits that it leaves out."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(len(free) * i / (radius + 1)) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(rows: DataFrame, by_mask: dict[int, list[int]] | None, first: list[int]) -> DataFrame:
    """``fp, mask, key`` for each mask; by_mask: the wider ones of a row's present mask."""
    if by_mask is None:
        new = F.array(*[F.lit(_signed(m)) for m in first])
    else:
        new = F.element_at(F.create_map(*[x for m, ws in by_mask.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(w)) for w in ws]))]), F.col("mask"))
    return rows.select("fp", F.explode(new).alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def _planes(fps: np.ndarray) -> np.ndarray:
    """64 planes of len / 64 words, the first row in the lowest bit."""
    n = -(-len(fps) // 64) * 64
    bits = np.zeros((64, n), np.uint8)
    bits[:, : len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _shifted(planes: np.ndarray, d: int) -> np.ndarray:
    """Bit i of the result is bit i + d of the planes."""
    q, r = divmod(d, 64)
    out = np.zeros_like(planes)
    if q < planes.shape[-1]:
        out[..., : planes.shape[-1] - q] = planes[..., q:] >> np.uint64(r)
        if r and q + 1 < planes.shape[-1]:
            out[..., : planes.shape[-1] - q - 1] |= planes[..., q + 1 :] << np.uint64(64 - r)
    return out


def near_at_lag(planes: np.ndarray, live: np.ndarray, d: int, radius: int = RADIUS) -> np.ndarray:
    """Words whose bit i says that rows i and i + d are within the radius; only pairs with a bit in ``live`` count."""
    width = (radius + 1).bit_length()
    words = np.flatnonzero(live)
    near = np.zeros_like(live)
    diff = planes[:, words] ^ _shifted(planes, d)[:, words]
    count = [np.zeros(len(words), np.uint64) for _ in range(width)]
    far = ~live[words]
    for b in range(64):
        carry = diff[b]
        for k in range(width):  # carry-save: each counter word takes the carry of the one below
            count[k], carry = count[k] ^ carry, count[k] & carry
        over = carry
        reached = ~np.zeros(len(words), np.uint64)
        for k in range(width):
            reached &= count[k] if (radius + 1) >> k & 1 else ~count[k]
        far = far | over | reached
        if b % 8 == 7 and b < 63:
            stay = far != np.uint64(FULL)
            if not stay.all():
                words, far, diff = words[stay], far[stay], diff[:, stay]
                count = [c[stay] for c in count]
                if not len(words):
                    return near
    near[words] = ~far
    return near


def linked(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row the first row of its group that it reaches by links inside the group. Rows of a group stand together."""
    n = len(fps)
    label = np.arange(n)
    rows = np.arange(n)
    sizes = np.bincount(group, minlength=1)[group] if n else np.zeros(0, int)
    planes, kept, d = None, 0, 0
    while True:
        d += 1
        more = sizes[rows] > d
        if not more.any():
            return label
        if planes is None or 2 * more.sum() < kept:  # only groups longer than the lag are still of interest
            rows = rows[more]
            planes, kept = _planes(fps[rows]), len(rows)
        same = np.zeros(planes.shape[1] * 64, bool)
        same[: len(rows) - d] = group[rows[:-d]] == group[rows[d:]]
        near = near_at_lag(planes, np.packbits(same, bitorder="little").view(np.uint64), d, radius)
        if near.any():
            i = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
            a, b = label[rows[i]], label[rows[i + d]]
            new = a != b
            for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True):
                while label[x] != x:
                    x = int(label[x])
                while label[y] != y:
                    y = int(label[y])
                label[max(x, y)] = min(x, y)
            if new.any():
                while (label[label] != label).any():
                    label = label[label]


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows ``mask, key, pair, fp`` to edges; a group may run over batches, and is held until it ends."""
    held: list[np.ndarray] = []

    def edges(cols: np.ndarray) -> pa.RecordBatch:
        ids = cols[:3]
        group = np.concatenate([[0], np.cumsum((ids[:, 1:] != ids[:, :-1]).any(axis=0))]) if cols.shape[1] else np.zeros(0, int)
        fps = np.ascontiguousarray(cols[3])
        first = linked(fps.view(np.uint64), group, radius)
        out = first != np.arange(len(first))
        return pa.RecordBatch.from_arrays([pa.array(fps[out]), pa.array(fps[first[out]])], names=["u", "v"])

    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
            rows += b.num_rows
        if rows < 1 << 15:
            continue
        cols = np.concatenate(held, axis=1)
        ends = np.flatnonzero((cols[:3, 1:] != cols[:3, :-1]).any(axis=0))
        if len(ends):
            cut = ends[-1] + 1
            yield edges(cols[:, :cut])
            cols = cols[:, cut:]
        held, rows = [cols], cols.shape[1]
    if held:
        yield edges(np.concatenate(held, axis=1))


def links(nodes: DataFrame, radius: int = RADIUS, limit: int = LIMIT, scratch: list | None = None) -> DataFrame:
    """Edges ``u, v`` that join all fingerprints within the radius: in each bucket every member to the first it reaches.

    Tables that are of no use once the edges have been read are added to ``scratch``.
    """
    scratch = [] if scratch is None else scratch
    first = masks(nodes.count(), radius)
    dealt, tree = _deal(nodes, None, first), first
    parts = []
    for level in range(LEVELS + 1):
        sizes = dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > limit)
        hot = save(sizes, "hot-buckets")
        scratch.append(hot)
        n_hot = hot.count()
        if not n_hot:
            parts.append(dealt.withColumn("pair", F.lit(0).cast("long")))
            break
        named = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
        parts.append(dealt.join(named, ["mask", "key"], "left_anti").select("fp", "mask", "key", F.lit(0).cast("long").alias("pair")))
        over = dealt.join(named, ["mask", "key"])
        if level < LEVELS:
            by_mask = {m: wider(m, radius) for m in tree}
            dealt = save(_deal(over.select("fp", "mask"), by_mask, []), "wider")
            scratch.append(dealt)
            tree = [w for ws in by_mask.values() for w in ws]
            continue
        blocks = F.ceil(F.col("n") / F.lit(limit // 2)).cast("long")
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks"))
        with_each = over.withColumn("blocks", blocks).withColumn("own", own).select("fp", "mask", "key", "blocks", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        parts.append(with_each.select("fp", "mask", "key", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other") + 1).alias("pair")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.select("mask", "key", "pair", "fp").repartition("mask", "key", "pair").sortWithinPartitions("mask", "key", "pair")
    return rows.mapInArrow(lambda it: _compare(it, radius), "u bigint, v bigint")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` for every row."""
    fps = save(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = save(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "nodes")
    n_nodes, n_rows = nodes.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    scratch: list[DataFrame] = []
    found = stars(links(nodes.select("fp"), radius, scratch=scratch)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    for t in scratch:
        discard(docs.sparkSession, t)
    rooted = save(nodes.join(found, "fp", "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")), "rooted")
    discard(docs.sparkSession, nodes)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    by_fp = by_key(rooted, ids, "root", n_nodes, []).select("fp", "component_id", F.col("rows").alias("n"))
    return by_key(fps, by_fp, "fp", n_rows, []).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The documents, with every column: of each group the one with the smallest id, once. Rows without an id stay.

    Only ids that go travel: they are broadcast while few, else joined by shuffle. Ids that occur more than once and would
    stay are settled apart.
    """
    name, place = free_name(docs, "_id"), free_name(docs, "_k")
    found = save(components(docs, id_col, text_col, radius, shingle).where("doc_id is not null"), "groups")
    gone = save(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    twice = save(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(name)).agg(F.count("*").alias("n")).where("n > 1").select(name), "twice")
    discard(docs.sparkSession, found)
    few = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids
    same = F.col(id_col) == F.col(name)
    kept = docs.join(few(gone), same, "left_anti")
    if twice.isEmpty():
        return kept
    named = few(twice)
    again = kept.join(named, same, "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col)))).where(f"{place} = 1").drop(place)
    return kept.join(named, same, "left_anti").unionByName(again)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return components(table(spark, sf_dir, "documents")).select("doc_id", hexed.alias("fingerprint"), "component_id")
