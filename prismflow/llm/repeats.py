"""Removal of long byte strings that occur more than once, by a depth-limited radix sort of suffixes.

Suffixes matter up to `depth` bytes only. They are dealt out digit by digit, and a group with one member ends at once, as its windows are unique:

1. The first digit of a window (the first `depth` bytes of a suffix) is its anchor: the gram of 32 bytes in it with the least hash.
   Equal windows have equal anchors at equal places, and neighbouring windows share theirs, so that
   one row stands for about 85 windows. Groups by anchor are counted with map-side aggregation; anchors that occur once end here.
2. The second digit is the extent: all bytes of the windows of one anchor, as a 128-bit BLAKE2b digest. If an extent occurs twice, all its windows do.
3. Extents that occur once, by an anchor that occurs elsewhere with other extents, come together by anchor, with one representative of each extent
   they meet. There the radix sort proper orders their suffixes by bytes, most significant first, eight bytes a pass, up to `depth`; after each pass, groups of one drop out.
   What is left at full depth are exactly the repeated windows. An anchor with very many different extents has its windows dealt out by
   their digests instead of one task's sort.

Hashes of grams only choose which windows meet: however many collide, bytes (or digests of 128 bits) decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismflow.llm import common

DEPTH, GRAM = 200, 32
#: Windows that are hashed at a time.
PIECE = 1 << 18
#: Different extents of one anchor that one task compares; windows of anchors with more are dealt out one by one.
BLOCK = 20_000
#: Extents that a task gathers, at least, before it compares them.
GATHER = 4_000
PLACE = np.uint64((1 << 20) - 1)
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= MIX[1]
    h ^= h >> np.uint64(29)
    return h


def hashes(data: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all substrings of the given sizes, which are powers of two, by doubling."""
    h, size, out = mixed((data.astype(np.uint64) + np.uint64(1)) * MIX[0]), 1, {}
    while True:
        if size in sizes:
            out[size] = h
        if size == max(sizes) or len(h) <= size:
            return out
        h = mixed(h[:-size] * MIX[2] + h[size:])
        size *= 2


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of the digest of each data[start:end]."""
    view = memoryview(data)
    return np.frombuffer(b"".join(blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64).reshape(-1, 2)


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Of the texts data[start:end], which have ``depth`` bytes or more: which text, anchor's place in the text, bytes from its first
    window's start to it, number of its windows less one, hash of the gram."""
    width = depth - GRAM + 1
    g = hashes(data, (GRAM,))[GRAM]
    packed = (g & ~PLACE) | np.arange(len(g), dtype=np.uint64)
    place = (sliding_least(packed, width) & PLACE).astype(np.int64)
    count = ends - starts - depth + 1
    text = np.repeat(np.arange(len(starts)), count)
    window = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
    own = place[window]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])])) if len(own) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [len(own)]])[: len(first)] - 1
    text, at, lo, hi = text[first], own[first], window[first], window[last]
    return text, at - starts[text], at - lo, hi - lo, g[at]


def text_anchors(raw: np.ndarray, offsets: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, ...]]:
    """anchors() of all texts, piece by piece. A text longer than a piece is cut into overlapping parts, whose
    shared anchors are put together again."""
    for a, b in common.pieces(offsets, PIECE):
        lo, hi = offsets[a], offsets[b]
        if hi - lo <= PIECE + depth:
            ok = np.flatnonzero(np.diff(offsets[a : b + 1]) >= depth)
            if len(ok):
                text, *more = anchors(raw[lo:hi], offsets[a:b][ok] - lo, offsets[a + 1 : b + 1][ok] - lo, depth)
                yield (ok[text] + a, *more)
            continue
        at, lo_, hi_, gram = [], [], [], []
        for k in range(lo, hi - depth + 1, PIECE):
            end = min(k + PIECE + depth - 1, hi)
            _, p, back, more, g = anchors(raw[k:end], np.array([0]), np.array([end - k]), depth)
            at.append(p + k - lo)
            lo_.append(p - back + k - lo)
            hi_.append(p - back + more + k - lo)
            gram.append(g)
        at, lo_, hi_, gram = map(np.concatenate, (at, lo_, hi_, gram))
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        at, lo_, hi_, gram = at[first], lo_[first], hi_[last], gram[first]
        yield np.full(len(at), a), at, at - lo_, hi_ - lo_, gram


def anchor_rows(rows: DataFrame, depth: int, extents: bool = True) -> DataFrame:
    """row_id, at (place << 16 | bytes before it << 8 | windows less one), anchor (hash) and, if asked for, the extent's digest (x, y) for each anchor of ``rows`` (row_id, text)."""
    names = ["row_id", "at", "anchor", "x", "y"] if extents else ["anchor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            raw, offsets = common.utf8(batch.column(1))
            for text, place, back, more, gram in text_anchors(raw, offsets, depth):
                if not extents:
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64))], names=names)
                    continue
                lo = offsets[text] + place - back
                digest = digests(raw, lo, lo + more + depth)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[text], place << 16 | back << 8 | more, gram.view(np.int64), digest[:, 0].copy(), digest[:, 1].copy())], names=names)

    return rows.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def packed_texts(rows: DataFrame) -> DataFrame:
    """``rows`` (row_id, other columns, text last) with each text compressed, as texts are most of what the joins move."""
    *kept, text = rows.columns
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for batch in batches:
            raw, offsets = common.utf8(batch.column(len(kept)))
            data, offs = memoryview(raw), offsets.tolist()
            packed = pa.array([squeeze(data[a:b]) for a, b in zip(offs, offs[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), packed], names=[*kept, "packed"])

    return rows.mapInArrow(run, schema)


def unpacked(column: pa.Array) -> list[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return [expand(x) for x in column.to_pylist()]


def cut_extents(rows: DataFrame, depth: int) -> DataFrame:
    """The bytes of extents: from ``rows`` (row_id, packed, wanted: at, anchor, single, hot after each other) to one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, data, wanted in zip(batch.column(0).to_pylist(), unpacked(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for at, anchor, single, hot in zip(wanted[::4], wanted[1::4], wanted[2::4], wanted[3::4], strict=True):
                    lo = (at >> 16) - (at >> 8 & 255)
                    out.append((anchor, row, lo, at >> 8 & 255, single, hot, data[lo : lo + (at & 255) + depth]))
                    if len(out) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)

    names = ["anchor", "row_id", "lo", "back", "single", "hot", "bytes"]
    return rows.mapInArrow(run, "anchor long, row_id long, lo long, back long, single long, hot long, bytes binary")


def extent_windows(batch: pa.RecordBatch, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of extents one after another, and of each window of theirs: which extent, its place in it, its start in the bytes."""
    raw, offsets = common.utf8(batch.column(batch.schema.names.index("bytes")))
    count = np.diff(offsets) - depth + 1
    which = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return raw, which, inside, offsets[:-1][which] + inside


def radix(data: np.ndarray, start: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the strings data[start : start + depth] that equal another one of their group.

    Passes over digits of eight bytes, most significant first, up to ``depth``: each sorts what is left within its groups and splits these; groups of one drop out.
    """
    view = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    live = np.arange(len(start))
    for k in (*range(0, depth - 8, 8), depth - 8):  # the last digit overlaps the one before it where 8 doesn't divide the depth
        digit = view[start[live] + k].astype(np.uint64)
        order = np.lexsort((digit, group))
        g, d = group[order], digit[order]
        begins = np.ones(len(g), bool)
        begins[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        number = np.cumsum(begins) - 1
        many = (np.bincount(number) > 1)[number] if len(number) else begins
        live, group = live[order[many]], number[many]
        if not len(live):
            break
    return live


def compare_extents(extents: DataFrame, depth: int) -> DataFrame:
    """row_id, a, b: ranges of bytes of single extents whose windows occur in another extent of the same anchor."""

    def spans(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        raw, which, inside, start = extent_windows(batch, depth)
        anchor = np.unique(batch.column("anchor").to_numpy(zero_copy_only=False), return_inverse=True)[1][which]
        back = batch.column("back").to_numpy(zero_copy_only=False)[which] - inside
        again = np.zeros(len(which), bool)
        again[radix(raw, start, anchor << 8 | back, depth)] = True
        again &= batch.column("single").to_numpy(zero_copy_only=False)[which] == 1
        at = np.flatnonzero(again)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(which[at]) != 0)])) if len(at) else at
        last = np.concatenate([first[1:], [len(at)]])[: len(first)] - 1
        x, y = at[first], at[last]
        lo = batch.column("lo").to_numpy(zero_copy_only=False)[which[x]]
        return pa.RecordBatch.from_arrays([pa.array(batch.column("row_id").to_numpy(zero_copy_only=False)[which[x]]), pa.array(lo + inside[x]), pa.array(lo + inside[y] + depth)], names=["row_id", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if n >= GATHER:  # up to the last change of anchor in what is new, if there is one
                anchor = np.concatenate([held[-1].column("anchor").to_numpy(zero_copy_only=False)[-1:], batch.column("anchor").to_numpy(zero_copy_only=False)])
                change = np.flatnonzero(anchor[1:] != anchor[:-1])
                if len(change):
                    yield spans([*held, batch.slice(0, int(change[0]))])
                    batch, held, n = batch.slice(int(change[0])), [], 0
            held.append(batch)
            n += len(batch)
        if n:
            yield spans(held)

    return extents.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "row_id long, a long, b long")


def deal_windows(extents: DataFrame, depth: int) -> DataFrame:
    """The same for anchors with very many extents, whose windows are dealt out by their own hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, which, inside, start = extent_windows(batch, depth)
            digest = digests(raw, start, start + depth)
            take = lambda c: batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False)[which]  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (digest[:, 0].copy(), digest[:, 1].copy(), take("row_id"), take("lo") + inside, take("single"))], names=["x", "y", "row_id", "a", "single"])

    dealt = extents.mapInArrow(run, "x long, y long, row_id long, a long, single long")
    again = dealt.groupBy("x", "y").count().where("count > 1")
    return dealt.where("single = 1").join(again, ["x", "y"], "left_semi").select("row_id", "a", (F.col("a") + depth).alias("b"))


def repeated_spans(rows: DataFrame, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """row_id, a, b: byte ranges of ``rows`` (row_id, text) that together cover the repeated strings of ``depth`` bytes. Ranges may overlap."""
    if not GRAM <= depth <= GRAM + 255:
        raise ValueError(f"depth is {GRAM} to {GRAM + 255}")
    common.arrow_rows(rows.sparkSession)
    # Tables of their own, so that joins with them can split the rows of an anchor that very many texts have.
    shared = common.checkpoint(anchor_rows(rows, depth, extents=False).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    found = common.checkpoint(anchor_rows(rows, depth).join(shared, "anchor"))
    extents = common.checkpoint(found.groupBy("anchor", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_id", "at")).alias("one")))
    whole = found.join(extents.where("n = 1").select("anchor", "x", "y"), ["anchor", "x", "y"], "left_anti")
    lo = F.shiftright("at", 16) - F.shiftright("at", 8).bitwiseAND(F.lit(255))
    whole = whole.select("row_id", lo.alias("a"), (lo + F.col("at").bitwiseAND(F.lit(255)) + depth).alias("b"))
    mixed_keys = common.checkpoint(extents.groupBy("anchor").agg(F.count(F.lit(1)).alias("extents"), F.min("n").alias("least")).where("extents > 1 AND least = 1"))
    wanted = extents.join(mixed_keys, "anchor").select("one.row_id", F.array("one.at", "anchor", (F.col("n") == 1).cast("long"), (F.col("extents") > block).cast("long")).alias("one"))
    wanted = wanted.groupBy("row_id").agg(F.flatten(F.collect_list("one")).alias("wanted"))
    cut = common.checkpoint(cut_extents(packed_texts(rows).join(wanted, "row_id").select("row_id", "packed", "wanted"), depth))
    return whole.unionByName(compare_extents(cut.where("hot = 0"), depth)).unionByName(deal_windows(cut.where("hot = 1"), depth))


NEW = (
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()),
    T.StructField("kept", T.BinaryType()),
)


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that overlap or touch as one."""
    order = np.argsort(a, kind="stable")
    a, top = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.concatenate([[True], a[1:] > top[:-1]]))
    return a[first], top[np.concatenate([first[1:], [len(a)]]) - 1]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """row_id, doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes that are left) for each row of ``docs``.

    A byte goes if a string of ``depth`` bytes over it starts anywhere else too, in this text or another; copies of
    whole texts are no exception, so that all of them go if they are that long. Null is empty; texts shorter than ``depth`` stay
    whole. Rows that repeat, and null ids, are texts of their own.
    """
    rows = common.numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "row_id").select("row_id", "doc_id", "text")
    spans = repeated_spans(rows.select("row_id", "text"), depth, block)
    spans = spans.groupBy("row_id").agg(F.flatten(F.collect_list(F.array("a", "b"))).alias("spans"))
    joined = packed_texts(rows).join(spans, "row_id", "left").select("row_id", "doc_id", "packed", "spans")
    schema = T.StructType([joined.schema["row_id"], joined.schema["doc_id"], *NEW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, data in enumerate(unpacked(batch.column(2))):
                own = batch.column(3)[k].values
                if own is None or not len(own):
                    out.append((len(data), 0, 0, data))
                    continue
                own = own.to_numpy(zero_copy_only=False)
                a, b = merged(own[::2], own[1::2])
                edge = [0, *np.column_stack([a, b]).ravel().tolist(), len(data)]
                out.append((len(data), int((b - a).sum()), len(a), b"".join(data[x:y] for x, y in zip(edge[::2], edge[1::2], strict=True))))
            new = [pa.array(x, f) for x, f in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=["row_id", "doc_id", *(f.name for f in NEW)])

    return joined.mapInArrow(run, schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
