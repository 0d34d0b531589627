"""N-gram Jaccard join by a grouped prefix join.

Two sets with a Jaccard similarity of 0.8 share a shingle among the rarest fifth of each: their prefixes. Texts with the same set of shingles are one class, and
classes with the same prefix and size are one group. Only groups are listed under the shingles of their prefixes, and a pair of groups
goes on if its sizes and the places of the shared shingle leave room for enough others. Then groups are expanded, pairs of classes whose outlines (counts of shingles by bin) can't share enough
or prefixes can't share enough are left out, and the others verified on their whole sets.

What is asked for are components, so pairs that are connected already need no verification. Each list's groups are first verified against one of them,
its hub, which connects most near copies with as many pairs as the list has groups; after that, only pairs of groups in different components are left, and all of these are verified.

Rarity comes from counts of all shingles of all documents in a table of a fixed size, by hash: an order that all documents share is enough for right results, and rare before common for short lists. A task sends on
only counters that stand out from its own mean, so that what moves isn't the table once for each task.

Shingles are hashed for a batch of texts at once. Prefixes are dealt to buckets of shingles as packed arrays, and a list goes on from its bucket only with the groups that have room for another of the list.
Sets are compared by 64-bit hashes of their shingles. A collision matters only between the two documents that are compared (one in 10^13 pairs of a thousand shingles), not among all.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismflow.llm import common, graph
from prismflow.llm.simhash import FORM

WORDS, PERCENT = 5, 80
#: Counters of shingles (32 MB in all, whatever the input), and the parts they are added up in.
COUNTERS, PARTS = 1 << 23, 64
#: Bins of a set's outline, one byte each.
BINS = 128
#: Bits of the table that says which documents a round needs: 8 MB, whatever the input.
BITS = 1 << 26
#: Shares of a common shingle's list, each with a hub of its own.
SHARES = 64
#: Rounds of hubs before what is left is verified pair by pair. A near copy is in dozens of lists, most with hubs of their own, so that one round connects nearly all.
HUBS = 1
#: Hubs of each list in a round: what one of them isn't like, another may be.
DRAWS = 4
#: Prefixes that a task remembers, so as to list each once.
SEEN = 1 << 18
#: Bytes of one batch between Spark and Python.
BATCH_BYTES = 32 << 20
#: Bytes of text that are hashed at a time, and of those between two starts of the powers that bytes are weighed by.
PIECE, SPAN = 1 << 20, 1 << 18
#: Entries of prefixes that a task holds before it deals them out, and those of one part of the buckets.
DEALT, PART = 1 << 20, 1 << 19
#: Groups after one in its list, by size, that it is held against before the list goes on. In longer lists, only bounds of all others are looked at.
WINDOW = 16
#: Lists of a group, of those it is still in, that take it to hubs: the first ones in the order of shingles, so that near copies have mostly the same.
FIRST = 8
#: Bytes of a token, share, place, group, size and number of tokens between tasks.
WIDTHS = (5, 1, 4, 8, 4, 4)

DRAWN = np.random.default_rng(13)
#: Weights of a shingle's words by place, and of a word's length; numbers of bytes; what a byte's weight grows by.
ODD = DRAWN.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE = DRAWN.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = int(DRAWN.integers(0, 1 << 60)) * 8 + 5


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


POWERS, INVERSE = powers(BASE, SPAN + 1), powers(pow(BASE, -1, 1 << 64), SPAN + 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts between ``offs``, which begin at 0, and for each offset the number of words before it."""
    data = FORM[raw]
    ink = data != 32
    # A word begins at a byte of its own after a space or at a text's first byte, and ends likewise.
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    inner = offs[(offs > 0) & (offs < len(data))]
    first[inner] = ink[inner]
    last[inner - 1] = ink[inner - 1]
    first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(first), np.uint64)
    k = 0
    while k < len(first):
        a = first[k]
        to = max(k + 1, int(np.searchsorted(last, a + SPAN, side="right")))
        own = data[a : last[to - 1]]
        # One word that is longer than a span begins at 0, so that it needs no inverse.
        weight = POWERS if len(own) <= SPAN else powers(BASE, len(own))
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(BYTE[own] * weight[: len(own)], out=total[1:])
        out[k:to] = (total[last[k:to] - a] - total[first[k:to] - a]) * INVERSE[first[k:to] - a]
        k = to
    return mix(out + (last - first).astype(np.uint64) * ODD[-1]), np.searchsorted(first, offs)


def sets_in(column: pa.Array, size: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; fewer words than ``size`` are one shingle, no words none."""
    raw, offs = common.utf8(column)
    for i, j in common.pieces(offs, PIECE):
        words, at = words_of(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        many = np.diff(at)
        runs = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            runs += words[k : k + len(runs)] * ODD[k]
        runs = mix(runs)
        for a, n in zip(at.tolist(), many.tolist(), strict=False):
            if n < size:
                yield mix((words[a : a + n] * ODD[:n]).sum(keepdims=True)) if n else runs[:0]
                continue
            h = np.sort(runs[a : a + n - size + 1])
            new = np.ones(len(h), bool)
            np.not_equal(h[1:], h[:-1], out=new[1:])
            yield h[new]


def batches_of(spark: SparkSession) -> None:
    """Lower the session's batches to ``BATCH_BYTES`` and ``common.BATCH_ROWS`` where they are larger."""
    common.arrow_rows(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def place(h: np.ndarray, counters: int) -> np.ndarray:
    return (h % np.uint64(counters)).astype(np.int64)


def counters(texts: DataFrame, size: int) -> np.ndarray:
    """About how many documents have a shingle of each counter, over all documents. Each task counts and sends on what stands out from its own mean (the rest counts
    as rare, which only matters for the length of lists), and tasks add up parts as they come."""

    size_of, parts = COUNTERS, min(PARTS, COUNTERS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size_of, np.uint32)
        for batch in batches:
            for h in sets_in(batch.column(0), size):
                np.add.at(own, place(h, size_of), 1)
        mean = own.mean()
        own[own <= mean + 2 * mean**0.5 + 1] = 0
        yield from packed((row.astype(np.int64) for row in own.reshape(parts, -1)), range(parts))

    def packed(rows: Iterable[np.ndarray], names: range | list[int]) -> Iterator[pa.RecordBatch]:
        sent = [(k, np.flatnonzero(r), r) for k, r in zip(names, rows, strict=True)]
        sent = [(k, zlib.compress(np.diff(i, prepend=0).astype(np.int32).tobytes(), 1), zlib.compress(r[i].tobytes(), 1)) for k, i, r in sent if len(i)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in sent], pa.int32()), pa.array([x[1] for x in sent], pa.binary()), pa.array([x[2] for x in sent], pa.binary())], names=["part", "steps", "counts"])

    def unpacked(steps: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(np.frombuffer(zlib.decompress(steps), np.int32)), np.frombuffer(zlib.decompress(counts), np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, *data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                i, n = unpacked(*data)
                own.setdefault(k, np.zeros(size_of // parts, np.int64))[i] += n
        yield from packed(own.values(), list(own))

    schema = "part int, steps binary, counts binary"
    out = np.zeros((parts, size_of // parts), np.uint32)
    for r in texts.mapInArrow(count, schema).repartition(parts, "part").mapInArrow(add, schema).toLocalIterator():
        i, n = unpacked(r["steps"], r["counts"])
        out[r["part"], i] = np.minimum(n, 2**32 - 1)
    return out.reshape(-1)


def shape(docs: DataFrame, seen, size: int, percent: int) -> DataFrame:  # noqa: ANN001
    """row_id, doc_id, n, set_key, prefix_key, prefix and outline (how many shingles fall into each of ``BINS`` bins, up to 255) of each row of ``docs`` (row_id, doc_id, text); ``seen``: broadcast of the counters."""
    schema = T.StructType([docs.schema["row_id"], docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("prefix_key", T.LongType()), T.StructField("prefix", T.BinaryType()), T.StructField("outline", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = seen.value
        for batch in batches:
            n, keys, groups, prefixes, outlines = [], [], [], [], []
            for h in sets_in(batch.column(2), size):
                most = len(h) - (percent * len(h) + 99) // 100 + 1 if len(h) else 0
                prefix = h[np.lexsort((h, count[place(h, len(count))]))[:most]]
                data = prefix.tobytes()
                n.append(len(h))
                keys.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                groups.append(xxhash.xxh3_64_intdigest(data, len(h)))
                prefixes.append(data)
                outlines.append(np.minimum(np.bincount((h & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(np.array(groups, np.uint64).view(np.int64)), pa.array(prefixes, pa.binary()), pa.array(outlines, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def planes(x: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of whole numbers, first bytes first, so that bytes that are mostly zero lie together and are compressed by the shuffle."""
    return np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplaned(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view(np.int64)


def fits(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray, percent: int) -> np.ndarray:
    """``room`` for arrays."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * np.minimum(n - at, m - to) >= percent * (n + m))


def listed(shaped: DataFrame, seen, percent: int) -> DataFrame:  # noqa: ANN001
    """token, prefix_key, n, at, share: the groups under each shingle of their prefixes that have room for another group of the list. A token is 40 bits of a shingle's
    hash: two shingles of one token make a longer list, no shorter one. Common shingles' groups are dealt out by shares from 1 on and all taken, so that no list has
    to be in one place."""
    spark = shaped.sparkSession
    rows = shaped.where("n > 0").select("prefix_key", "n", "prefix")
    entries = rows.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // 8 // PART + 1)
    buckets = 2 * parts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = seen.value
        often = 4 * int(count.mean()) + 256
        done: set[int] = set()
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0
        for batch in batches:
            for k, n, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k not in done:
                    done.add(k)
                    held.append((k, n, np.frombuffer(p, np.uint64)))
                    size += len(p) // 8
                    if size >= DEALT:
                        yield packed(held, count, often)
                        held, size = [], 0
            if len(done) > SEEN:
                done = set()
        if held:
            yield packed(held, count, often)

    def packed(held: list[tuple[int, int, np.ndarray]], count: np.ndarray, often: int) -> pa.RecordBatch:
        key, n, length = np.array([k for k, *_ in held], np.int64), np.array([n for _, n, _ in held], np.int64), np.array([len(p) for *_, p in held])
        token, who = np.concatenate([p for *_, p in held]), np.repeat(np.arange(len(held)), length)
        at = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
        share = np.where(count[place(token, len(count))] > often, 1 + mix(key.view(np.uint64))[who] % np.uint64(SHARES), 0).astype(np.uint8)
        bucket = (mix(token + share * ODD[-2]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        names, begin = np.unique(bucket[order], return_index=True)
        out = []
        for a, b in zip(begin.tolist(), [*begin.tolist()[1:], len(order)], strict=True):
            own = order[a:b]
            docs, times = np.unique(who[own], return_counts=True)
            out.append([planes(x, width) for x, width in zip((token[own], share[own], at[own], key[docs], n[docs], times), WIDTHS, strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *(pa.array(x, pa.binary()) for x in zip(*out, strict=True))], names=["bucket", "token", "share", "at", "prefix_key", "n", "times"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        came: list[list[np.ndarray]] = [[] for _ in WIDTHS]
        for batch in batches:
            for k, width in enumerate(WIDTHS):
                came[k] += [unplaned(b, width) for b in batch.column(k + 1).to_pylist()]
        if not came[0]:
            return
        token, share, at, key, n, times = (np.concatenate(x) for x in came)
        key, n = np.repeat(key, times), np.repeat(n, times)
        order = np.lexsort((at, key, n, share, token))
        token, share, at, key, n = (x[order] for x in (token, share, at, key, n))
        head = np.ones(len(token), bool)
        head[1:] = (token[1:] != token[:-1]) | (share[1:] != share[:-1])
        new = head.copy()
        new[1:] |= key[1:] != key[:-1]  # a group that several tasks have sent, or two of whose shingles are one token: the first place leaves most room
        token, share, at, key, n, head = (x[new] for x in (token, share, at, key, n, head))
        begin = np.flatnonzero(head)
        size = np.diff(begin, append=len(token))
        left = np.repeat(begin + size, size) - np.arange(len(token)) - 1
        size = np.repeat(size, size)
        # In a longer list, by size: one that the next has room for, or that an earlier one has room for.
        most = (100 + percent) * (n - at) // percent - n
        of = (np.cumsum(head) - 1) << 40
        earlier = np.full(len(n), -1, np.int64)
        earlier[1:] = np.maximum.accumulate(most + of)[:-1]
        later = np.zeros(len(n), bool)
        later[:-1] = n[1:] <= most[:-1]
        good = (share > 0) | (size > WINDOW + 1) & ((left > 0) & later | ~head & (earlier - of >= n))
        i = np.flatnonzero((size <= WINDOW + 1) & (share == 0) & (left > 0))
        for k in range(1, WINDOW + 1):
            i = i[left[i] >= k]
            met = i[fits(n[i], at[i], n[i + k], at[i + k], percent)]
            good[met] = good[met + k] = True
        for rows in np.array_split(np.flatnonzero(good), good.sum() // 100_000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(token[rows]), pa.array(key[rows]), pa.array(n[rows]), pa.array(at[rows].astype(np.int32)), pa.array(share[rows].astype(np.int32))], names=["token", "prefix_key", "n", "at", "share"])

    sent = rows.mapInArrow(deal, "bucket long, token binary, share binary, at binary, prefix_key binary, n binary, times binary")
    return sent.repartition(parts, "bucket").mapInArrow(gather, "token long, prefix_key long, n long, at int, share int")


def room(n: F.Column, at: F.Column, m: F.Column, to: F.Column, percent: int) -> F.Column:
    """Whether sets of sizes n and m may be alike whose first shared shingle is at these places: enough have to be left behind it."""
    return (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)) & (F.lit(100 + percent) * F.least(n - at, m - to) >= F.lit(percent) * (n + m))


def level_of(percent: int) -> F.Column:
    """A number of a set's size, such that sizes of sets that may be alike are on one level or on neighbouring ones."""
    return F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9).cast("int") if percent < 100 else F.col("n").cast("int")


def outlined(pairs: DataFrame, outlines: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose outlines (c, n, outline) leave room for enough shared shingles: two sets share no more of a bin than the smaller one has there."""
    met = pairs
    for x in ("a", "b"):
        met = met.join(outlines.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("outline").alias(f"o_{x}")), x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int64) for k in (4, 5))
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            most = np.where((x == 255) & (y == 255), n[:, None], np.minimum(x, y)).sum(axis=1)
            yield batch.select([0, 1]).filter(pa.array((100 + percent) * most >= percent * n))

    return met.select("a", "b", "n_a", "n_b", "o_a", "o_b").mapInArrow(run, "a long, b long")


def chosen(pairs: DataFrame, rows: DataFrame) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """``rows`` with a last column that tells the function beside it which rows' ``c`` is in ``pairs``, so that others don't move: places in a table of bits of a fixed
    size. Rows with a colliding bit come along and meet nothing."""
    spread = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - BITS.bit_length() + 1)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("c")).select(spread("c").alias("bit"))
    made = wanted.groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(0x7FFF))).alias("bits"))
    table = np.zeros(BITS // 8, np.uint8)
    for r in made.toLocalIterator():
        table[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    sent = pairs.sparkSession.sparkContext.broadcast(table)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = batch.column(batch.num_columns - 1).to_numpy()
        return batch.filter(pa.array((sent.value[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1))

    return rows.withColumn("bit", spread("c")), keep


def prefixed(pairs: DataFrame, shaped: DataFrame, seen, percent: int) -> DataFrame:  # noqa: ANN001
    """The pairs (a, b) of classes whose prefixes leave room for enough shared shingles. Up to the lesser of their last shingles both prefixes are whole: two sets share
    what is in both there, and behind it no more than the smaller rest."""
    rows, keep = chosen(pairs, shaped.select(F.col("row_id").alias("c"), "n", "prefix"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (keep(batch).select([0, 1, 2]) for batch in batches)

    rows = rows.mapInArrow(take, "c long, n long, prefix binary")
    met = pairs
    for x in ("a", "b"):
        met = met.join(rows.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("prefix").alias(f"p_{x}")), x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = seen.value
        for batch in batches:
            good = []
            for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                cx, cy = count[place(x, len(count))], count[place(y, len(count))]
                c, h = min((cx[-1], x[-1]), (cy[-1], y[-1]))
                x, y = x[(cx < c) | ((cx == c) & (x <= h))], y[(cy < c) | ((cy == c) & (y <= h))]
                most = len(np.intersect1d(x, y, assume_unique=True)) + min(n - len(x), m - len(y))
                good.append((100 + percent) * most >= percent * (n + m))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return met.select("a", "b", "n_a", "n_b", "p_a", "p_b").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """c, hashes: the whole sets of the classes in ``pairs``, made again from the texts of the rows that stand for them."""
    rows, keep = chosen(pairs, docs.select(F.col("row_id").alias("c"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(keep, batches):
            own = [h.tobytes() for h in sets_in(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["c", "hashes"])

    return rows.mapInArrow(run, "c long, hashes binary")


def verified(pairs: DataFrame, docs: DataFrame, shaped: DataFrame, seen, size: int, percent: int) -> DataFrame:  # noqa: ANN001
    """The pairs (a, b) of classes whose sets are alike."""
    pairs = common.checkpoint(outlined(pairs, shaped.select(F.col("row_id").alias("c"), "n", "outline"), percent))
    pairs = common.checkpoint(prefixed(pairs, shaped, seen, percent))
    sets = common.checkpoint(sets_of(docs, pairs, size))
    met = pairs.join(sets.select(F.col("c").alias("b"), F.col("hashes").alias("y")), "b").join(sets.select(F.col("c").alias("a"), F.col("hashes").alias("x")), "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                i = np.searchsorted(y, x)
                shared = int((y[np.minimum(i, len(y) - 1)] == x).sum())
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return met.mapInArrow(run, "a long, b long")


def ordered(pairs: DataFrame) -> DataFrame:
    """(a, b) with a < b, each once."""
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def hub_pairs(lists: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): the first classes of each list's groups with that of the hub among groups of like size, and hubs with each other."""
    pick = F.array(*(F.min(F.struct(F.xxhash64("prefix_key", F.lit(turn * DRAWS + k)).alias("draw"), "first", "n", "at", "lo", "hi")) for k in range(DRAWS))).alias("hubs")
    lists = lists.where(F.col("rank") <= FIRST).withColumn("level", level_of(percent))
    hubs = lists.groupBy("token", "level", "share").agg(pick)
    flat = hubs.select("token", "level", F.explode("hubs").alias("hub")).select("token", "level", "hub.*")
    above = flat.groupBy("token", "level").agg(F.min(F.struct("draw", "first", "n", "at", "lo", "hi")).alias("hub"))
    new = ~((F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("hub.lo")) & (F.col("lo") == F.col("hub.hi")))
    fits = new & room(F.col("n"), F.col("at"), F.col("hub.n"), F.col("hub.at"), percent)
    pair = lambda met: met.where(fits).select(F.col("first").alias("a"), F.col("hub.first").alias("b"))
    next_level = above.select("token", (F.col("level") - 1).alias("level"), "hub")
    own = lists.join(hubs, ["token", "level", "share"]).withColumn("hub", F.explode(F.array_distinct("hubs")))
    return pair(own).unionByName(pair(flat.join(above, ["token", "level"]))).unionByName(pair(above.select("token", "level", "hub.*").join(next_level, ["token", "level"])))


def labelled(lists: DataFrame, members: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lists`` with the least and greatest component of each group, and ``members`` with each class's component."""
    own = common.checkpoint(members.join(found.select(F.col("node").alias("c"), "component"), "c", "left").withColumn("component", F.coalesce("component", "c")))
    span = own.groupBy("prefix_key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    every = lists.drop("lo", "hi").join(span, "prefix_key")
    # Lists in one component have nothing left.
    open_ = every.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("token")
    return common.checkpoint(every.join(open_, "token", "left_semi")), own


def open_pairs(lists: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of classes that share a list, or a group, and are in different components."""
    lists = lists.withColumn("level", level_of(percent))
    # Blocks of a list: groups of one level and one component (or span of components). Pairs of groups within one component never meet.
    # Blocks meet only where one's least size is within what another's groups have room for.
    most = F.expr(f"(100 + {percent}) * (n - at) div {percent} - n")
    block = lists.groupBy("token", "level", "lo", "hi").agg(F.min("n").alias("least"), F.max(most).alias("most"))
    x = block.select("token", F.col("level").alias("lx"), F.col("lo").alias("ax"), F.col("hi").alias("bx"), F.col("least").alias("nx"), F.col("most").alias("mx"), F.explode(F.array("level", F.col("level") + 1)).alias("level"))
    y = block.select("token", "level", F.col("lo").alias("ay"), F.col("hi").alias("by"), F.col("least").alias("ny"), F.col("most").alias("my"))
    met = x.join(y, ["token", "level"]).where("ny <= mx AND nx <= my AND NOT (ax = bx AND ay = by AND ax = ay) AND (lx < level OR (ax, bx) <= (ay, by))").drop("nx", "mx")
    gx = lists.select("token", F.col("level").alias("lx"), F.col("lo").alias("ax"), F.col("hi").alias("bx"), F.col("prefix_key").alias("kx"), F.col("n").alias("nx"), F.col("at").alias("px"), most.alias("mx"))
    gy = lists.select("token", "level", F.col("lo").alias("ay"), F.col("hi").alias("by"), F.col("prefix_key").alias("ky"), F.col("n").alias("ny"), F.col("at").alias("py"))
    groups = met.join(gx, ["token", "lx", "ax", "bx"]).where("nx <= my AND ny <= mx").drop("ny", "my").join(gy, ["token", "level", "ay", "by"]).where((F.col("kx") != F.col("ky")) & room(F.col("nx"), F.col("px"), F.col("ny"), F.col("py"), percent))
    groups = groups.select(F.least("kx", "ky").alias("kx"), F.greatest("kx", "ky").alias("ky")).distinct()
    mx = members.select(F.col("prefix_key").alias("kx"), F.col("c").alias("a"), F.col("component").alias("ca"))
    my = members.select(F.col("prefix_key").alias("ky"), F.col("c").alias("b"), F.col("component").alias("cb"))
    within = mx.join(my, (F.col("kx") == F.col("ky")) & (F.col("ca") < F.col("cb"))).select("a", "b")
    return ordered(groups.join(mx, "kx").join(my, "ky").where("ca <> cb").select("a", "b").unionByName(within))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """row_id, doc_id, n_shingles, component_id for each row of ``docs``.

    Two rows link if 100 * shared >= ``percent`` * all of their sets of ``size``-word shingles. component_id is the smallest id reachable, itself included; null ids
    count as the largest, and a component of null ids only has a null one. Null and empty texts, and texts of white space, have no shingles and link with nothing.
    Rows that repeat are rows of their own with one set. Other columns aren't read. An empty table gives an empty result.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent has to lie between 50 and 100")
    spark = docs.sparkSession
    batches_of(spark)
    docs = common.numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "row_id")
    seen = spark.sparkContext.broadcast(counters(docs.select("text"), size))
    shaped = common.checkpoint(shape(docs.select("row_id", "doc_id", "text"), seen, size, percent))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))).alias("least")
    classes = common.checkpoint(shaped.where("n > 0").groupBy("set_key").agg(F.min("row_id").alias("c"), least, F.min("prefix_key").alias("prefix_key")))
    groups = classes.groupBy("prefix_key").agg(F.min("c").alias("first"), F.count(F.lit(1)).alias("size"))
    lists = common.checkpoint(listed(shaped, seen, percent).join(groups.select("prefix_key", "first"), "prefix_key").withColumn("rank", F.expr("row_number() OVER (PARTITION BY prefix_key ORDER BY at)")))
    members = classes.select("c", "prefix_key")
    several = groups.where("size > 1")
    members = common.checkpoint(members.join(lists.select("prefix_key").unionByName(several.select("prefix_key")).distinct(), "prefix_key", "left_semi"))
    links: list[DataFrame] = []
    for turn in range(max(1, HUBS)):
        # Members of a group have one prefix: the group itself is a list, and its first class the hub.
        pairs = members.join(several, "prefix_key").select(F.col("first").alias("a"), F.col("c").alias("b")) if not turn else None
        if HUBS:
            hubs = hub_pairs(lists if turn else lists.withColumns({"lo": F.col("first"), "hi": F.col("first")}), turn, percent)
            pairs = hubs if pairs is None else pairs.unionByName(hubs)
        links.append(common.checkpoint(verified(ordered(pairs), docs, shaped, seen, size, percent)))
        found = graph.components(reduce(DataFrame.unionByName, links))
        lists, own = labelled(lists, members, found)
    links.append(common.checkpoint(verified(open_pairs(lists, own, percent), docs, shaped, seen, size, percent)))
    found = graph.components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(links[-1]))
    label = classes.join(found.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    named = label.select("set_key", "component").join(label.groupBy("component").agg(F.min("least").alias("best")), "component").select("set_key", F.col("best.id").alias("component_id"))
    alone = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return shaped.join(named, "set_key", "left").select("row_id", "doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.documents(spark, sf_dir)).drop("row_id")


OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT w.doc_id, count(g)::BIGINT AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT e.b, r.seen FROM reach r JOIN e ON e.a = r.node)
SELECT n.doc_id, n.n AS n_shingles, min(seen) AS component_id FROM n JOIN reach ON node = n.doc_id GROUP BY ALL
"""
