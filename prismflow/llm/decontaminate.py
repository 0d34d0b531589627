"""Benchmark decontamination with Wu-Manber multi-pattern search.

A pattern is a window of benchmark words between single spaces, as bytes. Texts are brought to the same form: A-Z
in lower case, every run of other bytes than a word's one space. A window then occurs where its bytes occur. As in Wu and Manber's search, the block of
bytes at the end of the current position says how far the search may shift; only where the shift is zero do the
patterns of the block's bucket come up, which direct comparison confirms. Many positions (lanes) advance at a time, with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismflow.llm import common

#: Words of a window.
WINDOW = 10
#: Bytes of patterns that one broadcast holds; a larger benchmark is searched in that many more passes.
PATTERN_BYTES = 16 << 20
#: Passes after which the rows are written, so that no task or driver holds more tables than these.
PASSES = 4
#: Bytes of text that are searched at a time, and that one lane walks over.
PIECE, LANE = 2 << 20, 1 << 10
#: The shortest patterns of a class; each class has its own tables, so that a short pattern doesn't shorten all shifts.
CLASSES = (3, 6, 12, 24, 48)
TABLE_BITS = 18
SPREAD = np.uint64(0x9E3779B97F4A7C15)

#: What each byte is searched as: itself in a word, in lower case, or else a space.
FORM = np.full(256, 32, np.uint8)
FORM[0x30:0x3A] = np.arange(0x30, 0x3A)
FORM[0x41:0x5B] = np.arange(0x61, 0x7B)
FORM[0x61:0x7B] = np.arange(0x61, 0x7B)
FORM[0x80:] = np.arange(0x80, 0x100)

NEW = (
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.LongType())),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
)


def words(text: str | None) -> list[bytes]:
    return FORM[np.frombuffer((text or "").encode(), np.uint8)].tobytes().split()


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    own = words(text)
    if not own:
        return []
    return [b" " + b" ".join(own[i : i + size]) + b" " for i in range(max(1, len(own) - size + 1))]


class Tables:
    """Shift table and buckets of one class of patterns."""

    def __init__(self, patterns: list[bytes]):
        self.least = m = min(map(len, patterns))
        # Wu and Manber's rule: a block long enough that most blocks of a text end no pattern.
        self.block = b = int(min(8, m, max(2, np.ceil(np.log(2.0 * m * len(patterns)) / np.log(20.0)) + 2)))
        self.mask = np.uint64((1 << (8 * b)) - 1)
        ends = np.array([len(p) for p in patterns])
        self.data = np.frombuffer(b"".join(patterns) + bytes(8), np.uint8)
        self.start = np.concatenate([[0], np.cumsum(ends)[:-1]])
        self.length = ends
        self.shift = np.full(1 << TABLE_BITS, m - b + 1, np.int32)
        view = view8(self.data)
        for j in range(m - b + 1):
            np.minimum.at(self.shift, self.hash(view[self.start + j]), m - b - j)
        last = self.hash(view[self.start + m - b])
        order = np.argsort(last, kind="stable")
        self.bucket = order
        self.first = np.searchsorted(last[order], np.arange((1 << TABLE_BITS) + 1))
        self.longest = int(ends.max())

    def hash(self, blocks: np.ndarray) -> np.ndarray:
        return (((blocks & self.mask) * SPREAD) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and pattern numbers of all occurrences in data[:n]; eight more bytes follow."""
        m, b, view = self.least, self.block, view8(data)
        stop = n - m + 1
        at = np.arange(0, max(stop, 0), LANE)
        to = np.minimum(at + LANE, stop)
        starts, found = [], []
        while len(at):
            h = self.hash(view[at + (m - b)])
            step = self.shift[h]
            zero = step == 0
            if zero.any():
                s, p = self.candidates(at[zero], h[zero])
                same = self.compare(data, n, s, p)
                starts.append(s[same])
                found.append(p[same])
            at = at + np.maximum(step, 1)
            on = at < to
            if not on.all():
                at, to = at[on], to[on]
        return (np.concatenate(starts), np.concatenate(found)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def candidates(self, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.first[h + 1] - self.first[h]
        who = np.repeat(np.arange(len(at)), size)
        inside = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)
        return at[who], self.bucket[self.first[h][who] + inside]

    def compare(self, data: np.ndarray, n: int, s: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Which candidates are occurrences: the first eight bytes of all at once, then the whole pattern of what is left."""
        length, k = self.length[p], np.minimum(self.length[p], 8)
        mask = np.where(k == 8, ~np.uint64(0), (np.uint64(1) << (np.uint64(8) * k.astype(np.uint64) % np.uint64(64))) - np.uint64(1))
        ok = (s + length <= n) & (((view8(data)[s] ^ view8(self.data)[self.start[p]]) & mask) == 0)
        for i in np.flatnonzero(ok):
            a = self.start[p[i]]
            ok[i] = np.array_equal(data[s[i] : s[i] + length[i]], self.data[a : a + length[i]])
        return ok


def view8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as an integer; the array ends with eight bytes that aren't searched."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


class Searcher:
    def __init__(self, patterns: dict[bytes, list[str]]):
        names = sorted({x for items in patterns.values() for x in items})
        code = {x: k for k, x in enumerate(names)}
        self.names, self.tables, self.items = names, [], []
        for least, most in zip(CLASSES, (*CLASSES[1:], 1 << 62), strict=True):
            own = [p for p in patterns if least <= len(p) < most]
            if own:
                self.tables.append(Tables(own))
                self.items.append([[code[x] for x in patterns[p]] for p in own])

    def scan(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
        """For each text: its number of words; word ranges that occurrences cover, put together, as start, end, start, end ...; items that occur, sorted."""
        data, ends = common.spaced(raw, offsets, FORM)
        m = len(data) - 8
        word = np.zeros(m, bool)
        word[1:] = (data[1:m] > 32) & (data[: m - 1] == 32)
        number = np.cumsum(word)  # words begun up to here
        upto = np.concatenate([[0], number[ends]])
        n = len(ends)
        spots, seen = [np.zeros((0, 3), np.int64)], [np.zeros((0, 2), np.int64)]
        for table, items in zip(self.tables, self.items, strict=True):
            at, which = table.search(data, m)
            row = np.searchsorted(ends, at)
            spots.append(np.column_stack([row, number[at], number[at + table.length[which] - 1]]))
            found = np.unique(np.column_stack([row, which]), axis=0)
            size = np.array([len(items[p]) for p in found[:, 1].tolist()], int)
            codes = np.array([x for p in found[:, 1].tolist() for x in items[p]], np.int64)
            seen.append(np.column_stack([np.repeat(found[:, 0], size), codes]))
        row, a, b = np.concatenate(spots).T
        a, b = joined(a, b)  # words are numbered over all texts of the piece, and no window goes from one text into another
        row = np.searchsorted(upto, a, side="right") - 1
        pairs = np.column_stack([a - upto[row], b - upto[row]])
        spans = [x.ravel() for x in np.split(pairs, np.searchsorted(row, np.arange(1, n)))] if n else []
        own = np.unique(np.concatenate(seen), axis=0)
        names = [[self.names[c] for c in x[:, 1].tolist()] for x in np.split(own, np.searchsorted(own[:, 0], np.arange(1, n)))] if n else []
        return np.diff(upto), spans, names


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges [a, b) in order, those that overlap as one."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, top = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.concatenate([[True], a[1:] >= top[:-1]]))
    return a[first], top[np.concatenate([first[1:], [len(a)]]) - 1]


def pattern_blocks(items: DataFrame, id_col: str, text_col: str, window: int, most: int) -> Iterator[dict[bytes, list[str]]]:
    """Windows with their items, in blocks of about ``most`` bytes. Items without an id or words have no window."""
    # A window has about `window` times its share of the item's bytes.
    total = items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(1, -(-total * window // most))
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(blocks))
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), part.alias("part"))
    for k in range(blocks):
        own: dict[bytes, set[str]] = {}
        for r in rows.where(F.col("part") == k).toLocalIterator():
            for w in windows(r["text"], window):
                own.setdefault(w, set()).add(r["id"])
        yield {w: sorted(x) for w, x in own.items()}


def search(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside occurrences), hit_spans (their ranges as [start, end, start, end ...], in order and apart) and
    hit_items (ids of items whose windows occur, as strings, distinct and sorted).

    The benchmark is the stated query set: it is broadcast in blocks of ``pattern_bytes``, each searched in one
    pass over the texts, without a shuffle; after PASSES of them the rows are written and the blocks let go. Null and empty texts have no words and no hits; an empty benchmark
    hits nothing. Equal items count each by its id; rows that repeat count once. ``keep``: the columns that go on
    (None: all); columns with a new one's name are replaced.
    """
    spark = docs.sparkSession
    common.arrow_rows(spark)
    kept, _ = common.extended(docs, *NEW)
    kept = [c for c in kept if keep is None or c in keep or c == text_col]
    out = docs.select(*kept)
    held = []
    for k, patterns in enumerate(pattern_blocks(items, item_id, item_text, window, pattern_bytes)):
        if len(held) == PASSES:
            out = common.checkpoint(out)
            for block in held:
                block.unpersist()
            held = []
        held.append(spark.sparkContext.broadcast(Searcher(patterns)))
        out = search_pass(out, held[-1], text_col, kept, first=k == 0)
    return out if keep is None or text_col in keep else out.drop(text_col)


def search_pass(docs: DataFrame, searcher, text_col: str, kept: list[str], first: bool) -> DataFrame:
    schema = T.StructType([*(docs.schema[c] for c in kept), *NEW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = searcher.value
        for batch in batches:
            names = batch.schema.names
            raw, offsets = common.utf8(batch.column(names.index(text_col)))
            for a, b in common.pieces(offsets, PIECE):
                count, spans, items = own.scan(raw, offsets[a : b + 1])
                part = batch.slice(a, b - a)
                if not first:
                    before = [np.array(x, np.int64) for x in part.column(names.index("hit_spans")).to_pylist()]
                    spans = [np.column_stack(joined(*np.concatenate([x, y]).reshape(-1, 2).T)).ravel() for x, y in zip(before, spans, strict=True)]
                    items = [sorted({*x, *y}) for x, y in zip(part.column(names.index("hit_items")).to_pylist(), items, strict=True)]
                hit = [int((x[1::2] - x[::2]).sum()) for x in spans]
                new = [pa.array(count, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(c)) for c in kept), *new], names=[*kept, *(f.name for f in NEW)])

    return docs.mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no benchmark window occurs."""
    own, back = common.aside(docs, *(f.name for f in NEW))
    return back(search(own, items).where(F.size("hit_items") == 0))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(common.documents(spark, sf_dir).select("doc_id", "text"), common.documents(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_items") > 0).alias("contaminated"),
    )


def _sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents), i AS (SELECT item_id, {words} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id::VARCHAR AS item, least({WINDOW}, len(w)) AS n, array_to_string(w[k : k + {WINDOW - 1}], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS k FROM i WHERE len(w) > 0)),
spot AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, k, spot.n, item FROM spot JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item)::BIGINT AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM hit GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(items.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP2_SQL = _sql()
