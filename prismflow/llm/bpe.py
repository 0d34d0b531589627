"""Byte-level BPE encoding and decoding, with a queue of merge ranks over a linked symbol list."""

from __future__ import annotations

import heapq
import json
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismflow.llm import common

#: Pre-tokens whose ids a worker remembers (about 130 MB); others are encoded anew each time.
REMEMBERED = 600_000
#: Bytes of ids and text in one output batch.
OUTPUT_BYTES = 8 << 20
#: Letters and numbers that ``regex`` knows and the tokenizers' Unicode 16 doesn't (fixed values).
LATER = (
    (0x558, 0x558), (0x58b, 0x58c), (0x88f, 0x88f), (0xc5c, 0xc5c), (0xcdc, 0xcdc), (0x208f, 0x208f),
    (0x209d, 0x209f), (0xa7ce, 0xa7cf), (0xa7d2, 0xa7d2), (0xa7d4, 0xa7d4), (0xa7dd, 0xa7dd), (0xa7e2, 0xa7e2),
    (0xa7f1, 0xa7f1), (0xab6c, 0xab6d), (0x107bb, 0x107bf), (0x10940, 0x10959), (0x10ec5, 0x10ec7), (0x10ed9, 0x10eee),
    (0x11b0a, 0x11b0a), (0x11db0, 0x11ddb), (0x11de0, 0x11de9), (0x11df1, 0x11df1), (0x1246f, 0x1246f), (0x12475, 0x1247f),
    (0x12550, 0x12686), (0x16ea0, 0x16eb8), (0x16ebb, 0x16ed3), (0x16ff2, 0x16ff6), (0x187f8, 0x187ff), (0x18cd6, 0x18cda),
    (0x18d09, 0x18d20), (0x18d80, 0x18df2), (0x18e00, 0x19191), (0x191a0, 0x191d2), (0x1b123, 0x1b128), (0x1b168, 0x1b168),
    (0x1d6a6, 0x1d6a6), (0x1df1f, 0x1df24), (0x1df2b, 0x1df81), (0x1df90, 0x1df96), (0x1dfcd, 0x1dfff), (0x1e6c0, 0x1e6de),
    (0x1e6e0, 0x1e6e2), (0x1e6e4, 0x1e6e5), (0x1e6e7, 0x1e6ed), (0x1e6f0, 0x1e6f4), (0x1e6fe, 0x1e6ff), (0x2b73a, 0x2b73f),
    (0x2b81e, 0x2b81e), (0x2cea2, 0x2cead), (0x323b0, 0x33479), (0x3d000, 0x3fc3f),
)
NEW = (T.StructField("n_tokens", T.LongType()), T.StructField("ids_le", T.BinaryType()), T.StructField("decoded", T.StringType()))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def highest(text: str) -> int:
    """The end of the smallest of three alphabets that has all characters of ``text``."""
    try:
        text.encode("latin-1")
        return 0xFF
    except UnicodeEncodeError:
        return 0xFFFF if max(text) <= "\uffff" else 0x10FFFF


@lru_cache
def pre_token_pattern(end: int = 0x10FFFF) -> re.Pattern[str]:
    """The byte-level pre-token pattern for texts of characters up to ``end``, with its classes written out as ranges.

    ``regex`` says what is in a class; ``re`` matches faster, above all with short classes.
    """
    every = "".join(chr(c) for c in range(end + 1) if not 0xD800 <= c < 0xE000 and not any(a <= c <= b for a, b in LATER))

    def ranges(name: str) -> str:
        found = (c for m in regex.finditer(f"{name}+", every) for c in spans(m[0]))
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)

    letter, number, space = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def spans(text: str) -> Iterator[tuple[int, int]]:
    """Runs of consecutive code points."""
    start = last = ord(text[0])
    for c in map(ord, text[1:]):
        if c != last + 1:
            yield start, last
            start = c
        last = c
    yield start, last


class Codec(dict):
    """Ids of pre-tokens, packed as little-endian 32-bit integers; a missing pre-token is encoded by merging."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab: dict[str, int] = model["model"]["vocab"]
        self.letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(self.letters)}
        self.base = [vocab[c] for c in self.letters]
        self.size = 1 + max(max(vocab.values()), max((t["id"] for t in model["added_tokens"]), default=0))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.merges = {vocab[a] * self.size + vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.bytes_of = [b""] * self.size
        for token, k in vocab.items():
            self.bytes_of[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        for token, k in self.special.items():
            self.bytes_of[k] = token.encode()
        # A token that begins with another one is tried first.
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __missing__(self, word: str) -> bytes:
        ids = self.merged(word.encode("utf-8", "surrogatepass"))
        out = array("I", ids).tobytes()
        if len(self) < REMEMBERED and len(word) <= 64:
            self[word] = out
        return out

    def merged(self, raw: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, until no pair can be merged."""
        n, size, rank, made = len(raw), self.size, self.merges.get, self.made
        ids = [self.base[b] for b in raw]
        if n < 2:
            return ids
        queue = [r << 32 | i for i in range(n - 1) if (r := rank(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(queue)
        # The linked list of symbols. No pair has the symbol after the last; no pair has a merged one's -1.
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids.append(-size * size)
        while queue:
            entry = heapq.heappop(queue)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if ids[i] < 0 or rank(ids[i] * size + ids[j]) != r:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := rank(ids[i] * size + ids[k])) is not None:
                    heapq.heappush(queue, x << 32 | i)
            if (p := before[i]) >= 0 and (x := rank(ids[p] * size + ids[i])) is not None:
                heapq.heappush(queue, x << 32 | p)
        ids.pop()
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        find, get = pre_token_pattern(highest(text)).findall, self.__getitem__
        if self.split is None or not self.split.search(text):
            return b"".join(map(get, find(text)))
        return b"".join(struct.pack("<I", self.special[part]) if k % 2 else b"".join(map(get, find(part))) for k, part in enumerate(self.split.split(text)))

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    """One codec for a worker process and a file."""
    return Codec(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, keep: list[str] | None = None, decode: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids_le (ids as little-endian unsigned 32-bit integers) and decoded (the text decoded from these ids;
    left out if not ``decode``).

    Whole texts are encoded; a null text is empty and has no tokens. Strings of special tokens in a text become
    those tokens. ``vocabulary`` is a file that every executor has, ``keep`` the columns that go on (None: all).
    Columns of ``docs`` with a new column's name are replaced. Rows are never dropped or merged.
    """
    path = vocabulary or default_vocabulary()
    common.arrow_rows(docs.sparkSession)
    text_at = docs.columns.index(text_col)
    new_fields = NEW if decode else NEW[:2]
    kept, _ = common.extended(docs, *new_fields)
    kept = [c for c in kept if keep is None or c in keep]
    schema = T.StructType([*(docs.schema[c] for c in kept), *new_fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        arrow = None
        for batch in batches:
            texts = batch.column(text_at)
            start, size, rows = 0, 0, []
            for k in range(len(texts)):
                text = texts[k].as_py() or ""
                packed = own.encode(text)
                rows.append((len(packed) // 4, packed, own.decode(packed) if decode else None))
                size += 2 * len(packed)
                if size >= OUTPUT_BYTES or k == len(texts) - 1:
                    part = batch.slice(start, len(rows))
                    new = [pa.array(x, type=t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.string()), strict=True)][: len(new_fields)]
                    arrow = arrow or [*kept, *(f.name for f in new_fields)]
                    yield pa.RecordBatch.from_arrays([*(part.column(batch.schema.names.index(c)) for c in kept), *new], names=arrow)
                    start, size, rows = k + 1, 0, []

    return docs.mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return encode(docs, keep=["doc_id"]).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
