"""Edit-aware token counts: a tree of pre-token counts per document, of which an edit renews a few leaves.

A tree's leaves are runs of pre-tokens with their lengths in characters and their numbers of tokens; inner nodes have the
sums of both. An edit finds its place by descending along the lengths. Pre-tokens are then matched anew from a little before the
edit until they fall in with old ones behind it; only these are encoded, and the sums above them renewed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismflow.llm import bpe, common

#: Pre-tokens of a leaf, when built; a leaf of four times as many is split.
LEAF = 64
#: Characters after its end that can change where a pre-token ends: a pattern looks two ahead, and one that
#: ends a longer run of spaces too; a special token is found over its own length.
AHEAD = 2


class Tree:
    """Sums over leaves: level 0 has the leaves, each level half as many nodes as the one below."""

    def __init__(self, lengths: np.ndarray, tokens: np.ndarray):
        self.leaves = [(lengths[k : k + LEAF], tokens[k : k + LEAF]) for k in range(0, len(lengths), LEAF)] or [(lengths, tokens)]
        self.build()

    def build(self) -> None:
        level = np.array([[n.sum(), t.sum()] for n, t in self.leaves], np.int64)
        self.levels = [level]
        while len(level) > 1:
            level = np.add.reduceat(level, np.arange(0, len(level), 2), axis=0)
            self.levels.append(level)

    @property
    def total(self) -> int:
        return int(self.levels[-1][0, 1])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf with character ``at``, or the last one, and the characters before the leaf."""
        node, before = 0, 0
        for level in self.levels[-2::-1]:
            node *= 2
            if node + 1 < len(level) and before + level[node, 0] <= at:
                before += int(level[node, 0])
                node += 1
        return node, before

    def renew(self, first: int, last: int, lengths: np.ndarray, tokens: np.ndarray) -> None:
        """New pre-tokens in the place of leaves first to last. One leaf stays one, and only the sums above it change."""
        if first == last and len(lengths) <= 4 * LEAF:
            self.leaves[first] = (lengths, tokens)
            change = np.array([lengths.sum(), tokens.sum()]) - self.levels[0][first]
            for k, level in enumerate(self.levels):
                level[first >> k] += change
        else:
            self.leaves[first : last + 1] = [(lengths[k : k + LEAF], tokens[k : k + LEAF]) for k in range(0, len(lengths), LEAF)] or [(lengths, tokens)]
            self.build()


def split(codec: bpe.Codec, text: str, start: int = 0) -> Iterator[tuple[int, int]]:
    """Length and number of tokens of each pre-token from ``start`` on, where one begins."""
    pattern = bpe.pre_token_pattern(bpe.highest(text))
    specials = codec.split.finditer(text, start) if codec.split else iter(())
    while True:
        special = next(specials, None)
        for m in pattern.finditer(text[:special.start()] if special else text, start):
            yield m.end() - m.start(), len(codec[m[0]]) // 4
        if special is None:
            return
        yield special.end() - special.start(), 1
        start = special.end()


def build(codec: bpe.Codec, text: str) -> Tree:
    if codec.split is not None and codec.split.search(text):
        own = np.array(list(split(codec, text)), np.int64).reshape(-1, 2)
        return Tree(own[:, 0], own[:, 1])
    words = bpe.pre_token_pattern(bpe.highest(text)).findall(text)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return Tree(lengths, np.fromiter(map(len, map(codec.__getitem__, words)), np.int64, len(words)) // 4)


def edit(codec: bpe.Codec, tree: Tree, text: str, at: int, cut: int, put: str) -> tuple[str, int]:
    """The text with ``cut`` characters at ``at`` replaced by ``put``, and how many pre-tokens were encoded; the tree is brought up to it."""
    at = min(max(at, 0), len(text))
    cut = min(max(cut, 0), len(text) - at)
    new = text[:at] + put + text[at + cut :]
    reach = AHEAD + max(map(len, codec.special), default=0)
    # A leaf before the first one that a change this near can reach, so that pre-tokens are whole.
    first, before = tree.find(max(0, at - reach))
    lengths, tokens = tree.leaves[first]
    ends = before + np.cumsum(lengths)
    safe = int(np.searchsorted(ends, at - reach, side="right"))  # pre-tokens that end early enough stay
    start = int(ends[safe - 1]) if safe else before
    last, past = tree.find(at + cut)
    shift = len(put) - cut
    kept_l, kept_t = [*lengths[:safe].tolist()], [*tokens[:safe].tolist()]
    # Where old pre-tokens end behind the edit, leaf by leaf as they are needed.
    old = {past: 0}
    old.update({past + int(e): k + 1 for k, e in enumerate(np.cumsum(tree.leaves[last][0]))})
    place, done, resumed = start, 0, None
    for n, t in split(codec, new, start):
        while place - shift >= at + cut and place >= at + len(put):
            if place - shift in old:
                resumed = old[place - shift]
                break
            if place - shift > past + int(tree.leaves[last][0].sum()) and last + 1 < len(tree.leaves):
                past += int(tree.leaves[last][0].sum())
                last += 1
                old = {past: 0}
                old.update({past + int(e): k + 1 for k, e in enumerate(np.cumsum(tree.leaves[last][0]))})
                continue
            break
        if resumed is not None:
            break
        kept_l.append(n)
        kept_t.append(t)
        place += n
        done += 1
    rest_l, rest_t = tree.leaves[last]
    if resumed is None:  # the new text ended first
        resumed = len(rest_l)
        last = len(tree.leaves) - 1
        rest_l, rest_t = tree.leaves[last]
        resumed = len(rest_l)
    tree.renew(first, last, np.array([*kept_l, *rest_l[resumed:].tolist()], np.int64), np.array([*kept_t, *rest_t[resumed:].tolist()], np.int64))
    return new, done


NEW = (T.StructField("n_tokens", T.LongType()), T.StructField("lengths", T.BinaryType()), T.StructField("tokens", T.BinaryType()))
EDITED = (*NEW, T.StructField("n_renewed", T.LongType()))


def packed(tree: Tree) -> tuple[bytes, bytes]:
    return tuple(np.concatenate([x[k] for x in tree.leaves]).astype("<u4").tobytes() for k in (0, 1))


def unpacked(lengths: bytes, tokens: bytes) -> Tree:
    return Tree(*(np.frombuffer(x, "<u4").astype(np.int64) for x in (lengths, tokens)))


def count(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with n_tokens and the tree's leaves, lengths and tokens (little-endian 32-bit integers), which a later edit starts from.

    Null texts are empty and have no tokens. Columns with a new one's name are replaced; rows stay as many.
    """
    path = vocabulary or bpe.default_vocabulary()
    common.arrow_rows(docs.sparkSession)
    kept, schema = common.extended(docs, *NEW)
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(path)
        for batch in batches:
            trees = [build(codec, x or "") for x in batch.column(text_at).to_pylist()]
            leaves = [packed(t) for t in trees]
            new = [pa.array([t.total for t in trees], pa.int64()), pa.array([x[0] for x in leaves], pa.binary()), pa.array([x[1] for x in leaves], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in kept), *new], names=schema.names)

    return docs.mapInArrow(run, schema)


def recount(counted: DataFrame, edits_col: str = "edits", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``counted`` (of count()) after its edits: the new text, n_tokens, lengths and tokens, and n_renewed, the number of pre-tokens that were encoded.

    ``edits_col`` is an array of (at, cut, put): at a place in code points, so many go and a string comes. They are done in order, each
    on the text that the one before left. Places and lengths beyond the text end at its end; null edits and nulls in one are nothing, 0 or empty.
    """
    path = vocabulary or bpe.default_vocabulary()
    common.arrow_rows(counted.sparkSession)
    kept, schema = common.extended(counted, *EDITED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(path)
        for batch in batches:
            names = batch.schema.names
            out = []
            for text, lengths, tokens, edits in zip(*(batch.column(names.index(c)).to_pylist() for c in (text_col, "lengths", "tokens", edits_col)), strict=True):
                text, tree, renewed = text or "", unpacked(lengths, tokens), 0
                for e in edits or []:
                    if e:
                        text, n = edit(codec, tree, text, e["at"] or 0, e["cut"] or 0, e["put"] or "")
                        renewed += n
                out.append((text, tree.total, *packed(tree), renewed))
            text, *new = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(text if c == text_col else batch.column(names.index(c)) for c in kept), *new], names=schema.names)

    return counted.mapInArrow(run, schema)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after a revision made of their own columns: the source is named in front, a twentieth
    of the text goes from its middle, its first 40 characters come at two thirds."""
    n = F.length("text")
    change = lambda at, cut, put: F.struct(at.cast("int").alias("at"), cut.cast("int").alias("cut"), put.alias("put"))
    edits = F.array(change(F.lit(0), F.lit(0), F.concat(F.col("source"), F.lit(": "))), change(n / 2, n / 20, F.lit("")), change(2 * n / 3, F.lit(0), F.substring(F.col("text"), 1, 40)))
    counted = count(common.documents(spark, sf_dir).select("doc_id", "text", edits.alias("edits"))).withColumnRenamed("n_tokens", "n_before")
    return recount(counted).select("doc_id", "n_before", F.col("n_tokens").alias("n_after"), "n_renewed", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))
