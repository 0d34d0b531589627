"""Phrase collocation mining by Toivonen's method: a sample proposes, full passes count exactly.

A phrase can only be frequent if its parts are. Words and pairs that are frequent in a sample of the documents are the proposal. The full pass counts exactly
every phrase whose parts are all proposed: the proposal itself and its negative border (all words are counted, as nothing is shorter). If a phrase of
the border turns out frequent, the border was too narrow: the proposal grows by what is frequent, and a further full pass counts the phrases
that this adds, until no pass finds any. So counts are exact and complete, whatever the sample holds.

What is proposed goes to the tasks as bitmaps of a fixed size over hashes. A phrase that is let in by a colliding bit is only counted too.
These passes count hashes of phrases, which is never less than the phrases' own counts and moves a third of the bytes; a last pass counts the phrases themselves whose hashes reached the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow.llm import common

#: Kinds of bytes: 0 of a word, 1 blank, 2 end of a piece. [\x20\x09] and [.,;:!?\x0A-\x0D].
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes of text that are counted at a time.
PIECE = 2 << 20
#: Hashes that a task adds up before it passes them on.
HELD = 3 << 20
#: Bits of a bitmap: 8 MB, whatever the input.
BITS = 1 << 26
SAMPLE, SALTS = 0.2, 64
MIX = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0x100000001B3, np.uint64), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of some text: lower-cased, one blank after each, with hashes, and which words follow each other within a piece."""

    def __init__(self, raw: np.ndarray):
        kind = KIND[raw]
        word = np.concatenate([[0], (kind == 0).astype(np.int8), [0]])
        edge = np.diff(word)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = end - start
        self.n, self.at = len(start), np.cumsum(size + 1) - (size + 1)
        self.end = self.at + size
        cuts = np.concatenate([[0], np.cumsum(kind == 2)])
        self.joined = cuts[start[1:]] == cuts[end[:-1]]
        self.data = np.full(int((size + 1).sum()), 32, np.uint8)
        if self.n:
            inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            own = LOWER[raw[np.repeat(start, size) + inside]]
            self.data[np.repeat(self.at, size) + inside] = own
            self.hash = mixed(np.add.reduceat((own.astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[inside], np.cumsum(size) - size))
        else:
            self.hash = np.zeros(0, np.uint64)

    def phrases(self, first: np.ndarray, k: int) -> pa.Array:
        """The phrases of ``k`` words that begin with the words ``first``."""
        a, b = self.at[first], self.end[first + k - 1]
        size = b - a
        offsets = np.concatenate([[0], np.cumsum(size)])
        inside = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], size)
        data = self.data[np.repeat(a, size) + inside]
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def cut(raw: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """``raw`` in parts of about ``most`` bytes, each up to the end of a piece; a longer piece is a part of its own."""
    a = 0
    while a < len(raw):
        b = min(a + most, len(raw))
        while b < len(raw) and not len(ends := np.flatnonzero(KIND[raw[b : b + most]] == 2)):
            b += most
        b = b + int(ends[0]) + 1 if b < len(raw) else len(raw)
        yield raw[a:b]
        a = b


def salted(lang: str) -> np.uint64:
    return mixed(np.array([int.from_bytes(lang.encode()[:8].ljust(8, b"\1"), "little") ^ len(lang)], np.uint64))[0]


#: Bitmaps by the length of phrases; None: no limit.
Bits = dict[int, np.ndarray] | None


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(65 - (8 * len(bits)).bit_length())
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def marked(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes of phrases of ``k`` words, with their length in the two lowest bits."""
    return h & ~np.uint64(3) | np.uint64(k)


def eligible(lang: str, raw: np.ndarray, longest: int, now: Bits, before: Bits) -> Iterator[tuple[Words, int, np.ndarray, np.ndarray]]:
    """(words, length, places of first words, hashes) of one language's text, part by part, for lengths 1 to ``longest``. ``now``: a phrase of several words counts if its
    parts are proposed (None: all are); ``before``: and only if they weren't all proposed then."""
    for part in cut(raw, PIECE):
        w = Words(part)
        h = {1: marked(mixed(w.hash ^ salted(lang)), 1)}
        follows = {1: np.ones(w.n, bool), 2: w.joined, 3: w.joined[:-1] & w.joined[1:]}
        for k in range(1, longest + 1):
            if k > 1:
                h[k] = marked(mixed(h[k - 1][:-1] * np.uint64(3) + h[1][k - 1 :]), k)
            if not len(h[k]):
                break
            chosen = follows[k]
            if k > 1:
                for state, wanted in ((now, True), (before, False)):
                    if state is not None:
                        own = has(state[k - 1], h[k - 1])
                        chosen = chosen & ((own[:-1] & own[1:]) == wanted)
            elif before is not None:
                continue  # the first pass has counted all words
            first = np.flatnonzero(chosen)
            yield w, k, first, h[k][first]


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """Texts of (lang, text) rows, put together by language, an end of a piece between them."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def flush() -> Iterator[tuple[str, np.ndarray]]:
        for lang, own in held.items():
            yield lang, np.frombuffer(b"\n".join(own), np.uint8)
        held.clear()

    for batch in batches:
        raw, offs = common.utf8(batch.column(1))
        data, offs = memoryview(raw), offs.tolist()
        for lang, a, b in zip(batch.column(0).to_pylist(), offs, offs[1:], strict=False):
            held.setdefault(lang, []).append(bytes(data[a:b]))
            size += b - a
        if size >= PIECE:
            yield from flush()
            size = 0
    yield from flush()


def hashes(texts: DataFrame, longest: int, now=None, before=None) -> DataFrame:  # noqa: ANN001
    """h, c: how often a pass over ``texts`` (lang, text) meets each eligible hash. ``now`` and ``before`` are broadcasts of bitmaps by length."""
    common.arrow_rows(texts.sparkSession)
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64())])

    def summed(h: list[np.ndarray], c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        own, at = np.unique(np.concatenate(h), return_inverse=True)
        return own, np.bincount(at, np.concatenate(c), len(own)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (x.value if x is not None else None for x in (now, before))
        h, c, size = [], [], 0
        for lang, raw in by_language(batches):
            for *_, own in eligible(lang, raw, longest, a, b):
                found, times = np.unique(own, return_counts=True)
                h.append(found)
                c.append(times)
                size += len(found)
            if size > HELD:
                one, times = summed(h, c)
                h, c, size = [one], [times], len(one)
                if size > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(times)], schema=schema)
                    h, c, size = [], [], 0
        if h:
            one, times = summed(h, c)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(times)], schema=schema)

    # Tasks have added up what they could: dealt first, and added up after that.
    return texts.mapInArrow(run, "h long, c long").repartition("h").groupBy("h").agg(F.sum("c").alias("c"))


def phrases(texts: DataFrame, likely) -> DataFrame:  # noqa: ANN001
    """lang, k, phrase, c of the phrases whose hashes are in ``likely`` (broadcast of bitmaps by length), exactly. k = 0 has the number of words."""
    common.arrow_rows(texts.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = likely.value
        for lang, raw in by_language(batches):
            for w, k, first, h in eligible(lang, raw, 3, None, None):
                own = w.phrases(first[has(bits[k], h)], k)
                code = pc.dictionary_encode(own)
                c, own = np.bincount(code.indices.to_numpy(), minlength=len(code.dictionary)), code.dictionary
                for length, names, n in [(k, own, c)] + [(0, pa.array([""]), np.array([w.n]))] * (k == 1):
                    yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(n), np.int32))), pa.array(np.full(len(n), length, np.int32)), names.cast(pa.string()), pa.array(n.astype(np.int64))], schema=schema)

    return texts.mapInArrow(run, "lang string, k int, phrase string, c long").groupBy("lang", "k", "phrase").agg(F.sum("c").alias("c"))


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The bits of the hashes ``h`` of a table, ``BITS`` at most: Spark makes them, the driver gets them."""
    at = hashes.select(F.shiftrightunsigned("h", 64 - BITS.bit_length() + 1).alias("at"))
    made = at.groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(0x7FFF))).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in made.toLocalIterator():
        out[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def frequent(docs: DataFrame, least: int = 10, lang_col: str = "lang", text_col: str = "text", sample: float = SAMPLE, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, c of all phrases of 1 to 3 words that occur ``least`` times or more in their language's texts; lang, n of all words). Counts are exact.

    Null text counts as empty, null language as ``und``. Only cost depends on the sample. ``docs`` is read once for the sample
    and once for each full pass: three times at most, as each pass settles one more length, and once more for the phrases.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    # Somewhat more than a phrase of ``least`` has on average: what is missed makes a further pass, what is proposed for nothing a wider border.
    enough = max(2, math.ceil(1.5 * least * sample))
    of = lambda found, *k: {x: bitmap(found.where(F.col("h").bitwiseAND(F.lit(3)) == x)) for x in k}
    seen = common.checkpoint(hashes(texts.where(F.rand(seed) < sample), 2).where(F.col("c") >= enough).select("h"))
    proposal, before, likely = of(seen, 1, 2), None, dict.fromkeys((1, 2, 3), np.zeros(BITS // 8, np.uint8))
    while True:
        sent = spark.sparkContext.broadcast(proposal)
        # The proposal and its border; after the first pass, only what a wider proposal adds.
        found = common.checkpoint(hashes(texts, 3, sent, before).where(F.col("c") >= least).select("h"))
        likely = {k: likely[k] | x for k, x in of(found, 1, 2, 3).items()}
        wider = {k: proposal[k] | likely[k] for k in (1, 2)}
        if all(np.array_equal(wider[k], proposal[k]) for k in (1, 2)):
            break
        before, proposal = sent, wider
    known = common.checkpoint(phrases(texts, spark.sparkContext.broadcast(likely)).where((F.col("k") == 0) | (F.col("c") >= least)))
    return known.where("k > 0"), known.where("k = 0").select("lang", F.col("c").alias("n"))


def part(words: F.Column, first: int, n: int) -> F.Column:
    return F.array_join(F.slice(words, first, n), " ")


def score() -> F.Column:
    """floor(10^6 * a * a / (l * r)) of columns a, l and r up to 10^13, exactly: decimals of up to 35 digits."""
    return F.expr("CAST(a AS decimal(14,0)) * CAST(a AS decimal(14,0)) * CAST(1000000 AS decimal(7,0)) div (CAST(l AS decimal(14,0)) * CAST(r AS decimal(14,0)))")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, inside: int = 50, lang_col: str = "lang", text_col: str = "text", sample: float = SAMPLE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two or three words.

    The score is that of the weakest cut; a phrase goes if a longer one that holds it has ``inside`` percent of its occurrences or more. Ties: more occurrences, then
    the order of UTF-8 bytes. Rows that repeat count each time; an empty table, or texts without a frequent phrase, give no rows; other columns aren't read.
    """
    known, total = frequent(docs, least, lang_col, text_col, sample)
    one = known.select("lang", "phrase", "c")
    words = F.split("phrase", " ")
    cuts = F.when(F.col("k") == 2, F.array(F.struct(F.lit(1).alias("cut"), part(words, 1, 1).alias("left"), part(words, 2, 1).alias("right")))).otherwise(
        F.array(F.struct(F.lit(1).alias("cut"), part(words, 1, 1).alias("left"), part(words, 2, 2).alias("right")), F.struct(F.lit(2).alias("cut"), part(words, 1, 2).alias("left"), part(words, 3, 1).alias("right")))
    )
    cand = known.where("k > 1").select("lang", "phrase", "k", F.col("c").alias("a"), F.explode(cuts).alias("x")).select("lang", "phrase", "k", "a", "x.*")
    cand = cand.join(one.select("lang", F.col("phrase").alias("left"), F.col("c").alias("l")), ["lang", "left"]).join(one.select("lang", F.col("phrase").alias("right"), F.col("c").alias("r")), ["lang", "right"])
    cand = cand.withColumn("score", score())
    best = cand.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    longer = known.where("k = 3").select("lang", F.explode(F.array(part(words, 1, 2), part(words, 2, 2))).alias("phrase"), "c").groupBy("lang", "phrase").agg(F.max("c").alias("most"))
    left = best.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.lit(100) * F.col("most") < F.lit(inside) * F.col("a")))
    left = left.select("lang", "phrase", "a", "b.l", "b.r", "b.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = "ORDER BY score DESC, a DESC, phrase"
    # A language may hold most phrases: the best of each of its shares first.
    shares = left.withColumn("place", F.expr(f"row_number() OVER (PARTITION BY lang, salt {order})")).where(F.col("place") <= top)
    ranked = shares.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.documents(spark, sf_dir))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), lists AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM lists
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM lists WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM lists WHERE len(w) > 2
), f AS (SELECT lang, k, phrase, count(*)::BIGINT AS c FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND c >= 10),
cuts AS (
  SELECT lang, k, phrase, a, w, i AS cut, array_to_string(w[1:i], ' ') AS p, array_to_string(w[i + 1:], ' ') AS q FROM (SELECT *, unnest(range(1, k)) AS i FROM cand)
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.c AS l, y.c AS r, ((1000000::HUGEINT * c.a * c.a) // (x.c::HUGEINT * y.c))::BIGINT AS score, cut
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p AND x.k = cut JOIN f y ON y.lang = c.lang AND y.phrase = c.q AND y.k = c.k - cut
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS most FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM cand WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM cand WHERE k = 3) GROUP BY ALL
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE most IS NULL OR 100 * most < 50 * a
)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
