"""Language ID by averaged hashed subword embeddings with a linear softmax.

Subwords are the 2 to 4 byte pieces of words with their boundaries. A text's vector is the mean of its
subwords' embeddings; both layers are trained by stochastic gradient descent in numpy, on a bounded sample.
As the softmax is linear, a subword adds a fixed amount to each language's score, so that prediction sums one table row per subword.
A temperature and a rejection threshold are fitted on a part of the sample that training doesn't see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismflow.llm import common

UNKNOWN = "und"
SIZES = (2, 3, 4)
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
#: Labelled documents that training may gather, over all languages.
SAMPLE = 1600
DIMENSION, EPOCHS, RATE, BATCH = 16, 12, 40.0, 16
PIECE = 1 << 20

FORM = np.full(256, 32, np.uint8)
FORM[0x41:0x5B] = np.arange(0x61, 0x7B)
FORM[0x61:0x7B] = np.arange(0x61, 0x7B)
FORM[0x80:] = np.arange(0x80, 0x100)
FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))
NEW = (T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType()))


def subwords(data: np.ndarray, m: int) -> Iterator[np.ndarray]:
    """For each size, the bucket of the subword that begins at each of the first m places of data; BUCKETS if none does.

    No subword has a space within it or the zero that ends a text.
    """
    letter, some = data > 32, data > 0
    for n in SIZES:
        h = np.full(m, n, np.uint32)
        for j in range(n):
            h += data[j : j + m] * FACTORS[j]
        h ^= h >> np.uint32(15)
        h *= FACTORS[1]
        h >>= np.uint32(32 - BUCKET_BITS)
        ok = some[:m] & some[n - 1 : n - 1 + m]
        for j in range(1, n - 1):
            ok &= letter[j : j + m]
        if n == 2:
            ok &= letter[:m] | letter[1 : 1 + m]
        h[~ok] = BUCKETS
        yield h


def slices(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """Parts of the texts in common.spaced() form: the bytes, how many places belong to the part, where texts begin in it, which texts."""
    data, ends = common.spaced(raw, offsets, FORM)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    for a in range(0, len(data) - 8, PIECE):
        b = min(a + PIECE, len(data) - 8)
        first = max(0, int(np.searchsorted(begins, a, side="right")) - 1)
        last = int(np.searchsorted(begins, b))
        yield data[a : b + 8], b - a, np.maximum(begins[first:last] - a, 0), np.arange(first, last)


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a letter. Most have one of A-Z, which needs no look at the characters."""
    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    before = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = before[offsets[1:]] > before[offsets[:-1]]
    for k in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[k] = regex.search(r"\p{L}", raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")) is not None
    return out


@dataclass
class Model:
    languages: list[str]
    #: What each bucket adds to each language's score; a last row of zeros for no subword.
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    #: Of the texts that calibration saw: how many, share of wrong predictions, the same of those accepted, and share accepted.
    calibration: tuple[int, float, float, float] = (0, 0.0, 0.0, 1.0)

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        sums, count = np.zeros((n, len(self.languages))), np.zeros(n)
        columns = [np.ascontiguousarray(c) for c in self.table.T]
        for data, m, begins, texts in slices(raw, offsets):
            for h in subwords(data, m):
                count[texts] += np.add.reduceat(h != BUCKETS, begins, dtype=np.int64)
                for k, column in enumerate(columns):
                    sums[texts, k] += np.add.reduceat(column[h], begins)
        return sums / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        letters = has_letter(raw, offsets)
        p = softmax(self.logits(raw, offsets) / self.temperature)
        best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
        score = np.where(letters, p[np.arange(len(p)), best], 0.0)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)], score, letters & (score >= self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
    return e / e.sum(axis=1, keepdims=True) if len(z) else z


def descend(at: list[np.ndarray], weight: list[np.ndarray], y: np.ndarray, languages: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, output weights and bias after EPOCHS passes of stochastic gradient descent with a falling rate, over texts as the
    buckets that they have and their weights."""
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (DIMENSION, languages)).astype(np.float32), np.zeros(languages, np.float32)
    steps, step = EPOCHS * -(-len(at) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(at))
        for k in range(0, len(at), BATCH):
            rows = order[k : k + BATCH]
            rate = 1 - step / steps
            step += 1
            h = np.stack([weight[r] @ e[at[r]] for r in rows])
            g = softmax(h @ w + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            # A text's weight is spread over its subwords, so embeddings take far longer steps than the softmax.
            change = np.float32(RATE * rate) * (g @ w.T)
            w -= np.float32(rate) * (h.T @ g)
            bias -= np.float32(0.1 * rate) * g.sum(axis=0)
            for r, c in zip(rows, change, strict=True):
                e[at[r]] -= weight[r][:, None] * c
    return e, w, bias


def train(docs: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, seed: int = 7) -> Model:
    """A model from about ``sample`` labelled rows of ``docs`` (never more than twice as many), as many of each language as there are.

    Rows without text or label are left out;
    without any, every text is und. One pass reads the labels, one the sampled texts; the driver gets
    the subword counts of the sample only.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([UNKNOWN], np.zeros((BUCKETS + 1, 1), np.float32), np.zeros(1, np.float32))
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, sample / len(languages) / counts[lang]))))
    place = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("id", F.lit(""))), F.lit(1 << 20)) / (1 << 20)
    chosen = rows.withColumn("place", place).where(F.col("place") < F.element_at(share, F.col("lang"))).limit(2 * sample).select("lang", "place", "text")
    common.arrow_rows(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = common.utf8(batch.column(2))
            out = []
            for a, b in zip(offsets, offsets[1:], strict=False):
                total = np.zeros(BUCKETS + 1, np.int64)
                for data, m, _, _ in slices(raw, np.array([a, b])):
                    for h in subwords(data, m):
                        total += np.bincount(h, minlength=BUCKETS + 1)
                at = np.flatnonzero(total[:-1])
                out.append((at.astype("<u2").tobytes(), total[at].astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["lang", "place", "at", "n"])

    found = [r for r in chosen.mapInArrow(count, "lang string, place double, at binary, n binary").collect() if r["at"]]
    found.sort(key=lambda r: (r["lang"], r["place"], bytes(r["at"])))
    y = np.array([languages.index(r["lang"]) for r in found], int)
    at = [np.frombuffer(r["at"], "<u2") for r in found]
    weight = [n / n.sum() for n in (np.frombuffer(r["n"], "<f4") for r in found)]
    rng = np.random.default_rng(seed)
    seen = rng.random(len(found)) < 0.75
    if not seen.any():
        seen[:] = True
    pick = lambda of, which: [of[k] for k in np.flatnonzero(which)]
    e, w, bias = descend(pick(at, seen), pick(weight, seen), y[seen], len(languages), rng)
    model = Model(languages, np.vstack([e @ w, np.zeros((1, len(languages)), np.float32)]), bias)
    if not seen.all():
        calibrate(model, np.stack([n @ e[k] for k, n in zip(pick(at, ~seen), pick(weight, ~seen), strict=True)]) @ w + bias, y[~seen])
    return model


def calibrate(model: Model, z: np.ndarray, y: np.ndarray) -> None:
    """The temperature of least log loss, and the threshold that leaves the fewest mistakes: wrong predictions that are accepted and right ones that are rejected.

    Of equally good ones the one that rejects least is taken, a quarter of the way from the last score that goes (that of a guess, if none does) to the first that stays: few
    texts calibrate, and others that are less certain than any right one of them should stay.
    """
    loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.2, 5, 60), key=loss))
    p = softmax(z / model.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(score, kind="stable")
    s, r = score[order], right[order]
    # With the threshold at place k, what comes before it is rejected.
    cost = np.concatenate([[0], np.cumsum(r)])[:-1] + np.cumsum(~r[::-1])[::-1]
    cost[1:][s[1:] == s[:-1]] = len(s) + 1  # equal scores stay together
    k = int(np.argmin(cost))
    model.threshold = float(0.25 * s[k] + 0.75 * (s[k - 1] if k else min(s[0], 1 / z.shape[1])))
    kept = score >= model.threshold
    model.calibration = (len(y), float((~right).mean()), float((~right[kept]).mean()), float(kept.mean()))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred, score and accepted, from the whole text alone.

    A text without a letter, or null, is und with score 0 and is not accepted. accepted: score reaches the calibrated threshold.
    ``keep``: the columns that go on (None: all); columns with a new one's name are replaced. No row is dropped.
    """
    common.arrow_rows(docs.sparkSession)
    kept, _ = common.extended(docs, *NEW)
    kept = [c for c in kept if keep is None or c in keep]
    own = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = common.utf8(batch.column(text_at))
            for a, b in common.pieces(offsets, PIECE):
                lang, score, accepted = own.value.predict(raw[: offsets[b]], offsets[a : b + 1]) if a == 0 else own.value.predict(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(batch.schema.names.index(c)) for c in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=[*kept, *(f.name for f in NEW)])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *NEW]))


def held_out(id_col: str = "doc_id") -> F.Column:
    """A quarter of the documents, by crc32 of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is accepted."""
    model = train(docs.where(~held_out()))
    own, back = common.aside(docs, *(f.name for f in NEW))
    return back(predict(own, model).where("accepted"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
