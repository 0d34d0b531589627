"""Secret scans: candidates by pattern, and a random forest that removes false positives.

The forest sees a candidate's length, its character transitions, how much of it dictionary words cover, the kind of path it comes
from and the words next to it. It is grown in numpy from labelled findings of a bounded sample of documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow.llm import common

#: A candidate: 16 or more characters of keys and encodings, with no name and '=' before them.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![A-Za-z0-9+/_=-])")
#: A name of a secret up to the value that it gets.
NAMED = r"""(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|credential|auth|access[_-]?key|private[_-]?key)[A-Za-z0-9_.-]{0,24}["']?[ \t]{0,8}(?:=>|:=|[=:])[ \t]{0,8}(?:(?:bearer|basic|token)[ \t]+)?["']?"""
#: Such a value may be shorter and have other signs: up to its quote, or to a blank.
ASSIGNED = re.compile(NAMED + r"""(?:(?<=")([^"\s]{6,})|(?<=')([^'\s]{6,})|(?<!["'])([^\s"',;()]{6,}))""", re.I)
#: Keys that show by themselves what they are; a JWT is one with all its parts.
KEYS = re.compile(r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{16,}|github_pat_\w{20,}|xox[abeprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{10,}|AIza[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_=-]{4,}){1,4})")
#: Names and marks next to a secret, and next to what only looks like one (fixed values).
KEYWORDS = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access", "private", "credential", "auth", "bearer")
OTHERWISE = ("sha1", "sha256", "md5", "commit", "checksum", "digest", "uuid", "example", "sample", "dummy", "test", "href", "src")
#: Words that make a key an example, wherever they stand.
MADE_UP = ("example", "dummy")
#: Names with dots (hosts, files): words in them say nothing about a key next to them.
DOTTED = re.compile(r"[\w-]+(?:\.[\w-]+)+")
PREFIXES = ("AKIA", "ASIA", "gho_", "ghp_", "ghr_", "ghs_", "ghu_", "github_pat_", "xox", "sk_live_", "rk_live_", "eyJ", "AIza")
NEAR = 40
#: Documents from which training takes findings, findings, dictionary words, and made lines of each form, at most.
SAMPLE, FINDINGS, WORDS, MADE = 4000, 20_000, 3000, 40
TREES, DEPTH, LEAVES = 40, 8, 3
KINDS = 5  # lower, upper, digit, sign, none


def kinds(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    return np.select([(b >= 97) & (b <= 122), (b >= 65) & (b <= 90), (b >= 48) & (b <= 57)], [0, 1, 2], 3)


def said(text: str, words: tuple[str, ...]) -> bool:
    """Whether ``text`` has one of ``words`` as a word of its own, or as a part between signs, outside names with dots."""
    return re.search(rf"(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])", DOTTED.sub(" ", text.lower())) is not None


def features(text: str, start: int, end: int, path: str, words: frozenset[str]) -> list[float]:
    own = text[start:end]
    k = kinds(own)
    moves = np.bincount(k[:-1] * 4 + k[1:], minlength=16) / (len(k) - 1)
    count = Counter(own)
    p = np.array(list(count.values())) / len(own)
    low = own.lower()
    covered, at = 0, 0
    while at < len(low):
        n = next((n for n in range(min(12, len(low) - at), 2, -1) if low[at : at + n] in words), 0)
        covered += n
        at += n or 1
    before, after = text[max(0, start - NEAR) : start].lower(), text[end : end + NEAR].lower()
    near = before + " " + after
    return [
        len(own), float(-(p * np.log2(p)).sum()), *moves.tolist(), *(np.bincount(k, minlength=4) / len(k)).tolist(), covered / len(own),
        sum(c in "0123456789abcdefABCDEF" for c in own) / len(own), own.startswith(PREFIXES), own.endswith("="),
        before.endswith(('"', "'")) and after[:1] in ('"', "'"), bool(re.search(r"[=:]\s*[\"']?$", before)), any(w in before for w in KEYWORDS), said(near, OTHERWISE),
        bool(re.search(r"\.(py|js|java|go|env|ya?ml|json|conf)$|/src/|code", path)), bool(re.search(r"test|example|doc", path)),
    ]


N_FEATURES = len(features("x" * 16, 0, 16, "", frozenset()))


@dataclass
class Tree:
    """Split feature (-1: leaf), split value, left child (right one follows), and share of secrets of each node."""

    split: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    share: list[float] = field(default_factory=list)

    def add(self, share: float) -> int:
        for x, v in ((self.split, -1), (self.value, 0.0), (self.left, -1), (self.share, share)):
            x.append(v)
        return len(self.split) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        split, value, left, share = map(np.array, (self.split, self.value, self.left, self.share))
        node = np.zeros(len(x), int)
        for _ in range(DEPTH):
            inner = np.flatnonzero(split[node] >= 0)
            if not len(inner):
                break
            n = node[inner]
            node[inner] = left[n] + (x[inner, split[n]] > value[n])
        return share[node]


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> Tree:
    """A tree on a bootstrap sample, by Gini impurity over a random choice of features at each node."""
    tree = Tree()
    todo = [(tree.add(float(y.mean())), np.arange(len(y)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        own = y[rows]
        if depth == DEPTH or len(rows) < 2 * LEAVES or own.min() == own.max():
            continue
        best = None
        for f in rng.choice(x.shape[1], int(np.ceil(np.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, ones = x[rows, f][order], np.cumsum(own[order])
            n = np.arange(1, len(v))
            ok = (v[1:] > v[:-1]) & (n >= LEAVES) & (len(v) - n >= LEAVES)
            if ok.any():
                a, b = ones[:-1], ones[-1] - ones[:-1]
                m = len(v) - n
                impurity = np.where(ok, a * (n - a) / n + b * (m - b) / m, np.inf)
                k = int(impurity.argmin())
                if best is None or impurity[k] < best[0]:
                    best = (impurity[k], int(f), float((v[k] + v[k + 1]) / 2))
        if best:
            go = x[rows, best[1]] > best[2]
            parts = [rows[~go], rows[go]]
            children = [tree.add(float(y[p].mean())) for p in parts]
            tree.split[node], tree.value[node], tree.left[node] = best[1], best[2], children[0]
            todo += [(c, p, depth + 1) for c, p in zip(children, parts, strict=True)]
    return tree


@dataclass
class Forest:
    trees: list[Tree]
    words: frozenset[str] = frozenset()

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0) if self.trees else np.zeros(len(x))


def fit(x: np.ndarray, y: np.ndarray, words: frozenset[str], seed: int = 11) -> Forest:
    if not len(y):
        return Forest([], words)
    rng = np.random.default_rng(seed)
    draw = [rng.integers(0, len(y), len(y)) for _ in range(TREES)]
    return Forest([grow(x[d], y[d], rng) for d in draw], words)


def stand_in_label(before: str, own: str, after: str) -> bool:
    """The label of a finding where the tables have none: a key of a known form, or a value that is assigned to a name like token or
    password and mixes letters with digits or signs, which isn't called an example."""
    mixed = re.search("[A-Za-z]", own) and re.search("[0-9!@#$%^&*]", own)
    return bool(KEYS.match(own) or (mixed and re.search(NAMED + "$", before, re.I))) and not said(before + " " + after, MADE_UP)


def made(seed: int, rounds: int = MADE) -> list[tuple[str, str, bool]]:
    """Lines, a value in each, and whether it is a secret: labelled by how they were made, not by a pattern. A sample of documents may have few of these forms."""
    rng = np.random.default_rng(seed)
    draw = lambda of, n: "".join(rng.choice(list(of), int(n)))
    pick = lambda *of: of[rng.integers(len(of))]
    digits, lower, hexa = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    every = digits + lower + lower.upper()
    out = []
    for _ in range(rounds):
        secrets = [
            (pick("password", "db_passwd", "client_secret", "PASSWORD", "user.pwd"), draw(lower + digits, 6) + pick(*digits) + draw(every + "!@#$%", rng.integers(4, 12))),
            (pick("API_TOKEN", "apiKey", "AUTH_TOKEN", "access_key", "private_key"), draw(every, rng.integers(16, 48))),
            (pick("secret", "api_key", "session_secret"), draw(hexa, pick(32, 40, 64))),
            ("aws_secret_access_key", draw(every + "+/", 40)),
        ]
        put = lambda: pick("{}={}", '{} = "{}"', "{}: '{}'", '"{}": "{}"', "export {}={}", "{} := {}")
        out += [(put().format(name, value), value, True) for name, value in secrets]
        some = pick(every, every, hexa + "ABCDEF")  # keys may look like digests but for their beginning
        keys = [f"AKIA{draw(digits + lower.upper(), 16)}", f"ghp_{draw(some, 36)}", f"gho_{draw(some, 36)}", f"xoxb-{draw(digits, 11)}-{draw(some, 24)}", f"sk_live_{draw(some, 24)}", f"eyJ{draw(every, 20)}.eyJ{draw(every, 30)}.{draw(every, 43)}"]
        out += [(pick("{}", "see {} there", "with {} now", "Authorization: Bearer {}", "key {}").format(key), key, True) for key in keys]
        uuid = "-".join(draw(hexa, n) for n in (8, 4, 4, 4, 12))
        others = [
            (pick("commit {}", "merged {} today", "at revision {}"), draw(hexa, 40)), (pick("sha256: {}", "checksum {}", "digest={}"), draw(hexa, 64)), (pick("md5 {}", "etag {}"), draw(hexa, 32)),
            (pick("uuid {}", "id={}", "request {} done"), uuid), (pick("src=data/{}", "image {}"), draw(every + "+/", 60)), (pick("href=/a/{}", "path {}"), f"{draw(lower, 9)}/{draw(lower, 9)}/{draw(lower, 6)}"),
            (pick("id = {}", "order {}"), draw(digits, 18)), (pick("class {}", "def {}"), "".join(draw(lower, 6).title() for _ in range(3))), (pick("call {}", "{} is set"), "_".join(draw(lower, 6) for _ in range(4))),
            *((pick('example_token = "{}"', "example secret = '{}'", "sample password={}", "dummy api_key: {}", 'dummy_token = "{}"', "test_api_key={}"), draw(pick(every, hexa), pick(20, 24, 32, 40))) for _ in range(3)), (pick("password = {}", "token: {}", "secret={}"), pick("changeme", "required", "environment", "placeholder", "undefined", "hidden_field")),
        ]
        out += [(line.format(value), value, False) for line, value in others]
    return out


def findings_of(lines: list[tuple[str, str, bool]], words: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates that are the labelled values; other candidates of a line count as none."""
    x, y = [], []
    for text, value, label in lines:
        for a, b in find(text):
            if text[a:b] == value:
                x.append(features(text, a, b, "", words))
                y.append(float(label))
    return np.array(x, float).reshape(-1, N_FEATURES), np.array(y, float)


def measured(forest: Forest, lines: list[tuple[str, str, bool]], least: float = 0.5) -> tuple[float, float]:
    """Precision and recall on labelled lines; a secret that is no candidate is missed."""
    x, y = findings_of(lines, forest.words)
    said = forest.predict(x) >= least
    hit = float((said & (y == 1)).sum())
    return hit / max(1.0, float(said.sum())), hit / max(1, sum(label for *_, label in lines))


def find(text: str) -> Iterator[tuple[int, int]]:
    """Candidates in order, none over another: values of names first, then keys of known forms, then what else looks like one."""
    taken: list[tuple[int, int]] = []
    for m in ASSIGNED.finditer(text):
        a, b = m.span(m.lastindex)
        key = next((k.span() for k in KEYS.finditer(text, a, b) if k.start() > a), None) if m.lastindex == 3 else None
        taken.append((a, b) if key is None else key)
    for pattern in (KEYS, CANDIDATE):
        before, k = taken, 0
        taken = []
        for m in pattern.finditer(text):
            while k < len(before) and before[k][1] <= m.start():
                taken.append(before[k])
                k += 1
            if k == len(before) or before[k][0] >= m.end():
                taken.append(m.span())
        taken += before[k:]
    return iter(taken)


def train(docs: DataFrame, label=stand_in_label, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", sample: int = SAMPLE, findings: int = FINDINGS, seed: int = 11, dictionary: int = WORDS) -> Forest:
    """A forest from the labelled candidates of about ``sample`` documents (at most twice as many, ``findings`` candidates, and ``dictionary`` words of these), and from made() lines.

    ``label`` says whether a candidate with NEAR characters on both sides is a secret. Null texts have no candidates. The sample is drawn by id and text, so that null ids or one id for all don't matter;
    documents without candidates, or no documents, leave the made() lines to learn from.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"))
    n = rows.select("id").count()
    place = F.pmod(F.xxhash64(F.lit(seed), "id", "text"), F.lit(1 << 20)) / (1 << 20)
    chosen = rows.where(place < min(1.0, sample / max(n, 1))).limit(2 * sample)
    known = chosen.select(F.explode(F.expr(r"regexp_extract_all(lower(text), '[a-z]{3,12}', 0)")).alias("word")).groupBy("word").count().orderBy(F.desc("count"), "word").limit(dictionary)
    words = frozenset(r["word"] for r in known.collect())
    common.arrow_rows(docs.sparkSession)
    seen = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text, path in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "path")), strict=True):
                out = [(k, a, features(text, a, b, path, seen.value), label(text[max(0, a - NEAR) : a], text[a:b], text[b : b + NEAR])) for a, b in find(text)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.list_(pa.float64()), pa.bool_()), strict=True)], names=["id", "at", "x", "y"])

    found = chosen.mapInArrow(run, "id string, at long, x array<double>, y boolean").orderBy(F.xxhash64("id", "at"), "id", "at").limit(findings).collect()
    x, y = findings_of(made(seed), words)
    return fit(np.concatenate([np.array([r["x"] for r in found], float).reshape(-1, N_FEATURES), x]), np.concatenate([np.array([r["y"] for r in found], float), y]), words, seed)


def scan(docs: DataFrame, forest: Forest, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, at (code points before it), length, score and secret (score reaches ``least``) for each candidate in the whole texts of ``docs``.

    Null and empty texts have none; each row's candidates count, also where rows repeat. Nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"))
    common.arrow_rows(docs.sparkSession)
    own = docs.sparkSession.sparkContext.broadcast(forest)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, x = [], []
            for k, (text, path) in enumerate(zip(batch.column("text").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                for a, b in find(text or ""):
                    out.append((k, a, b - a))
                    x.append(features(text, a, b, path, own.value.words))
            if out:
                score = own.value.predict(np.array(x, float))
                own_row, at, length = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own_row)), pa.array(at, pa.int64()), pa.array(length, pa.int64()), pa.array(score), pa.array(score >= least)], names=["doc_id", "at", "length", "score", "secret"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, at long, length long, score double, secret boolean")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    seen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(True))
    return scan(docs, train(docs.where(seen)))
