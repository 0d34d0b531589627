"""Hard negatives, collocations and the Jaccard join against brute force, over cases made to be awkward."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from prismflow.llm import collocations, jaccard, negatives


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# Hard negatives.

VECTORS = "vec_id long, embedding array<float>, label int, id string, row_id int, score string"


def vectors(n=420, width=9, seed=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, width))
    rows = []
    for k in range(n):
        v = middle[k % 5] + rng.normal(size=width) * 0.3
        rows.append((k, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rng.integers(0, 3))))
    rows += [(1000, rows[7][1], 0), (1001, rows[7][1], 1), (1001, rows[7][1], 1), (1100, [0.0] * width, 1), (1200, [1.0, 0.5], 2), (1300, [], 0), (1400, [3e4] * width, 1)]
    rows += [(1500, None, 1), (1600, [1.0, None] + [0.0] * (width - 2), 1), (1700, [float("nan")] * width, 1), (1800, [float("inf")] * width, 1), (1900, rows[3][1], None), (None, rows[3][1], 1)]
    return rows


def brute_negatives(rows, anchor, positives=5, negatives=10, low=30, high=90, scale=256):
    own = [(i, k, label, [math.floor(scale * x) for x in v]) for i, (k, v, label) in enumerate(rows) if k is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=False))
    out = []
    for i, k, label, v in own:
        if anchor(k):
            scored = sorted((-dot(v, w), j, m) for n, j, m, w in own if n != i)
            for p, j, m in [x for x in scored if x[2] == label][:positives]:
                good = [x for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p][:negatives]
                out += [(k, j, r + 1, x[1], -p, -x[0]) for r, x in enumerate(good)]
    return sorted(out)


def mined(spark, rows, anchor=F"id % 20 = 0", **more):
    df = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], VECTORS).repartition(3)
    got = negatives.mine(df, negatives.F.expr(anchor), **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def test_negatives_equal_brute_force(spark, monkeypatch):
    rows = vectors()
    want = brute_negatives(rows, lambda k: k % 20 == 0)
    assert mined(spark, rows) == want and len(want) > 300
    monkeypatch.setattr(negatives, "ROWS", 50)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "WINDOW", 8)
    assert mined(spark, rows) == want
    assert mined(spark, rows, positives=2, negatives=3, low=10, high=60) == brute_negatives(rows, lambda k: k % 20 == 0, 2, 3, 10, 60)
    assert mined(spark, rows[:0]) == [] and mined(spark, [(0, [1.0], 1)]) == []


def test_scores_beyond_doubles(spark):
    rows = [(0, [3e6] * 4, 0), (1, [3e6, 3e6, 3e6, 2.99e6], 0), (2, [1e6, 1e6, 2e6, 1e6 + 0.25], 1), (3, [1e6, 1e6, 2e6, 1e6], 1)]
    assert mined(spark, rows, "id = 0") == brute_negatives(rows, lambda k: k == 0) != []


def test_windows_out_of_reach_are_not_scored():
    """Clustered vectors: most windows of a block can't hold a positive, and bounds are never too narrow."""
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(16, 24))
    of = np.repeat(np.arange(16), 128)
    v = np.floor(256 * (middle[of] + 0.05 * rng.normal(size=(len(of), 24)))).astype("i4")
    directions = middle / np.linalg.norm(middle, axis=1, keepdims=True)

    def block(at):
        n = np.arange(len(at)).astype(np.int64)
        return negatives.Block(len(at), {"v": v[at].tobytes(), "angles": negatives.angles(v[at], directions).tobytes(), "label": np.zeros(len(at), np.int64).tobytes(), "row_id": at.astype(np.int64).tobytes(), "id": n.tobytes()}, "i4")

    rows, anchors = block(np.arange(len(of))), block(np.arange(5, len(of), 200))
    every = np.iinfo(np.int64)
    counts = np.zeros(2, np.int64)
    a, _, s, j = negatives.best(anchors, rows, [(np.full(anchors.n, every.min), np.full(anchors.n, every.max))], 5, True, counts)
    assert counts[0] < counts[1] / 2
    whole = anchors.v.astype(np.int64) @ rows.v.astype(np.int64).T
    whole[np.arange(anchors.n), np.arange(5, len(of), 200)] = every.min
    for k in range(anchors.n):
        assert sorted(s[a == k].tolist()) == sorted(np.sort(whole[k])[-5:].tolist())
    lo, hi = negatives.bounds(anchors.angles, anchors.norm, rows.angles.min(axis=0), rows.angles.max(axis=0), rows.norm.min(), rows.norm.max())
    real = anchors.v.astype(np.int64) @ rows.v.astype(np.int64).T
    assert (real >= lo[:, None]).all() and (real <= hi[:, None]).all()


# Collocations.

TEXTS = "lang string, text string, n long, k int, h string, phrase string"


def brute_collocations(rows, least=10, top=2000, inside=50):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in (1, 2, 3):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    cand = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    out = []
    for lang in total:
        own = []
        for p, a in cand.items():
            if p[0] == lang and not (len(p) == 3 and any(100 * b >= inside * a for q, b in cand.items() if len(q) == 4 and q[0] == lang and p[1:] in (q[1:3], q[2:4]))):
                score, _, l, r = min(((10**6 * a * a) // (counts[p[: c + 1]] * counts[(lang, *p[c + 1 :])]), c, counts[p[: c + 1]], counts[(lang, *p[c + 1 :])]) for c in range(1, len(p) - 1))
                own.append((-score, -a, " ".join(p[1:]).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(own)[:top])]
    return sorted(out)


def texts():
    rng = random.Random(3)
    words = ["New", "York", "state", "the", "of", "é", "日本", "x1", "\x00z", "a-b"]
    rows = [(rng.choice(["en", "fr", None, "und"]), rng.choice([" ", "\t", "  "]).join(rng.choice(words) for _ in range(rng.randint(0, 30))) + rng.choice([".", "\n", "", "!?", " , "]) + " New York state " * rng.randint(0, 2)) for _ in range(160)]
    return rows + [("en", None), ("en", ""), (None, " \t"), ("de", ".,;"), ("en", "new york\x0bnew york\x0cnew york")] + [("en", "same text here")] * 12 + [("en", "q " * 30_000), ("fr", "longword" * 5000 + " end")]


def mined_phrases(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2, "a", "b") for r in rows], TEXTS).repartition(5)
    return sorted(tuple(r) for r in collocations.collocations(df, **more).collect())


@pytest.mark.parametrize("sample", [0.0, 0.2, 1.0])
def test_collocations_whatever_the_sample(spark, monkeypatch, sample):
    """No sample makes everything a border failure, so that further passes have to find all."""
    monkeypatch.setattr(collocations, "PIECE", 1 << 12)
    monkeypatch.setattr(collocations, "HELD", 100)
    rows = texts()
    want = brute_collocations(rows)
    assert mined_phrases(spark, rows, sample=sample) == want and len(want) > 60
    if sample == 0.2:
        assert mined_phrases(spark, rows, least=3, top=7, inside=90) == brute_collocations(rows, 3, 7, 90)
        assert mined_phrases(spark, rows[:0]) == [] and mined_phrases(spark, [("en", None)]) == []


def test_full_bitmaps_only_cost(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BITS", 1 << 15)
    rows = texts()
    assert mined_phrases(spark, rows) == brute_collocations(rows)


def test_scores_of_large_counts(spark):
    a, l, r = 9_000_000_000_000, 9_999_999_999_999, 9_876_543_210_987
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    assert df.select(collocations.score().alias("s")).first()["s"] == 10**6 * a * a // (l * r)


# Jaccard join.

DOCS = "doc_id long, text string, n string, token int, component string, c string"


def shingled(text, size=5):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", lower(text)) if w]
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_near(rows, size=5, percent=80):
    sets = [shingled(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted(((k, len(sets[i]), least.get(root(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=repr)


def near_texts(seed=0):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    rows = []
    shared = [word() for _ in range(60)]
    for g in range(25):
        base = [word() for _ in range(rng.choice([3, 5, 6, 12, 40, 90, 200]))] + (shared if g % 4 == 0 else [])
        for _ in range(rng.choice([1, 1, 2, 5, 14])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(own)))
    # Copies with single words changed: alike their model, some not each other, in a long list.
    base = [f"b{k}" for k in range(120)]
    for k in range(60):
        own = list(base)
        for _ in range(k % 4):
            own[rng.randrange(120)] = f"n{k}"
        rows.append((len(rows) + 1000, " ".join(own)))
    rows += [(5000, None), (5001, ""), (5002, " \n\x0b"), (5003, "One"), (5004, "one"), (5005, "one two"), (5006, rows[0][1]), (5006, rows[0][1]), (None, rows[0][1]), (None, "nobody has this"), (5007, "x " * 20_000), (5008, " ".join(f"v{k}" for k in range(30_000))), (5009, " ".join(f"v{k}" for k in range(29_000)))]
    rng.shuffle(rows)
    return rows


def near(spark, rows, **more):
    df = spark.createDataFrame([(*r, "a", 1, "b", "c") for r in rows], DOCS).repartition(4)
    got = jaccard.near_groups(df, **more)
    assert got.columns == ["row_id", "doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r)[1:] for r in got.collect()), key=repr)


def test_near_groups_equal_brute_force(spark):
    rows = near_texts()
    want = brute_near(rows)
    assert near(spark, rows) == want and len({x[2] for x in want}) < len(rows) - 60
    assert near(spark, rows[:0]) == [] and near(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("hubs,counters", [(0, 1 << 20), (1, 64)])
def test_near_groups_without_hubs_or_rarity(spark, monkeypatch, hubs, counters):
    """Results don't depend on hubs, nor on what is taken to be rare; with few counters all shingles are common."""
    monkeypatch.setattr(jaccard, "HUBS", hubs)
    monkeypatch.setattr(jaccard, "SEEN", 3)
    monkeypatch.setattr(jaccard, "COUNTERS", counters)
    rows = near_texts(1)
    assert near(spark, rows, size=3, percent=70) == brute_near(rows, 3, 70)


def test_near_copies_are_verified_in_proportion(spark, monkeypatch):
    """A group of near copies takes about as many verified pairs as it has members, not all its pairs."""
    seen = []
    real = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *more: (seen.append(pairs.count()), real(pairs, *more))[1])
    rng = random.Random(2)
    base = [f"b{k}" for k in range(300)]
    rows = []
    for k in range(200):
        own = list(base)
        own[rng.randrange(300)] = f"n{k}"
        rows.append((k, " ".join(own)))
    assert {x[2] for x in near(spark, rows)} == {0}
    assert sum(seen) < 12 * len(rows)


def test_lists_go_on_only_with_groups_that_may_be_alike(spark, monkeypatch):
    """Texts that share a passage but differ too much in size meet in lists; these don't leave their buckets, and no pair is looked at."""
    lists = []
    real = jaccard.common.checkpoint

    def checkpoint(df):
        out = real(df)
        if "token" in out.columns:
            lists.append(out.count())
        return out

    monkeypatch.setattr(jaccard.common, "checkpoint", checkpoint)
    monkeypatch.setattr(jaccard, "COUNTERS", 64)
    rows = []
    for k in range(40):
        shared = [f"s{k}x{i}" for i in range(60)]
        rows += [(2 * k + j, " ".join(shared + [f"r{k}x{j}x{i}" for i in range(40 + 100 * j)])) for j in range(2)]
    assert near(spark, rows) == brute_near(rows)
    assert lists and sum(lists) == 0


def test_hashed_shingles_are_those_of_texts():
    """Equal sets of shingles have equal hashes and others don't, whatever the white space, the case, the batch and the length of words."""
    texts = [x for _, x in near_texts()] + ["a b", "b a", "ab", "a  B\n", "\x00 a\x0bb", "é 日本 x", "É 日本 x", "a b c d e", "A b c d e f", "", None, "y" * 300_000 + " a b c d e " + "z" * 700_000 + " q", "y" * 300_000]
    for size in (5, 3):
        sets = [frozenset(shingled(x, size)) for x in texts]
        got = [h.tobytes() for h in jaccard.sets_in(jaccard.pa.array(texts), size)]
        assert [len(h) // 8 for h in got] == [len(x) for x in sets]
        assert len(set(zip(sets, got, strict=True))) == len(set(sets)) == len(set(got))
