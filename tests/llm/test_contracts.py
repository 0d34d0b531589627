"""The numbered queries against brute force, over a small table and over cases made to be awkward."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

from prismflow.llm import bpe, common, decontaminate, exact, graph, langid, repeats, simhash

AWKWARD = [
    (900, None), (901, ""), (902, "   \n\t"), (903, "a"), (904, "!!! 123 ???"), (905, "x " * 3000), (906, "The cat's hat, isn't it?  <|endoftext|> ok"),
    (907, "日本語のテキスト 𝔘 ǅ"), (908, "The cat's hat, isn't it?  <|endoftext|> ok"), (908, "The cat's hat, isn't it?  <|endoftext|> ok"), (None, "no id here"), (909, "q" * 5000),
]
SCHEMA = "doc_id long, text string, n_words string, row_id int, fp string, score string"


@pytest.fixture(scope="module")
def rows(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)) + AWKWARD


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA).repartition(5).write.parquet(path, mode="overwrite")
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def test_exact_groups(docs, rows, empty):
    own = defaultdict(list)
    for k, t in rows:
        own[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), k is None, k))
    want = []
    for n, g in own.items():
        best = min(g)
        want += [(k, best[2], len(g), sha(n.encode())) for _, _, k in g]
    got = exact.exact_groups(docs)
    assert bag(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
    assert got.where("kept").count() == len(own)
    assert got.where("kept and not doc_id <=> keep_id").count() == 0
    # The same with all groups cold, and with all groups hot.
    for heavy, tracked in ((1, 8), (1000, 4096)):
        assert bag(exact.exact_groups(docs, heavy=heavy, tracked=tracked), "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(own)
    assert exact.exact_groups(empty).count() == 0 and exact.drop_copies(empty).count() == 0


def test_bpe(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = []
    for k, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((k, len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    got = [(r[0], r[1], bytes(r[2]), r[3]) for r in bpe.encode(docs, keep=["doc_id"]).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(d == (x or "") for (_, x), (_, _, _, d) in zip(rows, want, strict=True))
    assert bpe.encode(empty).count() == 0


def test_pre_tokens_of_every_character():
    pre, find = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer, bpe.pre_token_pattern().findall
    for start in range(0, 0x110000, 32):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)} " for c in range(start, start + 32) if not 0xD800 <= c < 0xE000)
        at, want = 0, [x[1] for x in pre.pre_tokenize_str(text)]
        for m, span in zip(find(text), want, strict=True):
            assert (at, at + len(m)) == span, hex(start)
            at += len(m)


def brute_search(rows, items):
    wins = defaultdict(set)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    for k, t in items:
        w = word.findall(lower(t))
        for i in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[i : i + 10])].add(str(k))
    sizes, out = {len(w) for w in wins}, []
    for k, t in rows:
        w = word.findall(lower(t))
        hit, got = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := wins.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    got |= own
        out.append((k, len(w), len(hit), sorted(got)))
    return sorted(out, key=repr)


def test_decontamination(spark, docs, rows, empty, sf_dir):
    t = pq.read_table(f"{sf_dir}/benchmark.parquet")
    items = [*zip(t["item_id"].to_pylist(), t["text"].to_pylist(), strict=True), (77, "cat"), (78, "Hat isn"), (78, "Hat isn"), (79, None), (80, "  "), (81, "x x x x x x x x x x x x"), (82, "日本語のテキスト"), (None, "a")]
    frame = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, n_words string")
    want = brute_search(rows, [x for x in items if x[0] is not None])
    assert sum(bool(w[3]) for w in want) > 3
    for most in (decontaminate.PATTERN_BYTES, 20_000):  # one pass, and several
        got = decontaminate.search(docs, frame, keep=["doc_id"], pattern_bytes=most)
        assert bag(got, "doc_id", "n_words", "n_hit", "hit_items") == want
    clean = decontaminate.drop_contaminated(docs, frame)
    assert clean.columns == docs.columns and clean.count() == sum(not w[3] for w in want)
    assert decontaminate.search(empty, frame).count() == 0
    assert decontaminate.search(docs, frame.limit(0), keep=["doc_id"]).where("size(hit_items) > 0").count() == 0


def brute_fingerprint(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_simhash(docs, rows, empty):
    fp = [(k, brute_fingerprint(t)) for k, t in rows]
    distinct = sorted({f for _, f in fp})
    part = brute_components([(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 4], distinct)
    least = {}
    for k, f in fp:
        if k is not None:
            least[part[f]] = min(k, least.get(part[f], k))
    want = sorted(((k, f, least.get(part[f])) for k, f in fp), key=repr)
    got = sorted(((r[0], r[1] & (1 << 64) - 1, r[2]) for r in simhash.near_groups(docs).select("doc_id", "fp", "component_id").collect()), key=repr)
    assert got == want
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(part.values()))
    assert simhash.near_groups(empty).count() == 0


def test_links_find_every_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    made = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, n, replace=False)) for b in base for n in range(7)]
    fps = sorted({np.uint64(x).astype(np.int64).item() for x in made})
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == brute_components([p for p in pairs if p[0] != p[1]], nodes)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_id(spark, sf_dir, docs, rows, empty):
    full = common.documents(spark, "/root/testdata/sf0.01")
    model = langid.train(full.where(~langid.held_out()))
    got = langid.predict(full.where(langid.held_out()), model)
    assert got.where("lang = lang_pred").count() > 0.98 * got.count()
    assert got.where("not accepted").count() < 0.01 * got.count()
    own = {r["doc_id"]: r for r in langid.predict(docs, model, keep=["doc_id"]).collect()}
    assert all((own[k]["lang_pred"], own[k]["score"], own[k]["accepted"]) == ("und", 0.0, False) for k in (900, 901, 902, 904))
    assert own[907]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in own.values())
    assert langid.predict(empty, model).count() == 0
    none = langid.train(full.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}


def test_language_scores_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b"], np.vstack([rng.normal(size=(langid.BUCKETS, 2)), np.zeros((1, 2))]).astype(np.float32), np.zeros(2, np.float32))
    texts = [b"one two three " * 50, b"", "für élan".encode(), b"x"]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = model.logits(raw, offsets)
    monkeypatch.setattr(langid, "PIECE", 64)
    assert np.allclose(whole, model.logits(raw, offsets), atol=1e-4)


def brute_repeats(texts, depth):
    seen = defaultdict(int)
    for t in texts:
        for i in range(len(t) - depth + 1):
            seen[t[i : i + depth]] += 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - depth + 1):
            if seen[t[i : i + depth]] > 1:
                gone[i : i + depth] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), kept))
    return out


def test_repeats(docs, rows, empty):
    want = sorted(((k, *x) for (k, _), x in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], 200), strict=True)), key=repr)
    assert sum(0 < w[2] < w[1] for w in want) > 3
    got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in repeats.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()), key=repr)
    assert got == want
    assert repeats.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("block", [20_000, 1])
def test_repeats_with_many_extents(spark, block, monkeypatch, tmp_path):
    rng = np.random.default_rng(11)
    word = lambda n, letters="abcd": "".join(rng.choice(list(letters), n))
    passage, other = word(150), word(420)
    texts = [word(int(rng.integers(0, 90))) + passage[int(rng.integers(0, 40)) :] + word(int(rng.integers(0, 90))) + (other[int(rng.integers(0, 200)) : int(rng.integers(210, 420))] if i % 3 else "") for i in range(60)]
    texts += ["ab" * 200, "x" * 700, word(300) * 2, "", "é" * 99, "é" * 100]
    want = sorted((i, *x) for i, x in enumerate(brute_repeats([t.encode() for t in texts], 64)))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    got = sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in repeats.remove_repeats(spark.read.parquet(str(tmp_path / "t")), depth=64, block=block).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect())
    assert got == want


def test_anchors_of_a_long_text_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 101, 20_000).astype(np.uint8)
    raw[3000:9000] = 97
    offsets = np.array([0, 100, 19_000, 20_000])
    one = [np.concatenate(x) for x in zip(*repeats.text_anchors(raw, offsets, 200), strict=True)]
    monkeypatch.setattr(repeats, "PIECE", 512)
    two = [np.concatenate(x) for x in zip(*repeats.text_anchors(raw, offsets, 200), strict=True)]
    assert all(np.array_equal(a, b) for a, b in zip(one, two, strict=True))
