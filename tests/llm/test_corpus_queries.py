"""The registered queries themselves against brute force, on the tables of the smallest scale."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from prismflow.llm import bpe, common, exact, langid, licenses, repeats, secret_scan, simhash, token_counts, warc


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r for r in common.documents(spark, sf_dir).collect()}


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.no_truncation()
    own.no_padding()
    return own


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, sf_dir, docs):
    got = langid.op1_language_id(spark, sf_dir).collect()
    assert len(got) == len(docs) and {r["doc_id"]: r["held_out"] for r in got} == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in docs}
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in {d["lang"] for d in docs.values()} | {"und"} for r in got)
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.8


def test_calibration_rejects_wrong_predictions():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 900)
    z = rng.normal(0, 0.3, (900, 3))
    z[np.arange(900), y] += 3
    z[:60] = rng.normal(0, 0.3, (60, 3))  # no language at all
    model = langid.Model(["a", "b", "c"], np.zeros((1, 3)), np.zeros(3))
    langid.calibrate(model, z, y)
    n, before, after, kept = model.calibration
    assert n == 900 and before > 0.02 and after < before / 5 and kept > 0.9


def test_op3_and_op5(spark, sf_dir, docs, library):
    for r in bpe.op5_bpe(spark, sf_dir).collect():
        ids = library.encode(docs[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))
    for r in token_counts.op3_token_counts(spark, sf_dir).collect():
        assert r["n_before"] == len(library.encode(docs[r["doc_id"]]["text"] or "", add_special_tokens=False).ids)


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    if not words:
        return 0
    n = [0] * 64
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(shingles))


def test_op6(spark, sf_dir, docs):
    prints = {k: brute_fingerprint(d["text"]) for k, d in docs.items()}
    up = {k: k for k in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4 and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op6_simhash(spark, sf_dir).collect()}
    assert got == {k: (f"{prints[k]:016x}", root(k)) for k in ids}


def test_fingerprint_of_more_shingles_than_a_block(monkeypatch):
    text = " ".join(f"w{k % 977}" for k in range(4000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text.encode()) == whole == brute_fingerprint(text)


def test_op7(spark, sf_dir, docs):
    texts = {k: (d["text"] or "").encode() for k, d in docs.items()}
    seen = Counter(hashlib.blake2b(t[i : i + 200], digest_size=8).digest() for t in texts.values() for i in range(len(t) - 199))
    want = {}
    for k, t in texts.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[hashlib.blake2b(t[i : i + 200], digest_size=8).digest()] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        want[k] = (len(t), int(gone.sum()), spans, sha(np.frombuffer(t, np.uint8)[~gone].tobytes()))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.op7_suffix_dedup(spark, sf_dir).collect()}
    assert got == want and sum(x[1] > 0 for x in want.values()) > 10


def test_radix_passes():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    data[2000:2100] = data[100:200]
    start, group = np.arange(len(data) - 40), rng.integers(0, 2, len(data) - 40)
    for depth in (32, 37):
        seen = Counter((int(g), data[s : s + depth].tobytes()) for s, g in zip(start, group, strict=True))
        assert sorted(repeats.radix(data, start, group, depth)) == [i for i, (s, g) in enumerate(zip(start, group, strict=True)) if seen[int(g), data[s : s + depth].tobytes()] > 1]


def test_op8(spark, sf_dir, docs):
    groups = {}
    for k, d in docs.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", d["text"] or ""), []).append((-len(d["text"] or ""), k))
    want = {k: (min(g)[1], len(g), min(g)[1] == k, sha(t.encode())) for t, g in groups.items() for _, k in g}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact.op8_exact_dedup(spark, sf_dir).collect()} == want


def test_op10(spark, sf_dir, docs):
    got = secret_scan.op10_secret_scan(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["at"], r["length"]) for r in got) == sorted((k, a, b - a) for k, d in docs.items() for a, b in secret_scan.find(d["text"] or ""))


def test_secrets_that_training_did_not_see(spark, sf_dir):
    forest = secret_scan.train(common.documents(spark, sf_dir))
    precision, recall = secret_scan.measured(forest, secret_scan.made(4711))
    assert precision > 0.97 and recall > 0.97
    df = spark.createDataFrame([(7, 'token = "0a1b2c3d4e5f60718293a4b5c6d7e8f90a1b2c3d"', "p")] * 2, "doc_id int, text string, source string")
    got = secret_scan.scan(df, forest)
    assert [tuple(r)[:3] for r in got.collect()] == [(7, 9, 40)] * 2 and dict(got.dtypes)["doc_id"] == "int"


MIT = licenses.TEMPLATES["MIT-text"]


def wrapped(text, width, mark):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(line)
            line = ""
        line += (" " if line else "") + w
    return "\n".join(mark + x for x in [*lines, line])


def brute_licences(text):
    words = [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]
    own = [" ".join(p) for p in zip(words, words[1:], strict=False)]
    for name, template in licenses.TEMPLATES.items():
        w = [x for x in re.split("[^a-z0-9]+", template.lower()) if x]
        t = [" ".join(p) for p in zip(w, w[1:], strict=False)]
        best = None
        for i, b in enumerate(own):
            if b in set(t):
                part = own[i : i + len(t)]
                shared = {x for x in part if x in set(t)}
                n = len(shared) + sum(x not in set(t) for x in part)
                best = max(best or (-1,), (2 * len(shared) / (n + len(set(t))), -i, n))
        if best and best[0] >= licenses.LEAST:
            yield name, -best[1], round(best[0], 9), best[2]


def test_wrapped_notices(spark):
    texts = [None, "", "word", "Released under", wrapped(MIT, 70, " * "), "Some words before. " + wrapped(licenses.TEMPLATES["GPL-3.0-header"], 40, "# ") + " And after.", "Licensed under CC BY-SA 4.0 and, as said, licensed under CC BY-SA 4.0", "the software " * 3000 + MIT, licenses.TEMPLATES["BSD-notice"][:60], "// Licensed under the Apache License,\n// Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License."]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(4, texts[4], "again")], "doc_id int, text string, license_id string")
    got = sorted((r["doc_id"], r["license_id"], r["at"], round(r["dice"], 9), r["n_bigrams"]) for r in licenses.scan(df).collect())
    assert got == sorted((k, *x) for k, t in [*enumerate(texts), (4, texts[4])] for x in brute_licences(t))
    assert {(4, "MIT-text"), (5, "GPL-3.0-header"), (7, "MIT-text"), (9, "Apache-2.0-long")} <= {x[:2] for x in got} and not any(x[0] in (0, 1, 2, 3, 8) for x in got)
    assert licenses.scan(df.limit(0)).count() == 0


def test_revisits_of_repeated_rows_and_one_hot_url(spark):
    rows = [(1, "http://a/x", 1, "response", {"ETag": '"1"'}, "one")] * 2 + [(2, "http://a/x", 5, "revisit", {"etag": 'W/"1"'}, None)] * 2 + [(k, "http://a/x", 10_000_000 + k, "revisit" if k % 2 else "response", {"ETag": f'"{k // 2}"'}, "p") for k in range(10, 90)] + [(100, "http://b", 0, "revisit", None, None)] * 2
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, headers map<string,string>, payload string")
    got = warc.resolve(df).collect()
    assert Counter(r["record_id"] for r in got) == Counter(r[0] for r in rows if r[3] == "revisit")
    assert all(r["before"] == (1 if r["record_id"] == 2 else r["record_id"] - 1 if r["record_id"] < 100 else None) for r in got)
    assert {r["outcome"] for r in got if r["record_id"] < 100} == {"resolved"} and {r["outcome"] for r in got if r["record_id"] == 100} == {"no response"}
