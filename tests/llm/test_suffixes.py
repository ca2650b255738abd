import hashlib
import random

import numpy as np
import pytest

from sightline.llm import suffixes


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for i in range(len(r) - suffixes.LENGTH + 1):
            s = r[i : i + suffixes.LENGTH]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - suffixes.LENGTH + 1):
            if seen[r[i : i + suffixes.LENGTH]] > 1:
                gone[i : i + suffixes.LENGTH] = True
        left = bytes(b for b, g in zip(r, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def crowd(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(rnd.randint(30, 120)) for _ in range(4)]
    texts = [None, "", "short", "a" * 700, "ab" * 350, "é" * 300]
    for _ in range(n):
        kind = rnd.random()
        body = text(rnd.randint(5, 150))
        if kind < 0.3:
            p = rnd.choice(passages)
            a, b = sorted((rnd.randint(0, len(p)), rnd.randint(0, len(p))))
            body = body + p[a:b] + text(20)
        elif kind < 0.45:
            body = rnd.choice([t for t in texts if t])
        elif kind < 0.55:
            t = rnd.choice([t for t in texts if t])
            at = rnd.randint(0, len(t))
            body = t[:at] + "X" + t[at:]
        elif kind < 0.6:
            body = body + " " + body
        texts.append(body)
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # anchors of many blocks, several shards, several parts of a text
        monkeypatch.setattr(suffixes, "BLOCK", 3)
        monkeypatch.setattr(suffixes, "SHARD", 5)
        monkeypatch.setattr(suffixes, "BUCKET", 16)
        monkeypatch.setattr(suffixes, "CHUNK", 300)
    texts = crowd(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, anchor string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.measure(docs).collect()}
    expected = dict(enumerate(brute(texts)))
    assert {i for i in got if got[i] != expected[i]} == set() and len(got) == len(expected)


def test_every_start_has_one_anchor():
    raw = " ".join(crowd(7, 5)[6:]).encode()
    seen = np.zeros(len(raw) - suffixes.LENGTH + 1, int)
    for _, first, n, off in suffixes.contexts(raw):
        for a, k, o in zip(first, n, off):
            seen[a : a + k] += 1
            assert 0 <= o - (k - 1) and o < suffixes.WINDOW
    assert (seen == 1).all()


def test_removal_keeps_characters_rows_and_columns(spark):
    shared = "é" * 150
    rows = [(1, "x" + shared + "y", "k"), (2, "z" + shared, "k"), (None, None, None), (4, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = {r.doc_id: r for r in suffixes.remove(docs).collect()}
    assert got[1].text == "xy" and got[2].text == "z" and got[None].text is None and got[4].text == ""
    assert suffixes.remove(docs).columns == docs.columns
    empty = suffixes.measure(docs.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
