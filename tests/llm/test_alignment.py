"""Alignment of two tokenizers against the libraries over whole texts."""

import hashlib
import json
import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sightline.llm import alignment
from sightline.llm.common import vocabulary
from sightline.llm.token_counts import byte_symbols

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def plain(texts):
    """Rows by the contract, from the libraries on whole texts and all pairs of tokens."""
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=B)
    symbols = byte_symbols()
    with open(A, encoding="utf-8") as file:
        raw_a = {i: bytes(symbols[c] for c in t) for t, i in json.load(file)["model"]["vocab"].items() if all(c in symbols for c in t)}

    def raw_b(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    links, groups, facts = [], [], []
    for text in texts:
        x = first.encode(" " + text, add_special_tokens=False).ids if text else []
        y = second.encode(text) if text else []
        parts = [raw_a[i] for i in x], [raw_b(i) for i in y]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            links.append([]), groups.append(""), facts.append((0, 0, 0))
            continue
        ends = []
        for p in parts:
            total, own = 0, []
            for part in p:
                total += len(part)
                own.append(total)
            ends.append(own)
        common = sorted(set(ends[0]) & set(ends[1]))
        cut = [([t for t, e in zip(ids, own) if lo < e <= hi]) for lo, hi in zip([0, *common], common) for ids, own in ((x, ends[0]), (y, ends[1]))]
        pairs = list(zip(cut[::2], cut[1::2]))
        groups.append(hashlib.sha256(";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in pairs).encode()).hexdigest())
        links.append([(s, t) for p, q in pairs for s in p for t in q])
        facts.append((len(x), len(y), len(pairs)))
    docs = Counter(pair for own in links for pair in set(own))
    best = defaultdict(int)
    for (s, _), n in docs.items():
        best[s] = max(best[s], n)
    return [(*f, len(own), sum(docs[p] == best[p[0]] for p in own), sum(docs[p] for p in own), g) for f, own, g in zip(facts, links, groups, strict=True)]


def rows(spark, texts):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, block long")
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(docs, A, B).collect()}
    return [got[i] for i in range(len(texts))]


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n", " ", "a  b", "a  b", "x ▁y", "▁", "<|endoftext|> and <s> </s>", "<0x41>", "é ü 漢字 🙂", "\x00 a", "a\tb \t c",
    "don't we'll", "ab" * 3000, "word " * 500, " ".join(str(i) for i in range(400)), "one two\r\nthree", " wide  space  ", "a b", "a b", "́ combining", "tail  ",
]


def test_alignment_equals_the_libraries(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("aeioubcdtrn") for _ in range(rnd.randint(1, 9)))
    texts = [*ODD, *(" ".join(word() for _ in range(rnd.randint(1, 120))) for _ in range(60))]
    assert rows(spark, texts) == plain(texts)


def test_small_blocks_and_forgotten_chunks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 200)
    monkeypatch.setattr(alignment, "STORE_CHARS", 300)
    monkeypatch.setattr(alignment, "AT_ONCE", 20)
    assert rows(spark, ODD) == plain(ODD)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    got = alignment.align(docs, A, B).collect()
    assert len(got) == 3 and len({tuple(r)[1:] for r in got}) == 1
    assert got[0].count_sum == 3 * got[0].n_links
    assert alignment.align(docs.limit(0), A, B).collect() == []
    named = alignment.align(docs.selectExpr("concat('k', doc_id) AS `odd name`", "text"), A, B, key="odd name")
    assert named.columns[0] == "odd name" and named.count() == 3


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 200), max_size=60), st.lists(st.integers(0, 200), max_size=60))
def test_galloping(x, y):
    x, y = sorted(set(x)), sorted(set(y))
    assert alignment.common_ends(x, y) == [(x.index(v), y.index(v)) for v in sorted(set(x) & set(y))]


@settings(max_examples=600, deadline=None)
@given(st.text("ab \n ▁é.1'", min_size=1, max_size=25))
def test_chunks_put_together_again(text):
    chunks = alignment.chunks_of(text)
    assert "".join(chunks) == " " + text
    first = Tokenizer.from_file(A) if not hasattr(test_chunks_put_together_again, "t") else test_chunks_put_together_again.t
    test_chunks_put_together_again.t = first
    whole = first.encode(" " + text, add_special_tokens=False).ids
    assert [i for c in chunks for i in first.encode(c, add_special_tokens=False).ids] == whole
