"""The filter audit against a plain count."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from sightline.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, labels):
    """The contract, document by document."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    flags = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)}
        fails |= {"D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        flags.append((s or "", {f for f, x in fails.items() if x}, any(q == 1 for k, q, _ in labels if k == i), any(x == 1 for k, _, x in labels if k == i)))
    out = {}
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {p for p, *_ in flags}:
        own = [f for f in flags if f[0] == part]
        shapley = {c: sum(next((x for x in order if x in fails), None) == c for order in orders for _, fails, *_ in own) for c in "ABCDE"}
        for order in orders:
            for step, c in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [f for f in own if c in f[1] and not f[1] & before]
                out[part, order, step] = (
                    sum(not f[1] & (before | {c}) for f in own), len(removed), sum(c in f[1] and bool(f[1] & before) for f in own),
                    sum(f[1] == {c} for f in own), sum(f[2] for f in removed), sum(f[3] for f in removed), shapley[c],
                )
    return out


def test_audit_equals_a_plain_count(spark, monkeypatch):
    monkeypatch.setattr(audit, "SEGMENT", 7)  # many segments
    rnd = random.Random(1)
    words = lambda n, k: " ".join(rnd.choice("abcdefghijklmnop") * rnd.randint(1, k) for _ in range(n))
    texts = [None, "", " \n", "x" * 100_000, "É é A", "a\x0bb c", *("#" + words(210, 40) for _ in range(3))]
    texts += [words(rnd.choice([198, 199, 200, 201, 260]), rnd.choice([2, 60])) + rnd.choice(["", "", " A B C D E F G H", " 5%"]) for _ in range(50)]
    texts += [rnd.choice(texts) for _ in range(40)]
    rows = [(3 * i - 20, t, rnd.choice(["s", "t", None, ""])) for i, t in enumerate(texts)] + [(None, texts[9], "s"), (5, "twice", "t"), (5, "twice", "t"), (None, None, None)]
    rnd.shuffle(rows)
    labels = [(3 * i - 20, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 90, 2)] + [(-20, 1, 1), (-20, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, key int, mask int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.interactions(audit.flag_counts(docs, known)).collect()
    labels = [x for x in labels if x[0] is not None]
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == plain(rows, labels) and len(got) == 3 * 600
    assert audit.interactions(audit.flag_counts(docs.limit(0), known)).collect() == []
    assert audit.interactions(audit.flag_counts(docs, known.limit(0))).agg(F.sum("good_lost")).first()[0] == 0


def test_prepass_clears_unique_texts_and_keeps_repeats(spark):
    docs = spark.createDataFrame([(i, f"text {i % 4000}", "s") for i in range(4400)], "doc_id long, text string, source string").repartition(6)
    marked = audit.flagged(docs, "doc_id", "text", "source")
    found = audit.possible_repeats(marked).count()
    assert 400 <= found < 800
    assert audit.first_ids(marked).count() == 400
