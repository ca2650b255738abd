"""Personal data by fixed patterns and a semi-Markov conditional random field.

Four kinds have base patterns, whose matches always stay. The random field adds spans: in each
stretch of a line around digits or at-signs it considers every run of up to MOST_TOKENS tokens as
one whole segment of some kind, scores it by features of the whole span, and a dynamic program
over token positions and the kind of the last segment chooses boundaries and kinds jointly.

The field is trained here by gradient steps on its log-likelihood, over stretches of at most
SAMPLE_DOCS documents. Its labels are the base matches and, for secrets, a few exact formats.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
OUTSIDE = len(KINDS)

#: Bounds of the training sample and of a segment.
SAMPLE_DOCS = 3000
SAMPLE_STRETCHES = 1500

#: Bounds of what one document and one stretch give for training: the windows of a document that
#: have the least hashes, wherever in the text they are, and stretches of at most so many tokens.
SAMPLE_WINDOWS = 5
SAMPLE_TOKENS = 40
MOST_TOKENS = 6
MOST_LENGTH = 160
STEPS, RATE, DECAY = 6, 0.3, 1e-4

Span = tuple[str, int, int]

# -- base patterns. A match of a run of digits starts where the run does and ends where it does, so
# the look-behind and the possessive repeat find the same matches as the plain patterns, in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ACTIVE = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from the start of the run before an at-sign, but not into the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, by start and then kind."""
    found: list[Span] = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# -- what the random field looks at

_TOKEN = re.compile(r"[^\s=:\"'<>,;|]+")
_TRIM = ".,;:!?\"'<>[]{}"
_NAMED = re.compile(r"(?i)(?:token|passw(?:or)?d|secret|api.?key|key|auth)[\"']?\s*(?:=|:|\bis\b)\s*[\"']?$")
_EXACT = re.compile(r"AKIA[0-9A-Z]{16}|(?<=token = \")[0-9a-f]{40}(?=\")|(?<=password=)[0-9a-f]{16,}")
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_MAIL = re.compile(r"[^@\s]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


class Stretch(NamedTuple):
    """Tokens of a line around active ones: their places, and the features of each segment."""

    tokens: list[tuple[int, int]]
    segments: list[tuple[int, int]]  # first token, last token + 1
    features: np.ndarray  # segments x features
    allowed: np.ndarray  # segments x kinds: 0, or minus infinity where the form rules the kind out


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def segment_features(text: str, start: int, end: int, tokens: int) -> list[float]:
    s = text[start:end]
    digits = _NOT_DIGIT.sub("", s)
    n, size = len(digits), len(s)
    letters = sum(c.isalpha() for c in s)
    solid = s.isalnum() and s.isascii()
    quad = bool(_QUAD.fullmatch(s))
    named = bool(_NAMED.search(text, max(0, start - 24), start))
    before, after = text[start - 1 : start], text[end : end + 1]
    return [
        1.0, tokens == 1, tokens == 2, tokens > 3,
        n == 0, 0 < n < 7, 7 <= n < 10, 10 <= n <= 13, 14 <= n <= 19, n > 19,
        14 <= n <= 19 and luhn(digits), 14 <= n <= 19 and not luhn(digits),
        bool(_MAIL.fullmatch(s)), "@" in s, s[:1] == "+", s.startswith("+") and 10 <= n <= 15 and not letters,
        "(" in s or ")" in s, s.count("(") != s.count(")"),
        quad and all(int(p) <= 255 for p in s.split(".")), quad and not all(int(p) <= 255 for p in s.split(".")),
        letters == 0, 0 < letters < size / 2, letters >= size / 2,
        solid and size >= 16, solid and size >= 16 and n > 2 and letters > 2, solid and size >= 16 and s == s.lower() and letters > 2,
        solid and size >= 16 and s == s.upper() and letters > 2, size >= 16 and _entropy(s) > 3.0,
        named, named and tokens == 1 and size >= 8, size > 40,
        before.isalnum() or before == "+", after.isalnum(),
    ]


def possible_kinds(s: str) -> list[bool]:
    """Kinds that the form of a whole span admits, in the order of KINDS."""
    digits, letters = _NOT_DIGIT.sub("", s), any(c.isalpha() for c in s)
    return [
        bool(_MAIL.fullmatch(s)),
        bool(_QUAD.fullmatch(s)) and all(int(p) <= 255 for p in s.split(".")),
        not letters and 14 <= len(digits) <= 19 and luhn(digits),
        not letters and s[0] in "+(" and 7 <= len(digits) <= 15,
        letters and len(s) >= 8 and " " not in s,
    ]


N_FEATURES = len(segment_features("0", 0, 1, 1))


def stretches(text: str) -> list[Stretch]:
    """Stretches of neighbouring tokens with digits or at-signs (a token with neither ends one);
    segments start and end at such tokens, trimmed of marks at either end."""
    out: list[Stretch] = []
    hit = _ACTIVE.search(text)
    while hit:
        start = text.rfind("\n", 0, hit.start()) + 1
        stop = text.find("\n", hit.start())
        stop = len(text) if stop < 0 else stop
        run: list[tuple[int, int]] = []
        for m in _TOKEN.finditer(text, start, stop):
            a, b = m.span()
            while a < b and text[a] in _TRIM:
                a += 1
            while b > a and text[b - 1] in _TRIM:
                b -= 1
            if a < b and _ACTIVE.search(text, a, b):
                run.append((a, b))
            elif run:
                out.append(_stretch(text, run))
                run = []
        if run:
            out.append(_stretch(text, run))
        hit = _ACTIVE.search(text, stop)
    return out


def _stretch(text: str, run: list[tuple[int, int]]) -> Stretch:
    segments = [
        (i, j) for j in range(1, len(run) + 1) for i in range(max(0, j - MOST_TOKENS), j)
        if j - i == 1 or (run[j - 1][1] - run[i][0] <= MOST_LENGTH and text[run[i][0] : run[j - 1][1]].isascii())
    ]
    values = [segment_features(text, run[i][0], run[j - 1][1], j - i) for i, j in segments]
    allowed = [possible_kinds(text[run[i][0] : run[j - 1][1]]) for i, j in segments]
    return Stretch(run, segments, np.array(values, float), np.where(allowed, 0.0, -np.inf))


class Model(NamedTuple):
    """weights: kinds x features; moves: label before x label (the last one is outside)."""

    weights: np.ndarray
    moves: np.ndarray


def empty_model() -> Model:
    return Model(np.zeros((len(KINDS), N_FEATURES)), np.zeros((OUTSIDE + 1, OUTSIDE + 1)))


def _by_end(s: Stretch) -> list[list[int]]:
    ends: list[list[int]] = [[] for _ in range(len(s.tokens) + 1)]
    for k, (_, j) in enumerate(s.segments):
        ends[j].append(k)
    return ends


def decode(model: Model, s: Stretch) -> list[tuple[int, int, int]]:
    """Best segmentation as (first token, last token + 1, kind). Ties leave tokens outside."""
    scores, n = s.features @ model.weights.T + s.allowed, len(s.tokens)
    best = np.full((n + 1, OUTSIDE + 1), -np.inf)
    best[0, OUTSIDE] = 0
    back: dict[tuple[int, int], tuple[int, int, int]] = {}
    for j, ending in enumerate(_by_end(s)):
        if not j:
            continue
        options = best[j - 1] + model.moves[:, OUTSIDE]
        best[j, OUTSIDE], back[j, OUTSIDE] = options.max(), (j - 1, int(options.argmax()), OUTSIDE)
        for k in ending:
            i = s.segments[k][0]
            through = best[i][:, None] + model.moves[:, :OUTSIDE] + scores[k]
            for kind in range(OUTSIDE):
                if (value := through[:, kind].max()) > best[j, kind]:
                    best[j, kind], back[j, kind] = value, (i, int(through[:, kind].argmax()), kind)
    label = int(np.lexsort((-np.arange(OUTSIDE + 1), best[n]))[-1]) if best[n].max() > best[n, OUTSIDE] else OUTSIDE
    out, j = [], n
    while j:
        i, before, kind = back[j, label]
        if kind != OUTSIDE:
            out.append((i, j, kind))
        j, label = i, before
    return out[::-1]


def _gradient(model: Model, s: Stretch, gold: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray] | None:
    """Observed minus expected features and moves (forward-backward); None if gold isn't possible."""
    scores, n, ends = s.features @ model.weights.T + s.allowed, len(s.tokens), _by_end(s)
    forward = np.full((n + 1, OUTSIDE + 1), -np.inf)
    forward[0, OUTSIDE] = 0
    for j in range(1, n + 1):
        forward[j, OUTSIDE] = np.logaddexp.reduce(forward[j - 1] + model.moves[:, OUTSIDE])
        for k in ends[j]:
            i = s.segments[k][0]
            forward[j, :OUTSIDE] = np.logaddexp(forward[j, :OUTSIDE], np.logaddexp.reduce(forward[i][:, None] + model.moves[:, :OUTSIDE], 0) + scores[k])
    backward = np.full((n + 1, OUTSIDE + 1), -np.inf)
    backward[n] = 0
    starts: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, _) in enumerate(s.segments):
        starts[i].append(k)
    total = np.logaddexp.reduce(forward[n])
    weights, moves = np.zeros_like(model.weights), np.zeros_like(model.moves)
    for i in range(n - 1, -1, -1):
        out = model.moves[:, OUTSIDE] + backward[i + 1, OUTSIDE]
        moves[:, OUTSIDE] -= np.exp(forward[i] + out - total)
        backward[i] = out
        for k in starts[i]:
            j = s.segments[k][1]
            through = model.moves[:, :OUTSIDE] + scores[k] + backward[j, :OUTSIDE]
            share = np.exp(forward[i][:, None] + through - total)
            moves[:, :OUTSIDE] -= share
            weights -= share.sum(0)[:, None] * s.features[k]
            backward[i] = np.logaddexp(backward[i], np.logaddexp.reduce(through, 1))
    at, label, index = 0, OUTSIDE, {seg: k for k, seg in enumerate(s.segments)}
    while at < n:
        step = next(((j, kind) for (i, j), kind in gold.items() if i == at), None)
        if step is None:
            moves[label, OUTSIDE] += 1
            at, label = at + 1, OUTSIDE
            continue
        j, kind = step
        if (at, j) not in index or s.allowed[index[at, j], kind] < 0:
            return None
        weights[kind] += s.features[index[at, j]]
        moves[label, kind] += 1
        at, label = j, kind
    return weights, moves


def gold_segments(text: str, s: Stretch) -> dict[tuple[int, int], int]:
    """Segments that exact formats label, in a stretch of `text`; overlaps go to the longer one."""
    lo, hi = s.tokens[0][0], s.tokens[-1][1]
    found = [(a, b, KINDS.index(k)) for k, a, b in base_spans(text)]
    found += [(m.start(), m.end(), KINDS.index("secret")) for m in _EXACT.finditer(text)]
    begin, end = {a: i for i, (a, _) in enumerate(s.tokens)}, {b: i + 1 for i, (_, b) in enumerate(s.tokens)}
    taken, gold = -1, {}
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if lo <= a and b <= hi and a in begin and b in end and begin[a] > taken:
            gold[begin[a], end[b]] = kind
            taken = end[b] - 1
    return gold


def fit(texts: list[str]) -> Model:
    """Gradient steps with per-weight rates over the stretches of `texts`, in their order."""
    model = empty_model()
    squares = [np.full_like(model.weights, 1e-6), np.full_like(model.moves, 1e-6)]
    seen = []
    for text in texts:
        for s in stretches(text):
            if len(seen) < SAMPLE_STRETCHES and len(s.tokens) <= SAMPLE_TOKENS:
                seen.append((s, gold_segments(text, s)))
    for _ in range(STEPS):
        for s, gold in seen:
            step = _gradient(model, s, gold)
            if step is None:
                continue
            for part, square, change in zip(model, squares, step, strict=True):
                change = change - DECAY * part
                square += change**2
                part += RATE * change / np.sqrt(square)
    return model


def added_spans(model: Model, text: str, base: list[Span]) -> list[Span]:
    """Spans of the random field that meet no base span."""
    out = []
    for s in stretches(text):
        for i, j, kind in decode(model, s):
            a, b = s.tokens[i][0], s.tokens[j - 1][1]
            if not any(a < e and c < b for _, c, e in base):
                out.append((KINDS[kind], a, b))
    return out


# -- over DataFrames

_AROUND = 200


def _windows(text: str) -> list[str]:
    """What surrounds digits and at-signs, so that a long text need not travel for a few of them."""
    out, done = [], 0
    for m in _ACTIVE.finditer(text):
        if m.start() >= done:
            done = min(len(text), m.start() + _AROUND)
            out.append(text[max(0, m.start() - _AROUND) : done])
    return out


def _drawn(text: str) -> list[str]:
    return sorted(_windows(text), key=lambda w: (xxhash.xxh64_intdigest(w), w))[:SAMPLE_WINDOWS]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Fits the random field to the SAMPLE_DOCS documents with digits or at-signs whose hashed keys
    are least, and of each to the SAMPLE_WINDOWS surroundings of such characters whose hashes are;
    nothing else reaches the driver. Stretches of more than SAMPLE_TOKENS tokens teach nothing. Null
    texts are left out; with nothing to learn from, the model adds no spans."""
    active = docs.where(F.col(text).rlike("[0-9@]")).select(F.col(key).alias("_key"), F.xxhash64(key).alias("_order"))
    chosen = active.orderBy("_order", "_key").limit(SAMPLE_DOCS).select("_key").distinct()
    # at most SAMPLE_DOCS keys
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key", "left_semi")

    def batch(part: pa.RecordBatch) -> dict:
        pairs = [(str(k), w) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for w in _drawn(t or "")]
        return {"at": [p[0] for p in pairs], "seen": [p[1] for p in pairs]}

    found = arrow_map(rows, batch, "at string, seen string").orderBy(F.xxhash64("at", "seen"), "seen").limit(2 * SAMPLE_STRETCHES).collect()
    return fit([r["seen"] for r in found])


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, added): spans of each row in code points, end exclusive, by start and kind. Null
    and empty texts have none. Rows are judged one by one without a shuffle."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def batch(part: pa.RecordBatch) -> dict:
        base, added = [], []
        for t in part.column(1).to_pylist():
            found = base_spans(t) if t and _ACTIVE.search(t) else []
            more = added_spans(model, t, found) if t and _ACTIVE.search(t) else []
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            added.append([{"kind": k, "start": a, "end": b} for k, a, b in more])
        return {key: part.column(0), "base": pa.array(base, kind), "added": pa.array(added, kind)}

    narrow = docs.select(F.col(key), F.col(text))
    return arrow_map(narrow, batch, f"`{key}` {narrow.schema[0].dataType.simpleString()}, base {SPANS}, added {SPANS}")


def redacted(model: Model, text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if not _ACTIVE.search(text):
        return text
    base = base_spans(text)
    out, at = [], 0
    merged: list[list] = []
    for k, a, b in sorted([*base, *added_spans(model, text, base)], key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with its personal data replaced; null texts stay null and all columns stay."""
    at = docs.columns.index(text)

    def batch(part: pa.RecordBatch) -> dict:
        columns = dict(zip(part.schema.names, part.columns, strict=True))
        columns[text] = pa.array([None if t is None else redacted(model, t) for t in part.column(at).to_pylist()], pa.string())
        return columns

    return arrow_map(docs, batch, docs.schema)
