"""Removal of repeated byte strings by merging sorted suffix tables of shards.

A string of LENGTH bytes that occurs twice shares its anchor: the leftmost least-hashed substring
of GRAM bytes in it. So every start position belongs to one anchor, neighbouring starts with the
same anchor form a context, and only contexts with equal anchors can hold equal strings. Contexts
that occur twice as a whole are repeated without looking inside; the other contexts of an anchor
that has several are compared:

Each shard of contexts sorts its suffixes from the anchor on and keeps, as its Burrows-Wheeler
columns, the bytes that precede them. Shards are merged by refining their interleaving: starting
from classes of equal anchors, each round splits the classes by the next symbols, stably, so that
what a shard has sorted stays sorted; a split fixes the common prefix of two neighbours. From there
backward steps by the preceding byte order the longer suffixes, one byte at a time, with common
prefixes as range minima of the round before. Neighbours with LENGTH common bytes are repeats.

No text meets another one whole. An anchor with more than BLOCK contexts is cut into blocks. Strings
of different blocks meet in two steps: CELL neighbouring starts, by their distance to the anchor,
go out as one row under the hash of the bytes that all their strings have in common; only where
that meets another do the strings meet by their own 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, unused, written

LENGTH = 200
GRAM = 32
WINDOW = LENGTH - GRAM + 1

#: Contexts of one anchor that are compared in one task, of one task, and of one shard.
BLOCK, BUCKET, SHARD = 2048, 16_384, 4096

#: Neighbouring starts of a context that meet those of other blocks as one.
CELL = 16

#: Bytes of a text that are hashed at once; positions within them fit POSITION_BITS.
CHUNK, POSITION_BITS = 4_000_000, 24

MULTIPLIER = 0x9E3779B97F4A7C15


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on, by doubling."""
    with np.errstate(over="ignore"):
        h, base, width = data.astype(np.uint64) + np.uint64(1), np.uint64(MULTIPLIER), 1
        while width < GRAM:
            h = h[:-width] * base + h[width:]
            base, width = base * base, 2 * width
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def _window_minima(keys: np.ndarray) -> np.ndarray:
    """Least key of each WINDOW neighbouring ones, from running minima of blocks in both directions."""
    n = len(keys) - WINDOW + 1
    padded = np.full(-(-len(keys) // WINDOW) * WINDOW, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[WINDOW - 1 : WINDOW - 1 + n])


def contexts(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, first start, starts, anchor's distance from the first start) as arrays, for
    parts of a text. Every start of LENGTH bytes is in exactly one context or a part of one."""
    low = np.uint64((1 << POSITION_BITS) - 1)
    for at in range(0, len(raw) - LENGTH + 1, CHUNK):
        data = np.frombuffer(raw, np.uint8)[at : at + CHUNK + LENGTH - 1]
        h = _gram_hashes(data)
        least = _window_minima((h & ~low) | np.arange(len(h), dtype=np.uint64))
        anchors = (least & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
        a = anchors[first]
        yield h[a], first + at, np.diff(np.append(first, len(anchors))), a - first


def text_id(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()


def _places(docs: DataFrame, text: str, with_place: bool) -> DataFrame:
    """A row per context: (anchor, context), and (id, start, n, off) where asked for."""

    def batch(part: pa.RecordBatch) -> dict | None:
        anchors, hashes, ids, starts, counts, offs = [], [], [], [], [], []
        for t in part.column(0).to_pylist():
            raw = t.encode() if t else b""
            if len(raw) < LENGTH:
                continue
            own = text_id(raw) if with_place else b""
            for a, first, n, off in contexts(raw):
                ends = (first + n + LENGTH - 1).tolist()
                hashes += [xxhash.xxh3_64_intdigest(raw[i:j], o) for i, j, o in zip(first.tolist(), ends, off.tolist(), strict=True)]
                anchors.append(a)
                if with_place:
                    ids += [own] * len(a)
                    starts.append(first)
                    counts.append(n)
                    offs.append(off)
        if not hashes:
            return None
        out = {"anchor": np.concatenate(anchors).view(np.int64), "context": np.array(hashes, np.uint64).view(np.int64)}
        if with_place:
            out |= {"id": pa.array(ids, pa.binary()), "start": np.concatenate(starts)}
            out |= {"n": np.concatenate(counts).astype(np.int32), "off": np.concatenate(offs).astype(np.int32)}
        return out

    schema = "anchor bigint, context bigint" + ", id binary, start bigint, n int, off int" * with_place
    return arrow_map(docs.select(text), batch, schema)


# -- merging of shards

BYTES_IN_WORD, BITS = 7, 9


def _words(right: list[bytes]) -> np.ndarray:
    """Right contexts as rows of integers that order like them; 0 stands for the end."""
    columns = -(-LENGTH // BYTES_IN_WORD)
    flat = np.zeros((len(right), columns * BYTES_IN_WORD), np.uint64)
    for i, r in enumerate(right):
        flat[i, : len(r)] = np.frombuffer(r, np.uint8).astype(np.uint64) + np.uint64(1)
    words = np.zeros((len(right), columns), np.uint64)
    for k in range(BYTES_IN_WORD):
        words = (words << np.uint64(BITS)) | flat[:, k::BYTES_IN_WORD]
    return words


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading bytes of differing words."""
    differ, out = a ^ b, np.zeros(len(a), np.int64)
    for k in range(1, BYTES_IN_WORD):
        out += differ < np.uint64(1) << np.uint64(BITS * (BYTES_IN_WORD - k))
    return out


def interleave(order: np.ndarray, anchors: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of suffixes and the common prefix of each with the one before it (-1 where the
    anchor changes). `order` lists the shards' suffixes, each shard in its own order."""
    order = order[np.argsort(anchors[order], kind="stable")]
    prefix = np.full(len(order), LENGTH, np.int64)
    prefix[np.flatnonzero(np.concatenate(([True], anchors[order][1:] != anchors[order][:-1])))] = -1
    for column in range(words.shape[1]):
        new = prefix < LENGTH
        ends = np.append(new[1:], True)
        active = np.flatnonzero(~(new & ends))  # in classes of two and more
        if not active.size:
            break
        symbols = words[order[active], column]
        classes = np.cumsum(new)[active]
        inner = np.lexsort((symbols, classes))  # stable
        order[active] = order[active][inner]
        symbols, here = symbols[inner], active[1:]
        split = (symbols[1:] != symbols[:-1]) & ~new[here] & (here == active[:-1] + 1)
        prefix[here[split]] = column * BYTES_IN_WORD + _common(symbols[1:][split], symbols[:-1][split])
    same = prefix > 0
    prefix[same] = np.minimum(prefix[same], np.minimum(sizes[order], sizes[np.roll(order, 1)])[same])
    return order, prefix


def _shards(anchors: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each shard's suffixes in its own sorted order, one shard after the other."""
    parts = [np.arange(i, min(i + SHARD, len(anchors))) for i in range(0, len(anchors), SHARD)]
    return np.concatenate([interleave(p, anchors, words, sizes)[0] for p in parts])


def repeated_starts(anchors: np.ndarray, texts: list[bytes], offs: np.ndarray) -> np.ndarray:
    """class_of[i, o]: 0 where the LENGTH bytes that start o before the anchor of context i are no
    start of the context; else a number that equals another context's exactly if the bytes do."""
    right = [t[o : o + LENGTH] for t, o in zip(texts, offs.tolist(), strict=True)]
    sizes = np.fromiter(map(len, right), np.int64, len(right))
    left = np.zeros((len(texts), WINDOW), np.uint8)
    for i, (t, o) in enumerate(zip(texts, offs.tolist(), strict=True)):
        left[i, :o] = np.frombuffer(t, np.uint8)[:o][::-1]
    words = _words(right)
    order, prefix = interleave(_shards(anchors, words, sizes), anchors, words, sizes)
    class_of = np.zeros((len(texts), WINDOW), np.int64)
    _, groups = np.unique(anchors, return_inverse=True)
    total = np.fromiter(map(len, texts), np.int64, len(texts))
    number = 1
    for back in range(WINDOW):
        fits = (offs[order] >= back) & (total[order] - offs[order] + back >= LENGTH)
        classes = number + np.cumsum(prefix < LENGTH)
        number = int(classes[-1]) + 1 if len(classes) else number
        class_of[order[fits], back] = classes[fits]
        # a suffix whose neighbours share too little can't come to LENGTH by the last step
        near = np.maximum(prefix, np.append(prefix[1:], -1)) >= GRAM + back
        ranks = np.flatnonzero(near & (offs[order] > back))
        lone = np.flatnonzero(~near & (offs[order] > back))
        if lone.size:  # they stay alone in every further step
            rows = order[lone]
            steps = np.arange(back + 1, WINDOW)
            inside = (offs[rows][:, None] >= steps) & (total[rows][:, None] - offs[rows][:, None] + steps >= LENGTH)
            fresh = number + np.arange(inside.size).reshape(inside.shape)
            class_of[rows[:, None], steps] = np.where(inside, fresh, 0)
            number += inside.size
        if not ranks.size:
            break
        keys = groups[order[ranks]] * 256 + left[order[ranks], back]
        step = np.argsort(keys, kind="stable")
        ranks, keys = ranks[step], keys[step]
        longer = np.full(len(ranks), -1, np.int64)
        follows = np.flatnonzero(keys[1:] == keys[:-1]) + 1
        if follows.size:
            bounds = np.stack((ranks[follows - 1] + 1, ranks[follows] + 1), 1).ravel()
            longer[follows] = 1 + np.minimum.reduceat(np.append(prefix, -1), bounds)[::2]
        order, prefix = order[ranks], np.minimum(longer, LENGTH)
    return class_of


def _halves(raw: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(raw)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _compare(table: pa.Table) -> dict:
    """Marks (id, start, n) of contexts that occur once, and for anchors of several blocks rows
    (id, start, n, h1, h2, strings): of a cell the context's first start, the number of starts, the
    hash of the cell's common bytes and, for each class of equal strings that no row has shown
    before, the start from there on, its hash and whether it needs a mark."""
    anchors = table.column("anchor").to_numpy().view(np.uint64)
    texts = table.column("text").to_pylist()
    offs = table.column("off").to_numpy().astype(np.int64)
    ids, starts = table.column("id").to_pylist(), table.column("start").to_numpy()
    once, several = table.column("once").to_numpy(zero_copy_only=False), table.column("blocks").to_numpy() > 1
    class_of = repeated_starts(anchors, texts, offs)
    flat = class_of.ravel()
    _, back, sizes = np.unique(flat, return_inverse=True, return_counts=True)
    again = (sizes[back].reshape(class_of.shape) > 1) & (class_of > 0)
    out: dict[str, list] = {"id": [], "start": [], "n": [], "h1": [], "h2": [], "strings": []}

    def put(*row) -> None:
        for name, value in zip(out, row, strict=True):
            out[name].append(value)

    # as runs of neighbouring starts, which are runs of neighbouring offsets
    edges = np.diff(np.pad((again & once[:, None]).astype(np.int8), ((0, 0), (1, 1))), axis=1)
    for (i, lo), (_, hi) in zip(np.argwhere(edges == 1).tolist(), np.argwhere(edges == -1).tolist(), strict=True):
        put(ids[i], int(starts[i] + offs[i] - (hi - 1)), hi - lo, None, None, None)
    shown: set[int] = set()
    for i in np.flatnonzero(several).tolist():
        cells: dict[int, list[dict]] = {}
        for o in np.flatnonzero(class_of[i]).tolist():
            if (c := int(class_of[i, o])) in shown:
                continue
            shown.add(c)
            begin = int(offs[i]) - o
            h1, h2 = _halves(texts[i][begin : begin + LENGTH])
            cells.setdefault(o // CELL, []).append({"at": begin, "h1": h1, "h2": h2, "open": bool(once[i] and not again[i, o])})
        for cell, strings in cells.items():
            # the bytes between the last start and the end of the first string of a full cell
            last = int(offs[i]) - cell * CELL
            put(ids[i], int(starts[i]), len(strings), *_halves(texts[i][max(0, last) : last - CELL + 1 + LENGTH]), strings)
    return out


def marks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, start, n): runs of n starts of repeated strings, for each text, named by its 128-bit
    digest. Null and short texts have none."""
    counted = _places(docs, text, False).groupBy("anchor", "context").agg(F.count("*").alias("times"))
    counted = written(counted, "contexts")
    shared = counted.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("times").alias("most")).where("kinds > 1 OR most > 1")
    known = counted.join(shared.select("anchor", "kinds"), "anchor").where("kinds > 1 OR times > 1")
    known = written(known.select("anchor", "context", (F.col("times") == 1).alias("once"), "kinds"), "repeated")
    places = _places(docs, text, True).join(known, ["anchor", "context"])
    places = written(places, "places")
    whole = places.where("NOT once").select("id", "start", "n").distinct()

    # one of each context of anchors that have several
    one = places.where("kinds > 1").groupBy("anchor", "context").agg(F.min(F.struct("id", "start", "n", "off")).alias("at"), F.first("once").alias("once"), F.first("kinds").alias("kinds"))
    needed = one.select("at.id", F.struct("anchor", "context", "at.start", "at.n", "at.off", "once", "kinds").alias("at")).groupBy("id").agg(F.collect_list("at").alias("wanted"))
    total = int(counted.join(shared.where("kinds > 1"), "anchor", "left_semi").count())
    holders = docs.select(F.col(text).alias("text"), F.unhex(F.sha2(text, 256)).alias("id")).join(needed, "id").dropDuplicates(["id"])

    def cut(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("anchor", "context", "id", "start", "off", "once", "kinds", "text")}
        for own, t, wanted in zip(*(part.column(n).to_pylist() for n in ("id", "text", "wanted")), strict=True):
            raw = t.encode()
            for w in wanted:
                for name in ("anchor", "context", "start", "off", "once", "kinds"):
                    out[name].append(w[name])
                out["id"].append(own)
                out["text"].append(raw[w["start"] : w["start"] + w["n"] + LENGTH - 1])
        return {k: pa.array(v, pa.int32()) if k == "off" else v for k, v in out.items()}

    cuts = arrow_map(holders.select("id", "text", "wanted"), cut, "anchor bigint, context bigint, id binary, start bigint, off int, once boolean, kinds bigint, text binary")
    blocks = F.ceil(F.col("kinds") / BLOCK)
    place = F.xxhash64("anchor", F.pmod(F.xxhash64("context"), blocks))
    buckets = cuts.withColumn("blocks", blocks).withColumn("bucket", F.pmod(place, F.lit(max(1, -(-total // BUCKET)))))

    longs = pa.int64()
    strings = pa.list_(pa.struct([("at", longs), ("h1", longs), ("h2", longs), ("open", pa.bool_())]))

    def compare(group: pa.Table) -> pa.Table:
        kinds = [("id", pa.binary()), ("start", longs), ("n", pa.int32()), ("h1", longs), ("h2", longs), ("strings", strings)]
        return pa.table(_compare(group), pa.schema(kinds))

    string = "struct<at bigint, h1 bigint, h2 bigint, open boolean>"
    found = buckets.groupBy("bucket").applyInArrow(compare, f"id binary, start bigint, n int, h1 bigint, h2 bigint, strings array<{string}>")
    found = written(found, "compared")
    cells = found.where("h1 IS NOT NULL")
    near = cells.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2")
    classes = cells.join(near, ["h1", "h2"], "left_semi").select("id", "start", F.explode("strings").alias("s")).select("id", "start", "s.*")
    classes = written(classes, "classes")
    met = classes.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2")
    across = classes.where("open").join(met, ["h1", "h2"], "left_semi").select("id", (F.col("start") + F.col("at")).alias("start"), F.lit(1).alias("n"))
    return whole.unionByName(found.where("h1 IS NULL").select("id", "start", "n")).unionByName(across)


# -- what the marks remove

def removed_runs(starts: list[tuple[int, int]] | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes that runs of starts cover."""
    runs: list[list[int]] = []
    for start, n in sorted(starts or []):
        end = start + n + LENGTH - 1
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(end, runs[-1][1])
        else:
            runs.append([start, end])
    return [(a, b) for a, b in runs]


def kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in runs)]
    return b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in runs), len(raw)], strict=True))


def whole_characters(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without characters that they cover in part."""
    out = []
    for a, b in runs:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _marked(docs: DataFrame, text: str) -> DataFrame:
    """`docs` and, as last column, the marks of each text."""
    own, found = unused(docs.columns, "_id"), unused(docs.columns, "_marks")
    by_text = marks(docs, text).groupBy(F.col("id").alias(own)).agg(F.collect_list(F.struct("start", "n")).alias(found))
    named = docs.withColumn(own, F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)))
    return named.join(by_text, own, "left").select(*[F.col(f"`{c}`") for c in docs.columns], found)


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) per row, on whole bytes.

    A byte is removed if a string of LENGTH bytes that covers it starts anywhere else too, in the
    same text or in that of another row; repeated rows repeat each other. Null texts are empty.
    """
    marked = _marked(docs.select(F.col(key), F.col(text)), text)

    def batch(part: pa.RecordBatch) -> dict:
        sizes, removed, spans, digests = [], [], [], []
        for t, m in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
            raw = (t or "").encode()
            runs = removed_runs([(x["start"], x["n"]) for x in m or []])
            sizes.append(len(raw))
            removed.append(sum(b - a for a, b in runs))
            spans.append(len(runs))
            digests.append(hashlib.sha256(kept(raw, runs)).hexdigest())
        return {key: part.column(0), "n_bytes": sizes, "n_removed": removed, "n_spans": spans, "kept_sha256": digests}

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(marked, batch, f"`{key}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with repeated strings cut out of the texts, in whole characters; null texts stay null."""
    columns = docs.columns
    marked = _marked(docs, text)
    at = columns.index(text)

    def batch(part: pa.RecordBatch) -> dict:
        out = dict(zip(columns, part.columns, strict=False))
        texts = []
        for t, m in zip(part.column(at).to_pylist(), part.column(len(columns)).to_pylist(), strict=True):
            if t and m:
                raw = t.encode()
                t = kept(raw, whole_characters(raw, removed_runs([(x["start"], x["n"]) for x in m]))).decode()
            texts.append(t)
        return out | {text: pa.array(texts, pa.string())}

    return arrow_map(marked, batch, docs.schema)
