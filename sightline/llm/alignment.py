"""Alignment of two tokenizers over the same bytes.

Both tokenizers cut a text at every blank between two characters that are no white space, so a
text is a row of chunks and its alignment the row of theirs; distinct chunks are encoded by the
libraries and aligned once per task. Within a chunk both token sequences are lists of byte ends.
The shorter list drives a galloping search in the longer one: from the last hit on, steps of
doubling width, then a binary search between the last two. The common ends cut both sequences into
groups, whose tokens overlap: differences of ranks give their numbers.

How many documents hold a pair of identifiers linked is known only over the whole corpus. Texts are
handled in blocks: a first pass emits each block's chunks (which pairs they hold) and documents
(which chunks they hold) as packed integers, and the number of documents per pair of each task.
The pairs of a block, each once, look up the summed counts; where they meet the block again, its
documents add up what their links count. No text is shuffled, no list of pairs of a document is.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .token_counts import byte_symbols

#: Characters of the texts of a block, and of chunks kept by a worker until it starts anew.
BLOCK_CHARS, STORE_CHARS = 5_000_000, 5_000_000

#: Characters that are handed to the libraries at once.
AT_ONCE = 200_000

#: a blank between two characters that are no white space, and one beside white space
CUT, ODD = re.compile(r"(?<=\S) (?=\S)"), re.compile(r" (?:\s|(?<=\s ))")


def common_ends(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) with a[i] == b[j] of two ascending lists, by galloping through the longer one."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    swapped = len(a) > len(b)
    short, long = (b, a) if swapped else (a, b)
    out, low, n = [], 0, len(long)
    for i, end in enumerate(short):
        step, high = 1, low
        while high < n and long[high] < end:
            low, high = high + 1, high + step
            step *= 2
        low = bisect_left(long, end, low, min(high, n))
        if low == n:
            break
        if long[low] == end:
            out.append((low, i) if swapped else (i, low))
    return out


class Pair:
    """Both tokenizers of a worker and the chunks that it knows.

    A chunk has a number; `facts` holds (tokens of A, tokens of B, groups, links, 1 if its bytes are
    not its own) of all chunks one after the other, `starts`, `pairs` and `times` the pairs of
    identifiers that it links and how often, `shown` its groups as text.
    """

    def __init__(self, bytes_file: str, pieces_file: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(bytes_file)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=pieces_file)
        with open(bytes_file, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{bytes_file} is not a plain byte-level vocabulary")
        symbols = byte_symbols()
        raw = lambda t: bytes(symbols[c] for c in t) if all(c in symbols for c in t) else t.encode()
        entries = {i: raw(t) for t, i in spec["model"]["vocab"].items()}
        entries |= {t["id"]: t["content"].encode() for t in spec["added_tokens"] if t["id"] not in entries}
        if not {bytes([i]) for i in range(256)} <= set(entries.values()):
            raise ValueError(f"{bytes_file} has not all bytes")
        piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
        self.raw_b = [piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())):
            raise ValueError(f"{pieces_file} has pieces that span a blank")
        self.size_a, self.size_b = [len(entries.get(i, b"")) for i in range(max(entries) + 1)], list(map(len, self.raw_b))
        self.name = list(map(str, range(max(len(self.size_a), len(self.size_b)))))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.facts, self.shown = array("q"), []
        self.starts, self.pairs, self.times = array("q", [0]), array("q"), array("q")

    def learn(self, chunks: list[str]) -> None:
        """Chunks have a blank before them, which the second tokenizer adds by itself. Those without
        white space at their ends are encoded together, as one text."""
        at = 0
        while at < len(chunks):
            to, size = at, 0
            while to < len(chunks) and (to == at or size + len(chunks[to]) <= AT_ONCE):
                size += len(chunks[to])
                to += 1
            part, at = chunks[at:to], to
            plain = [c for c in part if len(c) > 1 and not c[1].isspace() and not c[-1].isspace() and "▁" not in c]
            together = len(plain) > 1 and self._together(plain)
            for c in part if not together else set(part).difference(plain):
                x, y = self.a.encode(c, add_special_tokens=False).ids, self.b.encode(c[1:])
                raw = b"".join(map(self.raw_b.__getitem__, y))
                self._add(c, x, y, *(list(accumulate(map(sizes.__getitem__, ids))) for sizes, ids in ((self.size_a, x), (self.size_b, y))), raw == c.encode())

    def _together(self, chunks: list[str]) -> bool:
        """Learns the chunks from one text; False if the text does not come back byte by byte."""
        text = "".join(chunks)
        x, y = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        if b"".join(map(self.raw_b.__getitem__, y)) != text.encode():
            return False
        bounds = np.cumsum(np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks)))
        cuts, ends = [], []
        for sizes, ids in ((self.size_a, x), (self.size_b, y)):
            own = np.cumsum(np.fromiter(map(sizes.__getitem__, ids), np.int64, len(ids)))
            at = np.searchsorted(own, bounds)
            if (own[at] != bounds).any():
                return False
            cuts.append((at + 1).tolist())
            ends.append(own.tolist())
        p = q = 0
        for c, i, j in zip(chunks, *cuts, strict=True):
            self._add(c, x[p:i], y[q:j], ends[0][p:i], ends[1][q:j], True)
            p, q = i, j
        return True

    def _add(self, chunk: str, x: list[int], y: list[int], ends_x: list[int], ends_y: list[int], faithful: bool) -> None:
        self.number[chunk] = len(self.shown)
        self.chars += len(chunk)
        if not faithful:
            self.facts.extend((0, 0, 0, 0, 1))
            self.shown.append("")
            self.starts.append(len(self.pairs))
            return
        name, linked, shown, links, i, j = self.name, {}, [], 0, 0, 0
        for p, q in common_ends(ends_x, ends_y):
            if p == i and q == j:
                links += 1
                shown.append(f"{name[x[i]]}|{name[y[j]]}")
                key = x[i] << 32 | y[j]
                linked[key] = linked.get(key, 0) + 1
            else:
                own, other = x[i : p + 1], y[j : q + 1]
                links += len(own) * len(other)
                shown.append(f"{','.join(map(name.__getitem__, own))}|{','.join(map(name.__getitem__, other))}")
                if len(own) * len(other) > 64:
                    tokens, partners = Counter(own).items(), Counter(other).items()
                else:
                    tokens, partners = zip(own, repeat(1), strict=False), [(o, 1) for o in other]
                for token, n in tokens:
                    high = token << 32
                    for partner, m in partners:
                        key = high | partner
                        linked[key] = linked.get(key, 0) + n * m
            i, j = p + 1, q + 1
        self.facts.extend((len(x), len(y), len(shown), links, 0))
        self.shown.append(";".join(shown))
        self.pairs.extend(linked)
        self.times.extend(linked.values())
        self.starts.append(len(self.pairs))


@lru_cache(maxsize=1)
def pair(bytes_file: str, pieces_file: str) -> Pair:
    return Pair(bytes_file, pieces_file)


def chunks_of(text: str) -> list[str]:
    """The text with a blank before it, cut before blanks between characters that are no white space."""
    parts = CUT.split(text) if ODD.search(text) or text[:1].isspace() else text.split(" ")
    if text[-1:] == " " and len(parts) > 1 and not parts[-1]:
        parts[-2:] = [parts[-2] + " "]
    return [" " + p for p in parts]


def _packed(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)  # equal bytes lie together


def _unpacked(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<i8").ravel()


def _within(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of several ranges one after the other."""
    sizes = ends - starts
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


def _block(tokens: Pair, keys: pa.Array, texts: list[str | None], held: Counter) -> dict:
    """One row for a block of texts. `held` gets the documents per pair."""
    split = [chunks_of(t) if t else [] for t in texts]
    new = dict.fromkeys(c for chunks in split for c in chunks if c not in tokens.number)
    tokens.learn(list(new))
    numbers = [list(map(tokens.number.__getitem__, chunks)) for chunks in split]
    facts = np.frombuffer(tokens.facts, np.int64).reshape(-1, 5)
    sums = np.zeros((len(texts), 4), np.int64)
    digests = []
    for i, own in enumerate(numbers):
        if own:
            total = facts[own].sum(0)
            if total[4]:
                numbers[i] = own = []
            else:
                sums[i] = total[:4]
        digests.append(hashlib.sha256(";".join(map(tokens.shown.__getitem__, own)).encode()).hexdigest() if own else "")
    sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
    flat = np.fromiter((k for own in numbers for k in own), np.int64, int(sizes.sum()))
    used, local = np.unique(flat, return_inverse=True)
    # documents: which chunks, how often
    cells, times = np.unique(np.repeat(np.arange(len(texts)), sizes) * len(used) + local, return_counts=True)
    width = max(1, len(used))
    doc, chunk = cells // width, cells % width
    # chunks: which pairs, how often
    starts = np.frombuffer(tokens.starts, np.int64)
    at = _within(starts[used], starts[used + 1])
    pairs, pair_of = np.unique(np.frombuffer(tokens.pairs, np.int64)[at], return_inverse=True)
    held_starts = np.concatenate(([0], np.cumsum(starts[used + 1] - starts[used])))
    # documents per pair, a run of documents at a time
    counts, step = np.zeros(len(pairs), np.int64), 0
    bounds = np.searchsorted(doc, np.arange(0, len(texts) + 256, 256))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        reach = held_starts[chunk[a:b] + 1] - held_starts[chunk[a:b]]
        linked = pair_of[_within(held_starts[chunk[a:b]], held_starts[chunk[a:b] + 1])]
        cell = np.unique(np.repeat(doc[a:b] - step, reach) * max(1, len(pairs)) + linked)
        counts += np.bincount(cell % max(1, len(pairs)), minlength=len(pairs))
        step += 256
    held.update(dict(zip(pairs.tolist(), counts.tolist(), strict=True)))
    return {
        "keys": keys,
        "sums": sums,
        "digests": digests,
        "pairs": pairs,
        "chunk_pairs": [_packed(x) for x in (np.diff(held_starts), pair_of, np.frombuffer(tokens.times, np.int64)[at])],
        "doc_chunks": [_packed(x) for x in (np.bincount(doc, minlength=len(texts)), chunk, times)],
    }


def blocks(docs: DataFrame, key: str, text: str, bytes_file: str, pieces_file: str) -> DataFrame:
    """Rows of two kinds: blocks (block, keys, facts, digests, own pairs, packed chunks and documents),
    and (pair, n), the documents of a task that hold a pair; block is null there."""
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = narrow.schema[0].dataType
    fields = f"block bigint, keys array<{kind.simpleString()}>, sums array<bigint>, digests array<string>, own array<bigint>, chunk_pairs array<binary>, doc_chunks array<binary>, pair bigint, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held = pair(bytes_file, pieces_file), Counter()
        number = TaskContext.get().partitionId() << 32
        key_type = None
        for part in batches:
            key_type, at, texts = part.schema.field(0).type, 0, part.column(1).to_pylist()
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to] or "") <= BLOCK_CHARS):
                    chars += len(texts[to] or "")
                    to += 1
                if tokens.chars > STORE_CHARS:
                    tokens.forget()
                row = _block(tokens, part.column(0).slice(at, to - at), texts[at:to], held)
                keys = row["keys"]
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([number], pa.int64()),
                    "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                    "sums": pa.array([row["sums"].ravel()], pa.list_(pa.int64())),
                    "digests": pa.array([row["digests"]], pa.list_(pa.string())),
                    "own": pa.array([row["pairs"]], pa.list_(pa.int64())),
                    "chunk_pairs": pa.array([row["chunk_pairs"]], pa.list_(pa.binary())),
                    "doc_chunks": pa.array([row["doc_chunks"]], pa.list_(pa.binary())),
                    "pair": pa.array([None], pa.int64()),
                    "n": pa.array([None], pa.int64()),
                })
                number, at = number + 1, to
        if held:
            none = lambda t: pa.nulls(len(held), t)
            yield pa.RecordBatch.from_pydict({
                "block": none(pa.int64()), "keys": none(pa.list_(key_type)), "sums": none(pa.list_(pa.int64())), "digests": none(pa.list_(pa.string())),
                "own": none(pa.list_(pa.int64())), "chunk_pairs": none(pa.list_(pa.binary())), "doc_chunks": none(pa.list_(pa.binary())),
                "pair": pa.array(list(held.keys()), pa.int64()), "n": pa.array(list(held.values()), pa.int64()),
            })

    return narrow.mapInArrow(run, fields)


def align(docs: DataFrame, bytes_file: str, pieces_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row.

    Texts that are null, empty, or that the second tokenizer does not give back byte by byte (blank
    marks in them) have zeros and an empty digest. Every row is a document of its own, repeated rows
    and null keys too; other columns make no difference, an empty table gives no rows.
    """
    kept = written(blocks(docs, key, text, bytes_file, pieces_file), "aligned")
    own = kept.where("block IS NOT NULL")
    counts = kept.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("docs")).withColumn("a", F.shiftright("pair", 32))
    counts = written(counts, "pairs")
    best = counts.groupBy("a").agg(F.max("docs").alias("most"))
    counts = counts.join(best, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    asked = own.select(F.col("block").alias("at"), F.explode("own").alias("pair")).join(counts, "pair")

    kind = kept.schema["keys"].dataType.elementType.simpleString()
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

    def add_up(block: pa.Table, known: pa.Table) -> pa.Table:
        keys = block.column("keys").combine_chunks().flatten()
        pairs = block.column("own").combine_chunks().flatten().to_numpy()
        found = known.column("pair").to_numpy()
        order = np.argsort(found)
        if len(found) != len(pairs) or (found[order] != pairs).any():
            raise ValueError("a block has pairs without counts")
        docs_of = known.column("docs").to_numpy()[order]
        best_of = known.column("best").to_numpy(zero_copy_only=False)[order]
        of_chunk, pair_of, times = map(_unpacked, block.column("chunk_pairs").to_pylist()[0])
        chunk = np.repeat(np.arange(len(of_chunk)), of_chunk)
        worth = np.zeros((2, len(of_chunk)), np.int64)
        np.add.at(worth[0], chunk, times * best_of[pair_of])
        np.add.at(worth[1], chunk, times * docs_of[pair_of])
        of_doc, chunk_of, often = map(_unpacked, block.column("doc_chunks").to_pylist()[0])
        doc = np.repeat(np.arange(len(of_doc)), of_doc)
        total = np.zeros((2, len(of_doc)), np.int64)
        np.add.at(total[0], doc, often * worth[0][chunk_of])
        np.add.at(total[1], doc, often * worth[1][chunk_of])
        sums = block.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, 4)
        out = {"key": keys} | {n: pa.array(c) for n, c in zip(numbers, [*sums.T, *total], strict=True)}
        return pa.table(out | {"groups_sha256": block.column("digests").combine_chunks().flatten()})

    schema = f"key {kind}, {', '.join(f'{n} bigint' for n in numbers)}, groups_sha256 string"
    return own.groupBy("block").cogroup(asked.groupBy("at")).applyInArrow(add_up, schema).withColumnRenamed("key", key)
