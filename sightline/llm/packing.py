"""Bounded-space online packing of token ids into windows.

Each partition keeps a fixed number of windows open and places every document best-fit: into
the open window with the least room that still holds it. Where none does, the fullest window is
emitted, after the document's head has filled it if the room is worth a cut. What stays open at
the end of the partitions meets in groups of partitions and is packed once more the same way.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .token_counts import byte_symbols

#: Entries kept per worker; a full cache starts anew. Long words are not kept.
CACHE, CACHED_LENGTH = 1_000_000, 48

NEVER = 1 << 60


#: Lines that are plain words: letters whose lower case and normal form are the same in every library, and
#: a few marks, which the library cuts off. An apostrophe may stay with letters. Other lines have no groups;
#: so have long ones, whose merging side by side would take the square of their length.
PLAIN = re.compile("([a-z\xdf-\xf6\xf8-\xff]{1,64})([!-&(-/:-@\\[-`{-~]{0,3})\n|[^\n]*\n")

#: Slots in which the pairs of the merge table are looked up; a power of two.
SLOTS = 1 << 20


class LetterRuns:
    """Ids of runs of plain lower-case letters: runs of equal length are merged side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        inner, final = [0] * 256, [0] * 256
        for char, byte in byte_symbols().items():
            inner[byte], final[byte] = ids[char], ids[char + end]
        self.inner, self.final = np.array(inner, np.int64), np.array(final, np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, joined = (np.array([ids[x] for x in c], np.int64) for c in zip(*((a, b, a + b) for a, b in pairs), strict=True))
        keys = left << 20 | right
        order = np.argsort(keys)
        self.keys, self.rank, self.joined = keys[order], order, joined[order]
        slots = self._slot(self.keys)
        self.place = np.zeros(SLOTS, np.int64)
        self.place[slots] = np.arange(len(slots))
        self.crowded = np.bincount(slots, minlength=SLOTS) > 1

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B97F4A7C1 >> 20) & (SLOTS - 1)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the merge table by rank, or a large number."""
        keys = left << 20 | right
        slots = self._slot(keys)
        at = self.place[slots]
        if (several := self.crowded[slots]).any():
            at[several] = np.minimum(np.searchsorted(self.keys, keys[several]), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at] << 20 | at, NEVER)

    def encode(self, runs: list[bytes]) -> dict[bytes, bytes]:
        by_size: dict[int, list[bytes]] = {}
        for r in runs:
            by_size.setdefault(len(r), []).append(r)
        found: dict[bytes, bytes] = {}
        for size, same in by_size.items():
            step = max(1, 100_000 // size)
            for i in range(0, len(same), step):
                part = same[i : i + step]
                found.update(zip(part, self._merge(part, size), strict=True))
        return found

    @staticmethod
    def _without(values: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """`values` without one of each row."""
        kept = np.ones(values.shape, bool)
        kept[rows, at] = False
        return values[kept].reshape(len(values), values.shape[1] - 1)

    def _merge(self, runs: list[bytes], size: int) -> list[bytes]:
        raw = np.frombuffer(b"".join(runs), np.uint8).reshape(-1, size)
        symbols = self.inner[raw]
        symbols[:, -1] = self.final[raw[:, -1]]
        ranks = self._ranks(symbols[:, :-1], symbols[:, 1:])
        out, left = np.full(symbols.shape, -1, "<i4"), np.arange(len(runs))
        while left.size and symbols.shape[1] > 1:
            at = ranks.argmin(1)  # lowest rank, leftmost among equals
            best = ranks[np.arange(len(at)), at]
            if (done := best == NEVER).any():
                out[left[done], : symbols.shape[1]] = symbols[done]
                left, symbols, ranks, at, best = left[~done], symbols[~done], ranks[~done], at[~done], best[~done]
            rows, width = np.arange(len(at)), symbols.shape[1] - 1
            symbols[rows, at] = self.joined[best & ((1 << 20) - 1)]
            symbols = self._without(symbols, rows, at + 1)
            ranks = self._without(ranks, rows, at)
            # only the pairs on both sides of the joined symbol are new
            before, after = at > 0, at < width - 1
            row = np.concatenate((rows[before], rows[after]))
            new = np.concatenate((at[before] - 1, at[after]))
            ranks[row, new] = self._ranks(symbols[row, new], symbols[row, new + 1])
        out[left, : symbols.shape[1]] = symbols
        sizes = (out >= 0).sum(1).tolist()
        return [row[: 4 * n] for row, n in zip(map(bytes, out), sizes, strict=True)]


class WordEncoder:
    """Ids of whole texts for a vocabulary whose pieces never span white space.

    Each distinct word between ASCII white space is encoded once per worker; its ids are kept as
    little-endian 32-bit integers. Runs of plain letters are merged in batches, all other words go
    to the library. Special strings hold no white space, so they are found inside a word exactly
    as in the text.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.runs = LetterRuns(path)
        self.marks: dict[str, bytes] = {"": b""}
        self.known: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct `words`."""
        lines = b"\n".join([*words, b""]).decode().lower()
        plain = PLAIN.findall(lines)
        runs = self.runs.encode([run.encode() for run in {run for run, _ in plain if run}])
        found: dict[bytes, bytes] = {}
        for word, (run, mark) in zip(words, plain, strict=True):
            if not run:
                found[word] = self._ids(word.decode())
            else:
                if mark not in self.marks:
                    self.marks[mark] = self._ids(mark)
                found[word] = runs[run.encode()] + self.marks[mark]
        return found

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_batch(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text in turn; new words of some texts at a time are learned together."""
        at = 0
        while at < len(texts):
            size, upto = 0, at
            while upto < len(texts) and (size < 2_000_000 or upto == at):
                size += len(texts[upto])
                upto += 1
            split = [t.split() for t in texts[at:upto]]
            if len(self.known) > CACHE:
                self.known.clear()
            ids = dict.fromkeys(chain.from_iterable(split))
            found = self.learn(list(set(ids).difference(self.known)))
            self.known.update(found)
            for word in ids:
                ids[word] = self.known[word]
            for words in split:
                yield b"".join(map(ids.__getitem__, words))
            for word in found:
                if len(word) > CACHED_LENGTH:
                    del self.known[word]
            at = upto


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Packer:
    """Open windows of one partition. A piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, size: int, most_open: int, least_cut: int, first: int):
        self.size, self.most_open, self.least_cut, self.next = size, most_open, least_cut, first
        self.open: list[list] = []  # [used, pieces]

    def place(self, doc, start: int, ids: bytes, doc_tokens: int) -> Iterator[tuple]:
        """Windows that are closed by this piece, as (id, pieces)."""
        width = 4 * self.size
        while len(ids) >= width:
            yield self._close([(doc, start, ids[:width], doc_tokens)])
            start, ids = start + self.size, ids[width:]
        while ids:
            n = len(ids) // 4
            best = min((w for w in self.open if self.size - w[0] >= n), key=lambda w: self.size - w[0], default=None)
            if best is not None:
                best[0] += n
                best[1].append((doc, start, ids, doc_tokens))
                if best[0] == self.size:
                    self.open.remove(best)
                    yield self._close(best[1])
                return
            if len(self.open) < self.most_open:
                self.open.append([n, [(doc, start, ids, doc_tokens)]])
                return
            full = max(self.open, key=lambda w: w[0])
            self.open.remove(full)
            if (room := self.size - full[0]) >= self.least_cut:
                full[1].append((doc, start, ids[: 4 * room], doc_tokens))
                start, ids = start + room, ids[4 * room :]
            yield self._close(full[1])

    def _close(self, pieces: list) -> tuple:
        self.next += 1
        return self.next - 1, pieces

    def rest(self) -> Iterator[tuple]:
        for _, pieces in self.open:
            yield self._close(pieces)


FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _rows(key: str, windows: Iterator[tuple], closed: bool, keep_ids: bool) -> Iterator[dict]:
    for window, pieces in windows:
        offset = 0
        for doc, start, ids, doc_tokens in pieces:
            n = len(ids) // 4
            yield {
                key: doc, "start": start, "length": n, "ids_crc32": zlib.crc32(ids), "doc_tokens": doc_tokens,
                "sequence_id": window, "offset": offset, "closed": closed, "ids": ids if keep_ids or not closed else None,
            }
            offset += n


def pack(
    docs: DataFrame,
    vocabulary: str,
    key: str = "doc_id",
    text: str = "text",
    size: int = 4096,
    end_id: int = 2,
    most_open: int = 32,
    least_cut: int = 16,
    fan_in: int = 16,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    `ids` are little-endian unsigned 32-bit token ids. Every id of a document and its `end_id` lies
    in one piece; null and empty texts are `end_id` alone; equal rows are packed each by itself;
    a null key stays null. No window exceeds `size`; the leftovers of `fan_in` partitions meet in
    one task, which holds at most `fan_in * most_open` windows whatever the input.
    The first pass is written to the shared folder, so a lost executor never changes it.
    """
    end = end_id.to_bytes(4, "little")
    narrow = docs.select(F.col(key), F.col(text))
    kind = narrow.schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ", ".join(f"`{f}` bigint" for f in FIELDS) + ", closed boolean, ids binary"

    def columns(rows: list[dict]) -> pa.RecordBatch:
        names = [key, *FIELDS, "closed", "ids"]
        return pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], types.get(n, pa.int64())) for n in names})

    types: dict = {"closed": pa.bool_(), "ids": pa.binary()}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, most_open, least_cut, TaskContext.get().partitionId() << 32)
        encode = encoder(vocabulary).encode_batch
        for part in batches:
            types[key] = part.schema.field(0).type
            keys, texts, rows = part.column(0).to_pylist(), part.column(1).to_pylist(), []
            for doc, ids in zip(keys, encode([t.encode() if t else b"" for t in texts]), strict=True):
                ids += end
                rows.extend(_rows(key, packer.place(doc, 0, ids, len(ids) // 4), True, keep_ids))
                if len(rows) >= 2000:
                    yield columns(rows)
                    rows = []
            if rows:
                yield columns(rows)
        rows = list(_rows(key, packer.rest(), False, keep_ids))
        if rows:
            yield columns(rows)

    def again(group: tuple, left: pa.Table) -> pa.Table:
        types[key] = left.schema.field(key).type
        packer = Packer(size, most_open, least_cut, (1 << 62) | group[0].as_py() << 32)
        rows: list[dict] = []
        for r in left.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
            rows.extend(_rows(key, packer.place(r[key], r["start"], r["ids"], r["doc_tokens"]), True, keep_ids))
        rows.extend(_rows(key, packer.rest(), True, keep_ids))
        return pa.Table.from_batches([columns(rows)])

    pieces = written(narrow.mapInArrow(first, schema), "pieces")
    group = F.expr(f"shiftright(sequence_id, 32) div {fan_in}").alias("group")
    leftovers = pieces.where("NOT closed").groupBy(group).applyInArrow(again, schema)
    packed = pieces.where("closed").unionByName(leftovers)
    return packed.select(key, *FIELDS, *(["ids"] if keep_ids else []))
