"""Token counts by byte-pair merging on a heap and a linked list; no identifiers are emitted.

A piece of n bytes starts as n symbols. The adjacent pair of lowest rank (leftmost among
equals) is merged until no pair has a rank; each merge takes away one symbol, so the count is
n minus the merges. Pieces come from the byte-level splitting pattern; special strings are cut
out first and count one each.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: The byte-level splitting pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries kept per worker; a full cache starts anew. Long pieces are not kept.
CACHE, CACHED_LENGTH = 400_000, 48


def byte_symbols() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary: printable Latin-1 stands
    for itself, the other bytes follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairMerger:
    """Counts the tokens of texts for one byte-level vocabulary file (tokenizers .json)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or spec["normalizer"] or split["add_prefix_space"] or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level pair vocabulary")
        ids = model["vocab"]
        to_byte = byte_symbols()
        self.first = [0] * 256
        for char, byte in to_byte.items():
            self.first[byte] = ids[char]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        #: (left id << 32 | right id) -> (rank, merged id)
        self.merges = {ids[a] << 32 | ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(SPLIT)
        #: a blank between two characters that are no white space always starts a piece
        self.blank = re.compile(r"(?<=\S) (?=\S)")
        #: a blank beside other white space
        self.odd = re.compile(r" (?:\s|(?<=\s ))")
        self.by_piece: dict[str, int] = {}
        self.by_chunk: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Symbols that are left of one piece."""
        n, merges = len(piece), self.merges
        symbols = [self.first[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i) for i in range(n - 1) if (m := merges.get(symbols[i] << 32 | symbols[i + 1]))]
        heapify(heap)
        left = n
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            found = merges.get(symbols[i] << 32 | symbols[j])
            if not found or found[0] != rank:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = found[1], -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if m := merges.get(symbols[i] << 32 | symbols[k]):
                    heappush(heap, (m[0], i))
            if (h := before[i]) >= 0 and (m := merges.get(symbols[h] << 32 | symbols[i])):
                heappush(heap, (m[0], h))
        return left

    def piece(self, piece: str) -> int:
        count = self.by_piece.get(piece)
        if count is None:
            raw = piece.encode()
            count = self.merged(raw) if len(raw) > 1 else len(raw)
            if len(piece) <= CACHED_LENGTH:
                if len(self.by_piece) >= CACHE:
                    self.by_piece.clear()
                self.by_piece[piece] = count
        return count

    def chunk(self, chunk: str) -> int:
        return sum(map(self.piece, self.split.findall(chunk)))

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings; chunks between single blanks are cached."""
        head, *rest = self.blank.split(text) if self.odd.search(text) else text.split(" ")
        total, known = self.chunk(head), self.by_chunk
        try:
            return total + sum(map(known.__getitem__, rest))
        except KeyError:
            pass
        for chunk in rest:
            count = known.get(chunk)
            if count is None:
                count = self.chunk(" " + chunk)
                if len(chunk) <= CACHED_LENGTH:
                    if len(known) >= CACHE:
                        known.clear()
                    known[chunk] = count
            total += count
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)


@lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def count_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row of `docs`.

    Null and empty texts have 0 bytes and tokens. Equal rows, null keys and other columns make
    no difference: every row is counted by itself, without a shuffle.
    """

    def batch(part: pa.RecordBatch) -> dict:
        count = merger(vocabulary).count
        texts = part.column(1).to_pylist()
        tokens = np.fromiter(map(count, texts), np.int64, len(texts))
        return {
            key: part.column(0),
            "n_bytes": np.fromiter((len(t.encode()) if t else 0 for t in texts), np.int64, len(texts)),
            "n_tokens": tokens,
            "over_limit": tokens > limit,
        }

    narrow = docs.select(F.col(key), F.col(text))
    kind = narrow.schema[0].dataType.simpleString()
    return arrow_map(narrow, batch, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
