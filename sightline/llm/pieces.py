"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text is cut where a blank mark follows something else (no piece spans such a place). Distinct
chunks of equal length advance together: polynomial hashes of all their substrings probe the
sorted keys of the pieces, and at every end position a vectorised maximum over the possible last
pieces stores the backpointer.

For a unigram model the maximum is over summed piece scores. A merge (BPE) model's scores are
merge priorities, whose sum has no meaning; there a step from piece p to piece q counts 0 where
merging the characters of p and q yields exactly (p, q), and minus infinity elsewhere. A
segmentation is the merge result exactly if all its neighbours agree in this way, and a prefix
has one such segmentation, so the search gives the merge model's own ids.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

BLANK = "▁"

#: Fixed value: what an unknown character costs below the worst piece in a unigram model.
UNKNOWN_COST = 10.0

NORMAL, USER_DEFINED, BYTE = 1, 4, 6
UNIGRAM, MERGE = 1, 2

BASE = np.uint64(0x9E3779B97F4A7C15)
BY_LENGTH = np.uint64(0xC2B2AE3D27D4EB4F)

#: Chunks kept per worker; a full cache starts anew. Long chunks aren't kept.
CACHE, CACHED_LENGTH = 400_000, 48

#: Bits of the slot number in the table of pairs whose agreement is known (a newer pair takes the
#: slot of an older one), and in the bitmap that spares most substrings the look-up.
PAIR_BITS, SEEN_BITS = 20, 20

#: Cells (chunks x characters) of one batch that advances together.
CELLS = 200_000


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal, self.kind = model.normalizer_spec, model.trainer_spec.model_type
        if normal.name != "identity" or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
            raise ValueError(f"{path} normalises its input; only identity is supported")
        if self.kind not in (UNIGRAM, MERGE):
            raise ValueError(f"{path} is neither a unigram nor a merge model")
        self.dummy = normal.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        types = [p.type for p in model.pieces]
        self.unknown = types.index(2)
        self.bytes = {p.piece: i for i, p in enumerate(model.pieces) if p.type == BYTE}
        usable = [i for i, t in enumerate(types) if t in (NORMAL, USER_DEFINED)]
        self.score = np.array([p.score for p in model.pieces], np.float32)
        self.worst = np.float32(self.score[usable].min() - np.float32(UNKNOWN_COST))
        self.ids = {self.pieces[i]: i for i in usable}
        self.longest = max(map(len, self.ids))
        if any(regex.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids):
            raise ValueError(f"{path} has pieces that span a blank")
        keys = np.array([self._key(self.pieces[i]) for i in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(usable, np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a key")
        self.raw = [self._raw(i, t) for i, t in enumerate(types)]
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.pieces))]
        self.seen = np.zeros(1 << SEEN_BITS, bool)
        self.seen[self.keys >> np.uint64(64 - SEEN_BITS)] = True
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)
        self.agreed = np.zeros(1 << PAIR_BITS, bool)
        self.known: dict[str, bytes] = {}

    def _key(self, piece: str) -> np.uint64:
        with np.errstate(over="ignore"):
            h = np.uint64(0)
            for c in piece:
                h = h * BASE + np.uint64(ord(c))
            return h + BY_LENGTH * np.uint64(len(piece))

    def _raw(self, i: int, kind: int) -> bytes:
        """Bytes that a piece stands for in a decoded text."""
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:-1], 16)])
        if kind in (NORMAL, USER_DEFINED):
            return self.pieces[i].replace(BLANK, " ").encode()
        return b" \xe2\x81\x87 " if i == self.unknown else b""

    # -- merge models: which pieces can stand beside each other

    def _string(self, token: int) -> str:
        """Tokens from len(pieces) on are characters that have no piece."""
        return self.pieces[token] if token < len(self.pieces) else chr(token - len(self.pieces))

    def _merge(self, text: str) -> list[str]:
        """Repeatedly join the adjacent pair whose union has the best score, leftmost first."""
        symbols = list(text)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                found = self.ids.get(symbols[i] + symbols[i + 1])
                if found is not None and (best is None or self.score[found] > best):
                    best, at = self.score[found], i
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _agree(self, pair: int) -> bool:
        """Whether the pieces left and right (packed as (left + 1) << 32 | right) stay apart; left
        -1 is the start of a chunk."""
        left, right = (pair >> 32) - 1, pair & 0xFFFFFFFF
        b = self._string(right)
        if left < 0:
            return self._merge(b) == [b]
        a = self._string(left)
        return self._merge(a + b) == [a, b]

    def _agreeing(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = (left + 1) << 32 | right
        with np.errstate(over="ignore"):
            slots = (pairs.astype(np.uint64) * BASE) >> np.uint64(64 - PAIR_BITS)
        out, miss = self.agreed[slots], np.flatnonzero(self.pairs[slots] != pairs)
        if miss.size:
            new, back = np.unique(pairs[miss], return_inverse=True)
            found = np.fromiter(map(self._agree, new.tolist()), bool, len(new))
            out[miss] = found[back]
            self.pairs[slots[miss]] = pairs[miss]
            # of pairs that share a slot the last one stays, in both arrays alike
            self.agreed[slots[miss]] = out[miss]
        return out

    # -- the search

    def _search(self, chunks: list[str]) -> list[list[int]]:
        """Token lists of chunks that all have the same length."""
        n, size = len(chunks), len(chunks[0])
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).reshape(n, size)
        hashes = np.zeros((n, size + 1), np.uint64)
        powers = np.ones(self.longest + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(1, len(powers)):
                powers[i] = powers[i - 1] * BASE
            for i in range(size):
                hashes[:, i + 1] = hashes[:, i] * BASE + codes[:, i]
        best = np.full((n, size + 1), -np.inf, np.float32)
        best[:, 0] = 0
        reached = np.zeros((n, size + 1), bool)
        reached[:, 0] = True
        last = np.full((n, size + 1), -1, np.int64)
        back = np.zeros((n, size + 1), np.int32)
        for end in range(1, size + 1):
            for start in range(max(0, end - self.longest), end):
                width = end - start
                with np.errstate(over="ignore"):
                    key = hashes[:, end] - hashes[:, start] * powers[width] + BY_LENGTH * np.uint64(width)
                rows = np.flatnonzero(self.seen[key >> np.uint64(64 - SEEN_BITS)] if width > 1 else reached[:, start])
                rows = rows[reached[rows, start]]
                if not rows.size:
                    continue
                at = np.minimum(np.searchsorted(self.keys, key[rows]), len(self.keys) - 1)
                token = np.where(self.keys[at] == key[rows], self.key_ids[at], -1)
                if width == 1:
                    token = np.where(token < 0, codes[rows, start].astype(np.int64) + len(self.pieces), token)
                else:
                    rows, token = rows[token >= 0], token[token >= 0]
                if self.kind == MERGE:
                    rows = rows[keep := self._agreeing(last[rows, start], token)]
                    token, value = token[keep], np.float32(0)
                else:
                    own = token < len(self.pieces)
                    value = np.where(own, self.score[np.where(own, token, 0)], self.worst)
                value = best[rows, start] + value
                up = value > best[rows, end]
                rows, token = rows[up], token[up]
                best[rows, end], last[rows, end], back[rows, end], reached[rows, end] = value[up], token, start, True
        # backpointers of all chunks at once, from the end: column k has the k-th last token
        steps, at, rows = [], np.full(n, size), np.arange(n)
        count = np.zeros(n, np.int64)
        while rows.size:
            column = np.zeros(n, np.int64)
            column[rows] = last[rows, at[rows]]
            steps.append(column)
            count[rows] += 1
            at[rows] = back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        tokens = np.stack(steps[::-1], 1).tolist()
        return [t[len(steps) - k :] for t, k in zip(tokens, count.tolist(), strict=True)]

    def _ids(self, chunk: str, tokens: list[int]) -> bytes:
        """Little-endian 32-bit ids; characters without a piece become bytes or the unknown id."""
        own = tokens if max(tokens) < len(self.pieces) else None
        if "".join(map(self.pieces.__getitem__, own) if own else map(self._string, tokens)) != chunk:
            raise ValueError("two substrings share a key")
        if own:
            return b"".join(map(self.packed.__getitem__, own))
        ids: list[int] = []
        for t in tokens:
            if t < len(self.pieces):
                ids.append(t)
            elif self.bytes:
                ids += [self.bytes[f"<0x{b:02X}>"] for b in chr(t - len(self.pieces)).encode()]
            elif not ids or ids[-1] != self.unknown or self.kind == MERGE:
                ids.append(self.unknown)
        return np.array(ids, "<u4").tobytes()

    def learn(self, chunks: Iterable[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        for c in chunks:
            by_length.setdefault(len(c), []).append(c)
        for size, same in by_length.items():
            step = max(1, CELLS // size)
            for i in range(0, len(same), step):
                part = same[i : i + step]
                for c, tokens in zip(part, self._search(part), strict=True):
                    found[c] = self._ids(c, tokens)
        return found

    def chunks(self, text: str) -> list[str]:
        """The text with blank marks, cut before each run of marks that follows something else."""
        if BLANK in text:
            text = text.replace(BLANK, " ")
        if text[:1] == " " or "  " in text:
            marked = (BLANK if self.dummy else "") + text.replace(" ", BLANK)
            return regex.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", marked)
        return ((BLANK if self.dummy else "") + text.replace(" ", " " + BLANK)).split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; null and empty texts have none."""
        split = [self.chunks(t) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        new: set[str] = set()
        for chunks in split:
            new.update(chunks)
        found = self.learn(new.difference(self.known))
        self.known.update(found)
        out = [b"".join(map(self.known.__getitem__, chunks)) for chunks in split]
        for c in found:
            if len(c) > CACHED_LENGTH:
                del self.known[c]
        return out

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self.dummy and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for each row; null and empty texts have no ids. Rows are encoded one
    by one without a shuffle, so nulls, repeated keys and other columns make no difference."""

    def batch(part: pa.RecordBatch) -> dict:
        ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in piece_model(model).encode(part.column(1).to_pylist())]
        return {key: part.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))}

    narrow = docs.select(F.col(key), F.col(text))
    return arrow_map(narrow, batch, f"`{key}` {narrow.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of encoded rows; null ids give an empty text."""

    def batch(part: pa.RecordBatch) -> dict:
        texts = [piece_model(model).decode(np.array(x or [], "<u4").tobytes()) for x in part.column(1).to_pylist()]
        return {key: part.column(0), "text": texts}

    narrow = encoded.select(F.col(key), F.col(ids))
    return arrow_map(narrow, batch, f"`{key}` {narrow.schema[0].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_pieces, ids_crc32, decoded_sha256, same): digests of `encode` and of `decode` after
    it, in one pass, so that ids of whole texts need not leave the task. `same` says whether the
    decoded text is the text (blank marks in it read as blanks; null reads as empty)."""

    def batch(part: pa.RecordBatch) -> dict:
        m, texts = piece_model(model), [t or "" for t in part.column(1).to_pylist()]
        encoded = m.encode(texts)
        decoded = [m.decode(x) for x in encoded]
        return {
            key: part.column(0),
            "n_pieces": pa.array([len(x) // 4 for x in encoded], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(x) for x in encoded], pa.int64()),
            "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for d in decoded],
            "same": [d == t.replace(BLANK, " ") for d, t in zip(decoded, texts, strict=True)],
        }

    narrow = docs.select(F.col(key), F.col(text))
    kind = narrow.schema[0].dataType.simpleString()
    return arrow_map(narrow, batch, f"`{key}` {kind}, n_pieces bigint, ids_crc32 bigint, decoded_sha256 string, same boolean")
