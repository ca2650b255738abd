"""Audit of how text filters interact: what each removes alone, after others, and on average.

Whether a text repeats is the one filter that needs the whole table. A counting Bloom prepass
clears the texts that are certainly unique: the digests of the texts are dealt over segments of
SEGMENT texts, each with a small counting Bloom filter. Every task sketches its own rows, the
sketches of a segment are merged where the segment's digests are looked up, and only digests whose
counters all reach two go on to the exact minimum of ids. No text is shuffled: the SHA-256 of the
full text stands for it.

The flags of a document are one bit each. Counts by (part, flags) are additive, and everything in
the report is a sum over them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")

#: Texts of a segment; counters of its sketch; counters that a text raises.
SEGMENT, COUNTERS, RAISED = 4096, 65_536, 3

SYMBOLS = re.compile(rb"[#$%&*|]")
NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)


def own_flags(raw: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that a text fails."""
    words = raw.split()  # bytes split at exactly the ASCII white space
    few = len(words) < 200
    same = 100 * len(set(words)) < 50 * len(words)
    loud = 100 * len(raw.translate(None, NOT_CAPITAL)) > 2 * n_chars
    return few | same << 1 | loud << 2 | bool(SYMBOLS.search(raw)) << 3


def flagged(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(key, part, mask, digest) per row: the filters A to D and the SHA-256 of the text."""

    def batch(rows: pa.RecordBatch) -> dict:
        masks, digests = [], []
        for t in rows.column(2).to_pylist():
            raw = t.encode() if t else b""
            masks.append(own_flags(raw, len(t or "")))
            digests.append(hashlib.sha256(raw).digest())
        return {"key": rows.column(0), "part": rows.column(1), "mask": pa.array(masks, pa.int32()), "digest": pa.array(digests, pa.binary())}

    narrow = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    return arrow_map(narrow, batch, f"key {narrow.schema[0].dataType.simpleString()}, part string, mask int, digest binary")


# -- the prepass

def _hashes(digests: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)


def counters_of(hashes: np.ndarray) -> np.ndarray:
    """The counters that each text raises, from 16 bits each of its first hash."""
    return np.stack([(hashes >> np.uint64(16 * i)) & np.uint64(COUNTERS - 1) for i in range(RAISED)], 1).astype(np.int64)


def sketches(digests: DataFrame, segments: int) -> DataFrame:
    """(segment, at, n): for each task and segment the counters raised there and whether once (1) or
    more often (2), as packed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.int64)
        often = np.zeros(0, np.int64)
        for rows in batches:
            if not rows.num_rows:
                continue
            four = _hashes(rows.column(0))
            segment = (four[:, 1] % np.uint64(segments)).astype(np.int64)
            raised = (segment[:, None] * COUNTERS + counters_of(four[:, 0])).ravel()
            own, back = np.unique(np.concatenate((own, raised)), return_inverse=True)
            # what was there counts as before, what is new once each
            often = np.minimum(np.bincount(back, np.concatenate((often, np.ones(len(raised)))), len(own)), 2).astype(np.int64)
        if len(own):
            segment, first = np.unique(own // COUNTERS, return_index=True)
            ends = np.append(first[1:], len(own))
            at, n = (own % COUNTERS).astype("<u2"), often.astype(np.uint8)
            yield pa.RecordBatch.from_pydict({
                "segment": segment,
                "at": pa.array([at[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
                "n": pa.array([n[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
            })

    return digests.mapInArrow(run, "segment bigint, at binary, n binary")


def possible_repeats(marked: DataFrame) -> DataFrame:
    """(hash): first 64 bits of the digests whose counters are all at two or more. Every text that
    occurs twice is among them; a unique text is there only where others raise all its counters."""
    segments = max(1, -(-marked.count() // SEGMENT))

    def keys(rows: pa.RecordBatch) -> dict:
        four = _hashes(rows.column(0))
        return {"segment": (four[:, 1] % np.uint64(segments)).astype(np.int64), "hash": four[:, 0].view(np.int64)}

    def look_up(partial: pa.Table, asked: pa.Table) -> pa.Table:
        counters = np.zeros(COUNTERS, np.int64)
        for at, n in zip(partial.column("at").to_pylist(), partial.column("n").to_pylist(), strict=True):
            counters[np.frombuffer(at, "<u2")] += np.frombuffer(n, np.uint8)
        hashes = asked.column("hash").to_numpy()
        again = (counters[counters_of(hashes.view(np.uint64))] > 1).all(1) if len(hashes) else np.zeros(0, bool)
        return pa.table({"hash": pa.array(hashes[again], pa.int64())})

    asked = arrow_map(marked.select("digest"), keys, "segment bigint, hash bigint").distinct()
    partial = sketches(marked.select("digest"), segments)
    return partial.groupBy("segment").cogroup(asked.groupBy("segment")).applyInArrow(look_up, "hash bigint")


def first_ids(marked: DataFrame) -> DataFrame:
    """(digest, first): the least key of each text that occurs more than once."""
    hashed = marked.select("key", "digest", _first_hash().alias("hash"))
    again = hashed.join(possible_repeats(marked), "hash", "left_semi")
    counted = again.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    return counted.where("n > 1 AND first IS NOT NULL").select("digest", "first")


def _first_hash() -> Column:
    """The first eight bytes of the digest as a little-endian signed integer, as in `_hashes`."""
    swapped = F.concat(*[F.substring("digest", i, 1) for i in range(8, 0, -1)])
    high = F.conv(F.hex(F.substring(swapped, 1, 4)), 16, 10).cast("bigint")
    low = F.conv(F.hex(F.substring(swapped, 5, 4)), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def flag_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters that they fail, as bits.

    E is failed where a row with a smaller key has the same text; rows with a null key never fail
    it and give no minimum, rows repeated with one key don't repeat each other. Null texts are
    empty, null parts the empty string. A document is good or toxic if any row of `labels` with its
    key says so. Other columns make no difference; an empty table gives no rows.
    """
    marked = written(flagged(docs, key, text, part), "flags")
    known = labels.groupBy(F.col(key).alias("key")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic")
    )
    repeats = (F.col("key") > F.col("first")).cast("int") * REPEATED
    full = marked.join(first_ids(marked), "digest", "left").select("key", "part", F.col("mask").bitwiseOR(F.coalesce(repeats, F.lit(0))).alias("mask"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return full.join(known, "key", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))


def _total(what: str, where: str) -> Column:
    return F.expr(f"aggregate(masks, 0L, (s, x) -> s + IF({where}, {what}, 0L))")


def interactions(counts: DataFrame) -> DataFrame:
    """The report: a row per part, order of the filters and step, from `flag_counts`."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 entries at most
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = parts.select("part", "masks", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    rows = rows.withColumn("own", F.expr("shiftleft(1, ascii(substring(filter_order, step, 1)) - 65)"))
    rows = rows.withColumn("before", F.expr("aggregate(slice(split(filter_order, ''), 1, step - 1), 0, (s, c) -> s | shiftleft(1, ascii(c) - 65))"))
    fails, earlier = "(x.mask & own) != 0", "(x.mask & before) != 0"
    removed = f"{fails} AND NOT {earlier}"
    return rows.select(
        "part",
        "filter_order",
        "step",
        _total("x.n", "(x.mask & (own | before)) = 0").alias("kept"),
        _total("x.n", removed).alias("removed"),
        _total("x.n", f"{fails} AND {earlier}").alias("redundant"),
        _total("x.n", "x.mask = own").alias("unique_fails"),
        _total("x.good", removed).alias("good_lost"),
        _total("x.toxic", removed).alias("toxic_lost"),
        # a document that fails k filters is removed by each of them in 120 / k orders
        _total("x.n * 120L DIV bit_count(x.mask)", fails).alias("shapley"),
    )


ORACLE = """
    WITH words AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), firsts AS (
        SELECT t, min(doc_id) AS first FROM words GROUP BY 1
    ), flags AS (
        SELECT doc_id, part,
            CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
            + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
            + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
            + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
            + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
        FROM words JOIN firsts USING (t)
    ), known AS (
        SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1
    ), counts AS (
        SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
        FROM flags LEFT JOIN known USING (doc_id) GROUP BY 1, 2
    ), letters AS (
        SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
    ), orders AS (
        SELECT a.c || b.c || d.c || e.c || f.c AS filter_order
        FROM letters a JOIN letters b ON b.c <> a.c JOIN letters d ON d.c NOT IN (a.c, b.c)
        JOIN letters e ON e.c NOT IN (a.c, b.c, d.c) JOIN letters f ON f.c NOT IN (a.c, b.c, d.c, e.c)
    ), steps AS (
        SELECT filter_order, step, 1 << (ascii(substring(filter_order, step, 1)) - 65) AS own,
            CASE WHEN step > 1 THEN 1 << (ascii(substring(filter_order, 1, 1)) - 65) ELSE 0 END
            + CASE WHEN step > 2 THEN 1 << (ascii(substring(filter_order, 2, 1)) - 65) ELSE 0 END
            + CASE WHEN step > 3 THEN 1 << (ascii(substring(filter_order, 3, 1)) - 65) ELSE 0 END
            + CASE WHEN step > 4 THEN 1 << (ascii(substring(filter_order, 4, 1)) - 65) ELSE 0 END AS before
        FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
    )
    SELECT part, filter_order, step,
        CAST(sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
        CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
        CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
        CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
        CAST(sum(CASE WHEN mask & own <> 0 THEN n * 120 // bit_count(CAST(mask AS INTEGER)) ELSE 0 END) AS BIGINT) AS shapley
    FROM counts, steps
    GROUP BY ALL
"""
