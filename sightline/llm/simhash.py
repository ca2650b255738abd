"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut in an upper and a lower half. Two that differ in at most four bits differ
in at most two bits of the upper half or in at most one of the lower half. So each half's table
is probed with small Hamming balls: for the upper half both sides enumerate the ball of radius
one (two values at distance two meet in a value between them), for the lower half the probing
side alone. Fetched matches are verified on the complete distance.

Groups of copies are never paired off. Equal fingerprints are one node. Fingerprints at most two
bits apart, which are tied to the least in their common ball of radius one, form first
components; probing then concerns only table entries where different components meet.

Balls are made by explode, which the planner's size check does not see: it would send all of their
values to the driver for their few fingerprints. So every join on them is hinted to sort both sides.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import overlap
from .common import arrow_map, written
from .components import components

SEED = 42
HALF = 32
RADIUS = 4


def shingles(text: str | None, words: int) -> list[bytes]:
    """Runs of `words` adjacent words, A-Z in lower case, joined by blanks; a text of fewer words is
    one shingle, one without words (or null) has none."""
    found = text.encode().lower().split() if text else []
    if not found:
        return []
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    width = min(words, len(found))
    return [joined[a:b] for a, b in zip(starts[: len(found) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    found = shingles(text, words)
    return np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64, len(found))


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes, as a signed integer; 0 without hashes."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, words: int) -> int:
    """Of all shingles, repeats included. A text without words has fingerprint 0."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(key, bits bigint) per row, without a shuffle."""

    def batch(part: pa.RecordBatch) -> dict:
        bits = [fingerprint(t, words) for t in part.column(1).to_pylist()]
        return {key: part.column(0), "bits": pa.array(bits, pa.int64())}

    narrow = docs.select(F.col(key), F.col(text))
    return arrow_map(narrow, batch, f"`{key}` {narrow.schema[0].dataType.simpleString()}, bits bigint")


def _ball(value: Column, width: int) -> Column:
    """The values at most one of `width` low bits away from `value`, itself first."""
    return F.array(value, *[value.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(width)])


def _upper(bits: Column) -> Column:
    return F.shiftrightunsigned(bits, HALF)


def _lower(bits: Column) -> Column:
    return bits.bitwiseAND(F.lit((1 << HALF) - 1))


def _tied(nodes: DataFrame) -> DataFrame:
    """Edges from fingerprints to the least one in each ball of radius one that they share."""
    near = nodes.select("bits", F.explode(_ball(F.col("bits"), 64)).alias("at"))
    least = near.groupBy("at").agg(F.min("bits").alias("b"), F.max("bits").alias("m")).where("b < m").select("at", "b")
    return near.join(least.hint("merge"), "at").where("bits <> b").select(F.col("bits").alias("a"), "b").distinct()


def _entries(labelled: DataFrame) -> DataFrame:
    """Table entries (side, at, flip) of both halves. Keys of the lower half are made negative;
    flip is the bit turned by the ball, -1 for none; probe and stored tell the roles."""
    upper = _upper(F.col("bits"))
    first = labelled.select("bits", "label", F.posexplode(_ball(upper, HALF)).alias("flip", "at"))
    below = F.transform(_ball(_lower(F.col("bits")), HALF), lambda v: -1 - v)
    second = labelled.select("bits", "label", F.posexplode(below).alias("flip", "at"))
    return first.unionByName(second).withColumn("flip", F.col("flip") - 1)


def _crossing(labelled: DataFrame) -> DataFrame:
    """Edges between labels that have fingerprints at most RADIUS bits apart, each pair of
    fingerprints verified once, at the place that its differing bits name."""
    entries = _entries(labelled)
    shared = entries.groupBy("at").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("at")
    met = written(entries.join(shared.hint("merge"), "at", "left_semi"), "entries")
    p, q = met.alias("p"), met.alias("q")
    apart = F.bit_count(F.col("p.bits").bitwiseXOR(F.col("q.bits")))
    upper = F.bit_count(_upper(F.col("p.bits").bitwiseXOR(F.col("q.bits"))))
    # upper half: equal values meet unturned, values one bit apart where q is turned, values two
    # bits apart where p turned the lower-numbered bit; lower half: q is stored as it is
    place_up = (F.col("p.at") >= 0) & (
        ((upper == 0) & (F.col("p.flip") < 0) & (F.col("q.flip") < 0))
        | ((upper == 1) & (F.col("p.flip") < 0) & (F.col("q.flip") >= 0))
        | ((upper == 2) & (F.col("p.flip") >= 0) & (F.col("p.flip") < F.col("q.flip")))
    )
    place_low = (F.col("p.at") < 0) & (upper > 2) & (F.col("q.flip") < 0)
    links = p.join(
        q.hint("merge"),
        (F.col("p.at") == F.col("q.at")) & (F.col("p.label") != F.col("q.label"))
        & (apart <= RADIUS) & (place_up | place_low),
    )
    return links.select(F.greatest("p.label", "q.label").alias("a"), F.least("p.label", "q.label").alias("b")).distinct()


def link(nodes: DataFrame) -> DataFrame:
    """(bits, root): components of distinct fingerprints linked at RADIUS or fewer differing bits.
    `nodes` has one row per fingerprint in `bits`; an empty table gives no rows."""
    first = written(components(_tied(nodes)), "roots")
    labelled = nodes.join(first.withColumnRenamed("node", "bits"), "bits", "left")
    labelled = written(labelled.select("bits", F.coalesce("root", "bits").alias("label")), "labelled")
    second = components(_crossing(labelled)).select(F.col("node").alias("label"), "root")
    return labelled.join(second, "label", "left").select("bits", F.coalesce("root", "label").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(key, fingerprint, component_id) per row; component_id is the least key of its component.

    Null and empty texts have fingerprint zero and are linked like any other. Rows with a null key
    get their component but never name it unless no row of it has a key. Repeated rows and other
    columns make no difference.
    """
    marked = written(fingerprints(docs, key, text, words), "fingerprints")
    nodes = written(marked.groupBy("bits").agg(F.min(key).alias("least")), "nodes")
    roots = written(link(nodes.select("bits")).join(nodes, "bits"), "linked")
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of_bits = roots.join(named, "root").select("bits", "component_id")
    hexed = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return marked.join(of_bits, "bits").select(F.col(key), hexed.alias("fingerprint"), "component_id")


# -- groups by similarity of shingle sets, for cleaning

#: 64-bit words of a wide fingerprint.
WIDE = 4
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _wide(hashes: np.ndarray) -> list[int]:
    out = []
    with np.errstate(over="ignore"):
        for factor in FACTORS:
            mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(factor)
            out.append(majority(mixed ^ (mixed >> np.uint64(29))))
    return out


def digest_of(text: str) -> Column:
    """What tells texts apart; null is the empty text."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def _close(held: DataFrame) -> DataFrame:
    """(v, w): values of `val` one or two bits apart, v < w, each pair once. A ball has 33 values at most."""
    near = held.select("val").distinct().select("val", F.explode(_ball(F.col("val"), HALF)).alias("at")).repartition("at")
    p, q = near.alias("p"), near.alias("q")
    turned = F.col("p.val").bitwiseXOR(F.col("q.val"))
    # one bit apart they meet in the lesser, two bits apart where the lesser has turned its lower bit
    place = F.when(F.bit_count(turned) == 1, F.col("p.val")).otherwise(F.col("p.val").bitwiseXOR(turned.bitwiseAND(-turned)))
    met = p.join(q.hint("merge"), (F.col("p.at") == F.col("q.at")) & (F.col("p.val") < F.col("q.val")) & (F.col("p.at") == place))
    return met.select(F.col("p.val").alias("v"), F.col("q.val").alias("w"))


def _likely(p: str, q: str, similarity: float) -> Column:
    """Of two numbers of shingles: whether sets so large can be alike."""
    return F.least(p, q) >= similarity * F.greatest(p, q)


def _stars(members: DataFrame, close: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each member of a value tied to its head, and the heads of close values, unless the marks
    of their full sets exclude them."""
    order = F.xxhash64("node")
    heads = written(members.groupBy("val").agg(F.min_by(F.struct("node", "size", "whole"), order).alias("h")), "heads")
    own = members.select("val", F.struct("node", "size", "whole").alias("m")).join(heads, "val").where("m.node <> h.node")
    own = own.where(_likely("m.size", "h.size", similarity) & overlap.marks_allow("m", "h", similarity)).select(F.col("m.node").alias("a"), F.col("h.node").alias("b"))
    across = close.join(heads.select(F.col("val").alias("v"), F.col("h").alias("p")), "v").join(heads.select(F.col("val").alias("w"), F.col("h").alias("q")), "w")
    across = across.where("p.node <> q.node").where(_likely("p.size", "q.size", similarity) & overlap.marks_allow("p", "q", similarity)).select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))
    both = own.unionByName(across)
    return both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


#: Values of the sketches that look for what the balls miss.
WIDTH = 128


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, component_id, digest, component_digest) per row: groups of texts whose sets of shingles
    have a Jaccard likeness of at least `similarity`, or that are equal, by multi-index hashing of
    fingerprints of WIDE * 64 bits. A group is named by its least key and, as a key may be repeated
    with other texts, the least digest (`digest_of`) with that key.

    Each half word is a segment, both sides enumerate its ball of radius one, and every text is tied
    to one text of its segment value, those to each other where their values are close. What is
    alike is one group from then on, so a group of n copies costs some n candidates.

    At a likeness of 0.8 two fingerprints differ in 15 of 100 bits, so no small ball finds every such
    pair. The exact rest is a similarity join of what is not yet in one group: on sketches of the
    shingle sets, the rarest values first, with length and position filters (`overlap.linked`), so
    that texts of one template meet only if they can be alike, and everywhere a bound on the values of
    one full set alone, from marks of 1024 bits, refuses pairs before they are listed. Every link is verified on the full
    sets; a pair is missed once in about 10^8.
    Texts without words are alike only if equal; rows with a null key are left alone.
    """
    narrow = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("copy", digest_of("_text"))
    kind = narrow.schema[0].dataType.simpleString()

    def batch(part: pa.RecordBatch) -> dict:
        wide, size, sketch, whole = [], [], [], []
        for t in part.column(1).to_pylist():
            hashes = shingle_hashes(t, words)
            wide.append(_wide(hashes))
            hashes = np.unique(hashes)
            size.append(len(hashes))
            sketch.append(overlap.retained(hashes, WIDTH))
            whole.append(overlap.marks_of(hashes))
        longs = pa.list_(pa.int64())
        return {"_key": part.column(0), "copy": part.column(2), "wide": pa.array(wide, longs), "size": pa.array(size, pa.int64()), "sketch": pa.array(sketch, longs), "whole": pa.array(whole, longs)}

    marked = written(arrow_map(narrow, batch, f"_key {kind}, copy string, wide array<bigint>, size bigint, sketch array<bigint>, whole array<bigint>"), "wide")
    named = marked.groupBy("copy").agg(F.min("_key").alias("_key"), *[F.first(c).alias(c) for c in ("wide", "size", "sketch", "whole")])
    named = written(named.withColumn("node", F.monotonically_increasing_id()), "copies")
    sets = named.where("size > 0").select("node", "size", "sketch", "whole")

    halves = F.flatten(F.transform("wide", lambda w: F.array(_upper(w), _lower(w))))
    values = F.transform(halves, lambda v, i: F.shiftleft(i.cast("bigint"), HALF) + v)
    held = written(named.where("size > 0").select("node", "size", F.explode(values).alias("val")), "segments")
    close = written(_close(held), "close")
    # texts that share a ball with another
    several = held.groupBy("val").agg(F.count("*").alias("n")).where("n > 1").select("val")
    several = several.union(close.select("v")).union(close.select("w")).distinct()
    held = written(held.join(several, "val", "left_semi").join(named.select("node", "whole"), "node"), "shared")

    def cut(part: pa.RecordBatch) -> dict:
        found = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in part.column(1).to_pylist()]
        return {"node": part.column(0), "hashes": pa.array(found, pa.list_(pa.int64()))}

    def full(wanted: DataFrame) -> DataFrame:
        ends = named.join(wanted, "node", "left_semi").select("_key", "copy", "node")
        texts = narrow.join(ends, ["_key", "copy"]).dropDuplicates(["_key", "copy"]).select("node", "_text")
        return arrow_map(texts, cut, "node bigint, hashes array<bigint>")

    pairs = written(_stars(held, close, similarity), "stars")
    labels = held.select("node").distinct().withColumn("label", F.col("node"))
    labels = overlap.merged(written(labels, "labels"), overlap.alike(pairs, sets, full, similarity, WIDTH))
    labels = overlap.linked(sets, labels, full, similarity, WIDTH, pairs)

    grouped = named.select("copy", "node", "_key").join(labels, "node", "left").select("copy", "_key", F.coalesce("label", "node").alias("label"))
    grouped = written(grouped, "grouped")
    first = grouped.groupBy("label").agg(F.min(F.struct("_key", "copy")).alias("first"))
    groups = grouped.join(first, "label").select("copy", "first")
    of_rows = marked.select("_key", "copy").join(groups, "copy")
    return of_rows.select(F.col("_key").alias(key), F.col("first._key").alias("component_id"), F.col("copy").alias("digest"), F.col("first.copy").alias("component_digest"))
