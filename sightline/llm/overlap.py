"""Near-duplicates by bottom-k sketches.

The sketch of a text is the WIDTH least values of one hash function over its set of shingles; a
smaller set is its own sketch. Two sets of likeness J share at least `least_shared` retained values,
so with every sketch ordered from the rarest to the commonest value they share one among the first
few of each. Only those enter the inverted lists, whose overlaps generate the candidates. The union
sketch estimates the likeness of a candidate (or gives it, where both sets are whole), and what is
left is verified on the full sets.

Groups are never paired off: equal sets are one node; TURNS rounds tie the members of a list to some
of them and join what is alike; only members that are then still in different components meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written
from .components import components

WORDS = 5
SIMILARITY = 0.85

#: Values of a sketch.
WIDTH = 192

#: Standard deviations below its mean up to which the number of shared values counts: a pair of the
#: least likeness that has too few shared values for the lists occurs once in about 10^8 such pairs,
#: and only among sets that are larger than a sketch.
DEVIATIONS = 6

#: Bits of the marks by which two sketches are compared where they meet; a power of two.
MARKS = 1024

#: Rounds that tie each member of a list to some of the list, before the others are compared.
TURNS = 2

#: Heads of a list in rounds after the first.
HEADS = 8

#: Distinct words kept per worker; a full store starts anew.
STORE = 500_000


# -- sets

@lru_cache(maxsize=STORE)
def _word(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit values of the shingles, A-Z in lower case; a text of fewer words is one
    shingle, one without words has none."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(_word, found), np.uint64, len(found))
    width = min(words, len(found))
    with np.errstate(over="ignore"):
        h = np.full(len(own) - width + 1, width, np.uint64)
        for i in range(width):
            h = (h ^ own[i : len(own) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def retained(hashes: np.ndarray, width: int) -> np.ndarray:
    """The bottom `width` values, cut to 48 bits."""
    return (hashes[:width] >> np.uint64(16)).astype(np.int64)


def sketched(docs: DataFrame, key: str, text: str, words: int, width: int) -> DataFrame:
    """(row, key, same, size, sketch) per row: `row` finds the row's text again, `same` is the digest
    of the full set."""

    def batch(part: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, words) for t in part.column(2).to_pylist()]
        return {
            "row": part.column(0),
            "key": part.column(1),
            "same": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
            "size": pa.array(map(len, sets), pa.int64()),
            "sketch": pa.array([retained(s, width) for s in sets], pa.list_(pa.int64())),
        }

    narrow = docs.select(_row(key, text), F.col(key).alias("key"), F.col(text).alias("text"))
    return arrow_map(narrow, batch, f"row string, key {narrow.schema[1].dataType.simpleString()}, same binary, size bigint, sketch array<bigint>")


def _row(key: str, text: str) -> Column:
    """Names a row by its key, or by its text where it has none."""
    return F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.concat(F.lit("t"), F.sha2(F.col(text), 256)), F.lit("n")).alias("row")


# -- inverted lists

def least_shared(size: Column, similarity: float, width: int) -> Column:
    """Retained values that a set of `size` shares at least with any set as like as `similarity`.

    Sets of up to similarity * width shingles and all their partners are whole. Of a union u of two
    larger sets at most (1 - similarity) * u values are not shared, and among its `width` least ones
    (1 - similarity) * width on average.
    """
    whole = F.ceil(similarity * size - 1e-9)
    drawn = math.floor(similarity * width - DEVIATIONS * math.sqrt(similarity * (1 - similarity) * width))
    cut = F.greatest(F.lit(width) - F.floor((1 - similarity) / similarity * size + 1e-9), F.lit(drawn))
    return F.when(size <= math.floor(similarity * width), whole).otherwise(F.least(whole, cut)).cast("int")


def lists(sets: DataFrame, similarity: float, width: int) -> DataFrame:
    """(token, before, node, size, own, place, near): the entries of the inverted lists. The `own`
    values of a sketch are ordered by the number of sets that retain them; `place` is that of the
    entry, `before` the value before it if that is in a list too. `near` tells whether the entry
    serves where this set is the smaller one of a pair: both sets whole, the smaller one shares
    2s / (1 + s) of its values and needs a shorter prefix.
    """
    rows = sets.select("node", F.explode("sketch").alias("token"))
    often = rows.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("rest"))
    placed = sets.select("node", "size", F.size("sketch").alias("own")).join(shared, "node")
    short = F.when(F.col("size") <= math.floor(similarity * width), F.ceil(2 * similarity / (1 + similarity) * F.col("size") - 1e-9)).otherwise(F.col("need"))
    placed = placed.withColumn("need", least_shared(F.col("size"), similarity, width)).withColumn("short", F.col("own") - short.cast("int") + 1)
    # values of one set alone come first and are in no list
    placed = placed.withColumn("alone", F.col("own") - F.size("rest")).withColumn("long", F.col("own") - F.col("need") + 1).where("long > alone")
    first = F.slice("rest", 1, F.col("long") - F.col("alone"))
    linked = F.transform(first, lambda x, i: F.struct(x.token.alias("token"), F.when(i > 0, F.get(F.col("rest"), i - 1).token).alias("before")))
    entries = placed.select("node", "size", "own", "alone", "short", F.posexplode(linked).alias("i", "entry"))
    place = F.col("alone") + F.col("i")
    return entries.select("entry.token", "entry.before", "node", "size", "own", place.alias("place"), (place < F.col("short")).alias("near"))


def marks_of(values: np.ndarray) -> np.ndarray:
    """MARKS bits, every value turning the one that its low bits name. Two sets have at least as many
    values of one alone as their marks have different bits."""
    turned = np.bincount((values & values.dtype.type(MARKS - 1)).astype(np.int64), minlength=MARKS) & 1
    return np.packbits(turned.astype(np.uint8)).view(np.int64)


def marked_sets(sets: DataFrame) -> DataFrame:
    """(node, marks) of each sketch."""

    def batch(part: pa.RecordBatch) -> dict:
        marks = [marks_of(np.array(sketch, np.int64)) for sketch in part.column(1).to_pylist()]
        return {"node": part.column(0), "marks": pa.array(marks, pa.list_(pa.int64()))}

    return arrow_map(sets.select("node", "sketch"), batch, "node bigint, marks array<bigint>")


def _apart(p: str, q: str) -> Column:
    """Different bits of two columns of marks."""
    return sum((F.bit_count(F.get(p, F.lit(i)).bitwiseXOR(F.get(q, F.lit(i)))) for i in range(MARKS // 64)), F.lit(0))


def marks_allow(p: str, q: str, similarity: float) -> Column:
    """Of two rows with the marks of their full sets in `whole`: whether so few values may be of one
    alone that the sets are alike. A pair that is alike is always allowed."""
    most = (1 - similarity) / (1 + similarity) * (F.col(f"{p}.size") + F.col(f"{q}.size"))
    return _apart(f"{p}.whole", f"{q}.whole") <= most + 1e-9


def _most_shared(p: str, q: str) -> Column:
    """Values that two marked sketches share at most."""
    return (F.col(f"{p}.own") + F.col(f"{q}.own") - _apart(f"{p}.marks", f"{q}.marks")) / 2


def _can_be_alike(p: str, q: str, similarity: float, width: int, most: Column | None = None) -> Column:
    """Of two entries of a token: whether the sizes, and the values from there on, leave room for it.
    What comes before the first shared value is not shared. `most` is another bound of what is."""
    small, large = F.least(f"{p}.size", f"{q}.size"), F.greatest(f"{p}.size", f"{q}.size")
    rest = F.least(F.col(f"{p}.own") - F.col(f"{p}.place"), F.col(f"{q}.own") - F.col(f"{q}.place"))
    rest = rest if most is None else F.least(rest, most)
    whole = rest >= similarity / (1 + similarity) * (small + large) - 1e-9
    # retained by both are the common values up to the last one that the larger set retains
    share = similarity / (1 + similarity) * (1 + small / large)
    drawn = F.floor(width * share - DEVIATIONS * F.sqrt(width * share * (1 - share)))
    cut = rest >= F.greatest(least_shared(small, similarity, width), least_shared(large, similarity, width), F.when(small >= width, drawn).otherwise(0))
    return (small >= similarity * large) & F.when(large <= width, whole).otherwise(cut)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("p.node", "q.node").alias("a"), F.least("p.node", "q.node").alias("b")).distinct()


def tied(members: DataFrame, turn: int, similarity: float, width: int) -> DataFrame:
    """(a, b): each member of a list and the list's heads, where they have different labels. In the
    first turn lists with the same members have the same head; in others each has HEADS of its own, for
    of a family of near copies a single one is unlike many that are like others."""
    whole = "whole" in members.columns
    entry = F.struct("node", "label", "size", "own", "place", *(["whole"] if whole else []))
    orders = [F.xxhash64("node", "token", F.lit(turn * HEADS + i)) for i in range(HEADS)] if turn else [F.xxhash64("node")]
    chosen = F.array_distinct(F.array(*[F.min_by(entry, order) for order in orders]))
    heads = members.groupBy("token").agg(chosen.alias("heads"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    heads = heads.where("lo < hi").select("token", F.explode("heads").alias("q"))
    own = members.select("token", entry.alias("p")).join(heads, "token")
    own = own.where("p.label <> q.label").where(_can_be_alike("p", "q", similarity, width))
    return _ordered(own.where(marks_allow("p", "q", similarity)) if whole else own)


def mixed(members: DataFrame) -> DataFrame:
    """The members of lists in which labels differ."""
    tokens = members.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    return members.join(tokens, "token", "left_semi")


def crossing(members: DataFrame, sets: DataFrame, similarity: float, width: int) -> DataFrame:
    """(a, b): all members of a list with different labels that can be alike. In a family of texts that
    are somewhat less like than that, sizes and places allow almost every pair; the marks do not."""
    members = written(mixed(members), "mixed")
    marks = marked_sets(sets.join(members.select("node").distinct(), "node", "left_semi"))
    members = written(members.join(marks, "node"), "marked")
    p, q = members.alias("p"), members.alias("q")
    # a pair that shares the value before has met there
    fresh = ~F.coalesce(F.col("p.before") == F.col("q.before"), F.lit(False))
    smaller = (F.col("p.size") < F.col("q.size")) | ((F.col("p.size") == F.col("q.size")) & (F.col("p.node") < F.col("q.node")))
    likely = _can_be_alike("p", "q", similarity, width)
    if "whole" in members.columns:
        likely &= marks_allow("p", "q", similarity)
    likely &= _can_be_alike("p", "q", similarity, width, _most_shared("p", "q"))
    met = p.join(q, (F.col("p.token") == F.col("q.token")) & F.col("p.near") & smaller & fresh & (F.col("p.label") != F.col("q.label")) & likely)
    return _ordered(met)


# -- verification

def estimated(pairs: DataFrame, sets: DataFrame, similarity: float, width: int) -> DataFrame:
    """(a, b, sure) of pairs whose union sketch does not speak against them; `sure` where both sets
    are whole and the likeness is known."""
    side = lambda n, s: sets.select(F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.col("sketch").alias(s))
    both = pairs.join(side("a", "p"), "a").join(side("b", "q"), "b")
    union = F.slice(F.array_sort(F.array_union("p", "q")), 1, width)
    both = both.withColumn("sure", F.greatest("size_a", "size_b") <= width)
    shared = F.size(F.array_intersect("p", "q"))
    exact = shared >= similarity * (F.col("size_a") + F.col("size_b") - shared) - 1e-9
    drawn = F.size(F.array_intersect(F.array_intersect("p", "q"), union))
    bound = math.floor(similarity * width - DEVIATIONS * math.sqrt(similarity * (1 - similarity) * width))
    return both.where(F.when(F.col("sure"), exact).otherwise(drawn >= bound)).select("a", "b", "sure")


def full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(node, hashes) of the nodes in `wanted` (node, row, same), from their texts."""

    def batch(part: pa.RecordBatch) -> dict:
        nodes, hashes = [], []
        for node, same, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
            own = shingle_set(t, words)
            if xxhash.xxh3_128_digest(own.tobytes()) == same:  # rows that share a key may differ
                nodes.append(node)
                hashes.append(own.view(np.int64))
        return {"node": pa.array(nodes, pa.int64()), "hashes": pa.array(hashes, pa.list_(pa.int64()))}

    texts = docs.select(_row(key, text), F.col(text).alias("text")).join(wanted, "row").select("node", "same", "text")
    return arrow_map(texts, batch, "node bigint, hashes array<bigint>").dropDuplicates(["node"])


def alike(pairs: DataFrame, sets: DataFrame, full: Callable[[DataFrame], DataFrame], similarity: float, width: int) -> DataFrame:
    """The `pairs` (a, b) that are at least as like as `similarity`. `full` gives (node, hashes) for
    nodes (node) whose sets are needed in full."""
    likely = written(estimated(pairs, sets, similarity, width), "likely")
    unsure = likely.where("NOT sure")
    wanted = unsure.select(F.col("a").alias("node")).union(unsure.select(F.col("b").alias("node"))).distinct()
    hashes = written(full(wanted), "full")
    both = unsure.join(hashes.select(F.col("node").alias("a"), F.col("hashes").alias("p")), "a").join(hashes.select(F.col("node").alias("b"), F.col("hashes").alias("q")), "b")
    shared = F.size(F.array_intersect("p", "q"))
    verified = both.where(100 * shared >= round(100 * similarity) * (F.size("p") + F.size("q") - shared)).select("a", "b")
    return likely.where("sure").select("a", "b").unionByName(verified)


def merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """(node, label) after the links `found` (a, b) have joined labels."""
    ends = found.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b")
    roots = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b"))).withColumnRenamed("node", "label")
    return written(labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")


def linked(
    sets: DataFrame, labels: DataFrame | None, full: Callable[[DataFrame], DataFrame], similarity: float, width: int, tried: DataFrame | None = None
) -> DataFrame:
    """(node, label) of the nodes of `sets` (node, size, sketch) that are in lists: components over all
    pairs at least as like as `similarity`. `labels` may join some nodes from the start; pairs in
    `tried` (a, b; a > b) are known and left out. If `sets` has the marks of the full sets (`whole`,
    by `marks_of`), pairs that these exclude are no candidates after the first round: of a family of
    texts somewhat less like, larger than their sketches, the sketches leave every pair."""
    entries = written(lists(sets, similarity, width), "entries")
    several = entries.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    entries = written(entries.join(several, "token", "left_semi"), "lists")
    nodes = entries.select("node").distinct()
    if labels is None:
        labels = nodes.withColumn("label", F.col("node"))
    else:
        labels = labels.unionByName(nodes.join(labels, "node", "left_anti").withColumn("label", F.col("node")))
    labels = written(labels, "labels")
    for turn in range(TURNS + 1):
        members = entries.join(labels, "node")
        if turn and "whole" in sets.columns:
            members = written(mixed(members).join(sets.select("node", "whole"), "node"), "met")
        pairs = tied(members, turn, similarity, width) if turn < TURNS else crossing(members, sets, similarity, width)
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "candidates")
        labels = merged(labels, alike(pairs, sets, full, similarity, width))
        tried = pairs if tried is None else tried.unionByName(pairs)
    return labels


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, width: int = WIDTH
) -> DataFrame:
    """(key, n_shingles, component_id, kept) per row; component_id is the least key of those reachable
    over links of at least `similarity`, and kept says whether that is the row's own.

    Null and empty texts and those without words have no shingles and are linked with nothing: their
    component is their own key. Rows with a null key join components but never name one; where no
    row has a key the name is null, and they are never kept. Rows repeated with their key are all
    kept or all not. An empty table gives no rows; other columns make no difference.
    """
    marked = written(sketched(docs, key, text, words, width), "sketched")
    named = marked.where("size > 0").groupBy("same").agg(F.min("key").alias("least"), F.min("row").alias("row"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    sets = written(named.withColumn("node", F.monotonically_increasing_id()), "sets")
    labels = linked(sets, None, lambda wanted: full_sets(docs, sets.join(wanted, "node", "left_semi").select("node", "row", "same"), key, text, words), similarity, width)

    grouped = written(sets.select("node", "same", "least").join(labels, "node", "left").select("same", "least", F.coalesce("label", "node").alias("label")), "grouped")
    first = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    groups = grouped.join(first, "label").select("same", F.lit(True).alias("grouped"), "component_id")
    rows = marked.select("key", "same", "size").join(groups, "same", "left")
    own = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("key"))
    return rows.select(F.col("key").alias(key), F.col("size").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("key") == own, F.lit(False)).alias("kept"))
