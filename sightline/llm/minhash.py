"""Document fingerprints by one-permutation MinHash, with built-in functions only.

Each shingle of five words is hashed once; the hash's upper bits name one of BINS bins, which
keeps its least hash. An empty bin takes the value of another by optimal densification: it probes
bins in an order of its own, given by hashes of (bin, attempt), until one is filled. The order is
PROBES random probes followed by the filled bins in the order of a hash of (bin, other bin), so a
walk always ends. Of every value the low-order LANE bits are stored. Two unrelated values agree in
them once in 2**LANE times, which `likeness` corrects.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import words

SHINGLE = 5
BINS = 128
LANE = 8
PROBES = 8

#: Bytes of text that meet in one sorted run of `with_next`, and the most runs.
RUN_BYTES = 16_000_000
MOST_RUNS = 65_536


def _bin(value: Column) -> Column:
    """Signed upper bits, moved to 0 .. BINS - 1: bins follow each other as their values do."""
    return (F.shiftright(value, 64 - int(math.log2(BINS))) + BINS // 2).cast("int")


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """`docs` with column `out`: BINS lanes in hexadecimal, or an empty string for a text without
    words (null, empty, white space). A text of fewer than SHINGLE words is one shingle. Equal
    texts have equal fingerprints; a column named `out` is replaced. Nothing is shuffled.
    """
    a, b, c, d, e = (f"_mh_{out}_{i}" for i in "abcde")
    get = F.get
    hashed = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    whole = F.array(F.xxhash64(a))
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(a), F.lit(SHINGLE)) - SHINGLE),
        lambda i: F.xxhash64(*[get(F.col(a), i + k) for k in range(SHINGLE)]),
    )
    shingles = F.when(F.size(a) == 0, F.array().cast("array<bigint>")).when(F.size(a) < SHINGLE, whole).otherwise(parts)
    firsts = F.filter(F.col(c), lambda v, i: (i == 0) | (_bin(get(F.col(c), i - 1)) != _bin(v)))
    bins = F.when(F.size(d) == BINS, F.col(d)).otherwise(_let(F.transform(F.col(d), _bin), lambda at: F.transform(
        F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: get(F.col(d), F.array_position(at, i).cast("int") - 1)
    )))

    def filled(value: Column, i: Column) -> Column:
        probes = [get(F.col(e), F.pmod(F.xxhash64(i, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(PROBES)]
        rest = F.array_min(F.transform(F.col(d), lambda v: F.struct(F.xxhash64(i, F.lit(-1), _bin(v)).alias("order"), v.alias("v"))))
        return F.coalesce(value, *probes, rest["v"])

    lanes = F.transform(F.col(e), lambda v, i: F.substring(F.hex(filled(v, i).bitwiseAND(F.lit(2**LANE - 1)) + 2**LANE), 2, LANE // 4))
    return (
        docs.withColumn(a, hashed).withColumn(b, shingles).withColumn(c, F.sort_array(b)).withColumn(d, firsts).withColumn(e, bins)
        .withColumn(out, F.when(F.size(d) == 0, F.lit("")).otherwise(F.lower(F.array_join(lanes, ""))))
        .drop(a, b, c, d, e)
    )


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def likeness(left: Column, right: Column) -> Column:
    """Estimated share of common shingles (0 to 1). Equal fingerprints have 1, an empty one and any
    other 0; null gives null."""
    size = LANE // 8
    pair = F.struct(F.unhex(left).alias("l"), F.unhex(right).alias("r"))
    same = _let(pair, lambda p: F.size(F.filter(
        F.sequence(F.lit(0), F.lit(BINS - 1)),
        lambda i: F.substring(p.l, i * size + 1, F.lit(size)) == F.substring(p.r, i * size + 1, F.lit(size)),
    )))
    chance = 2.0**-LANE
    corrected = F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))
    return F.when(left == right, F.lit(1.0)).when((left == "") | (right == ""), F.lit(0.0)).otherwise(corrected)


def with_next(docs: DataFrame, key: str, columns: list[str], size: Column) -> DataFrame:
    """`docs` with `next_` columns: those of the row that follows by `key`, after the last the first.

    Rows are cut into runs by quantiles of the key, about RUN_BYTES each by `size` (bytes of a
    row). Bounds are keys that occur, so a run's follower is the row at the next bound; it goes
    into both runs, as the first row of all goes into the last. Each row is shuffled once. Equal
    keys follow each other in the order of `columns`; null keys come first. Two small passes find
    the size and the bounds, of which there are at most MOST_RUNS - 1, on the driver.
    """
    n_bytes, rows, keyed, first = docs.agg(F.sum(size), F.count("*"), F.count(key), F.min(key)).first()
    runs = min(MOST_RUNS, max(1, math.ceil((n_bytes or 0) / RUN_BYTES)))
    bounds: list = []
    if runs > 1 and keyed:
        shares = [i / runs for i in range(1, runs)]
        found = docs.agg(F.percentile_approx(key, shares, max(10_000, 20 * runs))).first()[0]
        bounds = sorted(set(found) - {first})
    if rows > keyed:
        first = None
    step = max(1, math.isqrt(len(bounds)))
    coarse = F.array(*[F.lit(v) for v in bounds[step - 1 :: step]]) if bounds else F.array().cast("array<bigint>")
    fine = F.array(*[F.array(*[F.lit(v) for v in bounds[i : i + step]]) for i in range(0, len(bounds), step)]) if bounds else None
    over = F.size(F.filter(coarse, lambda v: v <= F.col(key)))
    run = over * step + F.coalesce(F.size(F.filter(F.get(fine, over), lambda v: v <= F.col(key))), F.lit(0)) if bounds else F.lit(0)
    run = F.when(F.col(key).isNull(), F.lit(0)).otherwise(run)
    placed = docs.withColumn("_run", run)
    at_bound = F.lit(False)
    if bounds:  # a row at a bound is counted over by its list of fine bounds, which may just have ended
        at_bound = F.coalesce(F.array_contains(F.get(fine, over), F.col(key)), F.lit(False)) | F.array_contains(coarse, F.col(key))
    targets = F.filter(F.array(
        F.struct(F.col("_run").alias("run"), F.lit(0).alias("role")),
        F.when(at_bound, F.struct((F.col("_run") - 1).alias("run"), F.lit(1).alias("role"))),
        F.when(F.col(key).eqNullSafe(F.lit(first)), F.struct(F.lit(len(bounds)).alias("run"), F.lit(2).alias("role"))),
    ), lambda t: t.isNotNull())
    spread = placed.withColumn("_to", F.explode(targets)).drop("_run")
    order = W.partitionBy("_to.run").orderBy("_to.role", key, *columns)
    followed = spread.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return followed.where("_to.role = 0").select(*docs.columns, *[f"next_{c}" for c in columns])


def with_edit(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "edited") -> DataFrame:
    """(key, text, fingerprint, next_text, next_fingerprint, edited): each text whose last quarter
    (code points, rounded down) is replaced by as many first ones of the next text, or all of it."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    rows = with_next(with_fingerprint(rows, text), key, [text, "fingerprint"], F.octet_length(text))
    quarter = F.floor(F.char_length(text) / 4).cast("int")
    edited = F.concat(
        F.substring(F.col(text), F.lit(1), F.char_length(text) - quarter), F.substring(F.col(f"next_{text}"), F.lit(1), quarter)
    )
    return rows.withColumn(out, edited)
