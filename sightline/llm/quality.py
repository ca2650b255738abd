"""Quality rules with adaptive thresholds.

Each text gets a few counts; two fixed base rules come first. What passes them is judged against
its own language and source: quantile sketches of each measure (the mergeable summaries behind
`percentile_approx`) per language and source, per language and over all, from which a document
takes those of the narrowest group that is large enough. A measure is rejected beyond the median
plus SPREADS times the distance from the tenth to the fiftieth percentile, which junk in the upper
half of a group cannot widen; LEAST_SPREAD keeps groups without spread from rejecting everything.
Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, words, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # percent

#: Least documents of a group whose own sketch is used.
MIN_GROUP = 30
SPREADS = 3.0
ACCURACY = 10_000

#: Measures and the least spread of each; the second set is also bounded below.
LEAST_SPREAD = {"symbol_ratio": 0.03, "dup_line_ratio": 0.16, "repeat_ratio": 0.16, "capital_ratio": 0.08, "word_length": 1.0}
TWO_SIDED = {"word_length"}

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c))
    return text


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(windows: Column) -> Column:
    """Words in windows (hashes of three adjacent words) that occur twice or more."""

    def covered(ordered: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            before, after = F.get(ordered, i - 1), F.get(ordered, i + 1)
            return F.coalesce(before.h == x.h, F.lit(False)) | F.coalesce(after.h == x.h, F.lit(False))

        starts = F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x.i))
        return _let(starts, lambda s: F.aggregate(
            F.transform(s, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - v, F.lit(3)))),
            F.lit(0), lambda total, v: total + v,
        ))

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(placed, covered))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the text, plus the base counts and `base_failed` and the measures.

    Null and empty texts have no words and fail the base. Every column is computed from the row
    alone; columns of `docs` with the names of new ones are replaced.
    """
    keep = [c for c in docs.columns if c != text and c not in {*BASE, *LEAST_SPREAD, "base_failed"}]
    body = F.coalesce(F.col(text), F.lit(""))
    blanks = " \t\n\x0b\x0c\r"
    lines = F.filter(F.split(body, "\n"), lambda line: _without(line, blanks) != "")
    rows = docs.select(*keep, body.alias("_text"), words(F.col(text)).alias("_words"), lines.alias("_lines"))
    count = F.size("_words")
    rows = rows.withColumn("_n", count).withColumn(
        "_windows",
        F.when(F.col("_n") < 4, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.col("_n"), F.lit(3)) - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
        ),
    )
    plain = _without(F.col("_text"), blanks)
    rows = rows.select(
        *keep,
        F.col("_n").cast("bigint").alias("n_words"),
        F.char_length(plain).cast("bigint").alias("word_chars"),
        (F.octet_length("_text") - F.octet_length(_without(F.col("_text"), SYMBOLS))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        _repeated(F.col("_windows")).cast("bigint").alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        (F.octet_length("_text") - F.octet_length(F.regexp_replace("_text", "[A-Z]+", ""))).alias("_capitals"),
    )
    total = F.greatest("n_words", F.lit(1))
    return rows.select(
        *keep, *BASE,
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / total).alias("symbol_ratio"),
        (F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / total).alias("repeat_ratio"),
        (F.col("_capitals") / F.greatest("word_chars", F.lit(1))).alias("capital_ratio"),
        (F.col("word_chars") / total).alias("word_length"),
    )


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (lang, source) that occurs, nulls being groups of their own, with `low_` and
    `high_` bounds of each measure. Only documents that pass the base rules count."""
    passed = measured.where("NOT base_failed").select(F.col(lang).alias("_lang"), F.col(source).alias("_source"), *LEAST_SPREAD)

    def sketched(rows: DataFrame, *by: str) -> DataFrame:
        marks = [F.percentile_approx(m, [0.1, 0.5, 0.9], ACCURACY).alias(m) for m in LEAST_SPREAD]
        return rows.groupBy(*by).agg(F.count("*").alias("n"), *marks)

    def bounds(quantiles: Column, measure: str) -> list[Column]:
        low, mid, high = (quantiles[i] for i in range(3))
        least = F.lit(LEAST_SPREAD[measure])
        lowest = mid - SPREADS * F.greatest(high - mid, least) if measure in TWO_SIDED else F.lit(None).cast("double")
        return [lowest.alias(f"low_{measure}"), (mid + SPREADS * F.greatest(mid - low, least)).alias(f"high_{measure}")]

    marks = F.struct(*LEAST_SPREAD)
    narrow = sketched(passed, "_lang", "_source").select("_lang", "_source", F.when(F.col("n") >= MIN_GROUP, marks).alias("own"))
    wide = sketched(passed, "_lang").select(F.col("_lang").alias("_of"), F.when(F.col("n") >= MIN_GROUP, marks).alias("lang_own"))
    overall = sketched(passed).select(marks.alias("all_own"))
    chosen = (
        narrow.join(wide, F.col("_lang").eqNullSafe(F.col("_of")), "left").crossJoin(overall)  # one row
        .select("_lang", "_source", F.coalesce("own", "lang_own", "all_own").alias("q"))
    )
    return chosen.select("_lang", "_source", *[c for m in LEAST_SPREAD for c in bounds(F.col("q")[m], m)])


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """`features` of each row and `kept`: false if the base rules fail, else whether every measure
    lies within the bounds of the row's language and source. Rows are judged by what they hold, so
    repeated rows get equal verdicts; an empty table gives no rows.

    The measures are written to the shared folder once; the bounds (one row per language and
    source) are joined to them, a join whose large side can be split for a hot source.
    """
    measured = written(features(docs, text), "features")
    bounds = thresholds(measured, lang, source)
    joined = measured.join(
        bounds, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left"
    )
    fine = ~F.col("base_failed")
    for m in LEAST_SPREAD:
        fine = fine & (F.col(m) <= F.coalesce(f"high_{m}", F.col(m))) & (F.col(m) >= F.coalesce(f"low_{m}", F.col(m)))
    return joined.select(*[F.col(f"`{c}`") for c in measured.columns if c.lower() != "kept"], fine.alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns. Rows find their verdict by two
    hashes of text, language and source, on which it depends alone, so keys may repeat or be null."""
    mark = [F.xxhash64(text, lang, source), F.xxhash64(source, lang, text, F.lit(1))]
    parts = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"), mark[0].alias("_m"), mark[1].alias("_o"))
    m, o = unused(docs.columns, "_m"), unused(docs.columns, "_o")
    good = judge(parts).where("kept").select(F.col("_m").alias(m), F.col("_o").alias(o)).distinct()
    return docs.withColumns({m: mark[0], o: mark[1]}).join(good, [m, o], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def _oracle() -> str:
    """The same in SQL, with exact quantiles (the sketch is exact up to ACCURACY documents)."""
    def rank(measure: str, share: float) -> str:
        return f"list_sort(list({measure}))[greatest(1, ceil({share} * count(*)))::BIGINT]"

    marks = ", ".join(f"{rank(m, p)} AS {m}_{k}" for m in LEAST_SPREAD for k, p in (("low", 0.1), ("mid", 0.5), ("high", 0.9)))
    names = [f"{m}_{k}" for m in LEAST_SPREAD for k in ("low", "mid", "high")]
    pick = ", ".join(f"CASE WHEN s.n >= {MIN_GROUP} THEN s.{c} WHEN l.n >= {MIN_GROUP} THEN l.{c} ELSE a.{c} END AS {c}" for c in names)
    tests = [f"m.{m} <= {m}_mid + {SPREADS} * greatest({m}_mid - {m}_low, {LEAST_SPREAD[m]})" for m in LEAST_SPREAD]
    tests += [f"m.{m} >= {m}_mid - {SPREADS} * greatest({m}_high - {m}_mid, {LEAST_SPREAD[m]})" for m in LEAST_SPREAD if m in TWO_SIDED]
    return rf"""
        WITH t AS (
            SELECT doc_id, lang, source, coalesce(text, '') AS t,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
            FROM documents
        ), windows AS (
            SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t)
        ), repeated AS (
            SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
        ), covered AS (
            SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM repeated, (VALUES (0), (1), (2)) v(k) GROUP BY 1
        ), base AS (
            SELECT doc_id, lang, source, len(ws) AS n_words,
                length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
                len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                coalesce(n_repeat_words, 0) AS n_repeat_words,
                len(ls) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS capitals
            FROM t LEFT JOIN covered USING (doc_id)
        ), m AS (
            SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
                n_symbols / greatest(n_words, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
                n_repeat_words / greatest(n_words, 1) AS repeat_ratio, capitals / greatest(word_chars, 1) AS capital_ratio,
                word_chars / greatest(n_words, 1) AS word_length
            FROM base
        ), passed AS (SELECT * FROM m WHERE NOT base_failed
        ), s AS (SELECT lang, source, count(*) AS n, {marks} FROM passed GROUP BY lang, source
        ), l AS (SELECT lang, count(*) AS n, {marks} FROM passed GROUP BY lang
        ), a AS (SELECT {marks} FROM passed
        ), q AS (
            SELECT s.lang, s.source, {pick} FROM s JOIN l ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a
        )
        SELECT doc_id, {", ".join(BASE)}, base_failed,
            NOT base_failed AND coalesce({" AND ".join(tests)}, true) AS kept
        FROM m LEFT JOIN q ON m.lang IS NOT DISTINCT FROM q.lang AND m.source IS NOT DISTINCT FROM q.source
    """


ORACLE = _oracle()
