"""URL filters: rules on host and path, and a classifier over segmented names for the rest.

Host labels are split into words by a unigram Viterbi search: word counts come from the text of
all pages, and only substrings of labels are looked up in them, by a join. A multinomial naive
Bayes model over hashed tokens of host and path gives the verdict where no rule fits. Its two
classes are learnt from all pages: hosts that hold a seed word after segmentation, and all others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written

#: Words that mark unwanted hosts.
SEEDS = ("ads", "adult", "bet", "bets", "casino", "cheap", "crack", "escort", "gamble", "loan", "lottery", "pills", "poker", "porn", "sex", "spam", "torrent", "track", "tracker", "viagra", "warez", "win", "xxx")

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Longest word of the segmentation; longer labels than names may have stay whole.
MOST_WORD, MOST_LABEL = 24, 63

#: Hashed token features: the model has two counts for each, whatever the input. SMOOTHING is added
#: to the count of each feature that occurs.
BUCKETS = 65_536
SMOOTHING = 0.1


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From the first :// to the next of / ? # or the end, A-Z in lower case; else empty."""
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host to the next of ? # or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (null: none) that fits the host or a domain above it and starts the path."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n): lower-case runs of letters in the text of all pages, markup left out."""
    text = F.lower(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), "<[^>]*>", " "))
    found = F.explode(F.split(text, r"[^\p{L}]+")).alias("word")
    return pages.select(found).where(F.length("word").between(1, MOST_WORD)).groupBy("word").agg(F.count("*").alias("n"))


def segment(label: str, known: dict[str, int], total: int) -> list[str]:
    """Most probable split of a label into words. An unknown word of k letters has the probability
    of 1 / (total * 10**k); of equal splits the one with the longest last word counts."""
    best, back = [0.0], [0]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - MOST_WORD), end):
            word = label[start:end]
            n = known.get(word)
            score = math.log(n / total) if n else -math.log(total) - len(word) * math.log(10)
            options.append((best[start] + score, -start))
        score, start = max(options)
        best.append(score)
        back.append(-start)
    words, end = [], len(label)
    while end:
        words.append(label[back[end] : end])
        end = back[end]
    return words[::-1]


def segmented(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) for each distinct row of `labels` (label). The substrings of a label that are
    words meet in one row: at most MOST_LABEL * MOST_WORD."""
    total = int(counts.agg(F.sum("n")).first()[0] or 1)
    labels = labels.where("label <> ''").distinct()
    n = F.length("label")
    pieces = F.flatten(F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(MOST_WORD), n - i + 1)), lambda k: F.substring(F.col("label"), i, k)),
    ))
    parts = labels.where(n <= MOST_LABEL).select("label", F.explode(F.array_distinct(pieces)).alias("word"))
    known = parts.join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def batch(part: pa.RecordBatch) -> dict:
        names, found = part.column(0).to_pylist(), part.column(1).to_pylist()
        words = [
            [a] if len(a) > MOST_LABEL else segment(a, {w["word"]: w["n"] for w in k or []}, total)
            for a, k in zip(names, found, strict=True)
        ]
        return {"label": part.column(0), "words": pa.array(words, pa.list_(pa.string()))}

    return arrow_map(labels.join(known, "label", "left"), batch, "label string, words array<string>")


def _buckets(tokens: Column) -> Column:
    """Feature numbers of tokens; numbers are alike."""
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(F.regexp_replace(t, r"^\d+$", "#")), F.lit(BUCKETS)).cast("int"))


def _host_tokens(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, host_tokens, seeded) for each row of `hosts` (host)."""
    cut = hosts.select("host", F.posexplode(F.split("host", r"[^\p{L}]+")).alias("at", "label")).where("label <> ''")
    words = segmented(cut.select("label"), counts)
    whole = cut.join(words, "label").groupBy("host").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: x.words)).alias("host_tokens")
    )
    tokens = F.coalesce("host_tokens", F.array().cast("array<string>"))
    seeds = F.array(*map(F.lit, SEEDS))
    return hosts.join(whole, "host", "left").select("host", tokens.alias("host_tokens"), F.arrays_overlap(tokens, seeds).alias("seeded"))


def log_odds(judged: DataFrame) -> tuple[float, np.ndarray]:
    """Prior and per-bucket log odds of the seeded class, from (seeded, buckets) of all rows. The
    driver gets two counts for each bucket at most."""
    n = np.zeros(2)
    for r in judged.groupBy("seeded").count().collect():
        n[int(r["seeded"])] = r["count"]
    tokens = np.zeros((2, BUCKETS))
    for r in judged.select("seeded", F.explode("buckets").alias("b")).groupBy("seeded", "b").count().collect():
        tokens[int(r["seeded"]), r["b"]] = r["count"]
    seen = tokens.sum(0) > 0
    share = np.log(tokens + SMOOTHING) - np.log(tokens.sum(1, keepdims=True) + SMOOTHING * max(1, seen.sum()))
    return float(np.log(n[1] + SMOOTHING) - np.log(n[0] + SMOOTHING)), np.where(seen, share[1] - share[0], 0.0)


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES) -> DataFrame:
    """(key, host, path, rule, verdict, score, host_words) per row.

    `verdict` is the rule's where one fits, else block if `score`, the log odds of the unwanted
    class, is above zero. Null urls and those without :// have an empty host and path and only the
    prior. Hosts are segmented once each, however many rows they have; repeated rows get equal
    verdicts; null html has no words.
    """
    counts = written(word_counts(pages, html), "words")
    narrow = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    hosts = _host_tokens(narrow.select("host").distinct(), counts)
    path_tokens = F.filter(F.split(F.lower("path"), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    tokens = F.concat("host_tokens", path_tokens)
    rows = written(narrow.join(hosts, "host").select(
        key, "host", "path", matching_rule(F.col("host"), F.col("path"), rules).alias("rule"),
        "host_tokens", "seeded", _buckets(tokens).alias("buckets"),
    ), "tokens")
    prior, odds = log_odds(rows)

    def batch(part: pa.RecordBatch) -> dict:
        columns = dict(zip(part.schema.names, part.columns, strict=True))
        scores = [prior + float(odds[np.array(b, int)].sum()) for b in part.column("buckets").to_pylist()]
        return {n: columns[n] for n in (key, "host", "path", "rule", "host_tokens")} | {"score": scores}

    kind = narrow.schema[0].dataType.simpleString()
    scored = arrow_map(rows, batch, f"`{key}` {kind}, host string, path string, rule string, host_tokens array<string>, score double")
    named = F.lit(None).cast("string")
    for verdict, rule in rules:
        named = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(named)
    verdict = F.coalesce(named, F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.select(key, "host", "path", "rule", verdict.alias("verdict"), "score", F.col("host_tokens").alias("host_words"))
