"""Joins that ask a filter of known keys first, against plain loops; candidates and plans."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from catalog import match_checks
from catalog.bindings import Bound
from sightline.operators import reconcile, resolve, spans, superseding, upserts
from sightline.operators.membership import key_filter, may_hold

D = dt.date


def test_filter_loses_no_key(spark, rows):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    probes = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("p")).unionByName(rows("p string", [(None,)]))
    held = {r.p for r in probes.where(may_hold(key_filter(keys, "k"), F.col("p"))).collect()}
    assert {f"k{i}" for i in range(3000)} <= held and len(held) < 3100 and None not in held
    crowded = key_filter(keys, "k", n_words=4)  # too small: lets more through, loses nothing
    assert len(crowded.first().words) == 4
    assert keys.where(may_hold(crowded, F.col("k"), n_words=4)).count() == 3000
    assert probes.where(may_hold(key_filter(keys.limit(0), "k"), F.col("p"))).count() == 0


def exchanged(df) -> list[str]:
    """The columns of every exchange of a plan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\(\d+\) (?:Exchange|BroadcastExchange)[^\n]*\nInput \[\d+\]: \[([^\]]*)\]", plan)


def test_mentions_shuffle_no_text(rows):
    texts = rows("doc_id int, text string", [(1, "Acme Rockets and acme  rockets, not acme"), (2, "$AR up"), (3, None), (4, "")])
    gaz = rows("company_id int, ticker string, name_key string", [(1, "AR", "acme rockets"), (2, None, "acme rockets"), (3, None, None)])
    found = spans.find_company_spans(texts, gaz)
    assert {(r.doc_id, r.company_id, r.char_start, r.char_end) for r in found.collect()} == {
        (1, 1, 0, 12), (1, 1, 17, 30), (1, 2, 0, 12), (1, 2, 17, 30), (2, 1, 0, 3)}
    moved = exchanged(found)
    assert moved and not any(re.search(r"\btext#", columns) for columns in moved)
    assert not any(re.search(r"\btext#", columns) for columns in exchanged(spans.company_hits(texts, gaz)))


def test_recipients_are_compared_once_and_dealt(spark, rows):
    """Many companies of one name and many awards of one recipient: words are compared once, and the
    pairs are made in more than one task."""
    firms = spark.range(40).select("id", F.lit("Rockets Acme Holdings").alias("name")).unionByName(rows("id bigint, name string", [(90, "Co"), (91, None), (92, "Boeing")]))
    awards = spark.range(60).select(F.lit("The ACMEROCKETS LLC").alias("recipient"), F.col("id").alias("award")).unionByName(
        rows("recipient string, award bigint", [("MacBoeings", 70), ("Rockets", 71), (None, 72)]))
    pairs = resolve.recipient_matches(firms, awards)
    dealt = pairs.select("company_id", "award", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.company_id, r.award) for r in dealt) == sorted([(c, a) for c in range(40) for a in range(60)] + [(92, 70)])
    assert len({r.task for r in dealt}) > 1
    first = resolve.first_recipient_matches(firms, awards)
    assert {r.award: r.company_id for r in first.collect()} == {a: 0 for a in range(60)} | {70: 92}
    made = [n for df in (resolve._carried(firms, awards)[1], first) for n in [df.count()]]
    assert made == [2, 61]


def test_beginnings_match_a_plain_loop(spark, rows):
    rnd = random.Random(4)

    def text():
        return " ".join(rnd.choice(["ALPHA", "BETA", "GAMMA", "AL"]) for _ in range(rnd.randrange(1, 5)))

    ours = [(i, i % 5, text(), D(2025, 1, 1 + i % 2), 10 * (i % 4), 10 * (i % 4) + 15 if i % 3 else None) for i in range(60)]
    theirs = [(i, "s", D(2025, 1, 1 + i % 2), None, text(), 10 * (i % 5) if i % 7 else None, None) for i in range(60)]
    trade = rows("id int, company_id int, description string, date date, amount_min long, amount_max long", ours)
    firm = rows("id int, ticker string", [(i, f"T{i}") for i in range(5)])
    record = rows("record_id int, source string, date date, ticker string, description string, amount_min long, amount_max long", theirs)
    spark.sparkContext.setJobGroup("planning", "no job while a plan is built")
    matched = reconcile.match_records(trade, firm, record)
    recipients = resolve.recipient_matches(rows("id int, name string", [(1, "Rockets Acme")]), rows("recipient string, award int", [("ACMEROCKETS LLC", 1), ("ROCKETS", 2)]))
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == []
    spark.sparkContext.setJobGroup("running", "")
    assert [r.award for r in recipients.collect()] == [1]
    keys = {r.id: r.t for r in trade.select("id", reconcile.names.normalize_description(F.col("description")).alias("t")).collect()}
    rec_keys = {r.record_id: r.t for r in record.select("record_id", reconcile.names.normalize_description(F.col("description")).alias("t")).collect()}
    want = {}
    for rid, _, day, _, _, low, high in theirs:
        fits = [
            tid for tid, _, _, d, lo, hi in ours
            if d == day and min(len(keys[tid]), len(rec_keys[rid])) >= reconcile.MIN_DESCRIPTION
            and (keys[tid].startswith(rec_keys[rid]) or rec_keys[rid].startswith(keys[tid]))
            and (low is None or (low <= (hi or 2**62) and lo <= (high or 2**62)))
        ]
        want[rid] = min(fits, default=None)
    assert {r.record_id: r.trade_id for r in matched.collect()} == want and any(want.values())


def test_descriptions_are_normalised_as_by_words(rows):
    noise = reconcile.names.fixed.DESCRIPTION_NOISE.replace("SHS?", "SH|SHS").split("|")
    texts = ["The Acme Co., Inc.", "CO", " co-op  The THE com\tX", "Équity élan", "SHSS SHS SH S", "a&b corporation/class cl", "", None, "COM COMET  COMMON-STOCK", "\u00a0ltd\u00a0x"]
    got = rows("t string", [(t,) for t in texts]).select("t", reconcile.names.normalize_description(F.col("t")).alias("d")).collect()
    for t, d in got:
        words = re.sub("[^A-Z0-9 ]", " ", t.upper()).split() if t is not None else []
        assert d == (None if t is None else " ".join(w for w in words if w not in noise))


def test_matching_reads_its_trades_from_one_table(spark):
    """Both sides, which are read several times, come from a table that is written once, and are
    shuffled by their matching keys alone."""
    b = Bound(spark, "/root/testdata/sf0.001")
    matched = match_checks._matches(b)
    assert not [f for f in matched.inputFiles() if "/root/testdata" in f]
    keys = [m.split(", ") for m in re.findall(r"hashpartitioning\(([^)]*), \d+\)", matched._jdf.queryExecution().executedPlan().toString())]
    tickers = [k for k in keys if any(c.startswith("ticker#") for c in k)]
    assert tickers and not any(c.startswith(("our_min#", "amount_min#", "company_id#")) for k in tickers for c in k)


def test_candidates_of_nearly_alike_texts(rows):
    """A day of different texts on one template that stay below the limit: most pairs are left out
    before they are compared, and the result is that of all pairs."""
    rnd = random.Random(5)
    template = [f"word{i}" for i in range(40)]
    docs = []
    for i in range(80):
        own = [f"own{i}x{j}" for j in range(rnd.choice([0, 20, 45, 60]))]
        docs.append((i, D(2025, 1, 1), " ".join(own + template), "Remarks at the old town hall" if i % 9 == 0 else None))
    df = rows("id int, day date, text string, venue string", docs)
    a, b = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    reps = [superseding._representatives(superseding._profile(side)) for side in (a, b)]
    found = {(r.official_rep, r.other_rep) for r in superseding.candidate_pairs(*reps).collect()}
    sizes = [side.count() for side in reps]
    pairs = superseding.matching_representatives(*reps).count()
    assert pairs <= len(found) < 0.6 * sizes[0] * sizes[1]
    sets = [{r.rep: (set(r.pairs), set(r.venue_pairs)) for r in side.collect()} for side in reps]

    def dice(x, y):
        return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0

    alike = {
        (k, m) for k, (p, v) in sets[0].items() for m, (q, w) in sets[1].items()
        if dice(p, q) >= 0.55 or (dice(v, w) >= 0.8 and dice(p, q) >= 0.3)
    }
    assert alike and alike <= found and pairs == len(alike)


def test_keys_of_word_sets_are_short_and_distinct(rows):
    docs = rows("id int, day date, text string, venue string", [(i, D(2025, 1, 1), f"one two three number{i % 50} five", None) for i in range(100)])
    keys = [r.rep for r in superseding._representatives(superseding._profile(docs)).collect()]
    assert len(keys) == len(set(keys)) == 50 and max(map(len, keys)) <= 24


def test_errors_of_a_run_are_bounded(rows):
    items = [(1, f"2025-01-{1 + i % 9:02d}", f"e{i:03d}" if i % 2 else None) for i in range(300)] + [(None, "2025-01-01", "x"), (2, "2025-01-02", None)]
    got = {r.run_id: r for r in upserts.run_metrics(rows("run_id int, at string, error string", items), "s", most_errors=7).collect()}
    assert got[1].errors == [f"e{i:03d}" for i in range(1, 15, 2)] and got[1].distinct_errors == 150
    assert (got[1].items_found, got[1].items_failed, got[1].status) == (150, 150, "failed")
    assert (got[None].errors, got[2].errors, got[2].status) == (["x"], [], "completed")
