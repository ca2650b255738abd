"""The correlate job against a plain per-trade loop on crowded random data."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from sightline.functions import scoring as S
from sightline.operators import aggregates
from sightline.operators.upserts import PAIR, apply_verdicts, prune_stale, upsert_correlations
from sightline.plans import correlate as C
from sightline.plans import maintain as M
from sightline.plans import timeline as T

DAY0 = dt.date(2025, 1, 1)
TOPICS = {1: ["chips"], 2: ["chips", "banks"], 3: [], 4: ["banks"]}
WEIGHTS = list(S.WEIGHTS.values())


def half_up(x, k):
    return math.floor(x * k + 0.5) / k


@pytest.fixture(scope="module")
def world():
    """Few days and companies, so that many events share a day, a company and an impact."""
    rnd = random.Random(7)
    day = lambda n: DAY0 + dt.timedelta(days=rnd.randrange(n))
    trades = [
        (i, i % 3, rnd.choice([1, 1, 1, 2, 3, 4]), day(60), rnd.choice(["Purchase", "Sale", "Sale (Partial)", "Exchange"]), rnd.randint(1, 10))
        for i in range(60)
    ]
    statements = [
        (i, day(60), rnd.choice(["official_transcript", "caption_derived"]), rnd.choice([0.7, 0.8, 0.9]),
         rnd.choice([None, None, True, False]), rnd.choice([None, None, None, 5]))
        for i in range(160)
    ]
    mentions = []
    for i in range(420):
        named = rnd.random() < 0.5
        mentions.append((
            i, rnd.randrange(160), rnd.choice([1, 1, 1, 2, 3]) if named else None,
            None if named else rnd.choice(["chips", "banks"]),
            rnd.choice(["positive", "negative", "neutral", None, None]), rnd.choice(["llm", "gazetteer"]),
            rnd.choice([0.5, 0.6]), rnd.randrange(40),
        ))
    actions = [(i, day(60), rnd.choice(["contract", "rule"])) for i in range(120)]
    targets = [
        (rnd.randrange(120), rnd.choice([1, 1, 2, 3]), None) if rnd.random() < 0.5
        else (rnd.randrange(120), None, rnd.choice(["chips", "banks"]))
        for _ in range(260)
    ]
    people = [(0, 1.0), (1, 0.35), (2, None)]
    return trades, statements, mentions, actions, targets, people


def frames(spark, world):
    trades, statements, mentions, actions, targets, people = world
    make = spark.createDataFrame
    trade = make(trades, "id bigint, filing_id bigint, company_id bigint, date date, type string, band int")
    filing = make(
        [(0, 0, "published"), (1, 1, "parsed"), (2, 2, "review")], "id bigint, person_id bigint, status string"
    ).withColumns({"filing_date": F.lit("2025-06-01").cast("date"), "source_url": F.lit("u")})
    company = make(list(TOPICS.items()), "id bigint, topics array<string>")
    person = make(people, "id bigint, authority double")
    statement = make(statements, "id bigint, spoken_at date, method string, confidence double, needs_review boolean, superseded_by bigint")
    mention = make(mentions, "id bigint, statement_id bigint, company_id bigint, sector string, sentiment string, method string, confidence double, char_start int")
    action = make(actions, "id bigint, occurred_on date, action_type string")
    target = make(targets, "action_id bigint, company_id bigint, sector string")
    return trade, filing, company, person, statement, mention, action, target


def by_hand(world, threshold, cap, weights=WEIGHTS):
    trades, statements, mentions, actions, targets, people = world
    trusted = {
        s[0]: s for s in statements
        if s[5] is None and (s[2] == "official_transcript" or (s[3] >= 0.8 and s[4] is not True))
    }
    acts = {a[0]: a for a in actions}
    authority = dict(people)
    out = set()
    for tid, fid, cid, day, kind, band in trades:
        if fid == 2:
            continue
        topics = TOPICS[cid]
        found = {}
        for m in mentions:
            s = trusted.get(m[1])
            spec = 1.0 if m[2] == cid else 0.6 if m[3] in topics else 0
            if s and spec and -45 <= (s[1] - day).days <= 30:
                key = ("statement", s[0])
                found[key] = (max(spec, found.get(key, (0,))[0]), (s[1] - day).days, None)
        for aid, c, sector in targets:
            spec = 1.0 if c == cid else 0.6 if sector in topics else 0
            gap = (acts[aid][1] - day).days
            if spec and -45 <= gap <= 30:
                key = ("action", aid)
                found[key] = (max(spec, found.get(key, (0,))[0]), gap, acts[aid][2])
        bonus = min(1.0, (len(found) - 1) * 0.25)
        low = [1001, 15001, 50001, 100001, 250001, 500001, 1000001, 5000001, 25000001, 50000001]
        mid = low[9] if band == 10 else (low[band - 1] + low[band]) // 2
        share = (math.log(mid) - math.log(8000)) / (math.log(5e7) - math.log(8000))
        scored = []
        for (ekind, eid), (spec, gap, act) in found.items():
            mood = None
            if ekind == "statement":
                views = [m for m in mentions if m[1] == eid and m[4] and (m[2] == cid or m[3] in topics)]
                views.sort(key=lambda m: (m[5] != "llm", -m[6], m[7], m[0]))
                mood = views[0][4] if views else None
            good = mood == "positive" or act == "contract"
            known = good or mood == "negative"
            if kind == "Exchange" or not known:
                aligned = 0.5
            else:
                aligned = 1.0 if good == (kind == "Purchase") else 0.0
            auth = authority[fid] if authority[fid] is not None else 1.0
            parts = [half_up(math.exp(-abs(gap) / 14), 1000), spec, auth, aligned, half_up(min(1, max(0, share)), 1000), bonus]
            total = 0.0
            for w, p in zip(weights, parts):  # plain additions; sum() compensates rounding
                total += w * p
            signal = math.floor(total * 1000 + 0.5) / 10
            if signal >= threshold:
                scored.append((-signal, -spec, ekind != "statement", eid, ekind, gap))
        for s in sorted(scored)[:cap]:
            out.add((tid, s[4], s[3], s[5], -s[0]))
    return out


@pytest.mark.parametrize("threshold,cap", [(25, 25), (25, 3), (55, 5)])
def test_equals_loop(spark, world, threshold, cap):
    got = C.correlate(*frames(spark, world), threshold=threshold, max_per_trade=cap)
    rows = {(r.trade_id, r.kind, r.event_id, r.days_gap, r.signal) for r in got.collect()}
    assert rows == by_hand(world, threshold, cap)


@pytest.mark.parametrize("cap", [3, 25])
def test_equals_loop_under_weights_that_favour_direction(spark, world, cap):
    """A topical view may then outweigh a direct link, so no tier may be cut before they meet."""
    weights = dict(S.WEIGHTS, specificity=0.05, direction=0.4)
    assert not C.cut_is_exact(weights) and C.cut_is_exact(S.WEIGHTS)
    got = C.correlate(*frames(spark, world), threshold=25, max_per_trade=cap, weights=weights)
    rows = {(r.trade_id, r.kind, r.event_id, r.days_gap, r.signal) for r in got.collect()}
    assert rows == by_hand(world, 25, cap, list(weights.values()))


def test_invariants_and_rerun(spark, world):
    args = frames(spark, world)
    first = C.correlate(*args, max_per_trade=4)
    rows = first.collect()
    keys = [(r.trade_id, r.kind, r.event_id) for r in rows]
    assert len(keys) == len(set(keys))
    per_trade = {}
    for r in rows:
        per_trade[r.trade_id] = per_trade.get(r.trade_id, 0) + 1
        assert 25 <= r.signal <= 100 and -45 <= r.days_gap <= 30
    assert max(per_trade.values()) <= 4
    reviewed = first.withColumns({"verified": F.col("event_id") % 2 == 0, "reason": F.lit("seen")})
    again = upsert_correlations(reviewed, C.correlate(*args, max_per_trade=4))
    assert again.filter("reason = 'seen'").count() == len(rows) == again.count()
    audit = C.audit_scores(first).first()
    assert audit.pairs == audit.consistent and audit.weights_sum_to_one


def test_weights_and_direction(rows):
    assert abs(sum(S.WEIGHTS.values()) - 1) < 1e-9
    df = rows("t string, k string, s string, a string", [
        ("Purchase", "statement", "positive", None), ("Sale (Partial)", "statement", "positive", None),
        ("Sale", "statement", "negative", None), ("Exchange", "statement", "positive", None),
        ("Purchase", "action", None, "contract"), ("Sale", "action", None, "contract"),
        ("Purchase", "action", None, "rule"), ("Purchase", "statement", "neutral", None),
    ])
    impact = S.event_impact(F.col("k"), F.col("s"), F.col("a"))
    got = [r.d for r in df.select(S.direction(S.trade_side(F.col("t")), impact).alias("d")).collect()]
    assert got == [1.0, 0.0, 1.0, 0.5, 1.0, 0.0, 0.5, 0.5]


def test_store_follows_batches(spark, world, tmp_path):
    """After each batch of events the store equals a full run over what is there; verdicts stay, also
    over later batches, and only the months that a batch can reach are written."""
    trade, filing, company, person, statement, mention, action, target = frames(spark, world)
    path, who = str(tmp_path / "pairs"), (trade, filing, company, person)
    batch = F.floor(F.col("id") * 3 / 160)
    events = statement.selectExpr("'statement' AS kind", "id AS event_id", "spoken_at AS event_date", "id").unionByName(
        action.selectExpr("'action' AS kind", "id AS event_id", "occurred_on AS event_date", "id")
    )
    facts = ["trade_id", "kind", "event_id", "days_gap", "signal"]
    for k in range(3):
        so_far = (statement.where(batch <= k), mention, action.where(batch <= k), target)
        for _ in range(2 if k == 1 else 1):  # one batch comes twice
            M.refresh(path, *who, *so_far, changed=events.where(batch == k).drop("id"))
        full = {tuple(r) for r in C.correlate(*who, *so_far).select(*facts).collect()}
        stored = M.stored_pairs(spark, path)
        assert {tuple(r) for r in stored.select(*facts).collect()} == full and stored.count() == len(full)
        if k == 0:
            given = stored.orderBy("signal").limit(5).select("trade_id", "kind", "event_id", F.lit(True).alias("verified"), F.lit("seen").alias("reason"))
            said = {tuple(r)[:3] for r in given.collect()}
            M.review(path, spark.createDataFrame(given.collect(), given.schema))
        still = {tuple(r)[:3] for r in stored.where("verified AND reason = 'seen'").select("trade_id", "kind", "event_id").collect()} if k else said
        assert still == {x for x in said if x in {f[:3] for f in full}}
    # events that go leave no pair behind, in whatever month
    gone = statement.where("id < 0"), mention, action.where("id < 0"), target
    M.refresh(path, *who, *gone, changed=events.drop("id"))
    assert M.stored_pairs(spark, path).count() == 0
    # an event of one day reaches the trades of its window alone
    one = spark.createDataFrame([("statement", 1, dt.date(2025, 6, 30))], "kind string, event_id bigint, event_date date")
    assert M.refresh(path, *who, statement, mention, action, target, changed=one).count() == 0


@pytest.mark.parametrize("entries,sets", [(0, 200), (2_000_000, 0)])
def test_equals_loop_with_lists_shuffled_or_limited(spark, world, monkeypatch, entries, sets):
    monkeypatch.setattr(C, "BROADCAST_ENTRIES", entries)
    monkeypatch.setattr(C, "MANY_SETS", sets)
    got = C.correlate(*frames(spark, world), threshold=25, max_per_trade=3)
    rows = {(r.trade_id, r.kind, r.event_id, r.days_gap, r.signal) for r in got.collect()}
    assert rows == by_hand(world, 25, 3)


def test_pairs_are_not_shuffled(spark, world):
    """Pairs are laid out after the last exchange."""
    plan = C.correlate(*frames(spark, world))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("explode(_best")]
    assert not any(step in above for step in ("Exchange", "Sort ", "Window", "Join"))


def test_texts_of_pairs_are_not_sorted(spark):
    """Unreviewed pairs carry their company's name: above the choice of pairs only event facts are joined."""
    from catalog import QUERIES

    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["verdict_candidates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    above = plan[: plan.index("explode(_best")]
    assert above.count("Join") == 1 and not any(step in above for step in ("Exchange hash", "Sort "))


def test_day_summary_equals_candidates(spark, world):
    trade, filing, company, person, *events = frames(spark, world)
    days = C.scored_trades(trade, filing, company, person).select("company_id", "topic_set", "trade_date").distinct()
    sides = C.company_events(company, *events), C.topic_events(company, *events)
    plain = C.day_candidates(days, *sides, 45, 30).groupBy("company_id", "trade_date").agg(
        F.count(F.lit(1)).alias("events"), F.min("days_gap").alias("first_gap"), F.max(S.temporal(F.col("days_gap"))).alias("temporal")
    )
    short = C.day_summary(days, *sides, 45, 30)
    rows = {tuple(r) for r in short.collect()}
    assert rows == {tuple(r) for r in plain.collect()} and rows


def test_candidates_of_both_tiers_are_direct_and_not_shuffled(spark, rows):
    """An event of both tiers is one direct candidate; the tiers meet before they are paired with days."""
    D = dt.date
    days = rows("company_id int, topic_set string, trade_date date", [(1, "x", D(2025, 1, 1)), (1, "x", D(2025, 3, 1)), (2, "x", D(2025, 1, 2)), (3, "", D(2025, 1, 1))])
    event = "kind string, event_id int, event_date date, impact int"
    named = rows(f"company_id int, {event}", [(1, "action", 7, D(2025, 1, 5), 1), (1, "statement", 7, D(2025, 1, 5), 0), (3, "action", 7, D(2025, 1, 5), 1), (2, "action", 9, D(2026, 1, 1), 0)])
    topical = rows(f"topic_set string, {event}", [("x", "action", 7, D(2025, 1, 5), 0), ("x", "action", 8, D(2025, 1, 20), 0), ("x", "action", 8, D(2025, 1, 20), 0)])
    found = C.day_candidates(days, named, topical, 45, 30)
    got = sorted((r.company_id, r.trade_date.month, r.kind, r.event_id, r.days_gap, r.specificity, r.impact) for r in found.collect())
    assert got == [
        (1, 1, "action", 7, 4, S.DIRECT, 1), (1, 1, "action", 8, 19, S.TOPICAL, 0), (1, 1, "statement", 7, 4, S.DIRECT, 0), (1, 3, "action", 8, -40, S.TOPICAL, 0),
        (2, 1, "action", 7, 3, S.TOPICAL, 0), (2, 1, "action", 8, 18, S.TOPICAL, 0), (3, 1, "action", 7, 4, S.DIRECT, 1),
    ]
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert dealt and not any("trade_date" in line and "event_id" in line for line in dealt)


def test_pairs_carry_columns_of_their_trade(spark, world):
    trade, *others = frames(spark, world)
    pairs = C.correlate(trade, *others, max_per_trade=2, carry=["date", "type"])
    facts = {r.id: (r.date, r.type) for r in trade.collect()}
    rows = pairs.select("trade_id", "trade_date", "trade_type").collect()
    assert rows and all(facts[r.trade_id] == (r.trade_date, r.trade_type) for r in rows)


def test_two_runs_meet_without_shuffling_pairs(spark, world):
    """Verdicts, stale pairs and upserts of pairs that lie together by company: nothing is exchanged above
    the pairs, and the results are those of the joins by key alone."""
    pairs = C.correlate(*frames(spark, world), max_per_trade=4).withColumn("id", F.concat_ws(":", *PAIR))
    old = pairs.where("event_id % 3 <> 0").withColumns({
        "verified": F.when(F.col("event_id") % 2 == 0, True), "reason": F.when(F.col("event_id") % 5 == 0, F.lit("seen")),
    })
    new, by = pairs.where("event_id % 4 <> 1"), ("company_id",)
    given = old.select(*by, "id", F.col("verified").alias("genuine"), "reason")
    none = pairs.withColumn("verified", F.lit(None).cast("boolean"))
    for near, plain in (
        (upsert_correlations(old, new, by), upsert_correlations(old, new)),
        (prune_stale(old, new, by), prune_stale(old, new)),
        (apply_verdicts(none, given, by), apply_verdicts(none, given)),
    ):
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("explode(_best")]
        columns = [*PAIR, *[c for c in ("verified", "reason") if c in plain.columns]]
        rows = sorted(map(str, near.select(*columns).collect()))
        assert rows == sorted(map(str, plain.select(*columns).collect())) and rows


def test_companies_count_the_pairs_of_a_run_where_they_are(spark, world):
    trade, filing, company, *others = frames(spark, world)
    trade = trade.withColumns({"amount_min": F.lit(1), "amount_max": F.lit(2)})
    firm = company.selectExpr("id", "topics", "concat('n', id) AS name", "concat('S', id) AS ticker", "'x' AS sector", "'y' AS industry")
    pairs = C.correlate(trade, filing, company, *others).withColumn("verified", F.when(F.col("event_id") % 3 == 0, False))
    for job in (aggregates.list_companies, aggregates.ticker_priority):
        near, plain = job(firm, trade, filing, pairs, of_run=True), job(firm, trade, filing, pairs.drop("company_id"))
        assert near.collect() == plain.collect() and near.count()
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(trade_id" not in plan


@pytest.mark.parametrize("bytes_sent", [1 << 28, 0])
def test_pairs_carry_facts_of_their_event(spark, world, monkeypatch, bytes_sent):
    """Of direct and of topical events; an event without facts has NULL."""
    monkeypatch.setattr(C, "BROADCAST_FACTS", bytes_sent)
    action = frames(spark, world)[6]
    facts = action.where("id % 5 <> 0").selectExpr("'action' AS kind", "id AS event_id", "action_type")
    pairs = C.correlate(*frames(spark, world), max_per_trade=9, facts=facts)
    told = {r.event_id: r.action_type for r in facts.collect()}
    rows = pairs.select("trade_id", "kind", "event_id", "event_action_type", "components.specificity").collect()
    assert {(r.specificity, r.event_action_type is None) for r in rows if r.kind == "action"} >= {(1.0, False), (0.6, False), (0.6, True)}
    assert all(r.event_action_type == (told.get(r.event_id) if r.kind == "action" else None) for r in rows)
    assert {r[:3] for r in map(tuple, rows)} == {r[:3] for r in by_hand(world, 25, 9)}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("explode(_best")]
    assert bytes_sent == 0 or not any(step in above for step in ("Exchange hash", "SortMergeJoin"))


def test_timeline_needs_only_trades_in_reach(spark, world):
    """With few lane events on distant days the result is that of all pairs, from fewer trades."""
    trade, filing, company, person, statement, mention, action, target = frames(spark, world)
    shift = F.date_sub("date", F.when(F.col("id") % 2 == 0, 400).otherwise(0))
    trade = trade.withColumns({"date": shift, "description": F.lit("d")})
    company = company.withColumn("ticker", F.concat(F.lit("S"), "id"))
    statement = statement.withColumns({"full_text": F.concat(F.lit("t"), "id"), "source_url": F.lit("u")})
    action = action.withColumns({"title": F.concat(F.lit("a"), "id"), "source_url": F.lit("u")})
    tables = (trade, filing, company, statement, mention, action)
    verdict = lambda pairs: pairs.withColumn("verified", F.when(F.col("event_id") % 7 == 0, False))
    run = lambda some: C.correlate(some, filing, company, person, statement, mention, action, target, carry=["type"])
    whole = T.timeline(verdict(run(trade)).drop("company_id", "trade_type"), *tables, limit=5)
    events = T.lanes(*tables, limit=5)
    near = T.trades_in_reach(trade, events)
    assert 0 < near.count() < trade.count()
    got = T.timeline(verdict(run(near)), *tables, limit=5, events=events)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and got.where("size(related) > 0").count()


def test_a_batch_that_touches_many_trades_keeps_verdicts(spark, world, monkeypatch, tmp_path):
    """The trades of its months are all scored again; what is stored equals a full run either way."""
    trade, filing, company, person, statement, mention, action, target = frames(spark, world)
    monkeypatch.setattr(M, "FEW_TRADES", 0)
    monkeypatch.setattr(M, "FEW_VERDICTS", 0)
    path, args = str(tmp_path / "pairs"), (trade, filing, company, person, statement, mention, action, target)
    changed = statement.selectExpr("'statement' AS kind", "id AS event_id", "spoken_at AS event_date").unionByName(
        action.selectExpr("'action' AS kind", "id AS event_id", "occurred_on AS event_date")
    )
    facts = ["trade_id", "kind", "event_id", "days_gap", "signal"]
    full = {tuple(r) for r in C.correlate(*args).select(*facts).collect()}
    M.refresh(path, *args, changed=changed)
    given = M.stored_pairs(spark, path).orderBy("signal", *PAIR).limit(5).select(*PAIR, F.lit(True).alias("verified"), F.lit("seen").alias("reason"))
    said = {tuple(r)[:3] for r in given.collect()}
    M.review(path, spark.createDataFrame(given.collect(), given.schema))
    M.refresh(path, *args, changed=changed.where("event_id % 20 = 0"))
    stored = M.stored_pairs(spark, path)
    assert {tuple(r) for r in stored.select(*facts).collect()} == full and stored.count() == len(full)
    assert {tuple(r) for r in stored.where("reason = 'seen'").select(*PAIR).collect()} == said


def test_touched_trades_meet_few_events(spark, rows, monkeypatch):
    """Trades that a topic touches are known by their day; only the others meet the events of their company."""
    D, rnd = dt.date(2025, 1, 1), random.Random(3)
    day = lambda n: D + dt.timedelta(days=n)
    trade = [(i, rnd.randrange(6) or None, day(rnd.randrange(300)) if i % 17 else None) for i in range(200)]
    topics = {1: ["a"], 2: ["a", "b"], 3: [], 4: ["b"], 5: None}
    mention = [(s, rnd.choice([None, 1, 2, 3, 4, 5]), rnd.choice([None, "a", "b"])) for s in range(4)]
    target = [(s, rnd.choice([None, 3, 5]), rnd.choice([None, "b"])) for s in range(4)]
    changed = [(kind, s, day(40 * s + (0 if kind == "action" else 90))) for kind in ("statement", "action") for s in range(4)]
    met, joined = [], M.window_join

    def seen(left, *args):
        met.extend(tuple(r) for r in left.collect())
        return joined(left, *args)

    monkeypatch.setattr(M, "window_join", seen)
    link = "company_id int, sector string"
    touched = M.touched_trades(
        rows("id int, company_id int, date date", trade), rows("id int, topics array<string>", list(topics.items())),
        rows(f"statement_id int, {link}", mention), rows(f"action_id int, {link}", target), rows("kind string, event_id int, event_date date", changed))
    got = [r.trade_id for r in touched.collect()]
    by_topic, want = set(), set()
    for kind, s, at in changed:
        for e, company, topic in mention if kind == "statement" else target:
            for i, firm, date in trade:
                if e == s and date and firm and -45 <= (at - date).days <= 30:
                    if topic in (topics[firm] or []):
                        by_topic.add(i)
                    if firm == company or topic in (topics[firm] or []):
                        want.add(i)
    assert sorted(got) == sorted(want) and by_topic and want - by_topic
    assert not {(firm, date) for i, firm, date in trade if i in by_topic} & set(met)
