"""Operators on hand-made frames, with the cases the random data does not have."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from sightline.operators import listing, quality, reconcile, resolve, series, spans, superseding, upserts
from sightline.plans import graph
from sightline.sources import exports, feeds, pages

D = dt.date


def test_spans_are_verified_and_ascii_bounded(rows):
    texts = rows("doc_id int, text string", [
        (1, "He met State\n Street, then STATE STREET again; the State Senate not."),
        (2, "Buy $AB.C now, not AB.C or $AB.CD. éstate street é"),
        (3, "😀 Datadog"),
    ])
    gaz = rows("company_id int, ticker string, name_key string", [(1, "ST", "state street"), (2, "AB.C", None), (3, "ON", "datadog")])
    got = {(r.doc_id, r.company_id, r.char_start, r.char_end) for r in spans.find_company_spans(texts, gaz).collect()}
    assert {(1, 1, 7, 20), (1, 1, 27, 39), (3, 3, 2, 9)} <= got
    assert (2, 1, 36, 48) in got  # an accented letter is no word character
    assert not any(doc == 2 and firm == 3 for doc, firm, *_ in got)


def test_cashtag_is_literal(rows):
    texts = rows("doc_id int, text string", [(1, "x $ABC y"), (2, "x $ABCD y"), (3, "ABC"), (4, "$IT")])
    gaz = rows("company_id int, ticker string, name_key string", [(1, "ABC", None), (2, "IT", None)])
    got = {(r.doc_id, r.char_start) for r in spans.find_company_spans(texts, gaz).collect()}
    assert got == {(1, 2)}


def test_quote_check(rows):
    df = rows("t string, q string", [("abc def", " def "), ("abc", "ab"), ("abc", "xyz")])
    got = [r.s for r in df.select(spans.verify_quote(F.col("t"), F.col("q")).alias("s")).collect()]
    assert got[0] == (4, 7) and got[1] is None and got[2] is None


def test_prefix_resolution(rows):
    titles = rows("position int, ticker string, title string", [
        (1, "C", "Citizens Inc"), (2, "JB", "JetBlue Airways Corp"), (3, "J2", "JetBlue Airways Group"), (4, "MS", "Microsoft Corp"),
    ])
    trades = rows("id int, description string", [
        (1, "JETBLUE AWYS CORP"), (2, "JetBlue Airways West Wing"), (3, "Citizens Utilities"), (4, "MICROSOFT 365 COM"), (5, "GO BOND 4%"), (6, "AB"),
    ])
    got = {r.id: (r.tier, r.ticker) for r in resolve.resolve_companies(trades, titles).collect()}
    assert got == {1: ("exact", "JB"), 2: ("prefix", "JB"), 3: ("unresolved", None), 4: ("prefix", "MS"), 5: ("non_equity", None), 6: ("unresolved", None)}


def test_recipients(rows):
    firms = rows("id int, name string", [(1, "Lockheed Martin Corp"), (2, "Boeing Company"), (3, "Co")])
    awards = rows("award int, recipient string", [(1, "THE BOEING CO"), (2, "Lockheed Martin Space"), (3, "Lockheed Credit"), (4, "MacBoeings")])
    got = {(r.company_id, r.award) for r in resolve.recipient_matches(firms, awards).collect()}
    assert got == {(2, 1), (1, 2), (2, 4)}


def test_reconcile_ranges(rows):
    trade = rows("id int, company_id int, description string, date date, amount_min bigint, amount_max bigint",
                 [(1, 1, "Acme Widgets Inc", D(2025, 1, 2), 1001, 15000), (2, None, "Beta Co", D(2025, 1, 2), 50000001, None)])
    firm = rows("id int, ticker string", [(1, "AW")])
    rec = rows("record_id int, source string, date date, ticker string, description string, amount_min bigint, amount_max bigint", [
        (1, "a", D(2025, 1, 2), "aw", None, None, None), (2, "a", D(2025, 1, 3), "aw", None, None, None),
        (3, "b", D(2025, 1, 2), None, "acme widgets common", 15000, None), (4, "b", D(2025, 1, 2), "AW", None, 15001, 50000),
        (5, "c", D(2025, 1, 2), None, "BETA HOLDINGS", 60000000, None), (6, "c", D(2025, 1, 2), None, "Bet", None, None),
    ])
    got = {r.record_id: r.trade_id for r in reconcile.match_records(trade, firm, rec).collect()}
    assert got == {1: 1, 2: None, 3: 1, 4: None, 5: 2, 6: None}
    sources = reconcile.reconciled_sources(reconcile.match_records(trade, firm, rec)).collect()
    assert {r.trade_id: r.sources for r in sources} == {1: ["a", "b"], 2: ["c"]}
    assert [r.record_id for r in reconcile.band_conflicts(trade, firm, rec).collect()] == [4]


def test_supersede_matches_pairwise(rows):
    base = [f"w{i:03d}" for i in range(40)]
    docs = []
    for i in range(24):
        words = list(base)
        for j in range(i):
            words[(j * 7) % 40] = f"x{i}{j}"
        docs.append((i, D(2025, 1, 1 + i % 2), " ".join(words), "Remarks at the old town hall of Springfield" if i % 5 == 0 else None))
    docs += [(100 + k, D(2025, 1, 1), " ".join(base), None) for k in range(6)]  # copies
    df = rows("id int, day date, text string, venue string", docs)
    official = df.filter("id % 3 = 0")
    other = df.filter("id % 3 != 0")
    got = {r.id: r.superseded_by for r in superseding.supersede_same_day(official, other).collect()}

    def grams(t, take):
        w = [x for x in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split() if len(x) >= 3][:take]
        return {(a, b) for a, b in zip(w, w[1:])} if len(w) >= 4 else set()

    def dice(a, b):
        return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0

    want = {}
    for o in docs:
        for c in docs:
            if o[0] % 3 == 0 and c[0] % 3 != 0 and o[1] == c[1]:
                alike = dice(grams(o[2], 120), grams(c[2], 120))
                if alike >= 0.55 or (dice(grams(o[3], 30), grams(c[3], 30)) >= 0.8 and alike >= 0.3):
                    want[c[0]] = min(want.get(c[0], 10**9), o[0])
    assert got == want and want
    assert superseding.least_overlap(119, 0.55) == 46


def test_prices(rows):
    price = rows("ticker string, date date, close double", [("A", D(2025, 1, 6), 10.0), ("A", D(2025, 1, 13), 12.0), ("Z", D(2025, 1, 6), 0.0)])
    trade = rows("id int, ticker string, date date", [
        (1, "A", D(2025, 1, 5)), (2, "A", D(2025, 1, 6)), (3, "A", D(2025, 1, 10)), (4, "A", D(2025, 2, 1)), (5, "B", D(2025, 1, 6)), (6, "Z", D(2025, 1, 7)),
    ])
    asof = {r.id: r.price_at for r in series.asof_price(trade, price).collect()}
    assert asof == {1: None, 2: 10.0, 3: 10.0, 4: 12.0, 5: None, 6: 0.0}
    near = {r.id: r.snapped_date.day for r in series.nearest_price(trade, price).collect()}
    assert near == {1: 6, 2: 6, 3: 13, 4: 13, 6: 6}
    stamped = {r.id: r.gain_loss_pct for r in series.stamp_prices(trade, price).collect()}
    assert stamped == {2: 20.0, 3: 20.0, 4: 0.0}


def test_quality(rows):
    r = rows("filing_id int, date string, band int, description string, type string", [
        (1, "2025-01-02", 3, "Acme", "Sale"), (1, "2025-02-30", 3, "Acme", "Sale"), (2, "2025-01-02", 11, "A", "Unknown"),
    ])
    p = rows("filing_id int, page int, text_source string, rows_found int, declared_total int", [(1, 1, "ocr", 2, 1), (2, 1, "ocr", 1, 3), (3, 1, "ocr", 0, None)])
    got = {x.filing_id: (x.confidence, x.page_reconciled) for x in quality.filing_confidence(r, p).collect()}
    assert got == {1: (0.45, True), 2: (0.0, False), 3: (0.0, False)}
    issues = [x.issues for x in quality.with_row_quality(r).orderBy("filing_id", "date").collect()]
    assert issues == [[], ["date"], ["band", "description"]]


def test_neighbourhood_depth_and_cap(rows):
    edges = rows("src_type string, src_id string, dst_type string, dst_id string, relation string, weight double, edge_id string",
                 [("n", str(i), "n", str(i + 1), "R", 1.0, f"e{i}") for i in range(6)] + [("n", "2", "n", "0", "R", 1.0, "e9")])
    walk = lambda depth, cap=1500: {(r.edge_id, r.level) for r in graph.neighbourhood(edges, "n", 0, depth, cap).collect()}
    assert walk(1) == {("e0", 1), ("e9", 1)}
    assert walk(2) == {("e0", 1), ("e9", 1), ("e1", 2), ("e2", 2)}
    assert walk(9) == walk(3)
    assert walk(3, 3) == {("e0", 1), ("e9", 1), ("e1", 2)}


def test_insert_and_requests(rows):
    target = rows("k string, v int", [("a", 1)])
    batch = rows("k string, v int", [("a", 2), ("b", 3), ("b", 4)])
    assert [tuple(r) for r in upserts.insert_if_new(target, batch, ["k"], [F.asc("v")]).collect()] == [("b", 3)]
    c = upserts.insert_counts(target, batch, ["k"]).first()
    assert (c.inserted, c.skipped) == (1, 2)
    req = rows("search string, type string, date_from string, date_to string, band_min string, sort_by string, sort_order string, page string, page_size string",
               [(None, "Sale", "2025-01-01", "2025-02-01", "3", None, "asc", "1", "200"), ("x" * 121, "Gift", "1/1/25", "soon", "2.5", "size", "up", "0", "abc")])
    got = [r.invalid for r in listing.request_problems(req, listing.trade_request_rules()).collect()]
    assert got[0] == [] and got[1] == ["search", "type", "dateFrom", "dateTo", "bandMin", "sortBy", "order", "page", "limit"]


PAGE = """Form 278 Transactions
Amount  Received Over 30 Days Ago
1 ACME CORP DUE 12/01/42 ourchaso 3/4/25 No $1,001 - $15,000
2 Beta Holdings Salo 03-05-2025 Y3s S15,001 • S50,000
3 Old Notes Exchange 1/2/2019 No $50,001 - $100,000
Gamma Inc Sale (Partial) 4.6.2025 No 0ver $50,000,000
Page 2 of 9"""


def test_page_rows(rows):
    page = rows("filing string, page int, text string, filing_year int", [("f", 1, PAGE, 2025)])
    got = pages.extract_rows(page).orderBy("row_number").collect()
    assert [(r["description"], r["type"], r["date"], r["late"], r["band"]) for r in got] == [
        ("ACME CORP DUE 12/01/42 ourchaso".replace(" ourchaso", ""), "Purchase", "2025-03-04", False, 1),
        ("Beta Holdings Salo", "Sale", "2025-03-05", True, 2),
        ("Gamma Inc  ()".replace("  ()", " ()"), "Sale (Partial)", "2025-04-06", False, 10),
    ]


def test_page_files(spark, tmp_path):
    for n in range(12):
        (tmp_path / f"doc.p{n}.txt").write_text(PAGE if n == 11 else f"page {n}\nline")
    (tmp_path / "notes.txt").write_text("no page")
    found = pages.scan_pages(spark, str(tmp_path))
    assert sorted(r.page for r in found.collect()) == list(range(1, 13))
    rows = pages.extract_rows(found.withColumn("filing_year", F.lit(2025))).collect()
    assert [r.row_number for r in sorted(rows, key=lambda r: r.row_number)] == [1, 2, 3] and rows[0].page == 12
    report = pages.page_reports(found, pages.extract_rows(found.withColumn("filing_year", F.lit(2025))))
    last = report.filter("page = 12").first()
    assert (last.rows_found, last.page_count, last.declared_total) == (3, 12, 9)


def test_feeds(spark, rows, tmp_path):
    lines = rows("value string", [('{"source":"a","date":"2025-01-01","amount_min":5}',), ("",), ("{oops",), ('{"source":"a"}',)])
    good, bad = feeds.parse_records(lines)
    assert good.count() == 1 and [r.bad_line for r in bad.collect()] == ["{oops"]
    view = rows("json string", [('{"viewentry":[{"@unid":"U1","entrydata":[{"text":{"0":" a "}},{"textlist":{"text":[{"0":"b"},{"0":3}]}},{"datetime":{"0":"2025-01-02"}},null]},{"entrydata":[]}]}',), ("[]",), ("nope",)])
    assert [tuple(r) for r in feeds.flatten_view_entries(view).collect()] == [("U1", ["a", "b", "3", "2025-01-02"])]
    caps = rows("video_id int, json string", [(1, '[{"text":" hi ","offset":120000},{"text":" "},{"text":"yo","start":3.5}]'), (2, '{"segments":[{"text":"a"}]}'), (3, "x")])
    assert {(r.video_id, r.text, r.start) for r in feeds.normalize_captions(caps).collect()} == {(1, "hi", 120.0), (1, "yo", 3.5), (2, "a", 0.0)}


def test_csv_quoting(spark, rows, tmp_path):
    cols = list(exports.EXPORT_COLUMNS)
    data = {c: "x" for c in cols} | {"description": 'a "b", c', "ticker": None, "date": "2025-01-01", "id": "1"}
    view = rows(", ".join(f"{c} string" for c in cols), [tuple(data[c] for c in cols)])
    path = exports.export_csv(view, str(tmp_path / "out"))
    lines = [line for f in (tmp_path / "out").glob("*.csv") for line in f.read_text().splitlines()]
    assert path and lines[0].startswith("id,rowNumber,transactionDate")
    assert '"a ""b"", c",,x' in lines[1]


@pytest.mark.parametrize("query,sector,sort,first", [(None, None, "ticker", 2), (" BETA ", None, "name", 1), (None, "S", "trades", 3)])
def test_company_table(rows, query, sector, sort, first):
    listing_df = rows("id int, name string, ticker string, sector string, trade_count int, correlation_count int",
                      [(1, "Beta", None, "S", 1, 0), (2, "Alpha", "A", None, 5, 3), (3, "Gamma", "G", "S", 9, 1)])
    assert listing.companies_view(listing_df, query=query, sector=sector, sort=sort).first().id == first


def _trade_rows(rows):
    days = [None, D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 2), D(2024, 1, 3)]
    data = [(n, days[n % 5], n % 3 if n % 4 else None) for n in range(1, 38)]
    return rows("id int, date date, band int", data)


@pytest.mark.parametrize("keys", [
    [("date", True), ("id", False)], [("date", False), ("id", False)], [("band", True), ("date", False), ("id", True)],
])
def test_seek_pages_walk_the_whole_listing_both_ways(rows, keys):
    df = _trade_rows(rows)
    sorting = [F.col(k).desc_nulls_first() if down else F.col(k).asc_nulls_last() for k, down in keys]
    whole = [r.id for r in df.orderBy(*sorting).collect()]
    place = lambda row: {k: row[k] for k, _ in keys}

    page, ahead = listing.seek_page(df, keys, limit=8).collect(), []
    first_rows = []
    while page:
        ahead += [r.id for r in page]
        first_rows.append((page, place(page[0])))
        page = listing.seek_page(df, keys, after=place(page[-1]), limit=8).collect()
    assert ahead == whole
    for (previous, _), (_, first) in zip(first_rows, first_rows[1:]):
        assert listing.seek_page(df, keys, before=first, limit=8).collect() == previous
    assert listing.seek_page(df, keys, before=first_rows[0][1]).collect() == []


def test_seek_page_of_a_row_that_is_gone_and_of_an_empty_table(rows):
    df, keys = _trade_rows(rows), [("date", True), ("id", False)]
    got = listing.seek_page(df.filter("id <> 7"), keys, after={"date": D(2024, 1, 2), "id": 7}, limit=1).collect()
    assert got[0].id == 8
    assert listing.seek_page(df.limit(0), keys, after={"date": None, "id": 3}).collect() == []
    with pytest.raises(ValueError):
        listing.seek_page(df, keys, after={"date": None, "id": 1}, before={"date": None, "id": 1})


def test_seek_condition_reaches_the_scan(spark, rows, tmp_path):
    path = str(tmp_path / "trades")
    _trade_rows(rows).write.parquet(path)
    page = listing.seek_page(spark.read.parquet(path), [("date", True), ("id", False)], after={"date": D(2024, 1, 2), "id": 7})
    pushed = next(line for line in page._jdf.queryExecution().toString().splitlines() if "PushedFilters" in line)
    assert "LessThan(date" in pushed and "GreaterThan(id" in pushed


def _graph(rows):
    # a hub with 20 companies, a chain, a loop, and two nodes of one id but different types
    data = [("person", "1", "company", str(n), "TRADED") for n in range(20)]
    data += [("company", "3", "action", "a", "AFFECTED_BY"), ("company", "4", "action", "a", "AFFECTED_BY")]
    data += [("company", "a", "action", "b", "AFFECTED_BY"), ("company", "5", "company", "5", "SELF")]
    edges = rows("src_type string, src_id string, dst_type string, dst_id string, relation string", data)
    return edges.withColumn("edge_id", F.concat_ws("|", "relation", "src_type", "src_id", "dst_type", "dst_id"))


@pytest.mark.parametrize("cap, root, depth", [
    (1500, ("company", "3"), 3), (1500, ("person", "1"), 1), (20, ("person", "1"), 1), (20, ("person", "1"), 2),
    (7, ("person", "1"), 2), (21, ("company", "3"), 2), (1500, ("company", "5"), 2), (1500, ("company", "none"), 2),
])
def test_walk_equals_the_neighbourhood_and_tells_of_cuts(spark, rows, tmp_path, cap, root, depth):
    edges, path = _graph(rows), str(tmp_path / "adjacency")
    graph.store_adjacency(edges, path, parts=8, files=2)
    got = graph.walk(spark.read.parquet(path), *root, depth, cap, parts=8).collect()

    links = sorted((r.edge_id, (r.src_type, r.src_id), (r.dst_type, r.dst_id)) for r in edges.collect())
    seen, found, cut = {root}, {}, False
    for level in range(1, depth + 1):
        near = [k for k, a, b in links if k not in found and (a in seen or b in seen)]
        cut = cut or len(near) > cap - len(found)
        found |= {k: level for k in near[:cap - len(found)]}
        seen |= {end for k, a, b in links if k in found for end in (a, b)}
    assert {r.edge_id: r.level for r in got} == found and len(got) == len(found)
    assert {r.cut for r in got} <= {cut}
    plain = graph.neighbourhood(edges, *root, depth, cap).select("edge_id", "level").collect()
    assert {r.edge_id: r.level for r in plain} == found


def test_walk_reads_the_parts_of_its_nodes_only(spark, rows, tmp_path):
    path = str(tmp_path / "adjacency")
    graph.store_adjacency(_graph(rows), path, parts=8, files=2)
    table = spark.read.parquet(path)
    assert table.count() == 2 * 24 - 1  # the loop lies under its node once
    per_node = table.groupBy("node_type", "node_id").agg(F.count_distinct("part").alias("n"))
    assert per_node.filter("n > 1").count() == 0
    one = table.filter(F.col("part").isin([3]))
    assert "PartitionFilters: [isnotnull(part" in one._jdf.queryExecution().toString()


def test_the_adjacency_table_holds_no_column_twice(spark, rows, tmp_path):
    path = str(tmp_path / "adjacency")
    edges = _graph(rows).withColumn("weight", F.lit(1.0))
    graph.store_adjacency(edges, path, parts=4, files=2)
    table = spark.read.parquet(path)
    assert set(table.columns) == {"part", "node_type", "node_id", "out", "far_type", "far_id", "relation", "weight"}
    back = graph.stored_adjacency(table).select(*edges.columns).distinct()
    assert sorted(map(str, back.collect())) == sorted(map(str, edges.collect()))


def test_pages_are_searched_once(rows, monkeypatch):
    """What finds the rows runs in one job, over what it stores; types and numbers read that."""
    plans, stored = [], pages._stored

    def planned(found):
        plans.append(found._jdf.queryExecution().optimizedPlan().toString())
        return stored(found)

    monkeypatch.setattr(pages, "_stored", planned)
    text = "Form Transactions\nAgo\n1 Acme Corp Sale 02/03/2025 Yes $1,001 - $15,000\n2 Beta Inc Ourchaso 13/03/2025 01/04/2025 No $15,001 - $50,000"
    page = rows("filing string, page int, text string, filing_year int", [("f", 1, text, 2025), ("f", 2, text, 2025), ("g", 1, None, 2025)])
    found = pages.extract_rows(page)
    assert len(plans) == 1
    # the numbers and types look at what was stored, and nothing looks for a row's amounts or dates again
    later = found._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in later and "BroadcastHashJoin [filing" not in later
    got = [tuple(r) for r in found.orderBy("filing", "row_number").select("filing", "page", "row_number", "type", "date", "late", "band").collect()]
    assert got == [(*n, *r) for n, r in zip(
        [("f", 1, 1), ("f", 1, 2), ("f", 2, 3), ("f", 2, 4)], [("Sale", "2025-02-03", True, 1), ("Purchase", "2025-01-04", False, 2)] * 2, strict=True)]
    reports = pages.page_reports(page, found)
    assert not re.search(r"BroadcastHashJoin \[filing#\d+, page#", reports._jdf.queryExecution().executedPlan().toString())
    assert sorted((r.filing, r.page, r.rows_found) for r in reports.collect()) == [("f", 1, 2), ("f", 2, 2), ("g", 1, 0)]
