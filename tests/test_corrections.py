"""Cases that the tables do not hold."""

import json

from pyspark.sql import functions as F

from sightline.operators import gates, quality, upserts
from sightline.plans import graph
from sightline.sources import feeds, pages


def test_verdicts_leave_other_reasons(rows):
    corr = rows("id long, verified boolean, reason string", [(1, True, "old reason"), (2, None, None), (3, False, "kept")])
    verdicts = rows("id long, genuine boolean, reason string", [(2, False, "new")])
    got = {r.id: (r.verified, r.reason) for r in upserts.apply_verdicts(corr, verdicts).collect()}
    assert got == {1: (True, "old reason"), 2: (False, "new"), 3: (False, "kept")}
    plain = upserts.apply_verdicts(corr.drop("reason"), verdicts)
    assert {r.id: r.reason for r in plain.collect()} == {1: None, 2: "new", 3: None}


def test_a_trade_s_own_person_comes_first(rows):
    trade = rows("id long, filing_id long, person_id long, company_id long", [(1, 10, 5, 7), (2, 10, None, 7)])
    filing = rows("id long, person_id long, filing_date string, source_url string, status string", [(10, 6, "2024-01-01", "u", "parsed")])
    assert {r.id: r.person_id for r in gates.public_trades(trade, filing).collect()} == {1: 5, 2: 6}
    assert {r.src_id for r in graph.edges_traded(trade, filing).collect()} == {"5", "6"}
    assert gates.public_trades(trade.drop("person_id"), filing).columns == ["filing_id", "id", "company_id", "filing_date", "filing_url", "person_id"]


def test_filings_without_filer_are_deduplicated(rows):
    filing = rows(
        "id long, person_id long, filing_date string, form_type string, source_domain string, status string",
        [(1, None, "2024-01-01", "annual", "primary", "parsed"), (2, None, "2024-01-01", "annual", "mirror", "parsed"), (3, 4, "2024-01-01", "annual", "mirror", "parsed")],
    )
    got = {r.id: (r.status, r.supersedes_id) for r in quality.dedupe_filings(filing, "primary").collect()}
    assert got == {1: ("parsed", None), 2: ("superseded", 1), 3: ("parsed", None)}


def test_records_in_any_print(rows):
    record = '{"source":"a","date":"2024-01-01","amount_min":%s}'
    lines = [record % "1001.0", record % '"1001"', record % '"many"', "5", '["x"]', "null", "{broken " + "x" * 200, '{"source":"a"}', ""]
    good, bad = feeds.parse_records(rows("value string", [(v,) for v in lines]))
    assert sorted((r.amount_min or 0) for r in good.collect()) == [0, 1001, 1001]
    assert [r.bad_line for r in bad.collect()] == ["{broken " + "x" * 200]


def test_values_at_any_depth(rows):
    deep = "leaf"
    for _ in range(30):
        deep = [deep, {"text": "t"}]
    value = {"other": [1.50, True, None, " x "], "more": deep}
    got = rows("v string", [(json.dumps(value),), ("plain",), (None,)]).select(feeds.flatten_values(F.col("v")).alias("c"))
    assert [r.c for r in got.collect()] == [["1.5", "true", "x", "leaf", *["t"] * 30], ["plain"], []]


def test_rows_of_a_page(rows):
    text = (
        "Instructions Amount\nReported Days Ago\n"
        "1 ACME Corp 5% due 01/01/2031 Purchase 3/4/2024 Yes $1,001 - $15,000\n"
        "2 Beta Inc Salo 03.05.24 No S15,001 – 50,000 extra\n"
        "Gamma LLC Exchange 2/30/24 no $9,999 - $12,000\n"  # no band, so its text runs on; what follows a date and a flag is cut
        "3 Delta Fund sale (partial) 2-7-2023 no Over $50,000,000\n"
        "OGE Form x 1/1/2024 $1,001 - $15,000\n"
        "Page 1 of 2"
    )
    page = rows("filing string, page int, text string, filing_year int", [("f", 2, text, 2024), ("f", 1, None, 2024), ("g", 1, "no rows here", 2024), ("f", 3, "X Holdings bougth 1/2/2024 $15,001 - $50,000 / transact", 2024)])
    got = sorted(map(tuple, pages.extract_rows(page).select("filing", "page", "row_number", "description", "type", "date", "late", "band").collect()))
    assert got == [
        ("f", 2, 1, "ACME Corp 5% due 01/01/2031", "Purchase", "2024-03-04", True, 1),
        ("f", 2, 2, "Beta Inc Salo", "Sale", "2024-03-05", False, 2),
        ("f", 2, 3, "extra Gamma LLC", "Sale (Partial)", "2023-02-07", False, 10),
        ("f", 3, 4, "X Holdings bougth", got[3][4], "2024-01-02", False, 2),
    ]
