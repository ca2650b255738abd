"""Column functions on hand-made rows."""

from pyspark.sql import functions as F

from sightline.functions import bands, dates, documents, names, numeric, text
from sightline.sources.pages import keyword_type, with_type


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_half_up(spark):
    assert [one(spark, numeric.half_up(F.lit(v))) for v in (0.5, -0.5, 1.4, -1.5)] == [1.0, 0.0, 1.0, -1.0]


def test_bands(spark):
    band = lambda n: F.lit(n)
    assert one(spark, bands.band_min(band(1))) == 1001 and one(spark, bands.band_max(band(10))) is None
    assert one(spark, bands.band_min(band(11))) is None and one(spark, bands.band_min(band(0))) is None
    assert one(spark, bands.band_midpoint(band(10))) == 50000001
    assert one(spark, bands.band_midpoint(band(1))) == 8001
    assert one(spark, bands.band_label(band(10))) == "Over $50,000,000"
    assert one(spark, bands.band_short_label(band(7))) == "$1M – $5M"
    assert one(spark, bands.band_short_label(band(1))) == "$1K – $15K"
    assert one(spark, bands.band_of_amount(F.lit(1000))) is None
    assert one(spark, bands.band_of_amount(F.lit(15000.5))) == 1


def test_band_of_text_reads_every_band(spark):
    for n in range(1, 10):
        label = spark.range(1).select(bands.band_label(F.lit(n)).alias("x")).first().x
        assert one(spark, bands.band_of_text(F.lit(f"row {label} No"))) == n, label
    assert one(spark, bands.band_of_text(F.lit("Over $50,000,000"))) == 10
    assert one(spark, bands.band_of_text(F.lit("nothing"))) is None
    assert one(spark, bands.band_of_text(F.lit("S1.001 ~ S15.000"))) == 1


def test_match_keys(spark):
    key = lambda n: one(spark, names.match_key(F.lit(n)))
    assert key("Datadog, Inc.") == "datadog"
    assert key("State Street Corp") == "state street"
    assert key("Southern Company") is None
    assert key("The Bank of America Corporation") is None


def test_normalize(spark):
    norm = lambda n: one(spark, names.normalize_name(F.lit(n)))
    assert norm("JETBLUE AWYS CORP, Equity Class A") == norm("JetBlue Airways Corporation") == "JETBLUE AIRWAYS"
    assert one(spark, names.is_non_equity(F.lit("City REV bond 4% DUE 12/01/39")))
    assert not one(spark, names.is_non_equity(F.lit("Acme Widgets Inc")))
    assert one(spark, names.code_to_sector(F.lit(3674))) == "Manufacturing"
    assert one(spark, names.code_to_sector(F.lit(9000))) == "Other"


def test_topics(spark):
    topics = one(spark, names.company_topics(F.lit("Semiconductors & Related Devices"), F.lit(None)))
    assert topics == ["semiconductors"]
    assert one(spark, names.company_topics(F.lit("Riverbanks"), F.lit(""))) == []
    assert one(spark, names.topic_label(F.lit("oil_gas"))) == "Oil & gas"
    assert one(spark, names.topic_label(F.lit("new_one"))) == "new one"


def test_html(spark):
    page = "<head>x</head><script>a<b</script><p>Caf&#233; &#8217;q&rsquo; &#128512;&bogus; A&amp;B</p>  end"
    assert one(spark, text.html_to_text(F.lit(page), drop_head=True)) == "Café 'q' 😀 A&B end"
    assert one(spark, text.post_to_text(F.lit("<p>a<br/>b &lt;3</p><i>c</i>"))) == "a\nb <3\nc"


def test_similarity(spark):
    a = "one two three four five six seven"
    sim = lambda x, y: one(spark, text.text_similarity(F.lit(x), F.lit(y)))
    assert sim(a, a) == 1.0 and sim(a, "one two three") == 0.0
    assert abs(sim(a, "one two three four five six eight") - 2 * 5 / 12) < 1e-9


def test_speaker_and_media(spark):
    single = lambda t: one(spark, text.single_speaker(F.lit(t)))
    assert single("Remarks at dinner") and not single("Remarks in a Town Hall") and not single("The Remarks")
    rule = lambda t, tier, s: one(spark, text.selection_rule(F.lit(t), F.lit(tier), F.lit(s), "doe"))
    assert rule("Doe speech reaction", "A", 10) is None
    assert rule("Anything", "A", None) == "tier-A channel"
    assert rule("President speaks", "B", 5).startswith("title")
    assert rule("Doe waves", "B", 200).startswith("duration") and rule("Doe waves", "B", 100) is None


def test_dates(spark):
    assert str(one(spark, dates.long_date(F.lit("on march 5, 2025.")))) == "2025-03-05"
    assert one(spark, dates.long_date(F.lit("February 31, 2025"))) is None
    assert str(one(spark, dates.dotted_date(F.lit("r-2.26.26-1.pdf")))) == "2026-02-26"
    assert one(spark, dates.dotted_date(F.lit("v1.2"))) is None
    assert str(one(spark, dates.iso_or_us_date(F.lit("5/1/2025")))) == "2025-05-01"
    assert one(spark, dates.iso_duration_seconds(F.lit("PT0S"))) is None
    assert one(spark, dates.iso_duration_seconds(F.lit("PT1H2M3S"))) == 3723
    assert one(spark, dates.url_host(F.lit("::bad::"))) == "unknown"
    assert one(spark, dates.url_file_name(F.lit("https://h/a/b%20c.pdf?x=1"))) == "b c.pdf"


def test_types(spark):
    texts = ["x ourchaso", "Sale (Partial)", "x Excnange", "qq", "ACME salo", "12 $", "zzz qqq", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = with_type(rows, keyword_type(F.col("t")), F.col("t")).orderBy("n").collect()
    assert [r.type for r in got] == ["Purchase", "Sale (Partial)", "Exchange", "Unknown", "Sale", "Unknown", "Unknown", "Unknown"]


def test_secrets_and_titles(spark):
    assert one(spark, text.redact_secrets(F.lit("u?a=1&api_key=xyz z"))) == "u?a=1&api_key=*** z"
    assert one(spark, documents.page_title(F.lit("<title>Day | Site</title>"))) == "Day"
    assert one(spark, documents.page_title(F.lit("<h1 class=a>Main</h1><title>x</title>"))) == "Main"
    assert one(spark, text.action_type_of_title(F.lit("A Notice on Wine"))) == "notice"
