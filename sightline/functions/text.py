"""HTML to text, word sets, similarity and small text rules.

Patterns are free of look-around except for ASCII word boundaries, which are spelled out
because Java and other engines disagree on what `\\b` means next to accented letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .numeric import let

BLANK = r"[\s\x{00A0}]+"
# Named and numeric entities with an own replacement.
QUOTE_ENTITIES = [
    ("&amp;", "&"), ("&#8217;|&rsquo;", "'"), ("&#8220;|&#8221;|&ldquo;|&rdquo;", '"'), ("&nbsp;", " "),
]
POST_ENTITIES = [
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
]


def ascii_bounded(pattern: str) -> str:
    """The pattern between ASCII word boundaries, with the same meaning in every engine."""
    return pattern.replace(r"\b", r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")


def squeezed(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, BLANK, " "))


def decode_numeric_entities(text: Column) -> Column:
    """Replace every &#NNN; by its character; the distinct codes of a text are folded in."""

    def put(done: Column, code: Column) -> Column:
        # UTF-32 bytes of the code point, so characters beyond the basic plane work too
        number = code.try_cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        known = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        return F.replace(done, F.concat(F.lit("&#"), code, F.lit(";")), F.when(known, char).otherwise(F.lit("")))

    def decode(raw: Column) -> Column:
        codes = F.array_distinct(F.regexp_extract_all(raw, F.lit(r"&#(\d+);"), F.lit(1)))
        return F.aggregate(codes, raw, put)

    return let(text, decode)


def html_to_text(html: Column, *, drop_head: bool = False) -> Column:
    """Page to one line of text: scripts, styles and tags become blanks, entities decoded."""
    out = F.regexp_replace(html, r"(?is)<head.*?</head>", " ") if drop_head else html
    out = F.regexp_replace(out, r"(?is)<script.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style.*?</style>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for pattern, plain in QUOTE_ENTITIES:
        out = F.regexp_replace(out, pattern, plain)
    out = decode_numeric_entities(out)
    out = F.regexp_replace(out, r"(?i)&[a-z]+;", " ")
    return squeezed(out)


def post_to_text(html: Column) -> Column:
    """Short post to text: line breaks are kept, other tags vanish."""
    out = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</p>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for pattern, plain in POST_ENTITIES:
        out = F.regexp_replace(out, pattern, plain)
    return trimmed(F.regexp_replace(out, "[ \t]+", " "))


def opening_words(text: Column, take: int) -> Column:
    """The first `take` lower-case words of at least three letters or digits."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), r"\s+")
    return F.slice(F.filter(words, lambda w: F.length(w) >= 3), 1, take)


def adjacent_pairs(words: Column) -> Column:
    """Neighbouring words joined by a blank; `words` must be cheap, a column or a let."""
    count = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(
        F.slice(words, F.lit(1), count), F.slice(words, F.lit(2), count), lambda a, b: F.concat_ws(" ", a, b)
    )


def bigrams(words: Column) -> Column:
    """Distinct adjacent word pairs; none for texts under four words."""
    none = F.array().cast("array<string>")
    return let(words, lambda w: F.when(F.size(w) >= 4, F.array_distinct(adjacent_pairs(w))).otherwise(none))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets; 0 when either is empty."""

    def of(x: Column, y: Column) -> Column:
        common = F.size(F.array_intersect(x, y))
        share = (F.lit(2.0) * common) / (F.size(x) + F.size(y))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(share)

    return let(a, lambda x: let(b, lambda y: of(x, y)))


def text_similarity(a: Column, b: Column, take: int = 120) -> Column:
    return dice(bigrams(opening_words(a, take)), bigrams(opening_words(b, take)))


def redact_secrets(text: Column) -> Column:
    return F.regexp_replace(text, fixed.SECRET_PARAMETERS, "$1***")


def content_key(prefix: str, ref: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{prefix}:"), ref.cast("string")), 256)


def single_speaker(title: Column) -> Column:
    return F.trim(title).rlike(fixed.SINGLE_SPEAKER) & ~title.rlike(fixed.MULTI_SPEAKER)


def channel_of_title(title: Column) -> Column:
    low = F.lower(title)
    return (
        F.when(low.startswith("remarks"), "remarks")
        .when(low.startswith("address"), "address")
        .when(low.startswith("statement"), "statement")
        .when(low.startswith("message") | low.startswith("letter"), "message")
        .otherwise("document")
    )


def action_type_of_title(title: Column) -> Column:
    low = F.lower(title)
    return (
        F.when(low.startswith("executive order"), "executive_order")
        .when(low.startswith("proclamation"), "proclamation")
        .when(low.startswith("memorandum"), "memorandum")
        .when(low.contains("notice"), "notice")
        .when(low.contains("determination"), "determination")
        .otherwise("presidential_document")
    )


def communication_class(url: Column, prefix: str) -> Column:
    """Class of an official communication by its address; `prefix` names the publisher."""
    low = F.lower(url)
    return F.concat(
        F.lit(f"{prefix}_"),
        F.when(low.contains("fact-sheet"), "fact_sheet")
        .when(low.contains("remarks"), "remarks")
        .when(low.contains("briefing"), "briefing")
        .otherwise("statement"),
    )


def selection_rule(title: Column, tier: Column, seconds: Column, subject: str) -> Column:
    """Why a recording is a candidate, NULL when it is not. `subject` is a word pattern."""
    about = title.rlike(f"(?i){ascii_bounded(rf'\b({subject}|president)\b')}")
    named = title.rlike(f"(?i){ascii_bounded(rf'\b{subject}\b')}")
    return (
        F.when(title.rlike(fixed.COMMENTARY), F.lit(None))
        .when(tier == "A", "tier-A channel")
        .when(about & title.rlike(fixed.SPEECH_TERMS), "title: subject + speech term")
        .when((seconds >= 180) & named, "duration ≥ 3min + subject in title")
    )


def other_feed_title(title: Column) -> Column:
    """Titles of document classes that another feed delivers with better metadata."""
    return F.coalesce(title, F.lit("")).rlike(fixed.OTHER_FEED_TITLES)
