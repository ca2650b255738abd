"""Fixed values the matching rules depend on: word lists, code ranges, patterns."""

# Words in company names without identifying weight.
GENERIC_NAME_WORDS = """
the and inc corp corporation company group holdings international global technologies technology
systems services industries enterprises solutions resources properties brands communications media
health healthcare bank bancorp trust fund financial finance capital partners american america
national united general first energy power electric water gas oil natural products materials
industrial consumer digital data cloud software network networks world states new south north east
west central great home city county real estate insurance life auto motors air lines airlines stores
retail food foods beverage metals mining gold silver steel pharmaceuticals pharma bio science
sciences medical devices entertainment studios hotels resorts
""".split()

# Short tickers that are ordinary words or abbreviations.
TICKER_STOPWORDS = """
A I IT ON OR SO BE GO AT ALL ANY ARE CEO DD ET FOR GOOD HAS KEY LOW NOW ONE OUT PLAN SEE TRUE TWO USA
WELL BIG CAR GAS NEW OLD RUN WIN WE AN AM PM US UK EU DOW FOX ICE JOB LOVE PAY TV
""".split()

# Single words that identify no company when they stand alone.
WEAK_SOLO_TOKENS = """
state states street world people value trust point river creek ridge field stone white black green
north south prime union grand royal crown eagle liberty summit vista metro civic public patriot
southern northern eastern western central american america national general pacific atlantic commerce
citizens citizen capital frontier heritage mountain valley harbor global united first premier
paramount sterling freedom victory alliance horizon legacy future vision pioneer century standard
republic independence select premium advance advanced enterprise service country border energy power
digital research technologies technology industries industrial defense engineering motors financial
partners ventures brands foods restaurant restaurants software semiconductor pharmaceutical
pharmaceuticals biosciences therapeutics networks communications entertainment resources minerals
petroleum airlines airways hotels properties realty insurance securities payments solutions services
products systems devices instruments laboratories materials chemicals automotive transport
transportation logistics development management consulting diagnostics biotech exploration operating
international associates holding carrier monster lincoln jackson tyler baxter brinker maine target
strategy gateway paper express comfort banner pathward douglas emmett warner cooper parker
""".split()

# Abbreviations in security descriptions and what they stand for.
NAME_ABBREVIATIONS = {
    "AWYS": "AIRWAYS", "MTRS": "MOTORS", "MTR": "MOTOR", "SYS": "SYSTEMS",
    "CMNCTNS": "COMMUNICATIONS", "CMNCTN": "COMMUNICATIONS", "INTL": "INTERNATIONAL",
    "NATL": "NATIONAL", "MFG": "MANUFACTURING", "LABS": "LABORATORIES", "FINL": "FINANCIAL",
    "SVCS": "SERVICES", "SVC": "SERVICES", "ENTMT": "ENTERTAINMENT", "RESTRNT": "RESTAURANT",
    "PROPS": "PROPERTIES", "PHARMA": "PHARMACEUTICALS",
}

# Legal, share-class and instrument words dropped from names.
NAME_NOISE = (
    "THE|COM|COMMON|STOCK|STK|SHS?|SHARES?|CLASS|CL|EQUITY|PREFERRED|PFD|ADR|ADS|DEPOSITARY|"
    "RECEIPTS?|RIGHTS?|WARRANTS?|UNITS?|SPONSORED|ORD|ORDINARY|VOTING|SER(?:IES)?|NEW|INC|CORP|"
    "CORPORATION|CO|COMPANY|LTD|LIMITED|PLC|HOLDINGS?|HLDGS?|GROUP|GRP|TRUST|PARTNERS|LP|NV|SA|AG|[A-C]"
)
# The shorter list used when descriptions of two sources are compared.
DESCRIPTION_NOISE = (
    "THE|INC|CORP|CORPORATION|CO|COMPANY|LTD|PLC|COM|COMMON|STOCK|SHS?|CLASS|CL|EQUITY"
)
# Structural words that do not distinguish a recipient.
STRUCTURAL_WORDS = ["CORP", "CORPORATION", "COMPANY", "HOLDINGS", "GROUP", "TRUST", "LIMITED"]
# Vocabulary of instruments that are not shares.
NON_EQUITY = r"(?i)\b(DUE|REV|B/E|OID|CTF|RFDG|RFUNDING|MUN|MTN|NOTE|BOND|GO\b|G/O|SER\b|@\d)"

# Industry code ranges and their sector; the last one has no upper end.
CODE_SECTORS = [
    (100, 999, "Agriculture & Natural Resources"),
    (1000, 1499, "Mining & Extraction"),
    (1500, 1799, "Construction"),
    (2000, 3999, "Manufacturing"),
    (4000, 4999, "Transportation & Utilities"),
    (5000, 5199, "Wholesale Trade"),
    (5200, 5999, "Retail Trade"),
    (6000, 6799, "Finance, Insurance & Real Estate"),
    (7000, 8999, "Services"),
    (9100, None, "Public Administration"),
]

# Topics, label, text pattern, industry pattern.
TOPICS = [
    ("semiconductors", "Semiconductors",
     r"\bsemiconductors?\b|\bmicrochips?\b|\bchip\s+(?:makers?|industry|companies|manufactur\w+|plants?|factor\w+)\b|\bAI\s+chips?\b",
     r"semiconductor"),
    ("airlines", "Airlines",
     r"\bairlines?\b|\bair\s+carriers?\b|\bair\s+travel\b|\baviation\s+industry\b",
     r"air\s*transport|air\s*courier"),
    ("pharmaceuticals", "Pharmaceuticals",
     r"\bpharmaceuticals?\b|\bbig\s+pharma\b|\bdrug\s+(?:prices?|pricing|makers?|companies|manufactur\w+)\b|\bprescription\s+drugs?\b",
     r"pharmaceutical|medicinal|biological\s+products"),
    ("defense", "Defense industry",
     r"\bdefense\s+(?:contractors?|industry|companies|spending)\b|\bmissile\s+defense\b|\bmilitary\s+(?:equipment|hardware|procurement)\b",
     r"ordnance|guided\s+missiles|defense|aircraft|aerospace"),
    ("banks", "Banking",
     r"\bbig\s+banks?\b|\bbanking\s+(?:industry|system|regulations?)\b|\bwall\s+street\s+banks?\b",
     r"\bbanks?\b|national\s+commercial|savings\s+institution"),
    ("oil_gas", "Oil & gas",
     r"\boil\s+and\s+gas\b|\boil\s+(?:companies|producers?|industry|drilling)\b|\bfracking\b|\bnatural\s+gas\s+(?:producers?|exports?)\b|\bdrill,?\s*baby,?\s*drill\b",
     r"petroleum|crude|natural\s+gas|oil\s+(?:and|&)\s+gas|drilling"),
    ("automakers", "Automakers",
     r"\bautomakers?\b|\bauto\s+(?:industry|companies|workers|plants?|tariffs?)\b|\bcar\s+(?:makers?|companies|manufactur\w+)\b",
     r"motor\s+vehicle"),
    ("steel_aluminum", "Steel & aluminum",
     r"\bsteel\s+(?:industry|workers?|imports?|tariffs?|mills?|companies)\b|\baluminum\s+(?:imports?|tariffs?|industry)\b",
     r"steel\s+works|blast\s+furnace|aluminum"),
    ("electric_utilities", "Electric utilities",
     r"\belectric\s+(?:utilities|grid|bills?)\b|\bpower\s+grid\b|\bratepayers?\b|\belectricity\s+prices?\b",
     r"electric\s+services"),
]

# Title shapes of one-speaker and many-speaker documents.
SINGLE_SPEAKER = r"(?i)^(remarks|address|statement|message|commencement|inaugural|letter)"
MULTI_SPEAKER = (
    r"(?i)(news conference|press conference|interview|exchange with reporters|"
    r"question-and-answer|town hall|debate|gaggle)"
)
# Document classes another feed delivers with better metadata.
OTHER_FEED_TITLES = r"(?i)^(executive order|proclamation|memorandum|notice)"
# Titles of commentary, and words that announce a speech.
COMMENTARY = r"(?i)(analysis|reaction|panel|recap|opinion|highlights\s+and\s+analysis)"
SPEECH_TERMS = (
    r"(?i)(remarks|speech|address|press|presser|briefing|interview|full|delivers|speaks|"
    r"news conference|signs|signing)"
)
# Query parameters that carry credentials.
SECRET_PARAMETERS = r"(?i)([?&](?:api_?key|apikey|token|key|access_token)=)[^&\s\"']+"
# Length gates and cuts of ingested texts.
MIN_BODY, MIN_REMARKS, MIN_SUMMARY = 120, 200, 80
MAX_TEXT, MAX_VENUE, MAX_SUMMARY = 60_000, 200, 8_000
# Month names as printed.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
