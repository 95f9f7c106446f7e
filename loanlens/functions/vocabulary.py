"""Word lists and patterns that the results depend on."""

# fmt: off
# Section, sector and geography headings that stand before an issuer's name; '&' reads as 'and'.
HEADINGS = [
    "non-controlled/non-affiliated investments", "non-control/non-affiliate investments", "non-controlled non-affiliated investments",
    "non-controlled/non-affiliated", "non-control/non-affiliate", "controlled affiliate investments", "non-controlled affiliate investments",
    "controlled investments", "control investments", "affiliate investments", "affiliated investments", "affiliate", "affiliated",
    "non-controlled", "non-affiliated",
    "portfolio company debt securities", "portfolio company warrant investments", "portfolio company equity investments", "debt securities portfolio",
    "debt securities", "debt investments", "equity investments", "warrant investments", "us corporate debt", "u s corporate debt", "corporate debt",
    "us debt", "u s debt", "issuer name", "issuer", "investments", "investment",
    "drug discovery and development", "drug discovery", "cannabis", "transportation services", "utilities services", "business services",
    "consumer products and services", "consumer products", "consumer services", "special retail", "specialty retail",
    "senior secured first lien debt", "first and second lien debt", "first lien debt", "second lien debt", "secured debt", "subordinated debt",
    "unsecured debt", "first lien senior secured", "1st lien senior secured debt", "1st lien last out unitranche", "last out unitranche",
    "1st lien", "2nd lien", "3rd lien", "senior secured", "first lien", "second lien", "unitranche", "broadly syndicated", "one stop",
    "preferred equity", "common equity", "common stock", "preferred stock", "common shares", "preferred shares", "structured products",
    "joint ventures", "short term investments", "services", "industrial conglomerates", "retail and consumer products", "diversified",
    "united states", "united kingdom", "australia", "canada", "netherlands", "luxembourg", "germany", "france", "ireland", "switzerland",
    "new zealand", "europe", "north america", "cayman islands", "bermuda", "jersey", "spain", "italy", "sweden", "norway", "denmark",
    "energy", "materials", "industrials", "consumer discretionary", "consumer staples", "health care", "healthcare", "financials",
    "information technology", "communication services", "utilities", "real estate",
    "software", "it services", "high tech industries", "technology hardware", "semiconductors", "communications equipment", "electronic equipment",
    "internet", "health care equipment and services", "health care equipment", "health care technology", "health care providers and services",
    "health care providers", "pharmaceuticals", "biotechnology", "life sciences tools and services", "life sciences tools",
    "commercial services and supplies", "commercial and professional services", "commercial services", "professional services",
    "equity securities", "capital goods", "aerospace and defense", "machinery", "building products", "construction and engineering",
    "electrical equipment", "trading companies and distributors", "media", "entertainment", "media and entertainment",
    "interactive media and services", "hotels restaurants and leisure", "hotels, restaurants and leisure", "diversified consumer services",
    "multiline retail", "distributors", "food products", "food and staples retailing", "beverages", "household durables", "household products",
    "personal products", "leisure products", "textiles apparel and luxury goods", "textiles, apparel and luxury goods", "chemicals",
    "containers and packaging", "metals and mining", "paper and forest products", "insurance", "banks", "capital markets",
    "diversified financial services", "consumer finance", "financial services", "thrifts and mortgage finance", "road and rail",
    "transportation", "air freight and logistics", "airlines", "energy equipment and services", "oil gas and consumable fuels",
    "oil, gas and consumable fuels", "automobiles", "auto components", "automotive",
]

# From the first of these on, an issuer string holds attributes.
ATTRIBUTES = [
    "investment type", "type of investment", "interest term", "interest rate", "reference rate( and spread)?", "maturity */? *dissolution",
    "maturity", "commitment type", "commitment expiration", "investment date", "acquisition date", r"acquisition +\d", "industry", "sector",
    "asset type", "facility type", "all[- ]?in rate", "benchmark", "variable index", "variable interest rate", "original purchase",
    "purchase date", "initial purchase",
]

# After a comma these belong to the name.
LEGAL = [
    "llc", "l.l.c.", "inc", "inc.", "incorporated", "corp", "corp.", "corporation", "co", "co.", "company", "lp", "l.p.", "llp", "l.l.p.",
    "ltd", "ltd.", "limited", "plc", "n.v.", "nv", "s.a.", "sa", "gmbh", "ag", "ab", "sas", "s.a.s.", "bv", "b.v.", "holdings", "holding",
    "group", "partners", "lp.",
]

# First match wins.
SENIORITY = [
    (r"\bfirst lien\b|\b1st lien\b", "First Lien"), (r"\bsecond lien\b|\b2nd lien\b", "Second Lien"), (r"\bthird lien\b|\b3rd lien\b", "Third Lien"),
    (r"\bsenior secured\b", "Senior Secured"), (r"\bsubordinat", "Subordinated"), (r"\bjunior\b|\bmezzanine\b", "Subordinated"),
    (r"\bunsecured\b", "Unsecured"), (r"\bsenior\b", "Senior"),
]
INSTRUMENT = [
    (r"\bdelayed draw\b|\bddtl\b", "Delayed Draw Term Loan"), (r"\brevolv|\bline of credit\b", "Revolver"), (r"\bterm loan\b|\bterm debt\b", "Term Loan"),
    (r"\bnotes?\b", "Notes"), (r"\bpreferred\b", "Preferred"), (r"\bwarrant", "Warrant"), (r"\bcommon\b", "Common Equity"),
    (r"\bequity\b|\bmember(ship)? units?\b|\bllc units?\b|\bshares?\b", "Equity"), (r"\bbond", "Notes"), (r"\bloan\b", "Loan"),
]

# Dropped from a name before it is compared.
SUFFIXES = [
    "llc", "inc", "incorporated", "corp", "corporation", "co", "company", "lp", "llp", "ltd", "limited", "plc", "nv", "sa", "gmbh", "ag",
    "holdings?", "group", "partners", "the",
]

# Words that do not tell issuers apart.
GENERIC = [
    "holdings", "holding", "holdco", "topco", "midco", "bidco", "buyer", "parent", "intermediate", "acquisition", "acquisitions", "group",
    "capital", "partners", "investors", "investor", "investments", "investment", "corp", "company", "inc", "llc", "ltd", "plc", "purchaser",
    "services", "service", "solutions", "systems", "technologies", "technology", "brands", "usa", "global", "international", "the", "borrower",
    "finance", "financial", "newco", "national", "american", "ventures", "enterprises", "industries", "and",
    "non", "controlled", "noncontrolled", "affiliated", "affiliate", "nonaffiliated", "control", "lien", "1st", "2nd", "3rd", "first",
    "second", "third", "senior", "secured", "subordinated", "unsecured", "debt", "loan", "loans", "notes", "note", "revolver", "revolving",
    "term", "delayed", "draw", "ddtl", "unitranche", "equity", "common", "preferred", "warrant", "warrants", "units", "unit", "interest",
    "interests", "stock", "shares", "share", "credit", "facility", "due", "sofr", "libor", "prime", "euribor", "spread", "fund", "fixed",
    "last", "out", "line", "bank", "related", "party", "undrawn", "commitment", "pssl", "pslf", "rate",
    "issuer", "name", "maturity", "original", "purchase", "date", "variable", "index", "benchmark", "floor", "initial", "type", "cash",
    "all", "corporate", "pik", "reference", "loc", "securities", "uk", "in", "of", "to", "at", "on", "for", "by", "as", "or",
    "unaffiliated", "nonaffiliate", "software", "healthcare", "industrials", "materials", "energy", "utilities", "financials", "media",
    "entertainment", "insurance", "banks", "chemicals", "machinery", "transportation", "pharmaceuticals", "biotechnology", "automobiles",
    "automotive", "retail", "distributors", "beverages", "internet", "semiconductors", "airlines", "products", "manufacturing",
]

JUNK = ["investment", "investments", "", "nan", "none"]
# fmt: on
