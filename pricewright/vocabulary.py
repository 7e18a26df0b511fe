"""Word lists and constants that results depend on."""

# Brands and the names by which listings call them.
BRANDS = {
    "nike": ("nike", "nike sportswear", "nikelab", "jordan", "air jordan", "nike acg"),
    "adidas": ("adidas", "adidas originals", "adidas performance", "adidas terrex", "y-3"),
    "new balance": ("new balance", "newbalance", "nb", "new balance numeric"),
}
# Lines of a brand that are no part of a model, and names of a brand that are.
SUBLABELS = ("originals", "performance", "sportswear", "nikelab", "terrex", "numeric")
KEPT_ALIASES = ("jordan", "air jordan", "y-3", "yeezy")
BRAND_NAMES = {"nike": "Nike", "adidas": "adidas", "new balance": "New Balance"}

# Formats of manufacturers' style codes, by brand and for any.
CODE_FORMATS = {
    "nike": (r"\b([A-Z]{2}\d{4}-\d{3})\b", r"\b(\d{6}-\d{3})\b"),
    "adidas": (r"\b([A-Z]{2}\d{4})\b", r"\b([A-Z]\d{5})\b"),
    "new balance": (r"\b([A-Z]{1,3}\d{3,4}[A-Z]{1,4}\d{0,2})\b",),
}
ANY_CODE = r"\b([A-Z]{2}\d{4}-\d{3}|\d{6}-\d{3}|[A-Z]{2}\d{4}|[A-Z]\d{5}|[A-Z]{1,3}\d{3,4}[A-Z]{1,4}\d{0,2})\b"

# Patterns of audiences, in the order of precedence.
GENDERS = (
    (r"\b(women'?s|womens|female|wmns)\b", "women"),
    (r"\b(men'?s|mens|male)\b", "men"),
    (r"\b(kids?|junior|grade school|toddler|gs|ps|td)\b", "kids"),
    (r"\bunisex\b", "unisex"),
)

# Phrases and words of titles that name no model.
NOISE_PHRASES = ("made in usa", "made in the usa", "made in uk", "made in england", "grade school", "big kids", "little kids", "free shipping", "online only", "limited edition", "official site")
NOISE_WORDS = ("shoes", "shoe", "sneakers", "sneaker", "trainers", "trainer", "footwear", "running", "casual", "lifestyle", "mens", "men", "womens", "women", "unisex", "adults", "adult", "grade school", "big kids", "little kids", "kids", "junior", "juniors", "gs", "sale", "new", "exclusive", "online", "buy", "official", "store", "free shipping")

# Words of colours.
COLOURS = ("white", "black", "grey", "gray", "red", "blue", "green", "yellow", "pink", "purple", "orange", "brown", "beige", "cream", "navy", "olive", "sail", "gum", "silver", "gold", "bone", "sand", "teal", "burgundy", "maroon", "ivory", "charcoal", "khaki", "platinum", "crimson", "infrared", "volt", "triple", "core", "cloud", "chalk", "wolf", "sea", "salt", "onyx", "mint")

# Nicknames, misspellings and colour slang, with what listings print.
NICKNAMES = {
    "af1": "air force 1", "af1s": "air force 1", "am90": "air max 90", "am95": "air max 95", "am97": "air max 97", "am1": "air max 1",
    "aj1": "air jordan 1 retro high og", "aj1s": "air jordan 1 retro high og", "jordan1": "air jordan 1", "lnf": "lost and found",
    "panda": "dunk low white black", "pandas": "dunk low white black", "dunks": "dunk", "sb": "dunk", "pegasus": "pegasus",
    "vapormax": "air vapormax", "tns": "air max plus", "tn": "air max plus", "ub": "ultraboost", "ubs": "ultraboost", "sambas": "samba",
    "gazelles": "gazelle", "campus 00": "campus 00s", "spezials": "spezial", "yeezys": "yeezy", "supers tar": "superstar",
    "nb": "new balance", "990s": "990", "550s": "550", "574s": "574", "1906": "1906r", "992s": "992", "dad": "990 1906r 2002r",
    "dad shoe": "990 1906r 2002r", "dad shoes": "990 1906r 2002r", "og": "og", "gs": "grade school", "ds": "deadstock",
}
MISSPELLINGS = {
    "adiddas": "adidas", "addidas": "adidas", "adidias": "adidas", "balence": "balance", "ballance": "balance", "newbalance": "new balance",
    "nikes": "nike", "jordons": "jordan", "ultrabost": "ultraboost", "ultraboots": "ultraboost", "peagasus": "pegasus", "colourway": "colorway",
}
COLOUR_SLANG = {
    "panda": "white black", "oreo": "white black", "triple white": "white", "triple black": "black", "bred": "black red",
    "unc": "university blue white", "chicago": "red white black", "sail": "sail cream", "gum": "gum brown",
}

# Words of questions that name no product.
QUERY_STOPWORDS = ("a", "an", "the", "and", "or", "of", "for", "in", "on", "at", "to", "with", "me", "my", "i", "is", "are", "im", "id", "please", "can", "you", "shoes", "shoe", "sneakers", "sneaker", "trainers", "trainer", "kicks", "creps", "footwear", "pair", "pairs", "cheapest", "cheap", "cheaper", "best", "lowest", "price", "prices", "cost", "costs", "deal", "deals", "buy", "get", "find", "show", "give", "size", "sizes", "us", "uk", "available", "stock", "site", "sites", "website", "websites", "seller", "sellers", "where", "which", "what", "who", "how", "much", "right", "now", "currently", "under", "below")
TERM_STOPWORDS = ("what", "whats", "which", "where", "who", "the", "a", "an", "is", "are", "can", "i", "me", "my", "buy", "get", "find", "cheapest", "cheap", "best", "price", "prices", "deal", "deals", "lowest", "site", "sites", "website", "websites", "for", "of", "on", "in", "at", "to", "and", "or", "with", "show", "give", "compare", "comparison", "shoe", "shoes", "sneaker", "sneakers", "pair", "please", "cost", "costs", "much", "how", "right", "now", "currently", "available", "stock", "size", "sizes", "any", "all", "list", "listing", "listings", "that", "has", "have", "including", "include", "shipping", "delivery", "delivered", "free", "under", "below", "less", "than", "cheaper", "up", "no", "more", "budget", "within", "us")

# Words that describe without identifying.
GENERIC = (*COLOURS, "og", "low", "mid", "high", "retro", "classic", "vintage", "premium", "new", "edition", "grade", "school", "big", "little", "men", "mens", "women", "womens", "unisex", "kids", "deadstock", "used", "nike", "adidas", "jordan", "balance", "nb", "air")

# Weights and thresholds of retrieval and matching.
ALIAS_WEIGHT, PLURAL_WEIGHT, FUZZY_WEIGHT, VARIANT_WEIGHT = 0.9, 0.85, 0.6, 0.5
BM25_K1, BM25_B, RRF_K, ALPHA = 1.5, 0.75, 60, 0.6
FUZZY_THRESHOLD, CODE_BOOST = 0.45, 1.0
MIN_COVERAGE, HIGH_COVERAGE, MIN_VECTOR = 0.4, 0.8, 0.55
RERANK_DEPTH, COMMON_DF, RARE_DF, PRUNE_FROM = 400, 0.5, 0.1, 100
FIELD_WEIGHTS = {"style_code": 4.0, "model": 3.0, "brand": 2.0, "colorway": 2.0, "gender": 1.0, "source_name": 1.0, "title": 1.0}
MODEL_THRESHOLD, COLOUR_THRESHOLD, UNKNOWN_COLOUR, MODEL_SHARE, MERGE_CONFIDENCE, BLOCK_CAP = 0.82, 0.45, 0.6, 0.65, 0.78, 400

# Words that stay in capitals, and signs of currencies.
ACRONYMS = ("og", "sb", "gs", "td", "ps", "nb", "usa", "uk", "us", "xt", "qs", "se")
CURRENCY_SIGNS = {"USD": "$", "GBP": "£", "EUR": "€", "CAD": "CA$"}

# Sellers as (key, name, home, search address, pattern of product links, brands carried or none for all, kind).
SITES = (
    ("nike", "Nike", "https://www.nike.com/", "https://www.nike.com/w?q={q}", r"/t/[a-z0-9-]+", ("nike",), "brand"),
    ("adidas", "adidas", "https://www.adidas.com/", "https://www.adidas.com/us/search?q={q}", r"/us/[a-z0-9-]+/[A-Z]{2}\d{4}\.html", ("adidas",), "brand"),
    ("newbalance", "New Balance", "https://www.newbalance.com/", "https://www.newbalance.com/search?q={q}", r"/pd/[a-z0-9-]+/[A-Z0-9]+\.html", ("new balance",), "brand"),
    ("stadiumgoods", "Stadium Goods", "https://www.stadiumgoods.com/", "https://www.stadiumgoods.com/en-us/search?q={q}", r"/en-us/shopping/[a-z0-9-]+", (), "resale"),
    ("flightclub", "Flight Club", "https://www.flightclub.com/", "https://www.flightclub.com/catalogsearch/result?query={q}", r"/[a-z0-9]+(?:-[a-z0-9]+){2,}$", (), "resale"),
    ("goat", "GOAT", "https://www.goat.com/", "https://www.goat.com/search?query={q}", r"/sneakers/[a-z0-9-]+", (), "resale"),
    ("kickscrew", "KicksCrew", "https://www.kickscrew.com/", "https://www.kickscrew.com/en-US/search?q={q}", r"/products/[a-z0-9-]+", (), "resale"),
)

# Markers of availability and of used goods in product pages.
IN_STOCK_MARKS = ("instock", "in_stock", "limitedavailability", "onlineonly", "preorder")
USED_MARKS = ("used", "pre-owned", "preowned", "refurbished", "worn")
