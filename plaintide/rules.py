"""Label sets, keyword tables, thresholds and report texts.

Everything here is data.  The order of labels, rules and keywords is meaningful:
ties are always broken in favour of the entry that comes first.
"""

# ---------------------------------------------------------------------------
# Missing-value words of a CSV cell.
# ---------------------------------------------------------------------------
NA_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# ---------------------------------------------------------------------------
# Column names of the raw table.
# ---------------------------------------------------------------------------
RAW_COLUMNS = {
    "Product Name": "product_name",
    "Brand Name": "brand",
    "Price": "price",
    "Rating": "rating",
    "Reviews": "review_text",
    "Review Votes": "review_votes",
}

# ---------------------------------------------------------------------------
# Label sets; the position of a label is its id.
# ---------------------------------------------------------------------------
SENTIMENTS = ["negative", "neutral", "positive"]

ISSUES = [
    "battery", "screen", "performance", "network", "camera", "shipping",
    "service", "price", "condition", "software", "other",
]

PRIORITY_TRUE_LABELS = ["condition", "performance", "shipping", "service"]

# ---------------------------------------------------------------------------
# Keyword-score table, label -> keywords.
# ---------------------------------------------------------------------------
ISSUE_KEYWORDS = {
    "battery": [
        "battery", "charge", "charging", "charger", "power", "drain", "dies",
        "dead", "hot", "overheat", "overheating",
    ],
    "screen": [
        "screen", "display", "touch", "touchscreen", "crack", "cracked",
        "pixel", "brightness",
    ],
    "performance": [
        "slow", "lag", "laggy", "freeze", "freezes", "frozen", "crash",
        "crashes", "stuck", "hang", "unresponsive", "performance",
    ],
    "network": [
        "signal", "wifi", "wi-fi", "bluetooth", "network", "sim", "call",
        "calls", "data", "lte", "4g", "3g",
    ],
    "camera": [
        "camera", "photo", "photos", "picture", "pictures", "video", "focus",
        "blurry", "blur",
    ],
    "shipping": [
        "shipping", "delivery", "delivered", "arrived", "package",
        "packaging", "box", "late", "missing",
    ],
    "service": [
        "service", "support", "seller", "warranty", "refund", "return",
        "replacement", "repair", "customer",
    ],
    "price": [
        "price", "value", "money", "cheap", "expensive", "deal", "worth",
        "cost",
    ],
    "condition": [
        "used", "refurbished", "scratch", "scratches", "dented", "dent",
        "condition", "new", "old",
    ],
    "software": [
        "software", "update", "android", "system", "os", "app", "apps", "ui",
        "bug",
    ],
}

# ---------------------------------------------------------------------------
# Keyword table of the second opinion.  Same words, but
# performance is asked first and its own name is not one of its keywords.
# ---------------------------------------------------------------------------
GUESS_ORDER = [
    "performance", "battery", "screen", "network", "camera", "shipping",
    "service", "price", "condition", "software",
]
GUESS_KEYWORDS = {
    label: [word for word in ISSUE_KEYWORDS[label] if word != "performance"]
    for label in GUESS_ORDER
}

# ---------------------------------------------------------------------------
# First-match table, label -> keywords.
# ---------------------------------------------------------------------------
FIRST_MATCH_KEYWORDS = {
    "battery": [
        "battery", "charge", "charging", "charged", "charger", "power",
        "drain", "drained", "dies", "dead", "last long",
    ],
    "screen": [
        "screen", "display", "touch", "touchscreen", "black screen", "crack",
        "cracked", "scratch", "scratched", "glass",
    ],
    "performance": [
        "slow", "lag", "laggy", "freeze", "freezes", "frozen", "crash",
        "crashes", "restart", "reboot", "overheat", "hot",
    ],
    "shipping": [
        "shipping", "delivery", "delivered", "arrived", "package",
        "packaging", "box", "late", "delay", "shipment",
    ],
    "condition": [
        "used", "refurbished", "condition", "damaged", "defective", "broken",
        "dirty", "worn", "dent", "dented",
    ],
    "camera": ["camera", "photo", "picture", "video", "lens", "flash"],
    "service": [
        "seller", "refund", "return", "replacement", "warranty",
        "customer service", "support", "contacted",
    ],
    "network": [
        "sim", "carrier", "network", "signal", "wifi", "bluetooth",
        "activation", "activate", "unlocked", "locked", "sprint", "verizon",
        "at&t", "tmobile", "t-mobile",
    ],
    "price": [
        "price", "cost", "expensive", "cheap", "money", "worth", "value",
        "paid", "pay",
    ],
}

# ---------------------------------------------------------------------------
# Annotation sample and review flags.
# ---------------------------------------------------------------------------
NEGATIVE_SHARE = 0.55
NEUTRAL_SHARE = 0.25
REASON_OTHER = "规则标签为 other，建议人工确认"
REASON_CONFLICT = "关键词辅助判断与规则标签不一致"
REASON_NEGATIVE = "负面评论但标签为 price/other，建议人工确认"
REASON_POSITIVE = "正面评论但标签为投诉类 issue，建议人工确认"
NEGATIVE_DOUBTFUL = ["price", "other"]
POSITIVE_DOUBTFUL = ["battery", "screen", "performance", "network", "service"]

# ---------------------------------------------------------------------------
# Theme rules, (theme, keywords, issues).
# ---------------------------------------------------------------------------
DEFAULT_THEME = "General negative feedback / mixed complaints"
ISSUE_BONUS = 3
THEME_RULES = [
    ("Battery and charging complaints",
     ["battery", "charge", "charging", "charger", "drain", "power", "turn",
      "dead", "dies", "hot", "overheat", "usb", "connector"],
     ["battery"]),
    ("Carrier, SIM, and network compatibility",
     ["unlocked", "locked", "verizon", "sprint", "att", "at&t", "tmobile",
      "t-mobile", "sim", "card", "lte", "4g", "3g", "network", "carrier",
      "wifi", "wi-fi", "data", "activate", "activation", "international",
      "venezuela", "brazil", "mobile"],
     ["network"]),
    ("Screen and display defects",
     ["screen", "display", "black", "touch", "touchscreen", "cracked",
      "crack", "glass", "lcd", "stripe", "pixel", "brightness",
      "responsive"],
     ["screen"]),
    ("Performance, lag, and app stability",
     ["slow", "lag", "laggy", "freeze", "freezes", "frozen", "crash",
      "crashes", "apps", "app", "stuck", "hang", "response", "responsive",
      "restart", "restarts"],
     ["performance"]),
    ("Refurbished, used, or damaged condition",
     ["refurbished", "used", "scratch", "scratches", "worn", "dent",
      "dented", "broken", "damage", "damaged", "new", "condition",
      "original", "back", "case", "dirty", "old"],
     ["condition"]),
    ("Camera and photo quality issues",
     ["camera", "photo", "photos", "picture", "pictures", "video", "focus",
      "blurry", "blur", "flash", "front", "quality"],
     ["camera"]),
    ("Shipping, delivery, and packaging issues",
     ["shipping", "delivery", "delivered", "arrived", "late", "package",
      "packaging", "box", "missing", "received", "send", "sent"],
     ["shipping"]),
    ("Seller, return, refund, and warranty service",
     ["seller", "service", "support", "return", "refund", "warranty",
      "repair", "replacement", "claim", "respond", "response", "company",
      "customer"],
     ["service"]),
    ("Price and value dissatisfaction",
     ["price", "expensive", "cheap", "value", "money", "worth", "cost",
      "deal", "paid", "pay"],
     ["price"]),
    ("Software, update, UI, and setup issues",
     ["software", "update", "android", "system", "os", "ui", "settings",
      "setting", "root", "rooted", "bloatware", "manual", "instructions",
      "sync", "program", "language", "chinese", "keyboard"],
     ["software"]),
    ("Audio, speaker, and call sound issues",
     ["speaker", "sound", "volume", "hear", "audio", "microphone", "mic",
      "call", "calls", "voice", "headphone", "headphones"],
     []),
    ("Accessory or case compatibility issues",
     ["otterbox", "cover", "case", "fit", "protector", "accessory",
      "accessories", "cable", "usb", "adapter"],
     []),
]

# ---------------------------------------------------------------------------
# Recommended actions.  (words looked up in the theme, action);
# then (words looked up in theme + issue + keywords, action); then the default.
# ---------------------------------------------------------------------------
THEME_ACTIONS = [
    (["battery", "charging"],
     "Investigate battery, charging, charger, and USB-port related failure patterns. "
     "Prioritize QA checks for charging stability, battery health, charger compatibility, and early-life battery failure."),
    (["carrier", "sim", "network"],
     "Review product listings and compatibility information for carrier, SIM, LTE/4G, unlocked status, and regional variants. "
     "Improve compatibility warnings and ensure that locked/unlocked device status is accurately described before purchase."),
    (["performance", "lag", "app stability"],
     "Analyze performance complaints related to slow response, app crashes, freezing, unexpected shutdowns, and early device failure. "
     "Separate true software lag from hardware failure in future issue labeling to improve triage precision."),
    (["quality dissatisfaction"],
     "Review general quality complaints to identify whether dissatisfaction is driven by build quality, low-end specifications, poor expectations management, or defective devices. "
     "Improve product positioning and listing clarity for lower-cost models."),
    (["refurbished", "damaged condition", "broken product condition"],
     "Strengthen inspection standards for refurbished, used, or damaged devices. "
     "Clearly disclose cosmetic defects, missing accessories, battery replacement status, and device condition in product listings."),
    (["screen", "display"],
     "Inspect screen, display, LCD, and touch-related defect reports. "
     "Check supplier quality, packaging protection, and early-life display failure patterns."),
    (["audio", "speaker", "call sound"],
     "Investigate speaker, microphone, call audio, and volume-related complaints. "
     "Consider adding a dedicated audio issue category in the next version of the issue taxonomy."),
    (["camera"],
     "Review camera quality, camera app stability, and photo/video complaints. "
     "Check whether the issue is caused by hardware defects, software compression, camera app instability, or expectation mismatch."),
    (["accessory", "case compatibility"],
     "Review accessory, case, cover, and compatibility complaints. "
     "Improve product compatibility descriptions and ensure accessories do not block key device functions."),
    (["smartwatch"],
     "Separate smartwatch-related complaints from mobile phone complaints in future preprocessing. "
     "Review smartwatch connectivity, Bluetooth stability, band quality, and feature expectation issues."),
    (["service", "warranty", "refund"],
     "Review seller support, return, refund, and warranty workflows. "
     "Identify whether dissatisfaction is driven by product failure, unclear return policies, or after-sales service delays."),
]
FALLBACK_ACTIONS = [
    (["battery", "charge", "charging", "charger", "usb", "port"],
     "Investigate battery, charging, charger, and USB-port related failure patterns. "
     "Prioritize QA checks for charging stability, battery health, and accessory compatibility."),
    (["network", "sim", "verizon", "sprint", "unlocked", "locked", "lte", "4g", "carrier"],
     "Review product listings and compatibility information for carrier, SIM, LTE/4G, and regional variants. "
     "Improve compatibility warnings and ensure unlocked status is accurately described."),
]
DEFAULT_ACTION = (
    "Review representative customer comments to clarify the dominant complaint pattern. "
    "Consider refining the issue taxonomy if this theme appears repeatedly."
)

# ---------------------------------------------------------------------------
# Priority weights, in percent-free shares, and the growth proxy.
# ---------------------------------------------------------------------------
PRIORITY_WEIGHTS = {
    "cluster_size_score": 0.40,
    "issue_concentration_score": 0.25,
    "confidence_score": 0.20,
    "negative_ratio_score": 0.10,
    "growth_proxy_score": 0.05,
}
GROWTH_PROXY = 0.5

# ---------------------------------------------------------------------------
# Words that never make a cluster keyword.
# ---------------------------------------------------------------------------
DOMAIN_STOP_WORDS = [
    "phone", "phones", "cell", "cellphone", "smartphone", "product", "item",
    "device", "just", "really", "very", "good", "great", "bad", "like",
    "love", "nice", "excellent", "awesome", "buy", "bought", "purchase",
    "purchased", "ordered", "got", "get", "received", "came", "come", "work",
    "works", "worked", "working", "use", "used", "using", "time", "day",
    "days", "week", "weeks", "month", "months", "thing", "things", "way",
    "lot", "bit", "don", "doesn", "didn", "isn", "wasn", "can", "could",
    "amazon", "seller", "review", "reviews", "star", "stars", "money", "new",
    "did", "does", "return", "returned", "returns", "problem", "problems",
    "issue", "issues", "waste", "recommend", "recommended", "try", "tried",
    "know", "want", "wanted", "going", "make", "made", "right", "away",
    "box", "case",
]

# English function words, the entries of Spark's own default
# English list (StopWordsRemover) that the tokeniser can produce.  Another list
# can be passed wherever this one is the default.
ENGLISH_STOP_WORDS = (
    "me my myself we our ours ourselves you your yours yourself yourselves he "
    "him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing an the and "
    "but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own "
    "same so than too very can will just don should now cannot could ought "
    "would"
).split()
