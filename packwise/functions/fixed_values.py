"""Fixed values.

Everything in this module is data that has to equal the published label-checking
rules for results to be right: regular expressions, word lists, look-up tables,
rule names, legal references and message texts.  There is no logic here.

Patterns use numbered groups, no look-around and no verbose mode, so that one
text works in Java's regex engine and in RE2.
"""

# ---------------------------------------------------------------- price
MRP_KEYWORD = r"(?i)\b(?:M\.?\s*R\.?\s*P\.?|MAX\.?(?:IMUM)?\s*RETAIL\s*PRICE|RETAIL\s*PRICE)\b"
MRP_FULL = (
    r"(?i)\b(?:M\.?\s*R\.?\s*P\.?|MAX\.?(?:IMUM)?\s*RETAIL\s*PRICE|RETAIL\s*PRICE)\b"
    r"[^\d₹RsINRz?]*(?:₹|Rs\.?|R\.?S\.?|INR|[zZ\?])?\s*"
    r"((?:\d{1,3}(?:,\d{2,3})+|\d+)(?:\.\d{1,2})?)"
)
CURRENCY_AMOUNT = r"(?i)(?:₹|Rs\.?|INR)\s*((?:\d{1,3}(?:,\d{2,3})+|\d+)(?:\.\d{1,2})?)"
SLASH_AMOUNT = r"((?:\d{1,3}(?:,\d{2,3})+|\d+)(?:\.\d{1,2})?)\s*(?:/-)"
BARE_AMOUNT = r"^\s*(\d+(?:\.\d{1,2})?)\s*$"
DATE_LIKE = r"\b\d{1,2}[\/\-]\d{2,4}\b"
PRICE_MARKS = ["₹", "Rs", "RS", "INR", "/-"]
AHEAD_PRICE_MARKS = ["₹", "Rs", "RS", "/-"]
AHEAD_PRICE_SKIP = ["KCAL", "KJ", "SERV", "PORTION", "PROTEIN", "FAT", "CARB", "FSSAI", "LIC"]
MIN_PLAUSIBLE_PRICE = 0.50
TAX_SUFFIX = " (INCL. OF ALL TAXES)"

# ---------------------------------------------------------------- net quantity
NET_QTY = (
    r"(?i)(?:(?:NET\s*(?:WT|WEIGHT|QTY|QUANTITY|CONTENT)?)|(?:QUANTITY)|(?:CONTENT)|(?:WEIGHT))\b"
    r"[^\d]*(\d+(?:\.\d+)?)\s*"
    r"(kg|g|gm|grams?|ml|m[lI1\|]|l|ltr|litres?|liter|liters?|N|units?|pcs|pieces|nos|sticks?|matches?"
    r"|tablets?|capsules?|sheets?|wipes?|pouches?|rolls?|bags?|tubes?|bars?|packs?)\b"
)
STANDALONE_QTY = (
    r"(?i)\b(\d+(?:\.\d+)?)\s*"
    r"(kg|g|gm|grams?|ml|m[lI1\|]|l|ltr|litres?|liter|liters?|N|units?|pcs|pieces|nos|sticks?|matches?"
    r"|tablets?|capsules?|sheets?|wipes?|pouches?|rolls?|bags?|tubes?|bars?|packs?)\b"
)
NET_QTY_WORDS = ["NET WT", "NET QTY", "NET WEIGHT", "NET QUANTITY", "NET CONTENT"]
NUTRITION_WORDS = [
    "serving", "serve", "portion", "energy", "protein", "fat", "carb",
    "carbohydrate", "sugar", "sodium", "fiber", "fibre", "salt", "vitamin",
    "iron", "calcium", "daily value", "gda", "rda", "%", "kcal", "kj",
    "table", "per 100", "per pack", "approx", "approx.",
]

# unit alias -> canonical unit
UNIT_ALIASES = {
    "100 ml": "100 ml", "100ml": "100 ml", "100 millilitre": "100 ml", "100 millilitres": "100 ml",
    "100 g": "100 g", "100g": "100 g", "100 gm": "100 g", "100 grams": "100 g", "100 gram": "100 g",
    "g": "g", "gm": "g", "gram": "g", "grams": "g",
    "kg": "kg", "kilogram": "kg", "kilograms": "kg",
    "ml": "ml", "millilitre": "ml", "millilitres": "ml", "mi": "ml", "m1": "ml", "m|": "ml",
    "l": "L", "ltr": "L", "litre": "L", "litres": "L", "liter": "L", "liters": "L",
    "n": "units", "unit": "units", "units": "units", "pc": "units", "pcs": "units",
    "piece": "units", "pieces": "units", "nos": "units",
    "stick": "sticks", "sticks": "sticks", "match": "matches", "matches": "matches",
    "tablet": "tablets", "tablets": "tablets", "capsule": "capsules", "capsules": "capsules",
    "sheet": "sheets", "sheets": "sheets", "wipe": "wipes", "wipes": "wipes",
    "pouch": "pouches", "pouches": "pouches", "roll": "rolls", "rolls": "rolls",
    "bar": "bars", "bars": "bars", "tube": "tubes", "tubes": "tubes", "pack": "packs", "packs": "packs",
}

# ---------------------------------------------------------------- dates
MFG_DATE = (
    r"(?i)(?:MFD|MFG|PKD|PACKED|DATE\s*OF\s*(?:MFG|PACKING|MANUFACTURE)|MFD\s*ON|PKD\s*ON|BEST\s*BEFORE"
    r"|EXP(?:IRY)?|USE\s*BY|B\.?NO|BATCH)\s*[:.\-]?\s*"
    r"((?:\d{1,2}[\/\-\.]\d{2,4})|(?:\d{4}[\/\-\.](?:0[1-9]|1[0-2]))|(?:\d{4}[A-Za-z]{2,3}\d{1,2})"
    r"|(?:(?:0[1-9]|1[0-2])\d{2,4})"
    r"|(?:(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[a-z]*[\s\.\-\/]*\d{2,4}))"
)
DATE_ONLY = (
    r"\b((?:0[1-9]|1[0-2])[\/\-](?:20\d{2}|\d{2})|20\d{2}[\/\-](?:0[1-9]|1[0-2])|\d{4}[A-Z]{2,3}\d{1,2}"
    r"|(?:0[1-9]|1[0-2])\d{2,4})\b"
)
DATE_NEXT_LINE_WORDS = ["MFD", "MFG", "PKD", "PACKED", "BEST BEFORE", "EXP", "USE BY"]
DATE_FALLBACK_WORDS = ["MFD", "MFG", "PKD", "PACKED", "DATE", "EXP", "BB"]

# ---------------------------------------------------------------- country of origin
ORIGIN = (
    r"(?i)(?:COUNTRY\s*OF\s*ORIGIN|MADE\s*IN|PRODUCT\s*OF|MANUFACTURED\s*IN|PRODUCED\s*IN)\b"
    r"[\s\:\-]+([A-Za-z]+(?:\s+[A-Za-z]+){0,2})"
)
LABEL_COUNTRIES = [
    "india", "vietnam", "china", "usa", "japan", "germany", "france",
    "italy", "bangladesh", "sri lanka", "indonesia", "thailand", "malaysia",
    "united states", "united kingdom", "korea", "taiwan", "nepal", "bhutan",
]
PHRASE_COUNTRIES = [
    "INDIA", "VIETNAM", "CHINA", "BANGLADESH", "SRI LANKA", "THAILAND", "JAPAN", "USA", "NEPAL", "BHUTAN",
]
ORIGIN_PHRASES = [
    "MADE IN ", "MADEIN", "PRODUCT OF ", "ORIGIN: ", "ORIGIN : ", "FOR SALE IN ", "SALE IN ",
    "FORSALEIN", "SALEIN", "MFD IN ", "PRODUCED IN ", "PACKED IN ",
]
INDIAN_PLACES = [
    "MUMBAI", "KOLKATA", "DELHI", "BANGALORE", "BENGALURU", "CHENNAI",
    "AHMEDABAD", "PUNE", "HYDERABAD", "INDIA", "MAHARASHTRA", "GUJARAT",
    "WEST BENGAL", "ANDHRA PRADESH", "TAMIL NADU", "HARYANA", "PUNJAB",
    "SURAT", "ANAND", "PAREL", "NAGPUR", "SIVAKASI",
]
PIN_5_OR_6 = r"\b\d{5,6}\b"
CORPORATE_WORDS = ["PVT", "LTD", "LIMITED"]

# ---------------------------------------------------------------- maker
MAKER_KEYWORD = (
    r"(?i)\b(?:MFD\.?\s*BY|MANUFACTURED\s*(?:AND\s*PACKED\s*)?BY|PACKED\s*BY|MKTD\.?\s*BY|MARKETED\s*BY"
    r"|PRODUCED\s*BY|IMPORTED\s*(?:&\s*MARKETED\s*)?BY)\b"
)
MAKER_CORPORATE = (
    r"(?i)\b(?:LIMITED|LTD\.?|PVT\.?\s*LTD\.?|P(?:RI|R)VATE\s*(?:LIMITED|UMITED|LMTED)|INDUSTRIES|FOODS"
    r"|BEVERAGES|CONSUMER\s*PRODUCTS|ENTERPRISES|PHARMA|PRODUCTS\s*PVT)\b"
)
PIN_6 = r"\b\d{6}\b"
MAKER_STOP_WORDS = [
    "M.R.P", "MRP", "RETAIL PRICE", "MAX RETAIL",
    "NET WT", "NET WEIGHT", "NET QTY", "NET QUANTITY", "NET CONTENT",
    "CUSTOMER CARE", "CONSUMER CARE", "FEEDBACK", "COMPLAINT", "QUERIES",
    "CONTACT US", "HELPLINE", "TOLL FREE", "FOR FEEDBACK",
    "MFD", "MFG", "PKD", "PACKED ON", "BEST BEFORE", "EXPIRY", "USE BY",
    "BATCH", "B.NO", "COUNTRY OF ORIGIN", "MADE IN", "PRODUCT OF",
    "INGREDIENT", "NUTRITION", "SERVING", "ALLERGEN",
]
MAKER_CONTEXT_SKIP = ["NUTRITION", "INGREDIENTS", "SERVING", "FSSAI", "LIC", "FEEDBACK", "CARE"]
MIN_MAKER_LENGTH = 5
MIN_CORPORATE_LENGTH = 8

# ---------------------------------------------------------------- consumer care
CARE_KEYWORD = (
    r"(?i)\b(?:CUSTOMER\s*CARE|CONSUMER\s*CARE|CUSTOMER\s*QUERIES|CUSTOMER\s*SERVICE|CONSUMER\s*CELL|FEEDBACK"
    r"|QUERIES|COMPLAINTS?|CARE\s*EXECUTIVE|CARE\s*CONTACT|CONTACT\s*US|HELPLINE|TOLL\s*FREE|FOR\s*FEEDBACK)\b"
)
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = (
    r"(?:\b(?:1800|1860|0800|0808)[\-\s]?\d{2,4}[\-\s]?\d{3,6}\b|\b(?:\+?91[\-\s]?)?[6-9]\d{9}\b"
    r"|\b0\d{2,4}[\-\s]\d{6,8}\b|\b0800\d{7}\b)"
)
WEBSITE = r"(?i)\b(?:https?://)?(?:www\.)?[a-zA-Z0-9-]+\.(?:com|in|org|net|co\.in)\b"
CARE_STOP_WORDS = ["MFD BY", "MANUFACTURED BY", "PACKED BY", "M.R.P", "NET WT", "NET QTY"]
CARE_LEAD_IN = (
    r"(?i)^(?:for\s*)?(?:feedback|complaints?|queries|customer\s*care)?[\s/,]*(?:contact)?\s*[:.\-]?\s*"
)
CARE_CONTACT_LABEL = r"(?i)\b(?:Ph|Phone|Tel|email|mail)\s*:\s*"
CARE_ADDRESS_LEAD_IN = r"(?i)^(?:/,?|contact|\s)+"
IGNORED_SITES = ["openfoodfacts", "example", "github"]
MIN_CARE_ADDRESS_LENGTH = 8
MIN_CARE_BLOCK_LENGTH = 5

# ---------------------------------------------------------------- generic name
GENERIC_KEYWORD = (
    r"(?i)\b(?:COMMON\s*OR\s*GENERIC\s*NAME|GENERIC\s*NAME|NAME\s*OF\s*(?:THE\s*)?COMMODITY|COMMODITY"
    r"|PRODUCT\s*NAME)\b\s*[\:\-\.]\s*([A-Za-z0-9\s,\-\(\)]+)"
)
COMMODITIES = [
    "instant noodles", "noodles", "cashew cookies", "cookies", "crackers",
    "glucose biscuits", "gluco biscuits", "biscuits",
    "milk chocolate", "dark chocolate", "chocolate", "pasteurized butter", "butter",
    "potato chips", "potatochips", "potato crisps", "crisps", "chips",
    "namkeen", "spicy fried split mung bean", "split mung bean", "mung bean", "moong dal", "bhujia",
    "homogenised toned milk", "toned milk", "pasteurized milk",
    "blended edible vegetable oil", "edible vegetable oil", "vegetable oil",
    "sunflower oil", "mustard oil", "soybean oil", "pure honey", "honey",
    "wheat flour", "atta", "tea", "coffee",
    "detergent powder", "detergent", "toilet soap", "bathing bar", "soap", "toothpaste", "toothbrush", "shampoo",
    "safety matches", "safety match", "matches", "matchbox",
    "notebook", "adhesive tape", "ball pen", "pencil", "battery",
]
COMMODITY_LINE_SKIP = ["INGREDIENT", "CONTAINS", "ALLERGEN", "NUTRITION", "PER 100", "SERVING", "STORE IN"]
TITLE_CONTEXT_WORDS = ["PRODUCT", "COMMODITY", "ITEM", "BRAND", "CATEGORY"]
TITLE_EXCLUDED_WORDS = [
    "INGREDIENTS", "INGREDIENT", "CONTAINS", "ALLERGEN", "ALLERGENS", "NUTRITION",
    "NUTRITIONAL", "SERVING", "SERVINGS", "PORTION", "ENERGY", "PROTEIN", "FAT",
    "SUGAR", "SALT", "SODIUM", "CARBOHYDRATE", "MAIDA", "FLOUR", "WHEAT", "SOY",
    "WALNUT", "WALNUTS", "PEANUT", "PEANUTS", "ALMOND", "ALMONDS", "CASHEW", "CASHEWS",
    "STORE", "KEEP", "COOL", "DRY", "PLACE", "AWAY", "DIRECT", "SUNLIGHT",
    "BEST", "BEFORE", "USE", "DATE", "BATCH", "PKD", "MFD", "MRP", "EXP", "RS", "LIC", "FSSAI",
    "REGISTERED", "TRADEMARK", "OWNED", "MARKETED", "MANUFACTURED", "PACKED", "CONSUMER", "CUSTOMER",
    "AVERAGE", "QUANTITY", "QUANTIN", "TABLE", "PER", "ANNATTO", "COLOUR", "COLOR", "VALUE",
]

# ---------------------------------------------------------------- unit sale price
UNIT_SALE_PRICE = (
    r"(?i)(?:(?:UNIT\s*SALE\s*PRICE|U\.?S\.?P\.?)\s*[\:\-\.]?\s*)?(?:₹|Rs\.?|INR)?\s*(\d+(?:\.\d{1,2})?)"
    r"\s*(?:/-)?\s*(?:/|per)\s*"
    r"((?:100\s*(?:ml|m[lI1\|]|millilitres?|g|gm|grams?))|kg|g|gm|grams?|ml|m[lI1\|]|millilitres?|l|ltr"
    r"|litres?|liter|liters?|pcs|pieces?|units?|nos|count|item|n)\b"
)
PRICE_NUMBER = r"(\d+(?:\.\d{1,2})?)"
PRICED_QUANTITY = (
    r"(?i)(\d+(?:\.\d+)?)\s*(kg|g|gm|grams?|ml|millilitres?|l|ltr|litres?|liter|liters?|pcs|pieces?|units?|nos"
    r"|count|item|n|sticks?|matches?|tablets?|capsules?|sheets?|wipes?|pouches?|rolls?|bars?|tubes?|packs?)\b"
)
COUNT_UNITS = [
    "units", "pcs", "nos", "sticks", "matches", "tablets", "capsules", "sheets", "wipes",
    "pouches", "rolls", "bars", "tubes", "packs",
]
CLIENT_PRICE_NUMBER = r"(\d+(?:\.\d+)?)"
CLIENT_PRICED_QUANTITY = (
    r"(?i)(\d+(?:\.\d+)?)\s*(kg|g|gm|grams?|ml|millilitres?|l|ltr|litres?|liter|pcs|units?|nos)"
)

# ---------------------------------------------------------------- line sanitizing: (pattern, replacement)
SANITIZE_CHARS_FROM = "\uff1a\uff08\uff09\u2013\u2014\u00a0"
SANITIZE_CHARS_TO = ":()-- "
SANITIZE_STEPS = [
    (r"(?i)\bM\s*\.\s*R\s*\.\s*P\.?\b", "M.R.P."),
    (r"(?i)\bM\s+R\s+P\b", "MRP"),
    (r"(?i)\bP\s*\.\s*K\s*\.\s*D\.?\b", "PKD"),
    (r"(?i)\bM\s*\.\s*F\s*\.\s*D\.?\b", "MFD"),
    (r"(?i)\bB\s*\.\s*N\s*\.\s*O\.?\b", "B.NO"),
    (r"(?i)\bR\s*s\s*\.", "Rs."),
]

# ---------------------------------------------------------------- raw text
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{0085}\x{2028}\x{2029}]"

# ---------------------------------------------------------------- token cleaning
LONE_NOISE_CHARS = list("~`^_|=+<>\\")
MIN_TOKEN_CONFIDENCE = 0.34
TOKEN_SPACES = r"[\s\x{00a0}\x{2000}-\x{200b}]+"
ZERO_IN_QUANTITY = r"(?i)(\b\d+)([ODod]+)(\s*(?:g|kg|gm|ml|l|ltr|pcs|units?|nos|n\b))"
ZERO_IN_PRICE = r"(?i)(?:Rs\.?|₹|MRP)\s*[\dODod]+(?:\.[\dODod]+)?"
COLLAPSED_COUNT = (
    r"(?i)\b(\d+)\s*(STICKS?|MATCHES?|TABLETS?|CAPSULES?|SHEETS?|WIPES?|POUCHES?|ROLLS?|BAGS?|TUBES?|BARS?"
    r"|PACKS?|PCS|NOS|UNITS?)\b"
)
PHONE_LABEL_TYPO = r"(?i)\bP[in1]\s*:\s*(\d)"
EMAIL_DOT_TYPO = r"(?i)@([A-Za-z0-9_-]+?)(in|com|org|net|co\.in)\b"
RUPEE_TYPO = r"(?i)\bR\s*(\d+)\s*(?:/-)"
VERTICAL_ASPECT = 1.8
VERTICAL_MIN_HEIGHT = 35

# line reconstruction
MAX_LINE_HEIGHT_RATIO = 2.2
MIN_LINE_OVERLAP = 0.45
COLUMN_GAP_HEIGHTS = 4.0
COLUMN_GAP_PIXELS = 120

# two-pass token merge
MERGE_MIN_IOU = 0.40
MERGE_CONFIDENCE_GAIN = 0.10
MERGE_LENGTH_GAIN = 3
RECOVERY_MIN_TOKENS = 18
RECOVERY_MIN_CONFIDENCE = 0.65
RECOVERY_MIN_SIDE = 500

# retry zones as fractions of the image: field -> (top, bottom, left, right)
RETRY_ZONES = {
    "mrp": (0.5, 1.0, 0.4, 1.0),
    "net_quantity": (0.4, 0.9, 0.0, 0.6),
    "manufacture_date": (0.5, 1.0, 0.0, 0.6),
}

# ---------------------------------------------------------------- numeric repair
MONTH_WORDS = [
    "JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC",
    "JANUARY", "FEBRUARY", "MARCH", "APRIL", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER",
    "NOVEMBER", "DECEMBER",
]
PRESERVED_WORDS = MONTH_WORDS + [
    "INCL", "INCLUSIVE", "OF", "ALL", "TAXES", "TAX", "MAX", "MAXIMUM", "RETAIL", "PRICE", "MRP",
    "KG", "G", "GM", "GMS", "GRAM", "GRAMS", "ML", "CL", "DL", "L", "LTR", "LITRE", "LITRES", "LITER", "LITERS",
    "FL.OZ", "N", "UNIT", "UNITS", "PCS", "PIECE", "PIECES", "NOS", "STICK", "STICKS",
    "MATCH", "MATCHES", "TABLET", "TABLETS", "CAPSULE", "CAPSULES", "SHEET", "SHEETS",
    "WIPE", "WIPES", "POUCH", "POUCHES", "ROLL", "ROLLS", "BAG", "BAGS", "TUBE", "TUBES",
    "BAR", "BARS", "PACK", "PACKS", "BOX", "BOXES", "BOTTLE", "BOTTLES",
    "MFD", "MFG", "PKD", "PACKED", "BEST", "BEFORE", "EXP", "EXPIRY", "USE", "BY", "BATCH", "B.NO", "DATE",
    "IS", "SO", "NO", "OR", "AS", "TO", "IN", "ON", "AT", "IF", "IT",
]
REPAIR_UNITS = [
    "g", "gm", "grams", "kg", "ml", "ltr", "litres", "liter",
    "units", "pcs", "pieces", "nos", "sticks", "tablets",
    "capsules", "sheets", "wipes", "pouches", "rolls", "bars", "packs",
]
CONFUSABLE_FROM = "OolISBZ"
CONFUSABLE_TO = "0011582"
CONFUSABLE_ONLY = r"^[OlISBZ0-9]+$"
KNOWN_CORRUPTED = ["SOO", "LSO", "SSO", "BOO"]
REPAIR_PARTS = r"(\s+|[(),:/\-₹]|[^\s(),:/\-₹]+)"

# ---------------------------------------------------------------- rules
MISSING_WORDS = ["none", "null", "n/a", "na", "-", ""]
RULE_COUNTRIES = [
    "india", "china", "usa", "united states", "united kingdom", "uk", "germany",
    "france", "japan", "south korea", "korea", "bangladesh", "pakistan", "sri lanka",
    "nepal", "bhutan", "thailand", "vietnam", "indonesia", "malaysia", "singapore",
    "canada", "australia", "new zealand", "brazil", "mexico", "italy", "spain",
    "netherlands", "switzerland", "turkey", "russia", "uae", "saudi arabia",
]
RULE_DATE = (
    r"(?i)(\d{1,2}[/\-\.]\d{2,4}|(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?"
    r"|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)[\s,]+\d{2,4}"
    r"|\d{2,4}[/\-\.]\d{1,2})"
)
RULE_UNIT_PRICE = (
    r"(?i)(?:₹|rs\.?|inr)?\s*\d+(?:\.\d{1,2})?\s*(?:/|per)\s*(?:100\s*(?:ml|millilitre|g|gm|grams?)|g|gm|grams?"
    r"|kg|kilogram|ml|millilitre|l|litre|liter|ltr|piece|unit|count|item|number|n)\b"
)
RULE_PHONE = r"(\+?[\d][\d\s\-]{8,}\d)"
RULE_EMAIL = r"[\w.\-+]+@[\w.\-]+\.\w{2,}"
RULE_QUANTITY = (
    r"(?i)(\d+(?:\.\d+)?)\s*(g|gm|gms|grams?|kg|kilogram|ml|millilitre|l|litre|liter|ltr|n|units?|pcs|count"
    r"|pieces?)"
)
RULE_MISLEADING = (
    r"(?i)\b(about|approximately|minimum|not\s+less\s+than|average|jumbo|giant|extra|huge|full)\b"
)
RULE_ADDRESS = (
    r"(?i)(\b[1-9]\d{5}\b)|(andhra\s+pradesh|arunachal\s+pradesh|assam|bihar|chhattisgarh|goa|gujarat|haryana"
    r"|himachal|jharkhand|karnataka|kerala|madhya\s+pradesh|maharashtra|manipur|meghalaya|mizoram|nagaland"
    r"|odisha|punjab|rajasthan|sikkim|tamil\s+nadu|telangana|tripura|uttar\s+pradesh|uttarakhand|west\s+bengal"
    r"|delhi|chandigarh|puducherry|gurgaon|gurugram|noida|mumbai|bangalore|bengaluru|kolkata|chennai"
    r"|hyderabad|pune|ahmedabad|faridabad|ghaziabad|jaipur|indore|lucknow|kanpur|surat|vadodara)\b"
)
MAKER_ADDRESS_WORDS = [
    "road", "street", "nagar", "colony", "pvt", "ltd", "limited", "corp", "corporation", "industries",
    "works", "sector", "phase", "plot",
]
PACKER_ADDRESS_WORDS = ["road", "nagar", "pvt", "ltd", "colony"]
RULE_COMMODITIES = [
    "noodles", "biscuit", "biscuits", "tea", "coffee", "soap", "rice", "wheat",
    "atta", "maida", "suji", "sugar", "salt", "milk", "bread", "butter", "cheese",
    "oil", "ghee", "chips", "crisps", "snack", "snacks", "cereal", "pasta",
    "juice", "water", "dal", "pulse", "pulses", "flour", "spice", "spices",
    "pickle", "sauce", "ketchup", "jam", "honey", "chocolate", "candy", "cookie", "cookies",
]
MULTI_ITEM_LIST = r"[,;]|\d+\s*[xX×]\s*\w"
RULE_CURRENCY = r"(?i)(₹|rs\.?|inr|mrp)"
CALCULATED_MARK = r"(?i)\(calculated\)"
CALCULATED_SUFFIX = " (Calculated)"
LIQUID_WORDS = ["ml", "millilitre", "l", "litre", "ltr"]
EXPIRY_WORDS = r"(?i)(best\s+before|expir|use\s+by|bb|ubd)"
DIMENSION_CATEGORIES = ["textile", "fabric", "sheet", "container", "household"]
DIMENSION = r"(?i)\d+\s*(cm|mm|m|metre|meter|inch|in|ft|feet)\b"
VEG_WORDS = ["green", "veg", "vegetarian"]
NONVEG_WORDS = ["red", "brown", "non-veg", "nonveg"]
OFF_PANEL_WORDS = ["OUTSIDE", "NON_PDP", "BACK_SEAM", "ILLEGAL_ZONE", "SIDE_SEAM"]
POOR_WORDS = ["POOR", "UNREADABLE", "ILLEGIBLE"]
FAIR_WORDS = ["FAIR", "REVIEW", "BORDERLINE"]
KILO_UNITS = ["kg", "kilogram", "l", "litre", "liter", "ltr"]
# upper bound of the normalized quantity -> minimum letter height in mm; None = everything above
FONT_TIERS = [(50.0, 1.0), (200.0, 2.0), (1000.0, 4.0), (None, 6.0)]
DEFAULT_CONFIDENCE = 0.90
REVIEW_PENALTY = 0.03

# (rule id, name, legal reference) in evaluation order
RULES = [
    ("R6-01", "Manufacturer / Packer Name & Address", "Rule 6(1)(a), Rule 10"),
    ("R6-02", "Packer Name & Address", "Rule 6(1)(a)"),
    ("R6-03", "Importer Name & Address", "Rule 6(1)(a)"),
    ("R6-04", "Country of Origin / Manufacture / Assembly", "Rule 6(1)(aa)"),
    ("R6-05", "Common or generic name", "Rule 6(1)(b)"),
    ("R6-06", "Multi-Product Package Declarations", "Rule 6(1)(b)"),
    ("R6-07", "Net Quantity Specification", "Rule 6(1)(c), Rule 11, Rule 12"),
    ("R6-08", "Maximum Retail Price (MRP)", "Rule 6(1)(e)"),
    ("R6-09", "Unit Sale Price (USP)", "Rule 6(11)"),
    ("R6-10", "Month & Year of Manufacture / Packing", "Rule 6(1)(d)"),
    ("R6-11", "Best Before / Use By Date", "Rule 6(1)(da)"),
    ("R6-12", "Consumer Care / Helpline Details", "Rule 6(2)"),
    ("R6-13", "Commodity-Specific Dimensions", "Rule 6(1)(f), Rules 14–17"),
    ("R6-14", "Commodity-Specific Mandatory Declarations", "Rule 6(1)(g)"),
    ("R6-15", "Genetically Modified (GM) Marking", "Rule 6(7)"),
    ("R6-16", "Vegetarian / Non-Vegetarian Symbol", "Rule 6(8)"),
    ("R6-17", "E-Commerce Mandatory Declarations", "Rule 6(10), Rule 6(10A)"),
    ("RULE7", "Declaration Font Height (Statutory Minimum)", "Rule 7, Table 1"),
    ("RULE8", "Principal Display Panel Placement", "Rule 8"),
    ("RULE9", "Declaration Legibility & Prominence", "Rule 9"),
]

# message texts; {} is filled in with the value at hand
REASONS = {
    "R6-01.missing": "Manufacturer name & address not detected on label.",
    "R6-01.review": "Manufacturer detected ('{}') but address completeness is uncertain — verify street/city/PIN.",
    "R6-01.pass": "Manufacturer/address declared: {}",
    "R6-02.review": "Packer '{}' detected but address is incomplete.",
    "R6-02.pass": "Packer address declared: {}",
    "R6-03.missing": "Product is imported but importer name & address are missing.",
    "R6-03.pass": "Importer declared: {}",
    "R6-04.missing": "Imported product must declare Country of Origin.",
    "R6-04.unknown": "Country of Origin not detected; could not determine if product is imported.",
    "R6-04.review": "'{}' may not be a recognized country name — verify manually.",
    "R6-04.pass": "Country of Origin: {}",
    "R6-05.missing": "Common or generic name not declared on label.",
    "R6-05.review": "'{}' appears to be a brand name, not a generic commodity name — verify.",
    "R6-05.pass": "Generic name declared: {}",
    "R6-06.review": "Multi-product pack detected but item names/quantities list is not clearly declared.",
    "R6-06.pass": "Multi-product items and quantities declared.",
    "R6-07.missing": "Net quantity not declared on label.",
    "R6-07.misleading": "Misleading Net Quantity expression: qualifier '{}' is prohibited (Rule 11).",
    "R6-07.review": (
        "Non-compliant Net Quantity unit: '{}' must use standard metric units: g, kg, ml, l, or count (Rule 12)."
    ),
    "R6-07.pass": "Net quantity declared: {}",
    "R6-08.missing": "Maximum Retail Price (MRP) not declared on label.",
    "R6-08.review": "Improper MRP declaration format: '{}' — must clearly show ₹/Rs. + price.",
    "R6-08.pass": "MRP declared: {}",
    "R6-09.format": (
        "Improper Unit Sale Price format: '{}'. Required: ₹ [amount] / [unit] "
        "(e.g. ₹ 16.00/100ml, ₹ 80/L for beverages; ₹ 0.28/g, ₹ 120/kg for solids)."
    ),
    "R6-09.decimals": (
        "USP '{}' has more than 2 decimal places — must be rounded to nearest 2 decimal places under Rule 6(11)."
    ),
    "R6-09.pass": "Unit Sale Price declared: {}",
    "R6-09.calculated": (
        "USP not printed on beverage label. Auto-calculated statutory expectation under Rule 6(11): {}. "
        "Verify packaging to confirm whether physical declaration was omitted."
    ),
    "R6-09.suggested": (
        "Unit Sale Price (USP) not declared on label. Mandatory requirement under Rule 6(11) "
        "(statutory expectation: {})."
    ),
    "R6-09.missing": (
        "Unit Sale Price (USP) not declared. Rule 6(11) requires ₹ per 100ml / L for beverages and liquids, "
        "or ₹ per 100g / kg for solid commodities."
    ),
    "R6-10.missing": "Month and year of manufacture/packing not declared.",
    "R6-10.format": "Manufacture date '{}' format is invalid — require MM/YYYY or Month YYYY.",
    "R6-10.review": "Detected date may be an expiry/best-before date, not manufacture date — verify.",
    "R6-10.pass": "Manufacture date declared: {}",
    "R6-11.review": (
        "Expiry-related text found in manufacture date field — extract Best Before date separately."
    ),
    "R6-11.format": "Best Before date format invalid: '{}' — require date, month and year.",
    "R6-11.pass": "Best Before / Use By declared: {}",
    "R6-12.missing": "Consumer care details not declared. Must include name, address, phone and email.",
    "R6-12.review": "Consumer care found but missing phone number or email address — verify completeness.",
    "R6-12.pass": "Consumer care contact details declared: {}",
    "R6-13.review": "Category '{}' may require dimension declaration — verify label.",
    "R6-13.pass": "Dimensions declared where applicable.",
    "R6-14.pass": "Category '{}' commodity declarations evaluated via applicable sub-rules.",
    "R6-15.review": "GM food detected but 'GM' label placement at top-of-PDP could not be verified.",
    "R6-15.fail": "'GM' marking must appear at the top of the Principal Display Panel.",
    "R6-15.pass": "'GM' marking present at top of Principal Display Panel.",
    "R6-16.green": "Green (vegetarian) symbol detected.",
    "R6-16.red": "Red/Brown (non-vegetarian) symbol detected.",
    "R6-16.review": "Veg/Non-veg mark '{}' detected but color/type unclear — verify symbol color.",
    "R6-17.missing": "{} mandatory field(s) missing from e-commerce listing (Rule 6(10)).",
    "R6-17.origin": (
        "E-commerce listing of imported product must specify Country of Origin filter "
        "(Rule 6(10A), effective July 2026)."
    ),
    "R6-17.pass": "E-commerce mandatory declarations verified.",
    "RULE7.review": "Font height could not be measured — manual verification required.",
    "RULE7.fail": (
        "Font height too small: {}mm detected. Minimum prescribed height is {}mm for this package size "
        "(Rule 7 Table 1)."
    ),
    "RULE7.pass": "Font height {}mm meets statutory minimum of {}mm.",
    "RULE8.missing": "Placement could not be verified — check declarations are on the Principal Display Panel.",
    "RULE8.review": (
        "Improper declaration placement: declarations appear outside Principal Display Panel ('{}')."
    ),
    "RULE8.pass": "Declarations on Principal Display Panel: {}",
    "RULE9.missing": "Readability could not be assessed — manual legibility check required.",
    "RULE9.poor": "Poor declaration readability: declarations are not sufficiently legible/prominent.",
    "RULE9.fair": "Readability assessed as '{}' — manual legibility verification recommended.",
    "RULE9.pass": "Readability: {} — declarations are legible and prominent.",
}

# ---------------------------------------------------------------- visual checks
MIN_SHARPNESS = 45.0
MIN_CONTRAST = 22.0
NOMINAL_DPI = 150.0
MM_PER_INCH = 25.4
REGION_LIMITS = {
    "min_width": 50, "min_height": 10, "min_area": 180, "max_area_ratio": 0.45, "min_aspect_ratio": 0.30,
    "max_height_ratio": 0.75, "tall_ratio": 0.25, "min_width_for_tall_region": 90,
}
MIN_SIDE, MAX_SIDE, TARGET_SIDE = 32, 8192, 1280
BASE_PADDING, PADDING_HEIGHT_RATIO, PADDING_ASPECT = 20, 0.15, 3.0
UNCHECKED_READABILITY = "POOR (Unchecked)"
UNCHECKED_PLACEMENT = "Uncertain"

# ---------------------------------------------------------------- uploads
ALLOWED_CONTENT_TYPES = ["image/jpeg", "image/png", "image/webp", "image/jpg", "application/octet-stream"]
MAX_UPLOAD_BYTES = 15 * 1024 * 1024
MAX_BATCH_FILES = 10

# ---------------------------------------------------------------- records, search, reports
UUID_SHAPE = r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"
DEFAULT_CATEGORY = "Packaged Commodity"
ADMIN_ROLES = ["admin", "administrator"]
KNOWN_ROLES = ["admin", "inspector", "user"]
DEFAULT_OFFICER = "Enforcement Officer"
DEFAULT_INSPECTOR = "Inspector"
PLACEHOLDER_NAMES = [
    "inspector", "inspector officer", "enforcement officer", "guest inspector",
    "lead inspector", "offline officer", "user", "officer", "admin",
]
UPLOAD_PREFIX = "/api/uploads/"
STORAGE_PATH = r"^/storage/v1/object/(public|sign)/"

# text fields first, then the four tri-state flags and the mark, in record order
TEXT_FIELDS = [
    "manufacturer", "packer", "importer", "country_of_origin", "generic_name", "net_quantity",
    "manufacture_date", "best_before", "mrp", "unit_sale_price", "consumer_care", "veg_nonveg_mark",
]
FLAG_FIELDS = ["is_imported", "is_multi_product", "is_gm_food", "is_ecommerce"]
EXTRACTED_FIELDS = [
    "mrp", "net_quantity", "manufacture_date", "country_of_origin", "manufacturer", "consumer_care",
    "generic_name", "unit_sale_price",
]

# certificate rows: (label, field)
CERTIFICATE_ROWS = [
    ("Manufacturer / Packer Address", "manufacturer"),
    ("Country of Origin", "country_of_origin"),
    ("Common / Generic Commodity Name", "generic_name"),
    ("Net Quantity", "net_quantity"),
    ("Date of Manufacture / Packing", "manufacture_date"),
    ("Maximum Retail Price (MRP)", "mrp"),
    ("Unit Sale Price (USP)", "unit_sale_price"),
    ("Consumer Care Details", "consumer_care"),
]
CERTIFICATE_MISSING = ["missing", "none", "null"]
STATUS_TEXT = {"PASS": "COMPLIANT (PASS)", "FAIL": "NON-COMPLIANT (FAIL)"}
STATUS_TEXT_OTHER = "UNDER REVIEW"
# declarations catalogue: field, label, required, format hint
DECLARATIONS = [
    ("manufacturer", "Manufacturer/Packer/Importer name & address", True, None),
    ("country_of_origin", "Country of Origin", True, None),
    ("generic_name", "Common or generic name of the commodity", True, None),
    ("net_quantity", "Net Quantity", True, "number + unit (g/kg/ml/l/N)"),
    ("manufacture_date", "Month & Year of Manufacture", True, "MM/YYYY"),
    ("mrp", "Maximum Retail Price (inclusive of all taxes)", True, "₹ amount"),
    ("unit_sale_price", "Unit Sale Price (USP)", True,
     "₹ amount / unit (e.g. ₹ 16.00/100ml, ₹ 80/L for beverages; ₹ 0.28/g, ₹ 120/kg for solids)"),
    ("consumer_care", "Consumer Care details (name/address/phone/email)", True, None),
]

# client-side clause list: (field, clause, name, reason when absent)
CLAUSES = [
    ("manufacturer", "Rule 6(1)(a)", "Rule 6(1)(a) — Manufacturer / Packer Details",
     "Manufacturer or packer name and complete postal address missing."),
    ("country_of_origin", "Rule 6(1)(n)", "Rule 6(1)(n) — Country of Origin",
     "Country of origin not declared on packaging."),
    ("generic_name", "Rule 6(1)(c)", "Rule 6(1)(c) — Generic / Commodity Name",
     "Common or generic name of commodity not clearly declared."),
    ("net_quantity", "Rule 6(1)(b)", "Rule 6(1)(b) — Net Quantity in Metric Units",
     "Net quantity missing or not formatted in standard SI units."),
    ("manufacture_date", "Rule 6(1)(d)", "Rule 6(1)(d) — Date of Manufacture / Packing",
     "Month and year of manufacture or pre-packaging missing."),
    ("mrp", "Rule 6(1)(e)", "Rule 6(1)(e) — Maximum Retail Price (MRP incl. taxes)",
     "MRP inclusive of all taxes missing, altered, or illegible."),
    ("unit_sale_price", "Rule 6(1)(f)", "Rule 6(1)(f) — Unit Sale Price (USP)",
     "Unit sale price missing where required by packaged commodity rules."),
    ("consumer_care", "Rule 6(1)(g)", "Rule 6(1)(g) — Consumer Care Contact Details",
     "Consumer grievance redressal telephone number or email missing."),
]
CLAUSE_ABSENT = r"(?i)not detected|missing|n/a"
FONT_CLAUSE = ("Rule 7", "Rule 7 — Minimum Font Height & Legibility")

# chart buckets: (label, pattern on the rule name), first match wins, last one takes the rest
VIOLATION_BUCKETS = [
    ("Rule 6(1)(e) — MRP Missing / Altered", r"(?i)mrp|price"),
    ("Rule 6(1)(b) — Net Quantity Non-standard Units", r"(?i)quantity|net"),
    ("Rule 7 — Font Height Below 1.0 mm", r"(?i)font|height|rule 7"),
    ("Rule 6(1)(a) — Manufacturer Details Incomplete", r"(?i)manufacturer|packer|address"),
    ("Rule 6(1)(d) — Date of Packing Omitted", r"(?i)date|manufacture"),
    ("Rule 6(1)(f) — Unit Sale Price Missing", None),
]
