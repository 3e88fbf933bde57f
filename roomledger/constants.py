"""Fixed values that must equal the reference's for right results.

Everything in this module is data, not logic: source names and their
priority, phrase patterns, keyword lists, lookup sets, enum codes and
limits.  They are written out plainly, in the reference's own order.
Operators take them as default parameters, so a caller can pass other
values (the driver-table checks do, because the driver's text is not
Dutch).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference's)
# ---------------------------------------------------------------------------

# Sources in priority order; the position (1-based) is `site_rank`.
SOURCES = [
    "kotwijs.be",
    "2dehands.be",
    "huurwoningen.be",
    "immoweb.be",
    "zimmo.be",
]

# "Listing is taken" phrases, matched as whole words, case-insensitive.
UNAVAILABLE_PATTERNS = [
    r"\bverhuurd\b",
    r"\bal verhuurd\b",
    r"\bbezet\b",
    r"\bniet (?:meer )?beschikbaar\b",
    r"\blou[ée]\b",
    r"\bpas disponible\b",
    r"\bnot available\b",
    r"\bonder optie\b",
    r"\bin optie\b",
]

# First Belgian-format number in a text ("1.250", "650,50", "599").
AMOUNT_PATTERN = r"\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?"

# Price in free text, after a euro sign.
EURO_TEXT_PATTERN = r"€\s*([\d.,]+)"

# Class-name patterns for the first matching element (case-insensitive).
PRICE_CLASS_PATTERN = r"price|prijs|rent"
ADDRESS_CLASS_PATTERN = r"listing-detail-summary__location|adres|address|locatie"

# Size patterns: on a size attribute, and on free text (case-insensitive).
SIZE_ATTR_PATTERN = r"(\d+)\s*m"
SIZE_TEXT_PATTERN = r"(\d+)\s*m[²2]"

# "Available from" patterns per text source (case-insensitive).
AVAILABLE_CLASSIFIEDS_PATTERN = r"beschikbaar\s+(?:vanaf|per)\s*[:\-]?\s*([\w\d/\-\. ]{3,20})"
AVAILABLE_RENTALS_PATTERN = (
    r"beschikbaar\s+(?:vanaf|per)?\s*[:\-]?\s*([\d]{1,2}[-/][\d]{1,2}[-/][\d]{2,4}|[\w]+ \d{4})"
)
AVAILABLE_JSPAGES_PATTERN = r"beschikbaar\s+(?:vanaf|per)?\s*[:\-]?\s*([\d]{1,2}[-/][\d]{1,2}[-/][\d]{2,4})"

# Detail-link patterns.
RENTALS_DETAIL_HREF = r"^(?:https?://[^/]+)?/huurwoning/[a-z0-9-]+/?$"  # case-insensitive
JSPAGES_DETAIL_HREF = r"/te-huur/.*/[A-Z0-9]{4,8}/?$"  # case-sensitive

# Next-page link text, and the classifieds next-page path.
NEXT_PAGE_TEXT_PATTERN = r"volgende|next|›|»"
CLASSIFIEDS_NEXT_PAGE = "/q/kot+leuven/p/{page}/"

# Classifieds: marker of an ad link, and the supply categories.
CLASSIFIEDS_AD_MARKER = "/v/immo/"
SUPPLY_CATEGORIES = [
    "appartementen-en-studio-s-te-huur",
    "kamers-te-huur",
    "studentenkamers-te-huur",
    "woningen-te-huur",
    "gemeubelde-appartementen-te-huur",
]

# Values in inline scripts.
EMBEDDED_STRING = r'"{key}":"([^"]+)"'
EMBEDDED_INTEGER = r'"{key}":\s*(\d+)'

# JSON-LD @type names accepted by the rental-pages source.
JSONLD_TYPES = [
    "Accommodation",
    "Apartment",
    "House",
    "Product",
    "Offer",
    "Residence",
    "SingleFamilyResidence",
    "Room",
]

# Card selectors, tried in order (tag, class pattern, case-insensitive).
CARD_SELECTORS = [
    ("article", r"listing|property|result|huurwoning|card"),
    ("div", r"listing-card|property-card|huurwoning|result-item"),
    ("li", r"listing|property|result|huurwoning"),
]

# Attribute list classes on classifieds detail pages.
ATTR_ITEM_CLASS = r"Attributes-module-item"
ATTR_LABEL_CLASS = r"Attributes-module-label"
ATTR_VALUE_CLASS = r"Attributes-module-value"
ATTR_SIZE_LABEL = "woonoppervlakte"

# Area: postcodes and localities of the target city.
AREA_POSTCODES = ["3000", "3001", "3010", "3012", "3018", "3020", "3040", "3051", "3052", "3053", "3054"]
AREA_LOCALITIES = [
    "leuven",
    "louvain",
    "heverlee",
    "kessel-lo",
    "kessel lo",
    "wilsele",
    "wijgmaal",
    "korbeek-lo",
    "korbeek lo",
    "sint-joris-weert",
    "blanden",
    "vaalbeek",
    "oud-heverlee",
]
AREA_NAME = "leuven"
AREA_CODE = "3000"

# Ads bigger AND pricier than this are family homes.
MAX_SIZE_M2 = 100
MAX_PRICE = 1400

# Unit-API enums.
UNIT_TYPES = {1: "Kamer", 2: "Studio", 3: "Appartement", 4: "Residentie", 5: "Huis"}
OPT_PRIVATE_BATHROOM = 5
OPT_PRIVATE_KITCHEN = 6
OPT_INTERNET_WIFI = 10
OPT_INTERNET_CABLE = 11
OPT_FURNISHED = 12
COST_COVERED = [1, 2, 3]
UNIT_PAGE_SIZE = 100

# Search-JSON source paging.
SEARCH_PAGE_SIZE = 30
SEARCH_DEFAULT_PAGES = 30
SEARCH_EMPTY_STREAK = 3

# Search-JSON URL pattern defaults and listing URL templates.
SEARCH_URL_TEMPLATE = "https://www.immoweb.be/en/classified/{type}/for-rent/{locality}/{postcode}/{id}"
SEARCH_URL_DEFAULTS = {"type": "apartment", "locality": "leuven", "postcode": "3000"}
UNIT_SITE = "https://www.kotwijs.be"
UNIT_LISTING_PATH = "/link/listing/"

# Site roots used to resolve relative links.
CLASSIFIEDS_BASE = "https://www.2dehands.be"
RENTALS_BASE = "https://huurwoningen.be"
JSPAGES_BASE = "https://www.zimmo.be"

# Test mode: listings per source.
TEST_MODE_LIMIT = 3

# Output: column labels in sheet order, with the canonical column each shows.
PRESENT_COLUMNS = [
    ("Link", "url"),
    ("Source", "source"),
    ("Title", "title"),
    ("Address", "address"),
    ("Neighborhood", "neighborhood"),
    ("Price (€/month)", "price_eur_month"),
    ("Size (m²)", "size_m2"),
    ("Price/m²", "price_per_m2"),
    ("Type", "listing_type"),
    ("Furnished", "furnished"),
    ("Private bathroom", "private_bathroom"),
    ("Shared bathroom", "shared_bathroom"),
    ("Private kitchen", "private_kitchen"),
    ("Shared kitchen", "shared_kitchen"),
    ("Internet included", "internet_included"),
    ("Utilities included", "utilities_included"),
    ("Washing machine", "washing_machine"),
    ("Elevator", "elevator"),
    ("Pets allowed", "pets_allowed"),
    ("Available from", "available_from"),
    ("Scraped on", "scraped_on"),
]
SUMMARY_LABELS = {"run": "Scraped on", "total": "Listings found", "per_source": "Per website"}

# Keyword dictionaries: feature -> keywords (substring match on lower-cased text).
KEYWORDS_CLASSIFIEDS = {
    "furnished": ["gemeubeld", "gemeubileerd", "bemeubeld", "furnished"],
    "private_bathroom": ["eigen badkamer", "eigen douche", "eigen sanitair", "private badkamer", "own bathroom"],
    "shared_bathroom": ["gedeelde badkamer", "gemeenschappelijke badkamer", "shared bathroom"],
    "private_kitchen": ["eigen keuken", "kitchenette", "private keuken"],
    "shared_kitchen": ["gedeelde keuken", "gemeenschappelijke keuken", "shared kitchen"],
    "internet_included": ["internet inbegrepen", "incl. internet", "inclusief internet", "wifi inbegrepen",
                          "internet included"],
    "utilities_included": ["all-in", "all in", "kosten inbegrepen", "inclusief kosten", "lasten inbegrepen",
                           "charges incluses"],
    "washing_machine": ["wasmachine", "washing machine"],
    "elevator": ["lift ", "lift,", "lift.", "elevator"],
    "pets_allowed": ["huisdieren toegelaten", "huisdieren welkom", "pets allowed"],
}
KEYWORDS_RENTALS = {
    "furnished": ["gemeubeld", "gemeubileerd", "furnished"],
    "private_bathroom": ["eigen badkamer", "eigen douche", "eigen sanitair"],
    "shared_bathroom": ["gedeelde badkamer", "gemeenschappelijke badkamer"],
    "private_kitchen": ["eigen keuken", "kitchenette"],
    "shared_kitchen": ["gedeelde keuken", "gemeenschappelijke keuken"],
    "internet_included": ["internet inbegrepen", "inclusief internet", "incl. internet", "wifi inbegrepen"],
    "utilities_included": ["kosten inbegrepen", "all-in", "all in", "inclusief kosten", "verwarming inbegrepen"],
    "washing_machine": ["wasmachine"],
    "elevator": ["lift ", "lift,", "lift."],
    "pets_allowed": ["huisdieren toegelaten", "huisdieren welkom"],
}
KEYWORDS_JSPAGES = {
    "furnished": ["gemeubeld", "gemeubileerd", "bemeubeld"],
    "private_bathroom": ["eigen badkamer", "eigen douche", "eigen sanitair"],
    "shared_bathroom": ["gedeelde badkamer", "gemeenschappelijke badkamer"],
    "private_kitchen": ["eigen keuken", "kitchenette"],
    "shared_kitchen": ["gedeelde keuken", "gemeenschappelijke keuken"],
    "internet_included": ["internet inbegrepen", "inclusief internet", "wifi inbegrepen"],
    "utilities_included": ["kosten inbegrepen", "all-in", "all in", "verwarming inbegrepen"],
    "washing_machine": ["wasmachine"],
    "elevator": ["lift ", "lift,", "lift."],
    "pets_allowed": ["huisdieren toegelaten", "huisdieren welkom"],
}
KEYWORDS_UNIT_API = {
    "washing_machine": ["wasmachine", "washing machine", "wasserette"],
    "elevator": ["lift ", "lift,", "lift.", "elevator"],
    "pets_allowed": ["huisdieren toegelaten", "huisdieren welkom", "pets allowed"],
}

# Listing type by keyword, first rule that matches wins.
TYPE_RULES_CLASSIFIEDS = [
    ("Studio", ["studio"]),
    ("Appartement", ["appartement", "apartment"]),
    ("Kamer", ["kamer", "kot", "room"]),
]
TYPE_RULES_RENTALS = [
    ("Studio", ["studio"]),
    ("Appartement", ["appartement"]),
    ("Kamer", ["kamer", "room"]),
]
TYPE_RULES_JSPAGES = [
    ("Studio", ["studio"]),
    ("Kamer", ["studentenkamer", "kamer"]),
    ("Appartement", ["appartement"]),
]

# Text windows read by the availability check (characters of the scope text).
RENTALS_SCOPE_CHARS = 1000
JSPAGES_SCOPE_CHARS = 800

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------


def site_rank(source: str) -> int:
    """1-based priority of a source; earlier sources win deduplication."""
    return SOURCES.index(source) + 1
