"""Rule tables kept as data.

Every operator takes its rules as an argument and defaults to the tables
below, so a deployment can swap or extend them without touching code.
Patterns are written in Python ``re`` syntax; ``querywarden.functions.regex``
adapts them to Java (Spark) or RE2 (DuckDB oracle) semantics.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PiiRule:
    name: str
    pattern: str
    placeholder: str
    case_insensitive: bool
    high_risk: bool


@dataclass(frozen=True)
class PatternRule:
    rule_id: str
    pattern: str
    case_insensitive: bool


# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the behaviour being reproduced. Do not edit
# to make a test pass; order matters (earlier rules see raw text, later
# rules see text already redacted by earlier ones).
# ---------------------------------------------------------------------------

MAX_BODY_BYTES = 16 * 1024
MAX_QUERY_LENGTH = 200
MAX_RESULTS = 5
MAX_SNIPPET_LENGTH = 500
MAX_CONTEXT_LENGTH = 4000
PAD_BUCKETS = (256, 512, 1024)
JITTER_MS = (500, 3000)
DECOY_GAP_MS = (200, 1500)
AUDIT_SEGMENT_BYTES = 50 * 1024 * 1024
HIGH_RISK_MIN = 2
REDACTED_RATIO = 0.5

REASON_EMPTY = "empty query"
REASON_HIGH_RISK = "query contains multiple high-risk identifiers"
REASON_TOO_MUCH_PII = "query contains too much PII"
REASON_UNIQUE = "contains highly unique/identifying terms"
UNIQUENESS_WARNING_PREFIX = "This query contains potentially identifying terms: "
CONTEXT_HEADER = "The following information was retrieved from web search:\n"
CONTEXT_TRUNCATION = "\n[... truncated for length]"
AUDIT_EVENT = "web_search"
SEARCH_LANGUAGE = "en"
SEARCH_SAFESEARCH = "1"

PII_RULES: tuple[PiiRule, ...] = (
    PiiRule("email", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", "[EMAIL]", False, False),
    PiiRule("phone", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE]", False, False),
    PiiRule("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]", False, True),
    PiiRule("card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "[CARD]", False, True),
    PiiRule("bank_account", r"\b(?:account|acct)[\s:#-]*\d{6,17}\b", "[BANK_ACCOUNT]", True, True),
    PiiRule("routing", r"\b(?:routing|aba)[\s:#-]*\d{9}\b", "[ROUTING]", True, True),
    PiiRule("passport", r"\b(?:passport)[\s:#-]*[A-Z0-9]{6,12}\b", "[PASSPORT]", True, True),
    PiiRule("address", r"\b\d{1,6}\s+[A-Za-z0-9.'-]+(?:\s+[A-Za-z0-9.'-]+)*\s+(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Drive|Dr|Lane|Ln|Court|Ct)\b", "[ADDRESS]", True, False),
    PiiRule("ip", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP]", False, False),
    PiiRule("dob", r"\b(?:born|dob|birthday)[:\s]+\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b", "[DOB]", True, False),
    PiiRule("api_key", r"\b(?:sk-|pk-|api[_-]?key[:\s=]+)[a-zA-Z0-9]{20,}\b", "[API_KEY]", True, True),
    PiiRule("hex_token", r"\b[a-fA-F0-9]{32,}\b", "[HEX_TOKEN]", False, True),
)

# Cheap superset test: every PII rule needs a digit, '@', one of these
# keywords or 32 hex letters, so rows failing it skip the 12-step chain.
PII_GATE = r"[\d@]|passport|[sp]k-|api[_-]?key|[a-f]{32}"

# Per-rule necessary conditions, checked on the same text the rule sees
# (so they are supersets by construction): a literal the match must
# contain, or a short pattern (with the rule's case flag) it must contain.
PII_GUARDS: dict[str, tuple[str, str]] = {
    "email": ("literal", "@"),
    "phone": ("regex", r"\d"),
    "ssn": ("literal", "-"),
    "card": ("regex", r"\d"),
    "bank_account": ("regex", r"acc"),
    "routing": ("regex", r"routing|aba"),
    "passport": ("regex", r"passport"),
    "address": ("regex", r"\s(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Drive|Dr|Lane|Ln|Court|Ct)\b"),
    "ip": ("literal", "."),
    "dob": ("regex", r"born|dob|birthday"),
    "api_key": ("regex", r"sk-|pk-|api"),
}

RARE_TERM_RULES: tuple[PatternRule, ...] = (
    PatternRule("proper_name", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", False),
    PatternRule("street_address", r"\b\d+\s+[A-Z][a-z]+\s+(?:St|Ave|Rd|Blvd|Dr|Ln|Ct)\b", False),
    PatternRule("case_id", r"\b[A-Z]{2,}\s*-?\s*\d{3,}\b", False),
    PatternRule("rare_disease", r"\brare\s+disease\b", True),
    PatternRule("case_reference", r"\bcase\s+(?:no|number|#)\s*\d+\b", True),
)

INJECTION_RULES: tuple[PatternRule, ...] = (
    PatternRule("ignore_instructions", r"ignore\s+(?:all\s+)?(?:previous|above|prior)\s+instructions", True),
    PatternRule("you_are_now", r"you\s+are\s+now\s+(?:a|an|in)\s+", True),
    PatternRule("system_prompt", r"system\s*prompt\s*:", True),
    PatternRule("active_tag", r"<\s*(?:script|iframe|object|embed)", True),
    PatternRule("javascript_uri", r"javascript\s*:", True),
    PatternRule("data_html_uri", r"data\s*:\s*text/html", True),
)

HTML_TAG = r"<[^>]+>"

# keyword -> broader category; first keyword (in this order) contained in
# the lower-cased query wins.
CATEGORY_KEYWORDS: tuple[tuple[str, str], ...] = (
    ("treatment", "medical conditions"),
    ("symptom", "health information"),
    ("disease", "medical conditions"),
    ("diagnosis", "health information"),
    ("medication", "pharmaceutical information"),
    ("drug", "pharmaceutical information"),
    ("lawyer", "legal services"),
    ("attorney", "legal services"),
    ("lawsuit", "legal news"),
    ("court", "legal news"),
    ("salary", "employment statistics"),
    ("income", "financial planning"),
    ("debt", "financial planning"),
    ("invest", "financial news"),
    ("crypto", "financial news"),
    ("divorce", "family law"),
    ("custody", "family law"),
    ("arrest", "crime news"),
    ("criminal", "crime news"),
    ("immigration", "government services"),
    ("visa", "travel documents"),
    ("passport", "travel documents"),
    ("addiction", "health information"),
    ("rehab", "health information"),
    ("therapy", "mental health"),
    ("depression", "mental health"),
    ("anxiety", "mental health"),
)

DECOY_QUERIES: tuple[str, ...] = (
    "weather forecast today",
    "world news headlines",
    "popular recipes",
    "movie reviews 2026",
    "stock market update",
    "sports scores today",
    "technology news",
    "book recommendations",
    "travel destinations",
    "music new releases",
    "science discoveries",
    "health tips",
    "home improvement ideas",
    "gardening basics",
    "history facts",
    "programming tutorials",
    "fitness exercises",
    "cooking techniques",
    "photography tips",
    "language learning",
    "best restaurants near me",
    "how to change a tire",
    "local events this weekend",
    "job interview tips",
    "budget travel planning",
    "online learning platforms",
    "pet care advice",
    "diy crafts for beginners",
    "smartphone comparison 2026",
    "electric vehicle reviews",
    "climate change statistics",
    "space exploration news",
    "mental health resources",
    "investment strategies",
    "home workout routines",
    "organic food benefits",
    "renewable energy facts",
    "video game releases 2026",
    "interior design trends",
    "car maintenance schedule",
    "hiking trails nearby",
    "resume writing guide",
    "sleep improvement tips",
    "public transit schedules",
    "volunteer opportunities",
    "digital privacy guide",
    "meal prep ideas",
    "apartment hunting tips",
    "common houseplant care",
    "tax preparation help",
    "camping gear checklist",
    "first aid basics",
    "music theory fundamentals",
    "recycling guidelines",
    "time management techniques",
    "outdoor grilling recipes",
    "yoga for beginners",
    "home energy efficiency",
    "water conservation tips",
    "college application advice",
    "podcast recommendations",
    "bicycle maintenance",
    "coffee brewing methods",
    "board game suggestions",
    "seasonal allergy remedies",
    "mindfulness meditation",
    "weekend brunch ideas",
    "local library services",
    "skin care routine",
    "bird watching guide",
    "earthquake preparedness",
    "foreign currency exchange",
    "used car buying guide",
    "composting for beginners",
    "national park information",
    "free online courses",
    "home security systems",
    "holiday gift ideas",
    "effective study habits",
    "community garden programs",
)

# Policy defaults applied when a key is absent.
POLICY_DEFAULTS = {
    "dp_enabled": True,
    "decoy_count": 2,
    "uniqueness_mode": "warn",
    "batch_window": 5.0,
}

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------


def high_risk_placeholders(rules=PII_RULES) -> list[str]:
    return [r.placeholder for r in rules if r.high_risk]
