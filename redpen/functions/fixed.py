"""Word lists, patterns, codes and message texts.

Reports, rule tables and reviewers' files already in use depend on these exact
values, so they are stated here as data and nowhere else.  Patterns are in Java
syntax; ``(?U)`` gives whitespace, word and digit classes their Unicode meaning.
"""

# --- fixed values: word lists -------------------------------------------------

REWRITE_STOP_WORDS = [
    "the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "with",
    "by", "from", "as", "is", "are", "was", "were", "be", "that", "this",
]

OVERLAP_STOP_WORDS = [
    "the", "and", "for", "with", "from", "that", "this", "was", "were",
    "are", "is", "to", "of", "in", "on", "by", "or", "a", "an", "as",
    "avoid", "using", "phrase", "phrasing", "consider", "rephrasing",
    "obvious", "redundant", "information", "stating", "remove", "review",
]

CAPITAL_WORDS = [
    "critical", "high", "medium", "low", "informational",
    "confidentiality", "integrity", "availability",
]

INDEX_TITLES = ["list of figures", "list of tables", "table of contents"]

FIELD_LABELS = {
    "narrative": ["narrative", "vulnerability", "description"],
    "business_impact": ["business impact", "business imapct", "impact"],
    "recommendations": ["recommendations", "recommendation", "remediation"],
    "evidence": ["evidence", "proof", "observation", "poc", "proof of concept"],
    "reproduction": ["steps to reproduce", "reproduction steps", "reproduction", "reproduce"],
}

RUBRIC_AXES = ["look", "words", "tone", "information", "structure"]

AI_SOURCES = ["ai", "ai_review", "llm"]

# Unicode whitespace, the plain space first.
WHITESPACE = (
    " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: patterns ---------------------------------------------------

URL = r"(?iU)(https?://|www\.)\S+"
IPV4 = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6 = r"(?U)\b(?:[0-9A-Fa-f]{1,4}:){2,}[0-9A-Fa-f:]{1,4}\b"

SECRETS = {
    "AWS Access Key": r"AKIA[0-9A-Z]{16}",
    "Private Key": r"-----BEGIN (?:RSA|EC|OPENSSH) PRIVATE KEY-----",
    "JWT": r"eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}",
    "Bearer Token": r"Bearer\s+[A-Za-z0-9\-\._~\+\/]+=*",
    "Password Assignment": r"\bpassword\b\s*[:=]\s*[^\s]{6,}",
    "API Key Assignment": r"\b(?:api[_-]?key|token|secret)\b\s*[:=]\s*[^\s]{8,}",
}

EVIDENCE_MARKERS = [
    r"^figure\b", r"^fig\.\b", r"\bscreenshot\b", r"\bproof of concept\b",
    r"\bpoc\b", r"\bpacket capture\b", r"\bburp\b",
]

# The texts the markers above begin with or consist of.
EVIDENCE_WORDS = ["figure", "fig.", "screenshot", "proof of concept", "poc", "packet capture", "burp"]

THREAT_LABEL = r"(?iU)\bthreat\s*level\s*[:=]?\s*(critical|high|medium|low|informational)\b"
THREAT_WORD = r"(?iU)\b(critical|high|medium|low|informational)\b"
SEVERITY_WORD = r"(?iU)\b(critical|high|medium|low)\b"

CVSS_BEFORE = r"(?U)([0-9](?:\.[0-9])?)\s*cvss\s*:"
CVSS_AFTER = r"(?U)cvss\s*(?:v[0-9](?:\.[0-9])?)?\s*[:=]\s*([0-9](?:\.[0-9])?)"
CVSS_ANY = r"(?U)\b([0-9](?:\.[0-9])?)\b"

VERSION_TOKEN = r"(?i)(?:^|[^a-z0-9])v?([0-9]+)\.([0-9]+)(?:v)?(?:$|[^a-z0-9])"

DECISIONS = [
    ("reject", r"(?iU)\[\s*reject(?:ed)?\s*\]"),
    ("accept", r"(?iU)\[\s*accept(?:ed)?\s*\]"),
    ("reject", r"(?iU)\breject(?:ed)?\s*[:\-]"),
    ("accept", r"(?iU)\baccept(?:ed)?\s*[:\-]"),
    ("reject", r"(?iU)\A\s*reject(?:ed)?\s*\z"),
    ("accept", r"(?iU)\A\s*accept(?:ed)?\s*\z"),
]
MARKER = r"(?iU)\[\s*(?:reject|accept)(?:ed)?\s*\]"

REWRITE_NAMED = r'(?iU)Preferred rewrite:\s*"([^"]+)"\s*(?:->|=>)\s*"([^"]+)"'
REWRITE_BARE = r'(?iU)"([^"]+)"\s*(?:->|=>)\s*"([^"]+)"'
DIAGNOSTIC_COMMENT = r"(?isU)\A\[[^\]]+\]\[([^\]]+)\]\[[^\]]+\]\s*(.*)\z"

GROUNDING = [
    r"""(?iU)instead of\s+['"]([^'"]+)['"]""",
    r"""(?iU)replace\s+['"]([^'"]+)['"]\s+with""",
    r"""(?iU)rather than\s+['"]([^'"]+)['"]""",
]

FENCE = r"```(?:json)?\s*(.*?)```"

# --- fixed values: codes, severities and message texts --------------------------

BLANK_PAGES = ("warning", "DOC-FMT-PAGE-001", "Likely blank page(s) detected around manual page breaks (count %d).")
INDEX_HEADING = ("suggestion", "DOC-FMT-INDEX-001", '"%s" is not using a heading style; it may not appear correctly in the index/TOC.')
REPETITION = ("warning", "DOC-STYLE-REDUND-001", 'Repeated phrase appears %d times: "%s"')
SENSITIVE = ("warning", "DOC-SENS-001", "Possible sensitive data detected: %s")
HYGIENE = ("suggestion", "DOC-STYLE-HYGIENE-001")
REPEATED_WORD = "Repeated word"
DOUBLE_SPACES = "Double spaces"
MID_CAPITAL = 'Mid-sentence capitalization: "%s"'
DEPRECATED = ("suggestion", "DOC-STYLE-DEPRECATED-001", 'Deprecated phrase found: "%s" (count %d)')
DEPRECATED_AI = ("suggestion", "DOC-STYLE-DEPRECATED-AI-001", 'AI-learned deprecated phrase found: "%s" (count %d)')
CASE = ("suggestion", "DOC-STYLE-CASE-001", 'Preferred casing: "%s"')
REWRITE = ("suggestion", "DOC-STYLE-REWRITE-001", 'Preferred rewrite: "%s" -> "%s"')
PARAGRAPH_STYLES = ("suggestion", "DOC-FMT-PARA-001", "Paragraph styles outside learned baseline: %s.")
TABLE_COLUMNS = ("suggestion", "DOC-FMT-TBL-001", "Table column patterns outside learned baseline: %s.")
IMAGE_WIDTHS = ("suggestion", "DOC-FMT-IMG-001", "Found %d image(s) outside learned width range (%d-%d EMU).")
NO_NARRATIVE = ("warning", "FND-STRUCT-005", "Missing narrative section.")
REQUIRED_FIELDS = [
    ("business_impact", "error", "FND-STRUCT-001", "Missing business impact section."),
    ("recommendations", "error", "FND-STRUCT-002", "Missing recommendations section."),
    ("evidence", "warning", "FND-STRUCT-003", "Missing evidence section."),
    ("reproduction", "warning", "FND-STRUCT-004", "Missing reproduction section."),
]
SHORT_FIELDS = [
    ("evidence", "warning", "FND-QUAL-001", "Evidence content appears too short."),
    ("reproduction", "warning", "FND-QUAL-002", "Reproduction content appears too short."),
]
SHORT_NARRATIVE = ("suggestion", "FND-QUAL-003", "Narrative appears too short for a clear story of the issue.")
NARRATIVE_REPEATS = ("suggestion", "FND-QUAL-004", 'Narrative repeats a sentence %d times: "%s"')
CVSS_MISMATCH = ("warning", "FND-CONSIST-001", 'Severity "%s" does not match CVSS %s (expected %s).')
REVIEW_CODE = "LLM-NARR-001"
REVIEW_UNPARSED = ("warning", "LLM-PARSE-001", "LLM returned non-JSON output for narrative review.")
REVIEW_DEFAULTS = {"severity": "suggestion", "message": "Narrative issue detected.", "location_hint": "Narrative"}

GUIDE_DEPRECATED = "Avoid overused/deprecated phrasing like: %s."
GUIDE_AI_DEPRECATED = "AI-learned deprecated phrasing to avoid: %s."
GUIDE_REWRITES = "Preferred rewrite patterns:\n- %s"
GUIDE_STYLE_RULES = "AI-learned style rules:\n- %s"

# --- fixed values: thresholds and caps that are part of the result -----------------

ACCEPTED_REWRITE_COUNT = 9999
EVIDENCE_CONTEXT = 20
LOCATION_CHARS = 120
NARRATIVE_CHARS = 8000
RULE_MESSAGE_CHARS = 220
EXAMPLE_CHARS = 220
