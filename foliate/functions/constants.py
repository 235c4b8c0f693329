"""Fixed values.

Everything here must equal the published behaviour for results to agree: word lists, patterns,
confidences, codes, messages and status tables. Patterns are written in the subset of regex syntax
that Java and RE2 share, with Unicode classes spelled out, so that the same text works in Spark and
in the SQL check.
"""

# --- characters -------------------------------------------------------------------------------
# White space as Python's str.strip() and \s see it.
WHITESPACE = "".join(
    map(
        chr,
        (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
         0x2028, 0x2029, 0x202F, 0x205F, 0x3000),
    )
)
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"

# --- section classification -------------------------------------------------------------------
STATIC = "STATIC"
DYNAMIC = "DYNAMIC"
RULE_BASED = "rule_based"
LLM_ASSISTED = "llm_assisted"
FALLBACK = "fallback"
HIGH = "high"
MEDIUM = "medium"
LOW = "low"
DEFAULT_THRESHOLD = 0.85
FALLBACK_CONFIDENCE = 0.5
FALLBACK_REASON = "Conservative fallback: defaulting to STATIC when classification inconclusive"


def _word(*words: str) -> str:
    """Any of the words or phrases, whole, in any case."""
    return rf"(?i)(?:\A|[^{WORD}])(?:{'|'.join(words)})(?:\z|[^{WORD}])"


_LEGAL = ("disclaimer", "confidential", "privileged", "copyright", "all rights reserved")
_BOILERPLATE = ("this document", "prepared by", "professional advice", "should not be construed")
_CONTACT = ("tel:", "email:", "address:", "phone:", "fax:")
_MARKER = ("to be completed", "insert", "customize", "client-specific", "personalized")
_VARIABLE = ("client name", "company name", "project name", "date", "amount", "percentage")
_NARRATIVE = ("our analysis", "we recommend", "specific to", "tailored", "customized approach")

# (section type, confidence, reason, pattern, literals), first match wins. A text that holds none of
# the literals in lower case cannot match the pattern; without literals the pattern itself decides.
RULES = (
    (STATIC, 0.95, "Legal disclaimer or confidentiality notice", _word(*_LEGAL), _LEGAL),
    (STATIC, 0.92, "Standard boilerplate text", _word(*_BOILERPLATE), _BOILERPLATE),
    (STATIC, 0.95, "Fixed header or footer content",
     r"(?i)\A(?:page \p{Nd}+|proprietary|internal use only)", ()),
    (STATIC, 0.90, "Fixed contact information",
     rf"(?i)(?:\A|[^{WORD}])(?:{'|'.join(_CONTACT)})", _CONTACT),
    (STATIC, 0.92, "Section heading or label (static structure)",
     r"(?i)\A(?:meeting notes?|action items?|agenda|attendees?|date|time|location|subject"
     rf"|discussion|notes?):?[{WS}]*\z", ()),
    (STATIC, 0.90, "Document section heading (static structure)",
     r"(?i)\A(?:executive summary|introduction|background|overview|conclusion|recommendations?"
     rf"|next steps):?[{WS}]*\z", ()),
    (DYNAMIC, 0.95, "Contains placeholder syntax",
     r"\{[^}]+\}|\[[^\]]+\]|<[^>]+>|\$\{[^}]+\}", ("{", "[", "<")),
    (DYNAMIC, 0.92, "Explicit customization marker", _word(*_MARKER), _MARKER),
    (DYNAMIC, 0.88, "Contains variable references", _word(*_VARIABLE), _VARIABLE),
    (DYNAMIC, 0.85, "Client-specific narrative content", _word(*_NARRATIVE), _NARRATIVE),
)
# Characters that fold to ASCII letters without being lower-cased to them.
ODD_LETTERS = ("\u017f", "\u0131", "\u0130", "\u212a")

# (section type, confidence, justification) of the structural and heuristic rules.
HEADER_FOOTER_RULE = (STATIC, 0.95, "Header or footer block type")
TOP_HEADING_RULE = (STATIC, 0.70, "Top-level heading typically structural")
SHORT_RULE = (STATIC, 0.75, "Very short content, likely structural label")
CAPS_RULE = (STATIC, 0.80, "ALL CAPS short text, likely static header")
NARRATIVE_RULE = (DYNAMIC, 0.72, "Long narrative paragraph, likely client-specific content")
SHORT_LENGTH = 10
CAPS_LENGTH = 50
NARRATIVE_LENGTH = 200
NARRATIVE_WORDS = 50

# --- structure suggestions --------------------------------------------------------------------
SUGGESTION_TYPES = ("promote_to_heading", "adjust_level", "merge_list")

# --- content validation -----------------------------------------------------------------------
EMPTY_CONTENT = "EMPTY_CONTENT"
NEAR_EMPTY_CONTENT = "NEAR_EMPTY_CONTENT"
CONTENT_TOO_LONG = "CONTENT_TOO_LONG"
CONTENT_TOO_SHORT = "CONTENT_TOO_SHORT"
CONTAINS_MARKUP = "CONTAINS_MARKUP"
CONTAINS_TAGS = "CONTAINS_TAGS"
CONTAINS_HEADERS = "CONTAINS_HEADERS"
CONTAINS_FORMATTING = "CONTAINS_FORMATTING"
STRUCTURAL_MODIFICATION = "STRUCTURAL_MODIFICATION"
REPETITIVE_CONTENT = "REPETITIVE_CONTENT"
BOILERPLATE_ONLY = "BOILERPLATE_ONLY"

MIN_LENGTH = 1
MAX_LENGTH = 50000
MIN_MEANINGFUL = 10
MIN_UNIQUE_WORDS = 5
MAX_REPETITION = 0.5

HTML_TAG = r"<[a-zA-Z][^>]*>|</[a-zA-Z]+>"
MD_HEADER = rf"#{{1,6}}[{WS}]+[^\n]+$"
BOLD_ITALIC = r"\*{1,3}[^*]+\*{1,3}|_{1,3}[^_]+_{1,3}"
LINK = r"\[[^\]]+\]\([^)]+\)"
CODE = r"(?s)```.*?```|`[^`]+`"
HORIZONTAL_RULE = r"[-*_]{3,}$"
TABLE_ROW = r"\|[^\n]*\|$"
NUMBERING = rf"(?:\p{{Nd}}+\.|\p{{Nd}}+\)|\(\p{{Nd}}+\)|[a-zA-Z]\.|\([a-zA-Z]\))[{WS}]+"

# At the start of the trimmed text or of any line, any case.
BOILERPLATE = (
    "lorem ipsum",
    "placeholder",
    rf"todo:?[{WS}]*$",
    rf"tbd:?[{WS}]*$",
    r"\[insert[^\n]*\]$",
    "content goes here",
    "sample text",
)

# The older constraint validator: each at line start unless noted, any one rejects.
CONSTRAINT_PATTERNS = (
    ("^#+\\s", rf"^#+[{WS}]"),
    ("^\\*{3,}", r"^\*{3,}"),
    ("^-{3,}", "^-{3,}"),
    ("^={3,}", "^={3,}"),
    ("^\\|.*\\|", r"^\|[^\n]*\|"),
    ("^```", "^```"),
    ("<[a-zA-Z][^>]*>", "<[a-zA-Z][^>]*>"),
    ("\\[.*\\]\\(.*\\)", r"\[[^\n]*\]\([^\n]*\)"),
)

# --- failures and retry -----------------------------------------------------------------------
VALIDATION_FAILURE = "VALIDATION_FAILURE"
GENERATION_FAILURE = "GENERATION_FAILURE"
RETRY_EXHAUSTION = "RETRY_EXHAUSTION"
STRUCTURAL_VIOLATION = "STRUCTURAL_VIOLATION"
BOUNDS_VIOLATION = "BOUNDS_VIOLATION"
QUALITY_FAILURE = "QUALITY_FAILURE"
UNEXPECTED_ERROR = "UNEXPECTED_ERROR"

MAX_RETRIES = 3
MAX_BACKOFF_SECONDS = 16
RETRY_ELIGIBLE = (GENERATION_FAILURE, BOUNDS_VIOLATION)
NON_RETRYABLE_CODES = (
    "STRUCTURAL_VIOLATION",
    "QUALITY_FAILURE",
    "VALIDATION_FAILURE",
    "CONTAINS_MARKUP",
    "CONTAINS_TAGS",
    "CONTAINS_HEADERS",
    "STRUCTURAL_MODIFICATION",
)
OUTPUT_STATUSES = ("PENDING", "IN_PROGRESS", "COMPLETED", "FAILED", "RETRYING", "VALIDATED")

# --- jobs -------------------------------------------------------------------------------------
JOB_STATUSES = ("PENDING", "RUNNING", "COMPLETED", "FAILED")
JOB_TYPES = ("PARSE", "CLASSIFY", "GENERATE", "REGENERATE", "REGENERATE_SECTIONS")
STAGE_JOB_TYPES = ("PARSE", "CLASSIFY", "GENERATE")
LEGAL_TRANSITIONS = (
    ("PENDING", "RUNNING"),
    ("PENDING", "FAILED"),
    ("RUNNING", "COMPLETED"),
    ("RUNNING", "FAILED"),
)
STUCK_MINUTES = 30
HEARTBEAT_TTL_SECONDS = 60
RUN_STAGES = (
    "INPUT_PREPARATION",
    "SECTION_GENERATION",
    "DOCUMENT_ASSEMBLY",
    "DOCUMENT_RENDERING",
    "VERSIONING",
)

# --- error catalogue: code, category, severity, recovery action, retryable --------------------
ERROR_CATALOGUE = (
    ("VALIDATION_INVALID_WORD_UPLOAD", "VALIDATION", "LOW", "RETRY", True),
    ("VALIDATION_INVALID_CLIENT_DATA", "VALIDATION", "LOW", "RETRY", True),
    ("PARSING_FAILURE", "PARSING", "MEDIUM", "RETRY", True),
    ("PARSING_MALFORMED_DOCUMENT", "PARSING", "MEDIUM", "MANUAL_INTERVENTION", False),
    ("CLASSIFICATION_FAILURE", "CLASSIFICATION", "MEDIUM", "RETRY", True),
    ("GENERATION_FAILURE", "GENERATION", "MEDIUM", "RETRY", True),
    ("GENERATION_VALIDATION_REJECTION", "GENERATION", "LOW", "RETRY", True),
    ("JOB_CRASH", "INFRASTRUCTURE", "HIGH", "RESTART", True),
    ("JOB_TIMEOUT", "INFRASTRUCTURE", "MEDIUM", "RESTART", True),
    ("REGENERATION_CONFLICT", "REGENERATION", "LOW", "RETRY", True),
)

# --- audit rows: event → entity type, action, metadata keys ------------------------------------
AUDIT_EVENTS = {
    "generation_initiated": ("GENERATION_BATCH", "GENERATION_INITIATED", ("document_id", "template_version_id", "version_intent", "total_sections", "job_id")),
    "section_completed": ("SECTION_OUTPUT", "SECTION_GENERATION_COMPLETED", ("batch_id", "section_id", "document_id", "content_hash", "content_length", "generation_duration_ms", "job_id")),
    "section_failed": ("SECTION_OUTPUT", "SECTION_GENERATION_FAILED", ("batch_id", "section_id", "document_id", "error_code", "error_message", "retry_count", "job_id")),
    "batch_completed": ("SECTION_OUTPUT_BATCH", "BATCH_GENERATION_COMPLETED", ("document_id", "completed_sections", "failed_sections", "total_sections", "job_id")),
    "batch_failed": ("SECTION_OUTPUT_BATCH", "BATCH_GENERATION_FAILED", ("document_id", "error_code", "error_message", "job_id")),
    "assembly_completed": ("ASSEMBLED_DOCUMENT", "DOCUMENT_ASSEMBLY_COMPLETED", ("document_id", "template_version_id", "version_intent", "total_blocks", "dynamic_blocks_count", "static_blocks_count", "injected_sections_count", "assembly_hash", "assembly_duration_ms", "job_id")),
    "assembly_failed": ("ASSEMBLED_DOCUMENT", "DOCUMENT_ASSEMBLY_FAILED", ("document_id", "template_version_id", "version_intent", "error_code", "error_message", "job_id")),
    "rendering_completed": ("RENDERED_DOCUMENT", "DOCUMENT_RENDERING_COMPLETED", ("document_id", "version", "output_path", "content_hash", "file_size_bytes", "total_blocks_rendered", "rendering_duration_ms", "job_id")),
    "rendering_failed": ("RENDERED_DOCUMENT", "DOCUMENT_RENDERING_FAILED", ("document_id", "version", "error_code", "error_message", "job_id")),
    "version_created": ("DOCUMENT_VERSION", "DOCUMENT_VERSION_CREATED", ("document_id", "version_number", "output_path", "content_hash", "job_id")),
    "template_created": ("TEMPLATE", "CREATE", ("name",)),
    "template_version_created": ("TEMPLATE_VERSION", "CREATE", ("template_id", "version_number")),
    "document_created": ("DOCUMENT", "CREATE", ("template_version_id",)),
    "template_switched": ("DOCUMENT", "UPDATE_TEMPLATE_VERSION", ("old_template_version_id", "new_template_version_id")),
    "document_version_stored": ("DOCUMENT_VERSION", "CREATE", ("document_id", "version_number", "output_path", "content_hash")),
    "current_version_moved": ("DOCUMENT", "UPDATE_CURRENT_VERSION", ("document_id", "new_current_version")),
    "sections_classified": ("template_version", "sections_classified", ("total_sections", "static_sections", "dynamic_sections", "high_confidence_count", "rule_based_count", "llm_assisted_count", "fallback_count", "duration_ms", "success_rate")),
}

# --- source files -----------------------------------------------------------------------------
MAX_FILE_BYTES = 50 * 1024 * 1024
UPLOAD_EXTENSION = ".docx"
UPLOAD_CONTENT_TYPES = (
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/octet-stream",
)
CONTENT_TYPES_PART = "[Content_Types].xml"
BODY_PART = "word/document.xml"
