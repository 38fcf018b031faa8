"""Thresholds, word lists and formats that results depend on, in one place."""

from __future__ import annotations

# Cells that mean no value, compared in lower case and trimmed.
NULL_TOKENS = (
    "<empty>", "null", "none", "na", "n/a", "nan", "nil", "tbd", "-", "--", "---", ".", "..", "?", "#", "#n/a", "#na", "#null!", "not available", "not applicable", "not provided", "not assigned", "missing", "unknown",
    "no data", "no value", "void", "blank", "empty", "#value!", "#ref!", "#div/0!", "#name?", "#num!", "#error!", "tba", "wip", "pending", "not entered", "not recorded",
)
# First cells of report rows that are no data, as regular expressions.
GARBAGE_PATTERNS = (
    r"total", r"grand\s+total", r"subtotal", r"sub\s+total", r"sum", r"page\s+total", r"running\s+total", r"end\s+of\s+report", r"average", r"avg", r"mean", r"balance\s+forward", r"carried\s+forward", r"min", r"max",
    r"summe", r"gesamtsumme", r"gesamt", r"zwischensumme", r"durchschnitt", r"gesamt\s+ergebnis", r"total\s+g[eé]n[eé]ral", r"total\s+partiel", r"moyenne", r"total\s+general", r"suma\s+total", r"promedio", r"m[eé]dia", "合計", "小計",
)
TRUE_VALUES = ("yes", "y", "true", "t", "1", "on", "enabled", "active", "x", "✓")
FALSE_VALUES = ("no", "n", "false", "f", "0", "off", "disabled", "inactive", "✗")
DATE_HINTS = ("date", "dt", "time", "timestamp", "created", "updated", "modified", "dob", "birth", "expir", "effective", "since", "until", "_at", "at_", "start", "end", "from", "to", "week", "day", "posted", "issued", "received", "shipped", "closed")
NUMBER_HINTS = ("amount", "price", "cost", "total", "sum", "count", "qty", "quantity", "balance", "rate", "pct", "percent", "ratio", "score", "revenue", "profit", "loss", "tax", "fee", "charge", "salary", "wage", "budget", "vol", "volume")
DATE_HINT_SHARE, DATE_SHARE, NUMBER_HINT_SHARE, NUMBER_SHARE = 0.55, 0.80, 0.50, 0.75
# Written dates, in the order they are tried.
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MM-yyyy", "MM-dd-yyyy", "dd.MM.yyyy", "MM.dd.yyyy", "yyyyMMdd", "dd MMM yyyy", "MMM dd yyyy", "dd MMMM yyyy", "MMMM dd yyyy", "MMM-dd-yyyy", "dd-MMM-yyyy", "MMM yyyy", "MMMM yyyy")
SERIAL_EPOCH, SERIAL_MIN, SERIAL_MAX, YEAR_MIN, YEAR_MAX = "1899-12-30", 7300, 73000, 1901, 2100
IDENTIFIER_EXACT, IDENTIFIER_SUFFIXES, IDENTIFIER_PREFIXES = ("id", "code", "sku", "key", "number", "no"), ("_id", "_code", "_key", "_no", "_number", "_num", "_sku"), ("id_", "code_")
CATEGORY_SHARE, CATEGORY_MAX = 0.05, 5000

# Joins found from values.
PK_UNIQUE, PK_NULL, GENERIC_PK_UNIQUE, FK_MAX_NULL, FK_MIN_UNIQUE, FK_MAX_UNIQUE = 0.95, 0.01, 0.98, 0.20, 0.02, 0.80
ROLE_MAX_NULL, ROLE_MIN_UNIQUE = 0.40, 0.01
MIN_OVERLAP_COUNT, MIN_OVERLAP, EDGE_MIN_OVERLAP, EDGE_MIN_CARDINALITY, INNER_OVERLAP = 2, 0.01, 0.50, 8, 0.05
UBIQUITY_CEILING, CLONE_OVERLAP, APPROVED_CONFIDENCE = 0.60, 0.999, 0.72
OVERLAP_WEIGHT, CARDINALITY_WEIGHT, CARDINALITY_REFERENCE, CONFIDENCE_MIN, CONFIDENCE_MAX = 0.75, 0.25, 1000.0, 0.60, 0.98
MASTER_UNIQUE, MASTER_NONNULL, MASTER_KEY, MASTER_ATTRIBUTES, MASTER_EDGES, MASTER_SATURATION = 0.40, 0.20, 0.20, 0.20, 0.10, 5.0
PLAN_JOIN_CONFIDENCE, PLAN_CONFIDENCE = 0.65, 0.75

# Retrieval.
RRF_K, TRIGRAM_MIN, VECTOR_MIN, PRUNE_MIN = 60, 0.2, 0.3, 0.05
# Documents.
HEADING_WORDS, HEADING_CHARS, CHUNK_TOKENS, CHUNK_OVERLAP, LOW_CONFIDENCE = 8, 80, 800, 100, 0.60
GLOSSARY_LIFT, GLOSSARY_OOV, LINK_MIN, LINK_MAX, STALE_DAYS, CARD_CHARS = 1.5, -6.0, 2, 8, 365, 480
CONFLICT_STOP = ("the", "are", "was", "were", "and", "for", "with", "this", "that", "not", "has", "have", "had", "but")
RESOLUTION_QUANTILE, RESOLUTION_FLOOR, SAME_CHUNK_BONUS, COMMUNITY_MIN = 0.85, 0.60, 0.05, 3
# Boards and guards.
TIEOUT_TOLERANCE, JACCARD_FLOOR, GRAIN_TOLERANCE = 0.01, 0.50, 0.05
MAX_SQL_CHARS, MAX_JOINS, MAX_RELATIONS, AUTO_LIMIT, RESULT_CAP = 8000, 5, 8, 10_000, 20
# Whole words a read-only statement never holds.
FORBIDDEN_WORDS = ("insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "revoke", "merge", "copy", "attach", "detach", "export", "import", "install", "load", "pragma")
# Catalogues: confidence bands, and words inside role labels, paths and names.
HIGH_CONFIDENCE, DIGITAL_COVERAGE, ENTITY_WITH_KEY, ENTITY_WITHOUT_KEY = 0.80, 0.70, 0.90, 0.60
CUSTOMER_WORDS = ("customer", "client", "sold_to", "bill_to", "ship_to", "payer", "sales", "receivable", "ar_")
VENDOR_WORDS = ("vendor", "supplier", "payable", "ap_", "purchas", "procure", "creditor")
LOOKUP_WORDS = ("master", "masters", "parties", "party", "accounts", "account", "lookup", "directory", "reference", "dimension")
NAME_SUFFIXES = ("_name", "name", "_desc", "_description", "_label", "_title")
SMALL_WORDS = ("", "and", "the", "of", "for", "a", "an", "in", "to")
CHART_WORDS = (("line", ("over time", "trend", "monthly", "daily", "weekly", "yearly")), ("pie", ("distribution", "proportion", "share", "percent")))
DICTIONARY_FIELD = ("field", "fieldname", "field_name", "column", "column_name", "col_name", "attribute", "technical_name", "element", "fieldid", "field_id", "colname")
DICTIONARY_TEXT = ("description", "desc", "short_text", "long_text", "label", "meaning", "definition", "documentation", "help_text", "medium_text", "descr", "description_text", "explanation")
DICTIONARY_NOTES = ("long_text", "documentation", "notes", "remark", "extended_description", "detail", "comment")
# What a positive status is no evidence of: the beginning of the status, and words of an alias that say the opposite.
STATUS_OPPOSITES = (("approved", ("pending", "open", "waiting")), ("delivered", ("notdelivered", "pending", "issue", "problem")), ("matched", ("unmatched", "mismatch", "issue", "problem")), ("paid", ("unpaid", "pending", "open", "issue")), ("cleared", ("uncleared", "open", "pending")))
# Evidence that a file is about an entity, the strongest reason first: signal, weight, reason.
EVIDENCE = (
    ("entity_key", 0.55, "semantic_role_match"), ("reference_key", 0.28, "transactional_reference"), ("key_dimension", 0.38, "key_dimension_match"), ("table_name", 0.42, "table_name_match"),
    ("column_name", 0.28, "column_name_match"), ("description", 0.18, "description_match"), ("good_for", 0.14, "good_for_match"), ("key_metric", 0.08, "metric_reference"),
)
EVIDENCE_OVERLAP, EVIDENCE_CAP, UNANCHORED_CAP, KEY_ONLY_CAP = 0.50, 0.95, 0.35, 0.74
