"""Patterns, word lists and the variable catalogue that results depend on. Not to be tuned."""

# Line patterns.
TABLE_LINE = r"^(.+?)\s+([\$\d,\(\)]+)\s+([\$\d,\(\)]+)(?:\s+([\$\d,\(\)]+))?$"
TABLE_ROW = r"^(.{3,60}?)\s*([\$\(]?[\d,]+\.?\d*[\)]?)\s+([\$\(]?[\d,]+\.?\d*[\)]?)(?:\s+([\$\(]?[\d,]+\.?\d*[\)]?))?"
NUMBER = r"\$?-?\(?\d[\d,]+\.?\d*[BMK]?\)?"
YEAR = r"\b(20\d{2})\b"
HEADER_WORDS = r"(?i)\b(summary|segment|discussion|overview|total|analysis)\b"
NARRATIVE_WORDS = r"(?i)\b(was|were|is|are|increased|decreased|compared|million|billion|reflect|represent|include|result|due to)\b"
FINANCIAL_KEYWORDS = ["net income", "net loss", "total revenues", "total revenue", "revenues", "earnings", "income from operations"]
MENTION = r"(?i)(net income(?:\s*\(loss\))?|total revenues?|net loss)[^$\d]{0,30}?(\$?\(?[\d,]+\.?\d*\)?)\s*(?:million|billion|M|B)?(?:[^.]{0,20}?\b(20\d{2})\b)?"
PAGE_NUMBER = r"^\s*(\d{1,3})\s*$"
NUMBER_TOKEN = r"\(\s*[-+]?\$?\d[\d,]*(?:\.\d+)?\s*\)|[-+]?\$?\d[\d,]*(?:\.\d+)?"
CLOSE_OPEN, LETTER_NUMBER = r"\)\s*(\$?\()", r"([a-zA-Z])\s*(\$?\(?\d)"
NEGATIVE_CELL = r"-?[\d.]+"
FORM_LABEL = r"(?i)(AIG\s*\|\s*\d{4}\s*Form\s*10-[KQ])"
FOOTER_SECTION = r"(?i)^(ITEM\s*\d+[A-Z]?)\s*\|\s*([^|]+?)(?:\|\s*(.+))?$"
TABLE_INTRO = r"(?i)^\s*the following table\b[\s:,-]*(.*)$"

# Limits.
SMALL_CHUNK_CHARS = 500
SPLIT_OVERLAP_CHARS = 200
MAX_LINE_CHARS = 300
EXCERPT_CHARS, EXCERPT_RADIUS, SHOWN_CHARS = 500, 2, 120
PLAN_TERMS = 8
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
NUMERIC_TOLERANCE = 100.0

# Variables of the extraction task: name, display name, aliases, query template; 20 candidates, 3 documents each.
TOP_K, MAX_DOCS = 20, 3
VARIABLES = [
    ("total_revenues", "Total Revenues", ["total revenues", "Total Revenues"], "total revenues in {year}"),
    ("shareholders_equity", "Total AIG shareholders' equity", ["total aig shareholders' equity", "Total AIG Shareholders' Equity"], "total aig shareholders' equity in {year}"),
    ("sp_rating", "S&P Long-term Debt Rating", ["s&p long-term debt rating", "senior long-term debt", "s&p ratings", "SP Rating", "Senior Long-term Debt"], "s&p long-term debt rating in {year}"),
    (
        "underwriting_income",
        "Underwriting Income - General Insurance Segment,",
        ["underwriting income general insurance segment", "underwriting income (loss) - general insurance segment", "Underwriting Income General Insurance Segment"],
        "underwriting income general insurance segment in {year}",
    ),
]
FALLBACK_QUERY = "financial statement table value"
