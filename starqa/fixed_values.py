"""Texts, word lists, limits and names that callers depend on.

Everything in this module is data that has to stay exactly as written for
results to agree with existing consumers (question wording, answer formats,
denied words, tolerances, slugs).  Code that uses it lives elsewhere.
"""

# --------------------------------------------------------------------------
# Difficulty tiers, answer types
# --------------------------------------------------------------------------

SINGLE_TABLE = "single_table"
MULTI_JOIN = "multi_join"
TIME_COMPARISON = "time_comparison"
DIFFICULTIES = (SINGLE_TABLE, MULTI_JOIN, TIME_COMPARISON)

RANKED_LIST = "ranked_list"
ENTITY_SET = "entity_set"
NUMERIC = "numeric"
CATEGORICAL = "categorical"

# Stands between the question and the answer format of a prompt.
BEFORE_FORMAT = "\n\nAnswer format: "

# --------------------------------------------------------------------------
# Numeric limits and tolerances
# --------------------------------------------------------------------------

MONEY_ABS_TOL = 0.01
MONEY_REL_TOL = 1e-3
COUNT_ABS_TOL = 0.0
COUNT_REL_TOL = 0.0
RECONCILE_TOL = 0.005
TOP_KS = (3, 5)
MIN_SET_ANSWERS = 1
MAX_SET_ANSWERS = 15
MIN_CATALOGUE = 2
MIN_CUSTOMERS_PER_COUNTRY = 2
PREVIEW_ROWS = 50

# --------------------------------------------------------------------------
# Question templates.  {name} is a parameter of the question.
# --------------------------------------------------------------------------

TEMPLATES = {
    "customer_count_in_country": {
        "difficulty": SINGLE_TABLE,
        "answer_type": NUMERIC,
        "question": "How many customers are based in {country}?",
        "answer_format": "a single integer, e.g. `7`",
        "notes": "{count} customers in {country}",
    },
    "total_revenue_in_year": {
        "difficulty": SINGLE_TABLE,
        "answer_type": NUMERIC,
        "question": (
            "What was the total revenue from all track sales in {year}? "
            "Revenue means the sum of UnitPrice multiplied by Quantity over "
            "invoice line items."
        ),
        "answer_format": "a single number rounded to 2 decimals, e.g. `1234.56`",
        "notes": "total revenue {year} = {value}",
    },
    "tracks_sold_in_genre_year": {
        "difficulty": SINGLE_TABLE,
        "answer_type": NUMERIC,
        "question": (
            "How many individual tracks in the {genre} genre were sold in {year}? "
            "Count the total quantity across invoice line items."
        ),
        "answer_format": "a single integer, e.g. `142`",
        "notes": "{count} {genre} tracks sold in {year}",
    },
    "top_customers_by_revenue": {
        "difficulty": MULTI_JOIN,
        "answer_type": RANKED_LIST,
        "question": (
            "Which {k} customers generated the most revenue in {year}? "
            "List them from highest to lowest revenue. Revenue means the sum of "
            "UnitPrice multiplied by Quantity over their invoice line items."
        ),
        "answer_format": (
            "a numbered list of exactly {k} customer full names, highest first, "
            "one per line, e.g. `1. Jane Doe`"
        ),
        "notes": "top {k} customers by revenue in {year}",
    },
    "top_artists_by_revenue": {
        "difficulty": MULTI_JOIN,
        "answer_type": RANKED_LIST,
        "question": (
            "Which {k} artists generated the most revenue in {year}? "
            "Attribute a track's revenue to the artist of its album. "
            "List them from highest to lowest revenue."
        ),
        "answer_format": (
            "a numbered list of exactly {k} artist names, highest first, "
            "one per line, e.g. `1. Some Artist`"
        ),
        "notes": "top {k} artists by revenue in {year}",
    },
    "top_genre_in_country": {
        "difficulty": MULTI_JOIN,
        "answer_type": CATEGORICAL,
        "question": (
            "Which music genre generated the most total revenue from customers "
            "based in {country}, across all years?"
        ),
        "answer_format": "the genre name only, e.g. `Rock`",
        "notes": "top genre in {country}: {winners}",
    },
    "top_countries_by_revenue": {
        "difficulty": MULTI_JOIN,
        "answer_type": RANKED_LIST,
        "question": (
            "Which {k} countries generated the most revenue in {year}? "
            "Use the customer's country. List them from highest to lowest revenue."
        ),
        "answer_format": (
            "a numbered list of exactly {k} country names, highest first, "
            "one per line, e.g. `1. Canada`"
        ),
        "notes": "top {k} countries by revenue in {year}",
    },
    "top_customer_revenue_increase": {
        "difficulty": TIME_COMPARISON,
        "answer_type": RANKED_LIST,
        "question": (
            "Which {k} customers had the largest increase in revenue from "
            "{year_a} to {year_b}? Increase means {year_b} revenue minus "
            "{year_a} revenue; a customer who bought nothing in a year counts "
            "as 0.00 for that year. List them from largest increase to smallest."
        ),
        "answer_format": (
            "a numbered list of exactly {k} customer full names, largest "
            "increase first, one per line, e.g. `1. Jane Doe`"
        ),
        "notes": "largest revenue increases {year_a}->{year_b}",
    },
    "artists_with_no_sales_in_year": {
        "difficulty": TIME_COMPARISON,
        "answer_type": ENTITY_SET,
        "question": (
            "Consider every artist who has at least one {genre} track in the "
            "catalogue. Which of them sold no {genre} tracks at all in {year}?"
        ),
        "answer_format": "a list of artist names, one per line; order does not matter",
        "notes": "{count} {genre} artists with no sales in {year}",
    },
}

# --------------------------------------------------------------------------
# SQL screening
# --------------------------------------------------------------------------

ALLOWED_LEADING_KEYWORDS = ("EXPLAIN", "SELECT", "VALUES", "WITH")

FORBIDDEN_KEYWORDS = (
    "ALTER", "ANALYZE", "ATTACH", "COMMIT", "CREATE", "DELETE", "DETACH",
    "DROP", "INSERT", "PRAGMA", "REINDEX", "RELEASE", "ROLLBACK", "SAVEPOINT",
    "TRUNCATE", "UPDATE", "UPSERT", "VACUUM",
)

FORBIDDEN_FUNCTIONS = (
    "edit", "fts3_tokenizer", "load_extension", "readfile", "writefile", "zipfile",
)

ERROR_TYPES = (
    "empty_query", "multiple_statements", "disallowed_statement",
    "forbidden_keyword", "forbidden_function", "not_authorized",
    "syntax_error", "timeout", "runtime_error",
)

CATALOGUE_PREFIX = "sqlite_"

MESSAGE_EMPTY = "Empty query. Provide a SELECT statement."
MESSAGE_NO_STATEMENT = (
    "Query contains no executable statement (only comments or whitespace)."
)
MESSAGE_NO_WORDS = "Query contains no SQL keywords."
MESSAGE_MULTIPLE = (
    "Only one statement may be executed per call, got %d. "
    "Remove the extra statements (and any trailing text after the first ';')."
)
MESSAGE_LEADING = (
    "Statement type '%s' is not allowed. This database is read-only; "
    "queries must start with one of: EXPLAIN, SELECT, VALUES, WITH."
)
MESSAGE_KEYWORD = (
    "Query contains forbidden keyword(s): %s. This database is read-only -- "
    "only SELECT/WITH/EXPLAIN queries are permitted."
)
MESSAGE_FUNCTION = "Query references forbidden function(s): %s."

# --------------------------------------------------------------------------
# Text patterns (Java regex).  WS is the set of characters that
# count as white space (WS_CHARS lists them), DIGIT any decimal digit.
# --------------------------------------------------------------------------

WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
DIGIT = r"\p{Nd}"
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x85\x{2028}\x{2029}]"
NUMBER = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"
JSON_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
ITEM_PREFIX = rf"^{WS}*(?:{DIGIT}+[.)]|[-*•]){WS}*"
TRAILING_NOTE = rf"(?d){WS}*[(\[].*?[)\]]{WS}*$"
TRAILING_FIGURE = rf"(?d){WS}*[-:–—]{WS}*\$?-?[{DIGIT},]+(?:\.{DIGIT}+)?{WS}*$"
SQL_BLOCK_COMMENT = r"(?s)/\*.*?\*/"
SQL_LINE_COMMENT = r"--[^\n]*"
SQL_WORD = "[A-Za-z_][A-Za-z_0-9]*"
