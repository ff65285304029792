"""Word lists, lookup tables and patterns that decide the results."""

# --- Fixed values: these must stay exactly as they are for right results ---------------

# Words a query leaves out, unless they are also in KEEP_WORDS.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on",
    "at", "to", "for", "of", "with", "by", "from", "as",
    "is", "was", "are", "were", "been", "be", "have", "has",
    "had", "do", "does", "did", "will", "would", "should", "could",
    "may", "might", "must", "can", "this", "that", "these", "those",
    "what", "which", "who", "when", "where", "why", "how",
]

KEEP_WORDS = [
    "total", "sum", "net", "gross", "average", "count", "max", "min",
    "year", "month", "quarter", "date", "amount", "value", "number", "id",
    "no", "vs", "to", "from", "in", "on", "at", "by",
]

# short form, long form
ABBREVIATIONS = {
    "qty": "quantity",
    "amt": "amount",
    "avg": "average",
    "yr": "year",
    "mo": "month",
    "no": "number",
    "id": "identifier",
    "desc": "description",
    "addr": "address",
    "dept": "department",
    "mgr": "manager",
    "emp": "employee",
    "cust": "customer",
    "prod": "product",
    "rev": "revenue",
    "exp": "expense",
}

# word: its synonyms
SYNONYMS = {
    "revenue": ["sales", "income", "earnings", "turnover", "proceeds"],
    "sales": ["revenue", "income", "turnover"],
    "income": ["revenue", "earnings", "profit"],
    "cost": ["expense", "expenditure", "spending", "outlay", "charge"],
    "expense": ["cost", "expenditure", "spending"],
    "price": ["cost", "rate", "charge", "fee", "value"],
    "profit": ["margin", "earnings", "gain", "net_income"],
    "margin": ["profit", "markup"],
    "customer": ["client", "buyer", "account", "purchaser", "consumer"],
    "client": ["customer", "account"],
    "product": ["item", "sku", "article", "goods", "merchandise"],
    "item": ["product", "sku"],
    "quantity": ["qty", "count", "number", "volume", "amount"],
    "qty": ["quantity", "count", "number"],
    "count": ["quantity", "number", "total"],
    "date": ["time", "period", "timestamp", "when"],
    "year": ["yr", "annual", "yearly"],
    "month": ["monthly", "mo"],
    "quarter": ["q1", "q2", "q3", "q4", "quarterly"],
    "total": ["sum", "aggregate", "combined", "overall"],
    "sum": ["total", "aggregate"],
    "average": ["mean", "avg"],
    "avg": ["average", "mean"],
    "assets": ["holdings", "resources", "property"],
    "liabilities": ["debt", "obligations", "payables"],
    "equity": ["capital", "ownership", "net_worth"],
    "depreciation": ["amortization", "writedown"],
}

# Query classes, tested in this order.
COLUMN_QUERY = [
    r"\bcolumn\b", r"\bfield\b", r"\bheader\b", r"\bfind.*column\b", r"\bwhich column\b",
    r"\bshow.*columns\b", r"\blist.*columns\b",
]
SHEET_QUERY = [
    r"\bsheet\b", r"\btab\b", r"\bwhich sheet\b", r"\blist.*sheets\b", r"\bshow.*sheets\b",
]
METADATA_QUERY = [
    r"\bhow many rows\b", r"\bhow many columns\b", r"\bcount\b", r"\btotal.*rows\b",
    r"\bnumber of\b", r"\bsize\b", r"\bdimensions\b",
]
PATTERN_MARKS = ["*", "?", "[", "]", "\\d", "\\w", "|"]
CONTENT_QUERY = [
    r"\bfind\b", r"\bsearch\b", r"\bwhere is\b", r"\bcontains\b", r"\blook for\b", r"\blocate\b",
]
COMPLEX_WORDS = ["compare", "aggregate", "group"]

# Header text that tells a pivot table.
PIVOT_MARKS = ["sum of", "count of", "average of", "total"]

# What stands before the name of a pivot field.
PIVOT_PREFIX = "sum|count|average|avg|max|min|stdev|var"

MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
CURRENCY_SIGN = "[$€£¥]"
FORMULA_OPERATOR = r"[\+\-\*\/\^\<\>\=\&]"

MAX_COLUMN = 18278  # ZZZ, the last column name of three letters

# --- End of the fixed values ------------------------------------------------------------

NO_RESULT_MESSAGE = "No match; name a column, a sheet or a text to look for"
