"""Fixed values shared by the Spark column functions and their SQL twins.

Every regular expression here is written in the common subset of Java regex
(Spark) and RE2 (DuckDB): no look-around, no back-references.
"""

# ---- fixed values: ERP domain (table names, rule lists, weights) ----------

# Key tables of the ERP schema, in the order they are listed for the model.
CORE_TABLES = [
    "SRM_PROJECTS", "SRM_COMPANIES", "SRM_CONTACTS", "PAC_MNT_PROJECTS", "PAC_MNT_RESOURCES",
    "CLNTSUPP", "CLNTRESPONS", "PROJCNTRTS", "PROJSTAFF", "PROJEVISION",
]

# All tables of the DDL catalog (core tables plus four auxiliary ones).
CATALOG_TABLES = CORE_TABLES + ["CLNTCLASS", "BIZ_OPP_GEN_PROPERTIES", "BIZ_COM_SUP_PROPERTIES",
                                "PAC_PURGE_FINANCIAL_LIST"]

# Tables the corpus post-processor treats as "domain" tables.
DOMAIN_TABLES = ["PAC_MNT_PROJECTS", "SRM_COMPANIES", "PROJSTAFF", "PROJCNTRTS", "PAC_MNT_RESOURCES", "SRM_CONTACTS"]

# Allowed status values per table (union of the coded and documented domains).
STATUS_DOMAINS = {
    "SRM_PROJECTS": ["Active", "Inactive", "Planning", "Completed"],
    "PAC_MNT_PROJECTS": ["Active", "Inactive", "On Hold", "Completed", "Cancelled"],
    "CLNTSUPP": ["Open", "In Progress", "Resolved", "Closed"],
    "PAC_MNT_RESOURCES": ["Available", "Busy", "Unavailable"],
}

REQUIRE_DATE_FILTER = ["CLNTSUPP", "PROJEVISION"]
LARGE_TABLES = ["CLNTSUPP", "PROJEVISION", "PROJSTAFF"]
SENSITIVE_TABLES = ["SRM_CONTACTS", "PROJCNTRTS"]
INDEX_HINT_TABLES = ["CLNTSUPP", "PROJEVISION"]

MAX_COMPLEXITY = 7.0
MAX_JOINS = 5
MAX_TABLES_WITHOUT_LIMIT = 3

# Reward weights and penalties.
W_SYNTAX, W_SCHEMA, W_BUSINESS, W_PERFORMANCE, W_REASONING = 2.0, 3.0, 4.0, 1.0, 1.0
P_MISSING_REASONING, P_INVALID_SYNTAX = -1.5, -3.0

REASONING_KEYWORDS = ["because", "therefore", "since", "given", "considering",
                      "first", "then", "finally", "need to", "should", "must"]
SQL_REASONING_TERMS = ["table", "join", "filter", "aggregate", "group",
                       "column", "select", "where", "condition"]

# Time-sensitive tables for the basic business reward and the status words it credits.
TIME_SENSITIVE_TABLES = ["CLNTSUPP", "PROJEVISION", "PROJSTAFF"]
VALID_STATUS_WORDS = ["ACTIVE", "INACTIVE", "OPEN", "CLOSED", "COMPLETED"]

# Clause keywords credited by the generator confidence.
CLAUSE_KEYWORDS = ["FROM", "WHERE", "JOIN", "GROUP BY", "ORDER BY"]

# Fixed rejected candidate used for ground-truth preference pairs.
REJECTED_SQL = "SELECT * FROM PAC_MNT_PROJECTS;"

# Security rules (documented injection patterns and forbidden functions).
INJECTION_PATTERNS = [
    r"(?i);\s*DROP\s+",
    r"(?i);\s*DELETE\s+",
    r"(?m)--.*$",
    r"(?s)/\*.*\*/",
    r"(?i)UNION\s+ALL\s+SELECT\s+NULL",
    r"(?i)OR\s+1\s*=\s*1",
    r"(?i)' OR '1'='1",
]
FORBIDDEN_FUNCTIONS = ["SYSTEM", "EXEC", "EXECUTE", "XP_CMDSHELL", "SP_EXECUTESQL"]
SYSTEM_TABLES = ["information_schema", "mysql", "sys", "pg_catalog"]

# ---- patterns --------------------------------------------------------------

AGG_CALL = r"\b(COUNT|SUM|AVG|MIN|MAX|GROUP_CONCAT)\s*\("
AGG_WORD = r"\b(COUNT|SUM|AVG|MIN|MAX)\s*\("
# String literals and comments; the groups are a literal's quotes.
MASKED = r"(?s)(')[^']*(')|(\")[^\"]*(\")|--[^\n]*|/\*.*?\*/"
FROM_TABLE = r"\bFROM\s+(\w+)"
JOIN_TABLE = r"\bJOIN\s+(\w+)"
DML_TABLE = r"\b(?:UPDATE|INTO)\s+(\w+)"
JOIN_WORD = r"\bJOIN\b"
WHERE_WORD = r"\bWHERE\b"
WHERE_SUBQUERY = r"(?s)\bWHERE\b.*\bSELECT\b"
SELECT_LIST = r"(?s)^\s*SELECT\s+(?:DISTINCT\s+)?(.*?)\s+FROM\b"
GROUP_LIST = r"(?s)\bGROUP\s+BY\s+(.*?)(?:\s+HAVING\b|\s+ORDER\s+BY\b|\s+LIMIT\b|;|$)"
ORDER_LIST = r"(?s)\bORDER\s+BY\s+(.*?)(?:\s+LIMIT\b|;|$)"
WHERE_TEXT = r"(?s)\bWHERE\s+(.*?)(?:\s+GROUP\s+BY\b|\s+ORDER\s+BY\b|\s+LIMIT\b|\s+HAVING\b|;|$)"
LIMIT_VALUE = r"\bLIMIT\s+(\d+)"
ALIAS_SUFFIX = r"\s+(AS\s+)?\w+$"
STATUS_VALUE = r"(?i)STATUS\s*=\s*['\"]([^'\"]*)['\"]"
DATE_PREDICATE = r"\w*DATE\w*\s*(BETWEEN|>=?|<=?)"
NEGATIVE_AMOUNT = r"(BUDGET|COST|VALUE)\s*<?=?\s*-\d+"
QUALIFIED_REF = r"\b([A-Z_][A-Z0-9_]*)\.([A-Z_][A-Z0-9_]*)\b"
OR_WORD = r"\bOR\b"
# a call on the left of a comparison
FUNCTION_IN_WHERE = r"\b[A-Z_]\w*\s*\([^()]*\)\s*(?:[<>=!]|LIKE\b|BETWEEN\b)"
JOIN_CONDITION = r"(?s)\bON\s+(.*?)(?:\s+(?:INNER|LEFT|RIGHT|FULL|CROSS)(?:\s+OUTER)?\s*$|\s+WHERE\b|\s+GROUP\b|\s+ORDER\b|\s+LIMIT\b|;|$)"
