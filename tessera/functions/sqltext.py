"""Column functions over SQL text: normalisation, structure, validation, reward.

All logic is native Spark expressions (regexp_*, higher-order array functions,
``when`` chains), so it runs inside whole-stage code generation on every
executor — no Python per row. Functions take ``Column`` arguments and return a
``Column`` (or a dict of named columns), ready for ``select``.

Issue lists are built in a fixed order and exposed both as arrays and as
``' | '``-joined strings (the latter compare equal across engines). The texts of
issues, suggestions and feedback lines are fixed values: users match on them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.catalog import qualified_columns
from . import patterns as P


def _lit_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _issues(*items: Column) -> Column:
    """Array of the non-null issue strings, in argument order."""
    return F.array_compact(F.array(*[i.cast("string") for i in items]))


def _flat(*arrays: Column) -> Column:
    return F.concat(*arrays)


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), 0))


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def _contains_any(text: Column, words: list[str]) -> Column:
    out = None
    for w in words:
        c = text.contains(w)
        out = c if out is None else (out | c)
    return out


def _items(text: Column) -> Column:
    """Top-level comma separated items of a clause, trimmed, empties dropped, at any depth of parentheses.

    The text is cut at every comma, and pieces are put together again while more
    parentheses are open than closed.
    """
    pieces = F.split(text, ",")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"),
                     F.lit(0).alias("depth"))

    def step(acc: Column, piece: Column) -> Column:
        so_far = F.when(acc["open"].isNull(), piece).otherwise(F.concat(acc["open"], F.lit(","), piece))
        depth = acc["depth"] + count_char(piece, "(") - count_char(piece, ")")
        ends = depth <= 0
        return F.struct(F.when(ends, F.array_append(acc["done"], so_far)).otherwise(acc["done"]).alias("done"),
                        F.when(~ends, so_far).alias("open"), depth.alias("depth"))

    def finish(acc: Column) -> Column:
        return F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))

    whole = F.when(text.contains("("), F.aggregate(pieces, start, step, finish)).otherwise(pieces)
    return F.filter(F.transform(whole, lambda x: F.trim(x)), lambda x: x != "")


def _clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def count_char(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def words(text: Column) -> Column:
    """Python ``str.split()``: whitespace-separated tokens, no empties."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


# ----------------------------------------------------------------- COR-01/02

def normalize_sql(sql: Column) -> Column:
    """Scoring normalisation: upper, collapse whitespace, strip trailing ';',
    double quotes to single, drop ``--`` and block comments, trim.

    Whitespace is collapsed before ``--`` removal, so a line comment removes the
    rest of the (now single-line) statement — same order as the scorer.
    """
    s = F.trim(F.regexp_replace(F.upper(sql), r"\s+", " "))
    s = F.regexp_replace(s, r";+$", "")
    s = F.replace(s, F.lit('"'), F.lit("'"))
    s = F.regexp_replace(s, r"(?m)--.*$", "")
    s = F.regexp_replace(s, r"(?s)/\*.*?\*/", "")
    return F.trim(s)


def normalize_sql_eval(sql: Column) -> Column:
    """Evaluation normalisation: trim, upper, drop every ';', collapse whitespace."""
    s = F.replace(F.upper(F.trim(sql)), F.lit(";"), F.lit(""))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


# ----------------------------------------------------------------- COR-03/04

def masked_upper(sql: Column) -> Column:
    """Upper-cased SQL without what its literals and comments say: a literal is ``' '``, a comment a space.

    One pass from the left decides which of them a quote or ``--`` belongs to. An
    unterminated literal or comment stays as it is.
    """
    return F.btrim(F.regexp_replace(F.upper(sql), P.MASKED, "$1$3 $2$4"), F.lit(" \t\r\n"))


def query_type(upper_sql: Column) -> Column:
    return (F.when(upper_sql.startswith("SELECT"), "SELECT").when(upper_sql.startswith("INSERT"), "INSERT")
            .when(upper_sql.startswith("UPDATE"), "UPDATE").when(upper_sql.startswith("DELETE"), "DELETE")
            .otherwise(""))


def sql_structure(sql: Column, upper_sql: Column | None = None) -> dict[str, Column]:
    """COR-03: query type, tables (first FROM + every JOIN), clause flags; literals and comments don't count."""
    u = masked_upper(sql) if upper_sql is None else upper_sql
    first_from = F.regexp_extract(u, P.FROM_TABLE, 1)
    tables = F.concat(F.when(first_from != "", F.array(first_from)).otherwise(F.array().cast("array<string>")),
                      F.regexp_extract_all(u, F.lit(P.JOIN_TABLE), 1))
    return {
        "query_type": query_type(u),
        "tables": tables,
        "has_where": u.contains("WHERE"),
        "has_join": u.contains("JOIN"),
        "has_group_by": u.contains("GROUP BY"),
        "has_order_by": u.contains("ORDER BY"),
        "has_limit": u.contains("LIMIT"),
    }


def group_list(upper_sql: Column) -> Column:
    return F.regexp_extract(upper_sql, P.GROUP_LIST, 1)


def complexity_score(upper_sql: Column, n_group_items: Column) -> Column:
    """COR-06: a score up to 10 of joins, conditions, aggregates, grouping and subqueries."""
    return F.least(F.lit(10.0),
                   F.when(query_type(upper_sql) == "SELECT", 1.0).otherwise(0.0) + _count(upper_sql, P.JOIN_WORD) * 1.5
                   + F.when(_has(upper_sql, P.WHERE_WORD), 0.5).otherwise(0.0) + _count(upper_sql, P.AGG_CALL) * 0.8
                   + n_group_items * 0.6 + F.when(_has(upper_sql, P.WHERE_SUBQUERY), 2.0).otherwise(0.0))


def sql_features(sql: Column, upper_sql: Column | None = None) -> dict[str, Column]:
    """COR-04/06/07: clause features, complexity score, cost class and advice.

    ``upper_sql`` is :func:`masked_upper` of ``sql``; projected beforehand, it is computed once.
    """
    u = masked_upper(sql) if upper_sql is None else upper_sql
    tables = F.array_sort(F.array_distinct(F.concat(
        F.regexp_extract_all(u, F.lit(P.FROM_TABLE), 1),
        F.regexp_extract_all(u, F.lit(P.JOIN_TABLE), 1),
        F.regexp_extract_all(u, F.lit(P.DML_TABLE), 1))))
    join_tables = F.regexp_extract_all(u, F.lit(P.JOIN_TABLE), 1)
    n_joins = _count(u, P.JOIN_WORD)
    has_where = _has(u, P.WHERE_WORD)
    where_sub = _has(u, P.WHERE_SUBQUERY)
    n_aggs = _count(u, P.AGG_CALL)
    group_items = _items(group_list(u))
    order_items = _items(F.regexp_extract(u, P.ORDER_LIST, 1))
    lim = F.regexp_extract(u, P.LIMIT_VALUE, 1)
    limit = F.when(lim != "", lim.cast("int"))
    sel_items = _items(F.regexp_extract(u, P.SELECT_LIST, 1))
    plain = F.transform(F.filter(sel_items, lambda x: ~x.rlike(P.AGG_CALL) & (x != "*")),
                        lambda x: F.regexp_replace(x, P.ALIAS_SUFFIX, ""))
    qtype = query_type(u)
    complexity = complexity_score(u, F.size(group_items))
    cost = F.when(complexity < 3, "low").when(complexity < 6, "medium").otherwise("high")
    advice = _issues(
        F.when(n_joins > 3, "Consider breaking complex joins into smaller queries or using CTEs"),
        F.when(limit.isNull() & (qtype == "SELECT"), "Consider adding LIMIT clause for large result sets"),
        F.when(~has_where, "No WHERE clause detected - ensure this is intentional"),
        F.when(F.size(tables) > 5, "Many tables involved - verify all joins are necessary"))
    return {
        "upper_sql": u, "query_type": qtype, "tables": tables, "join_tables": join_tables,
        "n_joins": n_joins, "has_where": has_where, "where_subquery": where_sub, "n_aggregations": n_aggs,
        "group_by": group_items, "order_by": order_items, "limit_value": limit, "select_items": sel_items,
        "plain_columns": plain, "has_star": F.array_contains(sel_items, "*"),
        "complexity": complexity, "cost_class": cost, "advice": advice,
    }


# ----------------------------------------------------------------- VAL

def _status_errors(values: Column, allowed: list[str], tail: str) -> Column:
    # closures built here: PySpark reads a 2-argument lambda as (element, index)
    domain = _lit_array(allowed)
    bad = F.filter(values, lambda s: ~F.array_contains(domain, s))
    return F.transform(bad, lambda s: F.concat(F.lit("Invalid status '"), s, F.lit("'"), F.lit(tail)))


FEATURE_KEYS = ["upper_sql", "query_type", "tables", "join_tables", "n_joins", "has_where", "where_subquery",
                "n_aggregations", "group_by", "order_by", "limit_value", "select_items", "plain_columns",
                "has_star", "complexity", "cost_class", "advice"]


def validation_issues(sql: Column, f: dict[str, Column] | None = None) -> dict[str, Column]:
    """VAL-01..06 issue arrays (syntax, schema, business, aggregation, performance,
    security) plus the performance-acceptable flag."""
    f = f or sql_features(sql)
    u, tables, has_where = f["upper_sql"], f["tables"], f["has_where"]
    is_blank = F.coalesce(F.trim(sql), F.lit("")) == ""

    # VAL-01 syntax
    syntax = _issues(
        F.when(is_blank, "Unable to parse SQL"),
        F.when(count_char(sql, "(") != count_char(sql, ")"), "Unmatched parentheses"),
        F.when(u.contains("SELECT") & ~u.contains("FROM")
               & ~_contains_any(u, ["CURRENT_DATE", "CURRENT_TIME", "DUAL"]),
               "SELECT statement missing FROM clause"),
        F.when(u.contains("GROUP BY") & ~_has(u, P.AGG_WORD), "GROUP BY without aggregation function"))

    # VAL-02 schema
    catalog = _lit_array(P.CATALOG_TABLES)
    valid_cols = _lit_array(qualified_columns())
    unknown_tables = F.transform(F.filter(tables, lambda t: ~F.array_contains(catalog, t)),
                                 lambda t: F.concat(F.lit("Table '"), t, F.lit("' not found in schema")))
    unknown_joins = F.transform(F.filter(F.array_distinct(f["join_tables"]), lambda t: ~F.array_contains(catalog, t)),
                                lambda t: F.concat(F.lit("Join table '"), t, F.lit("' not found in schema")))
    refs = F.array_distinct(F.regexp_extract_all(u, F.lit(P.QUALIFIED_REF), 0))
    bad_refs = F.filter(refs, lambda r: F.array_contains(catalog, F.substring_index(r, ".", 1))
                        & ~F.array_contains(valid_cols, r))
    bad_cols = F.transform(bad_refs, lambda r: F.concat(
        F.lit("Column '"), F.substring_index(r, ".", -1), F.lit("' not found in table '"),
        F.substring_index(r, ".", 1), F.lit("'")))
    schema = _flat(unknown_tables, bad_cols, unknown_joins)

    # VAL-03 business
    status_vals = F.regexp_extract_all(sql, F.lit(P.STATUS_VALUE), 1)
    status_errs = []
    for table, allowed in P.STATUS_DOMAINS.items():
        msg_tail = f" for table {table}. Valid values: {', '.join(allowed)}"
        errs = _status_errors(status_vals, allowed, msg_tail)
        status_errs.append(F.when(F.array_contains(tables, table), errs).otherwise(F.array().cast("array<string>")))
    has_date_pred = _has(u, P.DATE_PREDICATE)
    table_rules = []
    for t in P.REQUIRE_DATE_FILTER:
        table_rules.append(F.when(F.array_contains(tables, t) & ~has_date_pred,
                                  f"Table {t} requires date filter in WHERE clause"))
    for t in P.LARGE_TABLES:
        table_rules.append(F.when(F.array_contains(tables, t) & ~has_where,
                                  f"Large table {t} requires WHERE clause for performance"))
    for t in P.SENSITIVE_TABLES:
        table_rules.append(F.when(F.array_contains(tables, t) & ~has_where,
                                  f"Sensitive table {t} requires WHERE clause for security"))
    plain = f["plain_columns"]
    business = _flat(*status_errs, _issues(
        *table_rules,
        F.when(_contains_any(u, ["BUDGET", "COST", "VALUE"]) & _has(u, P.NEGATIVE_AMOUNT),
               "Budget/Cost/Value cannot be negative"),
        F.when(u.contains("PARENT_ID") & F.array_contains(tables, "SRM_PROJECTS")
               & _contains_any(u, ["CONNECT BY", "WITH RECURSIVE"])
               & ~u.contains("LEVEL") & ~F.lower(sql).contains("depth"),
               "Hierarchical query should have depth limit"),
        F.when((f["n_aggregations"] > 0) & (F.size(f["group_by"]) == 0) & (F.size(plain) > 0),
               "Non-aggregated columns must be in GROUP BY clause")))

    # VAL-04 aggregation consistency
    missing = F.filter(plain, lambda c: ~F.array_contains(f["group_by"], c))
    agg_consistency = _flat(
        F.when(f["n_aggregations"] > 0, F.transform(missing, lambda c: F.concat(
            F.lit("Column '"), c, F.lit("' must be in GROUP BY clause or used in aggregation"))))
        .otherwise(F.array().cast("array<string>")),
        _issues(F.when((F.size(f["group_by"]) > 0) & (f["n_aggregations"] == 0),
                       "GROUP BY used without aggregation functions")))

    # VAL-05 performance
    n_tables = F.size(tables)
    cartesian = (n_tables > 1) & (f["n_joins"] < n_tables - 1)
    too_complex = f["complexity"] > P.MAX_COMPLEXITY
    perf = _flat(_issues(
        F.when(too_complex, F.concat(F.lit("Query complexity ("), F.format_number(f["complexity"], 1),
                                     F.lit(f") exceeds threshold ({P.MAX_COMPLEXITY})"))),
        F.when(f["n_joins"] > P.MAX_JOINS, F.concat(F.lit("Too many joins ("), f["n_joins"].cast("string"),
                                                     F.lit(f"). Maximum recommended: {P.MAX_JOINS}"))),
        F.when((n_tables > P.MAX_TABLES_WITHOUT_LIMIT) & f["limit_value"].isNull(),
               "Query on multiple tables without LIMIT clause"),
        F.when(cartesian, "Potential cartesian product detected (missing joins)"),
        *[F.when(~has_where & F.array_contains(tables, t), f"Large table {t} accessed without WHERE clause")
          for t in P.INDEX_HINT_TABLES]))
    perf_ok = ~too_complex & ~cartesian
    where_text = F.regexp_extract(u, P.WHERE_TEXT, 1)
    optimizations = _issues(
        F.when(f["n_joins"] > P.MAX_JOINS, "Consider breaking query into smaller parts or using CTEs"),
        F.when((n_tables > P.MAX_TABLES_WITHOUT_LIMIT) & f["limit_value"].isNull(),
               "Add LIMIT clause to restrict result set size"),
        F.when(f["has_star"], "Avoid SELECT *, specify required columns explicitly"),
        F.when(f["where_subquery"], "Consider replacing subqueries with JOINs for better performance"),
        F.when(has_where & _has(where_text, P.OR_WORD),
               "Multiple OR conditions may prevent index usage, consider UNION"),
        F.when(has_where & _has(where_text, P.FUNCTION_IN_WHERE),
               "Functions in WHERE clause may prevent index usage"))

    # VAL-06 security
    low = F.lower(sql)
    trimmed = F.trim(sql)
    security = _issues(
        *[F.when(_has(sql, p), F.lit(f"Potential SQL injection pattern detected: {p}")) for p in P.INJECTION_PATTERNS],
        *[F.when(_has(u, rf"\b{fn}\b"), F.lit(f"Forbidden function {fn} detected")) for fn in P.FORBIDDEN_FUNCTIONS],
        F.when(sql.contains(";") & (F.substring(trimmed, -1, 1) != ";"), "Multiple SQL statements detected"),
        *[F.when(_has(low, rf"\b{t}\b"), F.lit(f"Access to system table '{t}' detected")) for t in P.SYSTEM_TABLES])

    return {
        **f,
        "syntax_errors": syntax, "schema_errors": schema, "business_errors": business,
        "aggregation_errors": agg_consistency, "performance_warnings": perf, "optimizations": optimizations,
        "security_warnings": security, "performance_acceptable": perf_ok,
    }


ISSUE_KEYS = ["syntax_errors", "schema_errors", "business_errors", "aggregation_errors", "performance_warnings",
              "optimizations", "security_warnings", "performance_acceptable"]


def validation_summary(v: dict[str, Column], f: dict[str, Column]) -> dict[str, Column]:
    """VAL-07/08/09 from the issue arrays (pass projected columns to avoid recomputation)."""
    syntax, schema, business = v["syntax_errors"], v["schema_errors"], v["business_errors"]
    perf, security = v["performance_warnings"], v["security_warnings"]
    syntax_ok = F.size(syntax) == 0
    schema_ok = F.size(schema) == 0
    business_ok = F.size(business) == 0
    security_ok = F.size(security) == 0
    n_tables = F.size(f["tables"])

    # VAL-07 suggestions
    suggestions = _issues(
        F.when(~syntax_ok, "Fix syntax errors before proceeding"),
        F.when(~schema_ok, "Verify table and column names against schema"),
        F.when(F.exists(business, lambda e: F.lower(e).contains("date filter")),
               "Add date range filter to improve performance and accuracy"),
        F.when(F.exists(business, lambda e: F.lower(e).contains("status")),
               "Use valid status values from the business rules"),
        F.when(F.size(perf) > 0, "Consider performance optimizations for production use"),
        F.when(~security_ok, "Review query for potential security vulnerabilities"),
        F.when(f["limit_value"].isNull() & (f["query_type"] == "SELECT"), "Consider adding LIMIT for testing"),
        F.when((n_tables == 1) & ~f["has_where"], "Add WHERE clause to filter results"))

    # VAL-08 confidence
    cx = f["complexity"]
    conf = (F.lit(1.0) - F.size(syntax) * 0.2 - F.size(schema) * 0.15 - F.size(business) * 0.1
            - F.size(perf) * 0.05 - F.size(security) * 0.25
            - F.when(cx > 7, 0.1).when(cx > 5, 0.05).otherwise(0.0))
    return {
        "suggestions": suggestions,
        "syntax_valid": syntax_ok, "schema_compliant": schema_ok, "business_valid": business_ok,
        "security_passed": security_ok,
        "confidence": _clamp(conf, 0.0, 1.0),
        # VAL-09
        "is_valid_strict": syntax_ok & schema_ok & business_ok & security_ok,
        "is_valid_lax": syntax_ok & security_ok,
    }


def validate_sql(sql: Column, f: dict[str, Column] | None = None) -> dict[str, Column]:
    """VAL-01..09 over one SQL text column; returns named result columns.

    ``f`` may map feature names to already-projected columns. For large inputs
    prefer ``tessera.operators.scoring.validate``, which projects features,
    issue arrays and the summary in three layers so nothing is recomputed.
    """
    f = f or sql_features(sql)
    v = validation_issues(sql, f)
    return {**v, **validation_summary(v, f)}


# ----------------------------------------------------------------- RWD

def syntax_reward_basic(sql: Column) -> Column:
    """RWD-01 without a validation result."""
    s = F.coalesce(sql, F.lit(""))
    su = F.upper(F.trim(s))
    starts = su.startswith("SELECT") | su.startswith("INSERT") | su.startswith("UPDATE") | su.startswith("DELETE")
    return (F.when(F.length(F.trim(s)) < 10, P.P_INVALID_SYNTAX)
            .when(~starts, -1.5)
            .when(count_char(s, "(") != count_char(s, ")"), -1.0)
            .when(su.startswith("SELECT") & ~su.contains("FROM") & ~_contains_any(su, ["CURRENT", "DUAL", "NOW()"]), -0.5)
            .when(s.contains(";;") | su.contains("SELECT SELECT"), -1.0)
            .otherwise(P.W_SYNTAX * 0.8))


def schema_reward_basic(sql: Column) -> Column:
    """RWD-02 without a validation result (substring match, as the scorer does)."""
    su = F.upper(F.coalesce(sql, F.lit("")))
    n = None
    for t in P.CORE_TABLES:
        term = F.when(su.contains(t), 1).otherwise(0)
        n = term if n is None else n + term
    return F.when(n == 0, -2.0).when(n == 1, P.W_SCHEMA * 0.5).otherwise(P.W_SCHEMA * 0.8)


def business_reward_basic(sql: Column) -> Column:
    """RWD-03 without a validation result."""
    su = F.upper(F.coalesce(sql, F.lit("")))
    date_kw = su.contains("DATE")
    r = F.lit(0.0)
    for t in P.TIME_SENSITIVE_TABLES:
        r = r + F.when(su.contains(t), F.when(date_kw, 0.5).otherwise(-0.5)).otherwise(0.0)
    r = r + F.when(su.contains("STATUS"),
                   F.when(_contains_any(su, P.VALID_STATUS_WORDS), 0.5).otherwise(-0.3)).otherwise(0.0)
    r = r + F.when(_contains_any(su, ["COUNT", "SUM", "AVG", "MIN", "MAX"]),
                   F.when(su.contains("GROUP BY"), 0.8).otherwise(0.3)).otherwise(0.0)
    money = su.contains("BUDGET") | su.contains("COST")
    r = r + F.when(money & _has(su, r"(BUDGET|COST)\s*>\s*0"), 0.3).otherwise(0.0)
    r = r + F.when(money & _has(su, r"(BUDGET|COST)\s*<\s*-"), -1.0).otherwise(0.0)
    return _clamp(r * 2, -4.0, 4.0)


def performance_reward_basic(sql: Column) -> Column:
    """RWD-04 without a validation result."""
    su = F.upper(F.coalesce(sql, F.lit("")))
    r = F.when(su.contains("LIMIT"), 0.3).otherwise(0.0)
    r = r + F.when(su.contains("SELECT *"), -0.2).otherwise(0.2)
    r = r + F.when(su.contains("WHERE") & _contains_any(su, ["_ID", "_CODE", "STATUS", "_DATE"]), 0.3).otherwise(0.0)
    joins = (F.length(su) - F.length(F.replace(su, F.lit("JOIN"), F.lit("")))) / 4
    r = r + F.when(joins > 5, -0.5).when(joins > 3, -0.2).otherwise(0.0)
    after_where = F.substring(su, F.instr(su, "WHERE"), F.length(su))
    r = r + F.when(su.contains("WHERE") & after_where.contains("SELECT"), -0.3).otherwise(0.0)
    return _clamp(r, -1.0, 1.0)


REASONING_INPUT_KEYS = ["rsn_text", "rsn_lower", "rsn_overlap", "rsn_query_len"]


def reasoning_inputs(reasoning: Column, query: Column) -> dict[str, Column]:
    """Lower-cased reasoning and its word overlap with the question (layer 1)."""
    r = F.coalesce(reasoning, F.lit(""))
    q = F.coalesce(query, F.lit(""))
    lr = F.lower(r)
    qw = F.array_distinct(words(F.lower(q)))
    rw = F.array_distinct(words(lr))
    # texts under 20 characters get a fixed score whatever their words are
    return {"rsn_text": r, "rsn_lower": lr, "rsn_overlap": F.when(F.length(r) >= 20, F.size(F.array_intersect(qw, rw))),
            "rsn_query_len": F.length(q)}


def reasoning_from(i: dict[str, Column]) -> Column:
    """RWD-05 from :func:`reasoning_inputs` (layer 2)."""
    r, lr = i["rsn_text"], i["rsn_lower"]
    n_kw = sum((F.when(lr.contains(k), 1).otherwise(0) for k in P.REASONING_KEYWORDS), F.lit(0))
    n_sql = sum((F.when(lr.contains(k), 1).otherwise(0) for k in P.SQL_REASONING_TERMS), F.lit(0))
    score = (F.when(F.length(r) > 50, 0.2).otherwise(0.0)
             + F.when(r.contains("Step") | r.contains("step"), 0.3).otherwise(0.0)
             + F.least(n_kw * 0.1, F.lit(0.3)) + F.least(n_sql * 0.1, F.lit(0.3))
             + F.when((i["rsn_query_len"] > 10) & (i["rsn_overlap"] > 2), 0.2).otherwise(0.0))
    return (F.when(r == "", P.P_MISSING_REASONING).when(F.length(r) < 20, -0.5)
            .otherwise(_clamp(score, -1.0, 1.0)))


def reasoning_reward(reasoning: Column, query: Column) -> Column:
    """RWD-05: length, structure, keyword and query-overlap credits, clamped to ±1."""
    return reasoning_from(reasoning_inputs(reasoning, query))


def similarity(a: Column, b: Column, distance: Column | None = None) -> Column:
    """Edit-distance similarity ``1 - levenshtein / max(len)`` (native in both engines).

    ``distance`` is their edit distance, where it is known already.
    """
    m = F.greatest(F.length(a), F.length(b))
    return F.when(m == 0, 1.0).otherwise(1.0 - (F.levenshtein(a, b) if distance is None else distance) / m)


ACCURACY_INPUT_KEYS = ["acc_gen_norm", "acc_exp_norm", "acc_gen_type", "acc_exp_type", "acc_gen_tables",
                      "acc_exp_tables", "acc_gen_where", "acc_exp_where", "acc_gen_blank", "acc_exp_null",
                      "acc_exp_blank"]


def accuracy_inputs(sql: Column, expected: Column, upper_sql: Column | None = None,
                    upper_expected: Column | None = None) -> dict[str, Column]:
    """Normalised texts and structures of generated and expected SQL (layer 1).

    The last two are :func:`masked_upper` of the first two, null as empty for ``sql``; projected beforehand, each
    is computed once.
    """
    g = F.coalesce(sql, F.lit(""))
    gs, es = sql_structure(g, upper_sql), sql_structure(expected, upper_expected)
    return {
        "acc_gen_norm": normalize_sql(g), "acc_exp_norm": normalize_sql(expected),
        "acc_gen_type": gs["query_type"], "acc_exp_type": es["query_type"],
        "acc_gen_tables": F.array_sort(F.array_distinct(gs["tables"])),
        "acc_exp_tables": F.array_sort(F.array_distinct(es["tables"])),
        "acc_gen_where": gs["has_where"], "acc_exp_where": es["has_where"],
        "acc_gen_blank": g == "", "acc_exp_null": expected.isNull(), "acc_exp_blank": expected == "",
    }


def accuracy_from(i: dict[str, Column], sim: Column | None = None) -> Column:
    """RWD-06 from :func:`accuracy_inputs` (layer 2)."""
    gn, en = i["acc_gen_norm"], i["acc_exp_norm"]
    s = sim if sim is not None else similarity(gn, en)
    struct = (F.when(i["acc_gen_type"] == i["acc_exp_type"], 0.3).otherwise(0.0)
              + F.when(i["acc_gen_tables"] == i["acc_exp_tables"], 0.4).otherwise(0.0)
              + F.when(i["acc_gen_where"] == i["acc_exp_where"], 0.3).otherwise(0.0))
    combined = s * 0.6 + struct * 0.4
    graded = (F.when(combined > 0.9, 1.8).when(combined > 0.7, 1.0).when(combined > 0.5, 0.3)
              .when(combined > 0.3, -0.5).otherwise(-1.5))
    return (F.when(i["acc_exp_null"], F.lit(None).cast("double"))
            .when(i["acc_gen_blank"] | i["acc_exp_blank"], -1.0)
            .when(gn == en, 2.0)
            .otherwise(graded))


def accuracy_reward(sql: Column, expected: Column, sim: Column | None = None) -> Column:
    """RWD-06. NULL when there is no ground truth (0.0 would read as "computed")."""
    return accuracy_from(accuracy_inputs(sql, expected), sim)


def total_reward(syntax: Column, schema: Column, business: Column, performance: Column,
                 reasoning: Column, accuracy: Column) -> Column:
    """RWD-07: sum of the five components plus 2 x accuracy when accuracy != 0."""
    acc = F.coalesce(accuracy, F.lit(0.0))
    return syntax + schema + business + performance + reasoning + F.when(acc != 0, acc * 2).otherwise(0.0)


def validated_components(v: dict[str, Column]) -> dict[str, Column]:
    """RWD-01..04 given the validation columns of :func:`validate_sql`."""
    return {
        "syntax_reward": F.when(v["syntax_valid"], P.W_SYNTAX)
        .otherwise(-F.least(F.size(v["syntax_errors"]) * 0.5, F.lit(2.0))),
        "schema_reward": F.when(v["schema_compliant"], P.W_SCHEMA)
        .otherwise(-F.least(F.size(v["schema_errors"]) * 0.6, F.lit(3.0))),
        "business_reward": F.when(v["business_valid"], P.W_BUSINESS)
        .otherwise(-F.least(F.size(v["business_errors"]) * 0.8, F.lit(4.0))),
        "performance_reward": F.when(v["performance_acceptable"] & (F.size(v["performance_warnings"]) == 0),
                                     P.W_PERFORMANCE)
        .when(v["performance_acceptable"], P.W_PERFORMANCE * 0.5)
        .otherwise(-F.least(F.size(v["performance_warnings"]) * 0.3, F.lit(1.0))),
    }


def short_sql_guard(sql: Column, reward: Column) -> Column:
    """Syntax reward is the invalid-syntax penalty for missing / very short SQL."""
    return F.when(F.length(F.trim(F.coalesce(sql, F.lit("")))) < 10, P.P_INVALID_SYNTAX).otherwise(reward)


def reward_feedback(c: dict[str, Column]) -> Column:
    """RWD-08 component feedback strings."""
    fb = _issues(
        F.when(c["syntax_reward"] < 0, "Improve SQL syntax correctness"),
        F.when(c["schema_reward"] < 0, "Ensure tables and columns exist in schema"),
        F.when(c["business_reward"] < 0, "Follow business rules and constraints"),
        F.when(c["performance_reward"] < 0, "Optimize query for better performance"),
        F.when(c["reasoning_reward"] < 0, "Provide clearer step-by-step reasoning"),
        F.when(F.coalesce(c["accuracy_reward"], F.lit(0.0)) < 0, "Generated SQL differs significantly from expected"))
    return F.when(F.size(fb) == 0, F.array(F.lit("Good SQL generation with proper reasoning"))).otherwise(fb)


def notebook_reward(sql: Column, query: Column, reasoning: Column) -> Column:
    """RWD-11: SELECT +2, FROM +1, +0.5 per question word found in the SQL,
    unbalanced parentheses -2, reasoning over 10 chars +1; clamped to [0, 10]."""
    su = F.upper(F.coalesce(sql, F.lit("")))
    qwords = words(F.lower(F.coalesce(query, F.lit(""))))
    hits = F.aggregate(qwords, F.lit(0.0),
                       lambda acc, w: acc + F.when(F.lower(F.coalesce(sql, F.lit(""))).contains(w), 0.5).otherwise(0.0))
    r = (F.when(su.contains("SELECT"), 2.0).otherwise(0.0) + F.when(su.contains("FROM"), 1.0).otherwise(0.0) + hits
         + F.when(count_char(su, "(") != count_char(su, ")"), -2.0).otherwise(0.0)
         + F.when(F.length(F.coalesce(reasoning, F.lit(""))) > 10, 1.0).otherwise(0.0))
    return _clamp(r, 0.0, 10.0)


def generator_confidence(sql: Column, reasoning: Column, tables: list[str] | None = None) -> Column:
    """RWD-12: 0.5 base + length / reasoning / SELECT credits + min(0.15, 0.05 per
    schema table named) + min(0.1, 0.02 per clause keyword), capped at 1."""
    s = F.coalesce(sql, F.lit(""))
    su = F.upper(s)
    n_tables = sum((F.when(s.contains(t), 1).otherwise(0) for t in (tables or P.CORE_TABLES)), F.lit(0))
    n_kw = sum((F.when(su.contains(k), 1).otherwise(0) for k in P.CLAUSE_KEYWORDS), F.lit(0))
    c = (F.lit(0.5) + F.when(F.length(F.trim(s)) > 10, 0.1).otherwise(0.0)
         + F.when(F.length(F.coalesce(reasoning, F.lit(""))) > 20, 0.15).otherwise(0.0)
         + F.when(F.upper(F.trim(s)).startswith("SELECT"), 0.1).otherwise(0.0)
         + F.when(n_tables > 0, F.least(F.lit(0.15), n_tables * 0.05)).otherwise(0.0)
         + F.least(F.lit(0.1), n_kw * 0.02))
    return F.least(F.lit(1.0), c)


def graded_feedback(c: dict[str, Column], v: dict[str, Column], most_errors: int | None = None,
                    most_suggestions: int | None = None) -> Column:
    """RWD-09: overall grade line, per-component good/bad lines, the errors of each
    layer and the suggestions, in that order; at most so many of them where a number is given."""
    def comp(name, bad, good, good_at):
        return F.when(c[name] < 0, bad).when(c[name] > good_at, good)

    def listed(arr, label, most=most_errors):
        shown = arr if most is None else F.slice(arr, 1, most)
        return F.when(F.size(arr) > 0, F.concat(F.lit(label), F.array_join(shown, ", ")))

    t = c["total_reward"]
    grade = (F.when(t > 5, "Excellent SQL generation!").when(t > 2, "Good SQL generation with minor issues")
             .when(t > 0, "Acceptable SQL with room for improvement").otherwise("SQL needs significant improvement"))
    return _issues(
        grade,
        comp("syntax_reward", "SQL syntax needs improvement", "SQL syntax is correct", 1),
        comp("schema_reward", "Schema compliance issues detected", "Schema compliance is good", 1),
        comp("business_reward", "Business logic violations found", "Business logic correctly applied", 2),
        comp("performance_reward", "Performance could be optimized", "Query is well-optimized", 0.5),
        comp("reasoning_reward", "Reasoning needs more detail", "Clear reasoning provided", 0.5),
        listed(v["syntax_errors"], "Syntax errors: "),
        listed(v["schema_errors"], "Schema errors: "),
        listed(v["business_errors"], "Business rule violations: "),
        listed(v["suggestions"], "Suggestions: ", most_suggestions))


def join_details(sql: Column) -> Column:
    """COR-05: one string per JOIN clause: ``TYPE table alias ON condition``.

    The text is split on the JOIN keyword (no look-ahead needed): the join type
    is the trailing keyword of the previous piece (default INNER), table and
    alias lead the current piece, and the condition runs from ON to the next
    clause keyword.
    """
    u = F.upper(sql)
    pieces = F.split(u, r"\bJOIN\b")

    def one(x, i):
        # i is 0-based, so 1-based element i is the previous piece (i = 0 is dropped below)
        prev = F.element_at(pieces, F.greatest(i, F.lit(1)))
        jtype = F.regexp_extract(prev, r"(INNER|LEFT|RIGHT|FULL|CROSS)(\s+OUTER)?\s*$", 1)
        table = F.regexp_extract(x, r"^\s*(\w+)", 1)
        alias = F.regexp_extract(x, r"^\s*\w+\s+(?:AS\s+)?(\w+)\s+ON\b", 1)
        cond = F.regexp_extract(x, P.JOIN_CONDITION, 1)
        return F.concat_ws(" ", F.when(jtype == "", "INNER").otherwise(jtype), table,
                           F.when(alias != "", alias), F.when(cond != "", F.concat(F.lit("ON "), cond)))

    return F.slice(F.transform(pieces, one), F.lit(2), F.size(pieces))
