"""DuckDB twins of :mod:`tessera.functions.sqltext` for the oracle queries.

Each function mirrors the Spark function of the same name and returns a SQL
expression string over the given SQL expression arguments. Only used to build
``oracle_sql()`` text; nothing here runs on Spark.
"""

from __future__ import annotations

from ..functions import patterns as P
from ..sources.catalog import qualified_columns


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def arr(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


EMPTY = "[]::VARCHAR[]"


def issues(*items: str) -> str:
    return "list_filter([" + ", ".join(f"CAST({i} AS VARCHAR)" for i in items) + "], lambda x: x IS NOT NULL)"


def flat(*arrays: str) -> str:
    return "(" + " || ".join(arrays) + ")"


def num(x: float) -> str:
    """A DOUBLE literal (bare decimals are DECIMAL in DuckDB)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def when(cond: str, val: str, other: str = "NULL") -> str:
    return f"(CASE WHEN {cond} THEN {val} ELSE {other} END)"


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}, 0))"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def contains(text: str, lit: str) -> str:
    return f"contains({text}, {q(lit)})"


def contains_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(contains(text, w) for w in words) + ")"


def items(text: str) -> str:
    """Pieces between commas, joined up to each comma before which as many parentheses have closed as opened."""
    depth = "len(replace({0}, ')', '')) - len(replace({0}, '(', ''))"
    ends = (f"list_filter(range(1, len(ps) + 1), lambda k: k = len(ps) OR "
            f"{depth.format("array_to_string(ps[1:k], ',')")} <= 0)")
    cut = ("list_transform(range(1, len(es) + 1), lambda j: trim(array_to_string("
           "ps[(CASE WHEN j = 1 THEN 0 ELSE es[j - 1] END) + 1:es[j]], ',')))")
    with_ends = f"list_transform([{ends}], lambda es: {cut})[1]"
    whole = f"list_transform([string_split({text}, ',')], lambda ps: {with_ends})[1]"
    return f"list_filter({whole}, lambda x: x <> '')"


def clamp(x: str, lo: float, hi: float) -> str:
    return f"greatest({lo}, least({hi}, {x}))"


def count_char(text: str, ch: str) -> str:
    return f"(length({text}) - length(replace({text}, {q(ch)}, '')))"


def words(text: str) -> str:
    return f"list_filter(string_split_regex(trim({text}), '\\s+'), lambda x: x <> '')"


def normalize_sql(sql: str) -> str:
    s = f"trim(regexp_replace(upper({sql}), '\\s+', ' ', 'g'))"
    s = f"regexp_replace({s}, ';+$', '', 'g')"
    s = f"replace({s}, '\"', '''')"
    s = f"regexp_replace({s}, '(?m)--.*$', '', 'g')"
    s = f"regexp_replace({s}, '(?s)/\\*.*?\\*/', '', 'g')"
    return f"trim({s})"


def normalize_sql_eval(sql: str) -> str:
    s = f"replace(upper(trim({sql})), ';', '')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def query_type(u: str) -> str:
    return (f"(CASE WHEN starts_with({u}, 'SELECT') THEN 'SELECT' WHEN starts_with({u}, 'INSERT') THEN 'INSERT' "
            f"WHEN starts_with({u}, 'UPDATE') THEN 'UPDATE' WHEN starts_with({u}, 'DELETE') THEN 'DELETE' ELSE '' END)")


def masked_upper(sql: str) -> str:
    return (f"trim(regexp_replace(upper({sql}), {q(P.MASKED)}, '\\1\\3 \\2\\4', 'g'), "
            "chr(32) || chr(9) || chr(13) || chr(10))")


def sql_structure(sql: str) -> dict[str, str]:
    u = masked_upper(sql)
    first = f"regexp_extract({u}, {q(P.FROM_TABLE)}, 1)"
    nonempty = first + " <> ''"
    tables = f"({when(nonempty, '[' + first + ']', EMPTY)} || regexp_extract_all({u}, {q(P.JOIN_TABLE)}, 1))"
    return {
        "query_type": query_type(u), "tables": tables,
        "has_where": contains(u, "WHERE"), "has_join": contains(u, "JOIN"),
        "has_group_by": contains(u, "GROUP BY"), "has_order_by": contains(u, "ORDER BY"),
        "has_limit": contains(u, "LIMIT"),
    }


def sql_features(sql: str, upper_sql: str | None = None) -> dict[str, str]:
    u = upper_sql or masked_upper(sql)
    tables = (f"list_sort(list_distinct(regexp_extract_all({u}, {q(P.FROM_TABLE)}, 1) || "
              f"regexp_extract_all({u}, {q(P.JOIN_TABLE)}, 1) || regexp_extract_all({u}, {q(P.DML_TABLE)}, 1)))")
    join_tables = f"regexp_extract_all({u}, {q(P.JOIN_TABLE)}, 1)"
    n_joins = count(u, P.JOIN_WORD)
    has_where = has(u, P.WHERE_WORD)
    where_sub = has(u, P.WHERE_SUBQUERY)
    n_aggs = count(u, P.AGG_CALL)
    group_items = items(f"regexp_extract({u}, {q(P.GROUP_LIST)}, 1)")
    order_items = items(f"regexp_extract({u}, {q(P.ORDER_LIST)}, 1)")
    lim = f"regexp_extract({u}, {q(P.LIMIT_VALUE)}, 1)"
    limit = f"(CASE WHEN {lim} <> '' THEN CAST({lim} AS INTEGER) END)"
    sel_items = items(f"regexp_extract({u}, {q(P.SELECT_LIST)}, 1)")
    plain = (f"list_transform(list_filter({sel_items}, lambda x: NOT regexp_matches(x, {q(P.AGG_CALL)}) AND x <> '*'), "
             f"lambda x: regexp_replace(x, {q(P.ALIAS_SUFFIX)}, '', 'g'))")
    qtype = query_type(u)
    is_select = qtype + " = 'SELECT'"
    complexity = (f"least(10.0, {when(is_select, '1.0', '0.0')} + {n_joins} * 1.5 + "
                  f"{when(has_where, '0.5', '0.0')} + {n_aggs} * 0.8 + len({group_items}) * 0.6 + "
                  f"{when(where_sub, '2.0', '0.0')})")
    cost = f"(CASE WHEN {complexity} < 3 THEN 'low' WHEN {complexity} < 6 THEN 'medium' ELSE 'high' END)"
    advice = issues(
        when(f"{n_joins} > 3", q("Consider breaking complex joins into smaller queries or using CTEs")),
        when(f"{limit} IS NULL AND {qtype} = 'SELECT'", q("Consider adding LIMIT clause for large result sets")),
        when(f"NOT {has_where}", q("No WHERE clause detected - ensure this is intentional")),
        when(f"len({tables}) > 5", q("Many tables involved - verify all joins are necessary")))
    return {
        "upper_sql": u, "query_type": qtype, "tables": tables, "join_tables": join_tables,
        "n_joins": n_joins, "has_where": has_where, "where_subquery": where_sub, "n_aggregations": n_aggs,
        "group_by": group_items, "order_by": order_items, "limit_value": limit, "select_items": sel_items,
        "plain_columns": plain, "has_star": f"list_contains({sel_items}, '*')",
        "complexity": complexity, "cost_class": cost, "advice": advice,
    }


def validate_sql(sql: str, f: dict[str, str] | None = None) -> dict[str, str]:
    """Twin of validate_sql. ``f`` may map feature names to already-computed column names."""
    f = f or sql_features(sql)
    u, tables, has_where = f["upper_sql"], f["tables"], f["has_where"]
    syntax = issues(
        when(f"coalesce(trim({sql}), '') = ''", q("Unable to parse SQL")),
        when(f"{count_char(sql, '(')} <> {count_char(sql, ')')}", q("Unmatched parentheses")),
        when(f"{contains(u, 'SELECT')} AND NOT {contains(u, 'FROM')} AND NOT "
             f"{contains_any(u, ['CURRENT_DATE', 'CURRENT_TIME', 'DUAL'])}", q("SELECT statement missing FROM clause")),
        when(f"{contains(u, 'GROUP BY')} AND NOT {has(u, P.AGG_WORD)}", q("GROUP BY without aggregation function")))
    catalog = arr(P.CATALOG_TABLES)
    valid_cols = arr(qualified_columns())
    unknown_tables = (f"list_transform(list_filter({tables}, lambda t: NOT list_contains({catalog}, t)), "
                      f"lambda t: 'Table ''' || t || ''' not found in schema')")
    unknown_joins = (f"list_transform(list_filter(list_distinct({f['join_tables']}), "
                     f"lambda t: NOT list_contains({catalog}, t)), lambda t: 'Join table ''' || t || ''' not found in schema')")
    refs = f"list_distinct(regexp_extract_all({u}, {q(P.QUALIFIED_REF)}, 0))"
    bad_cols = (f"list_transform(list_filter({refs}, lambda r: list_contains({catalog}, split_part(r, '.', 1)) "
                f"AND NOT list_contains({valid_cols}, r)), lambda r: 'Column ''' || split_part(r, '.', 2) || "
                f"''' not found in table ''' || split_part(r, '.', 1) || '''')")
    schema = flat(unknown_tables, bad_cols, unknown_joins)

    status_vals = f"regexp_extract_all({sql}, {q(P.STATUS_VALUE)}, 1)"
    status_errs = []
    for table, allowed in P.STATUS_DOMAINS.items():
        tail = f" for table {table}. Valid values: {', '.join(allowed)}"
        errs = (f"list_transform(list_filter({status_vals}, lambda s: NOT list_contains({arr(allowed)}, s)), "
                f"lambda s: 'Invalid status ''' || s || '''' || {q(tail)})")
        status_errs.append(when(f"list_contains({tables}, {q(table)})", errs, EMPTY))
    has_date = has(u, P.DATE_PREDICATE)
    rules = []
    for t in P.REQUIRE_DATE_FILTER:
        rules.append(when(f"list_contains({tables}, {q(t)}) AND NOT {has_date}",
                          q(f"Table {t} requires date filter in WHERE clause")))
    for t in P.LARGE_TABLES:
        rules.append(when(f"list_contains({tables}, {q(t)}) AND NOT {has_where}",
                          q(f"Large table {t} requires WHERE clause for performance")))
    for t in P.SENSITIVE_TABLES:
        rules.append(when(f"list_contains({tables}, {q(t)}) AND NOT {has_where}",
                          q(f"Sensitive table {t} requires WHERE clause for security")))
    plain = f["plain_columns"]
    business = flat(*status_errs, issues(
        *rules,
        when(f"{contains_any(u, ['BUDGET', 'COST', 'VALUE'])} AND {has(u, P.NEGATIVE_AMOUNT)}",
             q("Budget/Cost/Value cannot be negative")),
        when(f"{contains(u, 'PARENT_ID')} AND list_contains({tables}, 'SRM_PROJECTS') AND "
             f"{contains_any(u, ['CONNECT BY', 'WITH RECURSIVE'])} AND NOT {contains(u, 'LEVEL')} AND NOT "
             f"{contains('lower(' + sql + ')', 'depth')}", q("Hierarchical query should have depth limit")),
        when(f"{f['n_aggregations']} > 0 AND len({f['group_by']}) = 0 AND len({plain}) > 0",
             q("Non-aggregated columns must be in GROUP BY clause"))))

    missing = f"list_filter({plain}, lambda c: NOT list_contains({f['group_by']}, c))"
    agg_consistency = flat(
        when(f"{f['n_aggregations']} > 0",
             f"list_transform({missing}, lambda c: 'Column ''' || c || ''' must be in GROUP BY clause or used in aggregation')",
             EMPTY),
        issues(when(f"len({f['group_by']}) > 0 AND {f['n_aggregations']} = 0",
                    q("GROUP BY used without aggregation functions"))))

    n_tables = f"len({tables})"
    cartesian = f"({n_tables} > 1 AND {f['n_joins']} < {n_tables} - 1)"
    too_complex = f"({f['complexity']} > {P.MAX_COMPLEXITY})"
    perf = issues(
        when(too_complex, f"'Query complexity (' || printf('%.1f', {f['complexity']}) || "
                          f"{q(f') exceeds threshold ({P.MAX_COMPLEXITY})')}"),
        when(f"{f['n_joins']} > {P.MAX_JOINS}", f"'Too many joins (' || CAST({f['n_joins']} AS VARCHAR) || "
                                                f"{q(f'). Maximum recommended: {P.MAX_JOINS}')}"),
        when(f"{n_tables} > {P.MAX_TABLES_WITHOUT_LIMIT} AND {f['limit_value']} IS NULL",
             q("Query on multiple tables without LIMIT clause")),
        when(cartesian, q("Potential cartesian product detected (missing joins)")),
        *[when(f"NOT {has_where} AND list_contains({tables}, {q(t)})", q(f"Large table {t} accessed without WHERE clause"))
          for t in P.INDEX_HINT_TABLES])
    perf_ok = f"(NOT {too_complex} AND NOT {cartesian})"
    where_text = f"regexp_extract({u}, {q(P.WHERE_TEXT)}, 1)"
    optimizations = issues(
        when(f"{f['n_joins']} > {P.MAX_JOINS}", q("Consider breaking query into smaller parts or using CTEs")),
        when(f"{n_tables} > {P.MAX_TABLES_WITHOUT_LIMIT} AND {f['limit_value']} IS NULL",
             q("Add LIMIT clause to restrict result set size")),
        when(f["has_star"], q("Avoid SELECT *, specify required columns explicitly")),
        when(f["where_subquery"], q("Consider replacing subqueries with JOINs for better performance")),
        when(f"{has_where} AND {has(where_text, P.OR_WORD)}",
             q("Multiple OR conditions may prevent index usage, consider UNION")),
        when(f"{has_where} AND {has(where_text, P.FUNCTION_IN_WHERE)}",
             q("Functions in WHERE clause may prevent index usage")))

    low = f"lower({sql})"
    security = issues(
        *[when(has(sql, p), q(f"Potential SQL injection pattern detected: {p}")) for p in P.INJECTION_PATTERNS],
        *[when(has(u, rf"\b{fn}\b"), q(f"Forbidden function {fn} detected")) for fn in P.FORBIDDEN_FUNCTIONS],
        when(f"{contains(sql, ';')} AND right(trim({sql}), 1) <> ';'", q("Multiple SQL statements detected")),
        *[when(has(low, rf"\b{t}\b"), q(f"Access to system table '{t}' detected")) for t in P.SYSTEM_TABLES])
    syntax_ok, schema_ok = f"(len({syntax}) = 0)", f"(len({schema}) = 0)"
    business_ok, security_ok = f"(len({business}) = 0)", f"(len({security}) = 0)"
    suggestions = issues(
        when(f"NOT {syntax_ok}", q("Fix syntax errors before proceeding")),
        when(f"NOT {schema_ok}", q("Verify table and column names against schema")),
        when(f"len(list_filter({business}, lambda e: contains(lower(e), 'date filter'))) > 0",
             q("Add date range filter to improve performance and accuracy")),
        when(f"len(list_filter({business}, lambda e: contains(lower(e), 'status'))) > 0",
             q("Use valid status values from the business rules")),
        when(f"len({perf}) > 0", q("Consider performance optimizations for production use")),
        when(f"NOT {security_ok}", q("Review query for potential security vulnerabilities")),
        when(f"{f['limit_value']} IS NULL AND {f['query_type']} = 'SELECT'", q("Consider adding LIMIT for testing")),
        when(f"{n_tables} = 1 AND NOT {has_where}", q("Add WHERE clause to filter results")))
    cx = f["complexity"]
    conf = (f"(1.0 - len({syntax}) * 0.2 - len({schema}) * 0.15 - len({business}) * 0.1 - len({perf}) * 0.05 "
            f"- len({security}) * 0.25 - (CASE WHEN {cx} > 7 THEN 0.1 WHEN {cx} > 5 THEN 0.05 ELSE 0.0 END))")
    return {
        **f,
        "syntax_errors": syntax, "schema_errors": schema, "business_errors": business,
        "aggregation_errors": agg_consistency, "performance_warnings": perf, "optimizations": optimizations,
        "security_warnings": security, "suggestions": suggestions,
        "syntax_valid": syntax_ok, "schema_compliant": schema_ok, "business_valid": business_ok,
        "performance_acceptable": perf_ok, "security_passed": security_ok,
        "confidence": clamp(conf, 0.0, 1.0),
        "is_valid_strict": f"({syntax_ok} AND {schema_ok} AND {business_ok} AND {security_ok})",
        "is_valid_lax": f"({syntax_ok} AND {security_ok})",
    }


def syntax_reward_basic(sql: str) -> str:
    s = f"coalesce({sql}, '')"
    su = f"upper(trim({s}))"
    starts = "(" + " OR ".join(f"starts_with({su}, {q(k)})" for k in ["SELECT", "INSERT", "UPDATE", "DELETE"]) + ")"
    return (f"(CASE WHEN length(trim({s})) < 10 THEN {num(P.P_INVALID_SYNTAX)} WHEN NOT {starts} THEN -1.5 "
            f"WHEN {count_char(s, '(')} <> {count_char(s, ')')} THEN -1.0 "
            f"WHEN starts_with({su}, 'SELECT') AND NOT {contains(su, 'FROM')} AND NOT "
            f"{contains_any(su, ['CURRENT', 'DUAL', 'NOW()'])} THEN -0.5 "
            f"WHEN {contains(s, ';;')} OR {contains(su, 'SELECT SELECT')} THEN -1.0 ELSE {num(P.W_SYNTAX * 0.8)} END)")


def schema_reward_basic(sql: str) -> str:
    su = f"upper(coalesce({sql}, ''))"
    n = "(" + " + ".join(when(contains(su, t), "1", "0") for t in P.CORE_TABLES) + ")"
    return f"(CASE WHEN {n} = 0 THEN -2.0 WHEN {n} = 1 THEN {num(P.W_SCHEMA * 0.5)} ELSE {num(P.W_SCHEMA * 0.8)} END)"


def business_reward_basic(sql: str) -> str:
    su = f"upper(coalesce({sql}, ''))"
    date_kw = contains(su, "DATE")
    r = "0.0"
    for t in P.TIME_SENSITIVE_TABLES:
        r = f"{r} + {when(contains(su, t), when(date_kw, '0.5', '-0.5'), '0.0')}"
    r = f"{r} + {when(contains(su, 'STATUS'), when(contains_any(su, P.VALID_STATUS_WORDS), '0.5', '-0.3'), '0.0')}"
    r = (f"{r} + {when(contains_any(su, ['COUNT', 'SUM', 'AVG', 'MIN', 'MAX']), when(contains(su, 'GROUP BY'), '0.8', '0.3'), '0.0')}")
    money = f"({contains(su, 'BUDGET')} OR {contains(su, 'COST')})"
    r = f"{r} + {when(money + ' AND ' + has(su, r'(BUDGET|COST)\s*>\s*0'), '0.3', '0.0')}"
    r = f"{r} + {when(money + ' AND ' + has(su, r'(BUDGET|COST)\s*<\s*-'), '-1.0', '0.0')}"
    return clamp(f"({r}) * 2", -4.0, 4.0)


def performance_reward_basic(sql: str) -> str:
    su = f"upper(coalesce({sql}, ''))"
    r = when(contains(su, "LIMIT"), "0.3", "0.0")
    r = f"{r} + {when(contains(su, 'SELECT *'), '-0.2', '0.2')}"
    r = f"{r} + {when(contains(su, 'WHERE') + ' AND ' + contains_any(su, ['_ID', '_CODE', 'STATUS', '_DATE']), '0.3', '0.0')}"
    joins = f"((length({su}) - length(replace({su}, 'JOIN', ''))) / 4)"
    r = f"{r} + (CASE WHEN {joins} > 5 THEN -0.5 WHEN {joins} > 3 THEN -0.2 ELSE 0.0 END)"
    after = f"substring({su}, instr({su}, 'WHERE'), length({su}))"
    r = f"{r} + {when(contains(su, 'WHERE') + ' AND ' + contains(after, 'SELECT'), '-0.3', '0.0')}"
    return clamp(f"({r})", -1.0, 1.0)


def reasoning_reward(reasoning: str, query: str) -> str:
    r = f"coalesce({reasoning}, '')"
    qq = f"coalesce({query}, '')"
    lr = f"lower({r})"
    n_kw = "(" + " + ".join(when(contains(lr, k), "1", "0") for k in P.REASONING_KEYWORDS) + ")"
    n_sql = "(" + " + ".join(when(contains(lr, k), "1", "0") for k in P.SQL_REASONING_TERMS) + ")"
    qw = f"list_distinct({words('lower(' + qq + ')')})"
    rw = f"list_distinct({words(lr)})"
    overlap = f"len(list_intersect({qw}, {rw}))"
    score = (f"({when(f'length({r}) > 50', '0.2', '0.0')} + "
             f"{when(contains(r, 'Step') + ' OR ' + contains(r, 'step'), '0.3', '0.0')} + "
             f"least({n_kw} * 0.1, 0.3) + least({n_sql} * 0.1, 0.3) + "
             f"{when(f'length({qq}) > 10 AND {overlap} > 2', '0.2', '0.0')})")
    return (f"(CASE WHEN {r} = '' THEN {num(P.P_MISSING_REASONING)} WHEN length({r}) < 20 THEN -0.5 "
            f"ELSE {clamp(score, -1.0, 1.0)} END)")


def similarity(a: str, b: str) -> str:
    m = f"greatest(length({a}), length({b}))"
    return f"(CASE WHEN {m} = 0 THEN 1.0 ELSE 1.0 - levenshtein({a}, {b}) / {m} END)"


def accuracy_reward(sql: str, expected: str) -> str:
    g = f"coalesce({sql}, '')"
    e = expected
    gn, en = normalize_sql(g), normalize_sql(e)
    gs, es = sql_structure(g), sql_structure(e)
    s = similarity(gn, en)
    same = f"list_sort(list_distinct({gs['tables']})) = list_sort(list_distinct({es['tables']}))"
    struct = (f"({when(gs['query_type'] + ' = ' + es['query_type'], '0.3', '0.0')} + {when(same, '0.4', '0.0')} + "
              f"{when(gs['has_where'] + ' = ' + es['has_where'], '0.3', '0.0')})")
    comb = f"({s} * 0.6 + {struct} * 0.4)"
    graded = (f"(CASE WHEN {comb} > 0.9 THEN 1.8 WHEN {comb} > 0.7 THEN 1.0 WHEN {comb} > 0.5 THEN 0.3 "
              f"WHEN {comb} > 0.3 THEN -0.5 ELSE -1.5 END)")
    return (f"(CASE WHEN {e} IS NULL THEN NULL WHEN {g} = '' OR {e} = '' THEN -1.0 WHEN {gn} = {en} THEN 2.0 "
            f"ELSE {graded} END)")


def total_reward(syn: str, sch: str, bus: str, perf: str, rsn: str, acc: str) -> str:
    a = f"coalesce({acc}, 0.0)"
    return f"({syn} + {sch} + {bus} + {perf} + {rsn} + (CASE WHEN {a} <> 0 THEN {a} * 2 ELSE 0.0 END))"


def validated_components(v: dict[str, str]) -> dict[str, str]:
    return {
        "syntax_reward": f"(CASE WHEN {v['syntax_valid']} THEN {num(P.W_SYNTAX)} ELSE -least(len({v['syntax_errors']}) * 0.5, 2.0) END)",
        "schema_reward": f"(CASE WHEN {v['schema_compliant']} THEN {num(P.W_SCHEMA)} ELSE -least(len({v['schema_errors']}) * 0.6, 3.0) END)",
        "business_reward": f"(CASE WHEN {v['business_valid']} THEN {num(P.W_BUSINESS)} ELSE -least(len({v['business_errors']}) * 0.8, 4.0) END)",
        "performance_reward": (f"(CASE WHEN {v['performance_acceptable']} AND len({v['performance_warnings']}) = 0 "
                               f"THEN {num(P.W_PERFORMANCE)} WHEN {v['performance_acceptable']} THEN {num(P.W_PERFORMANCE * 0.5)} "
                               f"ELSE -least(len({v['performance_warnings']}) * 0.3, 1.0) END)"),
    }


def short_sql_guard(sql: str, reward: str) -> str:
    return f"(CASE WHEN length(trim(coalesce({sql}, ''))) < 10 THEN {num(P.P_INVALID_SYNTAX)} ELSE {reward} END)"


def reward_feedback(c: dict[str, str]) -> str:
    fb = issues(
        when(f"{c['syntax_reward']} < 0", q("Improve SQL syntax correctness")),
        when(f"{c['schema_reward']} < 0", q("Ensure tables and columns exist in schema")),
        when(f"{c['business_reward']} < 0", q("Follow business rules and constraints")),
        when(f"{c['performance_reward']} < 0", q("Optimize query for better performance")),
        when(f"{c['reasoning_reward']} < 0", q("Provide clearer step-by-step reasoning")),
        when(f"coalesce({c['accuracy_reward']}, 0.0) < 0", q("Generated SQL differs significantly from expected")))
    return f"(CASE WHEN len({fb}) = 0 THEN ['Good SQL generation with proper reasoning'] ELSE {fb} END)"


def notebook_reward(sql: str, query: str, reasoning: str) -> str:
    su = f"upper(coalesce({sql}, ''))"
    qwords = words(f"lower(coalesce({query}, ''))")
    hits = (f"coalesce(list_sum(list_transform({qwords}, lambda w: CASE WHEN contains(lower(coalesce({sql}, '')), w) "
            f"THEN 0.5 ELSE 0.0 END)), 0.0)")
    parens = f"{count_char(su, '(')} <> {count_char(su, ')')}"
    long_reason = f"length(coalesce({reasoning}, '')) > 10"
    r = (f"({when(contains(su, 'SELECT'), '2.0', '0.0')} + {when(contains(su, 'FROM'), '1.0', '0.0')} + {hits} + "
         f"{when(parens, '-2.0', '0.0')} + {when(long_reason, '1.0', '0.0')})")
    return clamp(r, 0.0, 10.0)


def generator_confidence(sql: str, reasoning: str) -> str:
    s = f"coalesce({sql}, '')"
    su = f"upper({s})"
    n_tables = "(" + " + ".join(when(contains(s, t), "1", "0") for t in P.CORE_TABLES) + ")"
    n_kw = "(" + " + ".join(when(contains(su, k), "1", "0") for k in P.CLAUSE_KEYWORDS) + ")"
    long_sql = f"length(trim({s})) > 10"
    long_reason = f"length(coalesce({reasoning}, '')) > 20"
    is_select = f"starts_with(upper(trim({s})), 'SELECT')"
    return (f"least(1.0, 0.5 + {when(long_sql, '0.1', '0.0')} + {when(long_reason, '0.15', '0.0')} + "
            f"{when(is_select, '0.1', '0.0')} + "
            f"(CASE WHEN {n_tables} > 0 THEN least(0.15, {n_tables} * 0.05) ELSE 0.0 END) + least(0.1, {n_kw} * 0.02))")


def graded_feedback(c: dict[str, str], v: dict[str, str]) -> str:
    def comp(name, bad, good, good_at):
        return f"(CASE WHEN {c[name]} < 0 THEN {q(bad)} WHEN {c[name]} > {good_at} THEN {q(good)} END)"

    def listed(a, label):
        return when(f"len({a}) > 0", f"{q(label)} || array_to_string({a}, ', ')")

    t = c["total_reward"]
    grade = (f"(CASE WHEN {t} > 5 THEN 'Excellent SQL generation!' WHEN {t} > 2 THEN "
             f"'Good SQL generation with minor issues' WHEN {t} > 0 THEN 'Acceptable SQL with room for improvement' "
             f"ELSE 'SQL needs significant improvement' END)")
    return issues(
        grade,
        comp("syntax_reward", "SQL syntax needs improvement", "SQL syntax is correct", 1),
        comp("schema_reward", "Schema compliance issues detected", "Schema compliance is good", 1),
        comp("business_reward", "Business logic violations found", "Business logic correctly applied", 2),
        comp("performance_reward", "Performance could be optimized", "Query is well-optimized", 0.5),
        comp("reasoning_reward", "Reasoning needs more detail", "Clear reasoning provided", 0.5),
        listed(v["syntax_errors"], "Syntax errors: "),
        listed(v["schema_errors"], "Schema errors: "),
        listed(v["business_errors"], "Business rule violations: "),
        listed(v["suggestions"], "Suggestions: "))


def join_details(sql: str) -> str:
    u = f"upper({sql})"
    pieces = f"string_split_regex({u}, {q(r'\bJOIN\b')})"
    prev = f"{pieces}[i - 1]"  # DuckDB list index i is 1-based: previous piece
    jtype = f"regexp_extract({prev}, {q(r'(INNER|LEFT|RIGHT|FULL|CROSS)(\s+OUTER)?\s*$')}, 1)"
    table = f"regexp_extract(x, {q(r'^\s*(\w+)')}, 1)"
    alias = f"regexp_extract(x, {q(r'^\s*\w+\s+(?:AS\s+)?(\w+)\s+ON\b')}, 1)"
    cond = f"regexp_extract(x, {q(P.JOIN_CONDITION)}, 1)"
    one = (f"concat_ws(' ', CASE WHEN {jtype} = '' THEN 'INNER' ELSE {jtype} END, {table}, "
           f"CASE WHEN {alias} <> '' THEN {alias} END, CASE WHEN {cond} <> '' THEN 'ON ' || {cond} END)")
    return f"list_transform({pieces}, lambda x, i: {one})[2:]"
