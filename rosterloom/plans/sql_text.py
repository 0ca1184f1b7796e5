"""SQL text of the keys and rules, for a DuckDB that holds the same tables.

Builders take and return SQL expressions. They state the same rules as the column expressions in
rosterloom.functions, and the queries' oracle SQL is made of them.
"""

from __future__ import annotations

from rosterloom.functions import vocab
from rosterloom.functions.nicknames import SEED, NicknameDictionary


def _one(expr: str, what: str) -> str:
    if not isinstance(expr, str) or not expr.strip():
        raise ValueError(f"{what} requires a non-empty column expression")
    return expr


def sql_quote_literal(x):
    """A quoted literal, or NULL; a list gives a list."""
    if isinstance(x, (list, tuple)):
        return [sql_quote_literal(v) for v in x]
    if x is None:
        return "NULL"
    if not isinstance(x, str):
        raise ValueError(f"sql_quote_literal() requires strings; got {type(x).__name__}")
    return "'" + x.replace("'", "''") + "'"


_q = sql_quote_literal


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(_q(list(values))) + "]"


def sql_translit_upper(expr: str) -> str:
    out = f"nfc_normalize({expr})"
    for a, b in (vocab.EXPANSIONS | vocab.SINGLE_LETTERS).items():
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    return f"strip_accents(upper({out}))"


def sql_npi_name(expr: str) -> str:
    return f"trim({sql_translit_upper(_one(expr, 'sql_npi_name()'))}, e' \\t\\r\\n')"


def sql_strip_parenthetical(expr: str) -> str:
    out = f"regexp_replace({_one(expr, 'sql_strip_parenthetical()')}, '([A-Za-z''])\\(([^)]*)\\)', '\\1\\2', 'g')"
    for pattern in (r"\([^)]*\)", r"\([^)]*$", r"[][()]"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return out


def sql_name_key(expr: str, fold_hyphens: bool = False) -> str:
    out = sql_strip_parenthetical(sql_translit_upper(_one(expr, "sql_name_key()")))
    if fold_hyphens:
        out = f"replace({out}, '-', ' ')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def sql_name_clean(expr: str) -> str:
    base = sql_strip_parenthetical(sql_npi_name(_one(expr, "sql_name_clean()")))
    return f"trim(regexp_replace(regexp_replace({base}, '{vocab.TRAILING_CREDENTIAL}', '', 'g'), '[^A-Z]', ' ', 'g'))"


def sql_name_compact(expr: str, strip_suffixes: bool = False) -> str:
    if not isinstance(strip_suffixes, bool):
        raise ValueError("strip_suffixes must be True or False")
    base = sql_name_clean(expr) if strip_suffixes else sql_strip_parenthetical(sql_translit_upper(_one(expr, "sql_name_compact()")))
    return f"nullif(regexp_replace({base}, '[^A-Z]', '', 'g'), '')"


def sql_first_initial(expr: str) -> str:
    return f"nullif(substr(regexp_replace({sql_translit_upper(_one(expr, 'sql_first_initial()'))}, '[^A-Z]', '', 'g'), 1, 1), '')"


def sql_middle_initial_guard(left_initial: str, right_middle: str) -> str:
    """True unless both are there and the middle name's first letter is another."""
    a, b = _one(left_initial, "sql_middle_initial_guard()"), _one(right_middle, "sql_middle_initial_guard()")
    letter = f"substr(regexp_replace(upper(coalesce({b}, '')), '[^A-Z]', '', 'g'), 1, 1)"
    return f"({a} IS NULL OR trim({a}) = '' OR {b} IS NULL OR trim({b}) = '' OR {letter} = {a})"


def sql_nm_key(expr: str) -> str:
    return f"regexp_replace(regexp_replace({sql_npi_name(expr)}, '\\s+', ' ', 'g'), '[''’`]', '', 'g')"


def sql_tokens(expr: str, separators: str, keep: str) -> str:
    return f"list_filter(string_split_regex(coalesce({expr}, ''), '{separators}'), lambda t: {keep})"


def sql_middle_tokens(expr: str) -> str:
    return sql_tokens(sql_name_key(expr), "[^A-Z''-]+", "regexp_matches(t, '[A-Z]')")


def sql_surname_tokens(expr: str) -> str:
    return sql_tokens(sql_name_key(expr), "[^A-Z'']+", f"length(t) >= {vocab.MIN_SURNAME_TOKEN} AND NOT list_contains({sql_list(vocab.SURNAME_PARTICLES)}, t)")


def sql_components(key: str) -> str:
    return sql_tokens(f"upper({key})", "[^A-Z]+", "length(t) >= 2")


def sql_leading(key: str) -> str:
    return f"list_filter(string_split_regex(upper({key}), '[^A-Z-]+'), lambda t: regexp_matches(t, '[A-Z]'))[1]"


def sql_surname_match_type(ka: str, kb: str, xa: str, xb: str) -> str:
    """Of columns that hold keys and component lists."""
    particles = sql_list(vocab.NAME_SURNAME_PARTICLES)
    inside = lambda s, b: f"len(list_filter({s}, lambda t: NOT list_contains({b}, t))) = 0"
    glued = lambda s, b: f"(len({s}) > 1 AND list_contains({b}, array_to_string({s}, '')))"
    nests = lambda s, b: f"({inside(s, b)} AND len(list_filter({s}, lambda t: NOT list_contains({particles}, t))) > 0)"
    return (
        f"CASE WHEN {ka} <> '' AND {ka} = {kb} THEN 'exact' WHEN len({xa}) = 0 OR len({xb}) = 0 THEN 'none' "
        f"WHEN {inside(xa, xb)} AND {inside(xb, xa)} THEN 'separator_equivalent' WHEN {glued(xa, xb)} OR {glued(xb, xa)} THEN 'concatenated_equivalent' "
        f"WHEN {nests(xb, xa)} OR {nests(xa, xb)} THEN 'component_subset' ELSE 'none' END"
    )


def sql_verdict(known: str, agrees: str) -> str:
    return f"CASE WHEN NOT coalesce({known}, false) THEN 'uninformative' WHEN {agrees} THEN 'corroborates' ELSE 'conflicts' END"


def sql_case(table: dict, expr: str) -> str:
    lit = lambda v: str(v) if isinstance(v, int) else _q(v)
    return f"CASE {expr} " + " ".join(f"WHEN {_q(k)} THEN {lit(v)}" for k, v in table.items()) + " END"


def sql_roots(expr: str, edges: NicknameDictionary = SEED) -> str:
    """List of a token and the formal names it is recorded for."""
    cases = " ".join(f"WHEN {_q(k)} THEN {sql_list(v)}" for k, v in sorted(edges.formals.items()))
    return f"list_concat([{expr}], CASE {expr} {cases} ELSE []::VARCHAR[] END)"


def sql_luhn_sum(digits14: str) -> str:
    """Luhn sum of a 14-digit string whose even places are doubled."""
    d = f"substr({digits14}, i, 1)::INT"
    return f"list_sum(list_transform(range(1, 15), lambda i: CASE WHEN i % 2 = 1 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END))"


def sql_npi_luhn_ok(expr: str) -> str:
    body = f"'80840' || substr({expr}, 1, 9)"
    return f"CASE WHEN {expr} IS NULL THEN NULL WHEN NOT regexp_full_match({expr}, '[12][0-9]{{9}}') THEN false ELSE (10 - ({sql_luhn_sum('(' + body + ')')} % 10)) % 10 = substr({expr}, 10, 1)::INT END"
