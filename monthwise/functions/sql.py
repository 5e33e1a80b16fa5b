"""The scalar functions for SQL: temporary functions whose bodies are SQL expressions.

The bodies are put into the plan where a function is called, so they run in generated
code as the column expressions of ``scalars`` do, and give the same values. Categories come
from a table of rules, ordered by place, so that own rules need no code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from . import scalars

MONEY = scalars.MONEY.upper()
RULES = "place int, pattern string, category string"
#: Rules are a column of the plan, so there is a bound on them.
MOST_RULES = 1000


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_ISO = r"^\d{4}-\d\d-\d\d$"
_BARE = r"regexp_replace({0}, '(?i)\\b(rs|inr|aed)\\b\\.?', '')"
_TRIMMED = r"regexp_replace(trim(x), '^\\((.*)\\)$', '$1')"
_KEPT = "regexp_replace(regexp_replace(" + _BARE.format(_TRIMMED) + r", '[^0-9.\\-]', ''), '^-', '')"
_DIGITS = "regexp_extract(regexp_replace(" + _BARE.format("x") + r", '[^0-9.\\-]', ''), '^-?(\\d+\\.?\\d*|\\.\\d+)', 0)"


def _date_body() -> str:
    named = f"replace(initcap(regexp_replace(regexp_replace(trim(x), {_quoted(scalars._TIME)}, '$1'), '[./-]', ' ')), ' ', '/')"
    parts = [f"CASE WHEN {named} RLIKE {_quoted(shape)} THEN date_format(try_to_timestamp({named}, '{layout}'), 'yyyy-MM-dd') END" for shape, layout in scalars.DATE_SHAPES]
    return f"coalesce(CASE WHEN trim(x) RLIKE {_quoted(_ISO)} THEN trim(x) END, {', '.join(parts)}, trim(x))"


def _narration_body() -> str:
    codes = ", ".join(_quoted(c) for c in scalars.RAILS)
    parts = "split(coalesce(x, ''), '-')"
    at = f"CAST(array_position(transform({parts}, p -> upper(trim(p)) IN ({codes})), true) AS INT)"
    field = f"CASE WHEN get({parts}, 0) RLIKE '(?i)^upi' THEN coalesce(get({parts}, 1), '') WHEN {at} > 0 AND coalesce(get({parts}, {at}), '') <> '' THEN get({parts}, {at}) ELSE get({parts}, 0) END"
    return rf"trim(regexp_replace({field}, '\\s+', ' '))"


#: name: (parameters, type, body).
FUNCTIONS = {
    "parse_amount": ("x STRING", MONEY, f"coalesce(try_cast({_DIGITS} AS {MONEY}), CAST(0 AS {MONEY}))"),
    "parse_accounting": (
        "x STRING",
        MONEY,
        rf"CASE WHEN trim(x) RLIKE '\\d{{1,2}}[-/:]\\d{{1,2}}' AND NOT trim(x) RLIKE '[₹$€£¥]|(?i)\\b(rs|dr|cr)\\b' THEN NULL WHEN {_KEPT} RLIKE '^(\\d+\\.?\\d*|\\.\\d+)$' THEN "
        rf"CASE WHEN trim(x) RLIKE '^\\(.*\\)$' OR startswith(trim(x), '-') OR trim(x) RLIKE '(?i)\\bdr\\b' THEN -abs(try_cast({_KEPT} AS {MONEY})) ELSE try_cast({_KEPT} AS {MONEY}) END END",
    ),
    "month_key": ("x STRING", "STRING", "substring(x, 1, 7)"),
    "month_label": ("x STRING", "STRING", "coalesce(date_format(try_to_timestamp(concat(x, '-01'), 'yyyy-MM-dd'), 'MMMM yyyy'), x)"),
    "date_iso": ("x STRING", "STRING", _date_body()),
    "payee": ("x STRING", "STRING", "trim(split_part(coalesce(x, ''), ' - ', 1))"),
    "narration_payee": ("x STRING", "STRING", _narration_body()),
    "is_upi": ("x STRING", "INT", "CAST(contains(lower(x), 'upi') AS INT)"),
    "js_round": ("x DOUBLE", "DOUBLE", "floor(x * 100 + 0.5D) / 100"),
    "grouped_digits": ("x BIGINT", "STRING", r"regexp_replace(CAST(x AS STRING), '(\\d)(?=(\\d\\d)+\\d$)', '$1,')"),
}


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]] = scalars.CATEGORY_RULES) -> DataFrame:
    """RULES of (pattern, category) pairs in their order."""
    return spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(rules)], RULES)


def rules_of(table: DataFrame) -> list[tuple[str, str]]:
    """(pattern, category) by place; more than MOST_RULES are an error."""
    rows = table.orderBy("place", "pattern").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return [(r["pattern"], r["category"]) for r in rows]


def categorize_body(rules: Sequence[tuple[str, str]], default: str = scalars.DEFAULT_CATEGORY) -> str:
    """The category of the first rule that matches, as an expression over x."""
    cases = " ".join(f"WHEN lower(x) RLIKE {_quoted(p)} THEN {_quoted(c)}" for p, c in rules)
    return f"CASE {cases} ELSE {_quoted(default)} END" if cases else _quoted(default)


def register(spark: SparkSession, rules: DataFrame | None = None, prefix: str = "") -> list[str]:
    """Make the functions known to the session's SQL, ``categorize`` by a table of rules; their names."""
    pairs = scalars.CATEGORY_RULES if rules is None else rules_of(rules)
    found = FUNCTIONS | {"categorize": ("x STRING", "STRING", categorize_body(pairs))}
    for name, (parameters, kind, body) in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
    return [f"{prefix}{n}" for n in found]
