"""SQL surface: the main functions as temporary SQL functions.

They are SQL expressions, so Spark plans them like built-in functions; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..constants import (
    CODE_HINT, ENTROPY_SLACK, POSIX_HOME, SECRET_PATTERNS, TOKEN_ENTROPY, TOKEN_NAME, TOKEN_PATTERN, URL_PATTERN, WINDOWS_HOME,
)

_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def _lit(pattern: str) -> str:
    """A raw SQL string; quotes inside a pattern become escapes of the pattern language."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _entropy(x: str) -> str:
    n = f"length({x}) - length(replace({x}, ch, ''))"
    return (f"if({x} = '', 0D, aggregate(transform(array_distinct(split({x}, '')), ch -> cast({n} as double)), 0D, "
            f"(a, v) -> if(v > 0, a - (v / length({x})) * log2(v / length({x})), a)))")


def _random(x: str) -> str:
    return rf"({x} rlike r'\p{{Nd}}' AND {x} rlike r'\p{{L}}' AND {_entropy(x)} >= {TOKEN_ENTROPY}D - {ENTROPY_SLACK}D)"


def _redact(x: str) -> str:
    """``struct<text, names>`` as nested SQL lets, one per pattern."""
    state = f"named_struct('text', {x}, 'names', cast(array() as array<string>))"
    for i, (name, pattern, replacement) in enumerate(SECRET_PATTERNS):
        s, rx = f"s{i}", _lit(pattern)
        state = _let(s, state, f"named_struct('text', regexp_replace({s}.text, {rx}, '{replacement}'), "
                               f"'names', if({s}.text rlike {rx}, array_append({s}.names, '{name}'), {s}.names))")
    rx = _lit(TOKEN_PATTERN)
    found = f"regexp_extract_all(z.text, {rx}, 0)"
    mark = f"'[REDACTED:{TOKEN_NAME}]'"
    swapped = (f"array_join(zip_with(split(z.text, {rx}, -1), transform({found}, tok -> if({_random('tok')}, {mark}, tok)), "
               f"(gap, tok) -> concat(gap, coalesce(tok, ''))), '')")
    return _let("z", state, f"if(exists({found}, tok -> {_random('tok')}), named_struct('text', {swapped}, 'names', "
                            f"array_sort(array_append(z.names, '{TOKEN_NAME}'))), named_struct('text', z.text, 'names', array_sort(z.names)))")


def _functions() -> dict[str, tuple[str, str, str]]:
    home = f"regexp_replace(regexp_replace(t, {_lit(WINDOWS_HOME)}, '~'), {_lit(POSIX_HOME)}, '~')"
    trimmed = f"regexp_replace(t, r'\\A{_SPACE}+|{_SPACE}+\\z', '')"
    secret = f"size(({_redact('t')}).names) > 0"
    lone = _let("w", trimmed, f"NOT contains(w, ' ') AND length(w) BETWEEN 12 AND 256 AND {_random('w')}")
    day = "try_cast(concat_ws('-', substring(k, 1, 4), substring(k, 5, 2), substring(k, 7, 2)) AS DATE)"
    scp, web = r"^[\w.+-]+@([^:/]+):(.+)$", r"^[a-zA-Z][\w+.\-]*://(?:[^@/]+@)?([^/]+)/(.+)$"
    host = f"if(u rlike {_lit(scp)}, regexp_extract(u, {_lit(scp)}, 1), regexp_extract(u, {_lit(web)}, 1))"
    path = f"if(u rlike {_lit(scp)}, regexp_extract(u, {_lit(scp)}, 2), regexp_extract(u, {_lit(web)}, 2))"
    bare = f"regexp_replace(regexp_replace(trim({path}), '/+$', ''), r'(?i)\\.git$', '')"
    return {
        "db_entropy": ("t STRING", "DOUBLE", _entropy("t")),
        "db_scrub": ("t STRING", "STRING", f"({_let('h', home, _redact('h'))}).text"),
        "db_redaction_codes": ("t STRING", "ARRAY<STRING>",
                               f"concat(if({home} <> t, array('path'), cast(array() as array<string>)), ({_let('h', home, _redact('h'))}).names)"),
        "db_basename": ("p STRING", "STRING", r"element_at(split(regexp_replace(replace(p, r'\', '/'), '/+$', ''), '/', -1), -1)"),
        "db_date_key": ("t STRING", "STRING", "CASE WHEN t rlike r'^\\d{8}(\\D|$)' THEN substring(t, 1, 8) "
                        "WHEN replace(substring(t, 1, 10), '-', '') <> '' THEN replace(substring(t, 1, 10), '-', '') ELSE '00000000' END"),
        "db_period_key": ("k STRING, granularity STRING", "STRING",
                          "CASE WHEN granularity = 'week' THEN coalesce(if(k rlike r'^\\d{8}$', concat(lpad(extract(YEAROFWEEK FROM " + day
                          + "), 4, '0'), '-W', lpad(weekofyear(" + day + "), 2, '0')), NULL), '0000-W00') "
                          "WHEN k rlike r'^\\d{8}$' THEN concat_ws('-', substring(k, 1, 4), substring(k, 5, 2)) ELSE '0000-00' END"),
        "db_clipboard_kind": ("t STRING", "STRING", f"CASE WHEN {secret} OR {lone} THEN 'credential' WHEN t rlike {_lit(URL_PATTERN)} THEN 'url' "
                              f"WHEN contains(t, '\\n') OR t rlike {_lit(CODE_HINT)} THEN 'code_snippet' ELSE 'text' END"),
        "db_remote": ("x STRING", "STRING", _let("u", "trim(x)", f"if({host} <> '' AND {bare} <> '', concat_ws('/', {host}, {bare}), NULL)")),
    }


# Table functions: name -> (arguments, columns, query).
_TABLES = {
    "db_split_sections": ("t STRING", "label STRING, chunk STRING",
                          r"SELECT if(c rlike r'\A---\n## .+', trim(regexp_extract(c, r'\A---\n## (.+)', 1)), substring(c, 1, 60)), c FROM "
                          r"(SELECT explode(filter(split(coalesce(t, ''), r'(?m)(?=^---\n## )', -1), x -> trim(x) <> '')) AS c)"),
    "db_split_diff": ("t STRING", "path STRING, body STRING",
                      r"SELECT regexp_extract(substring_index(c, '\n', 1), r'^diff --git a/(.+?) b/(.+?)\s*$', 2), c FROM "
                      r"(SELECT explode(if(t rlike r'(?m)^diff --git a/.+ b/', filter(split(t, r'(?m)(?=^diff --git a/.+? b/.+?\s*$)', -1), "
                      r"x -> x rlike r'\Adiff --git a/'), array(t))) AS c)"),
    "db_split_markdown": ("t STRING", "heading STRING, body STRING",
                          r"SELECT h, b FROM (SELECT if(c rlike r'\A\s*#', trim(regexp_replace(trim(substring_index(c, '\n', 1)), '^#+', '')), '') AS h, "
                          r"regexp_replace(if(c rlike r'\A\s*#', regexp_replace(c, r'\A[^\n]*\n?', ''), c), r'\A\s+|\s+\z', '') AS b FROM "
                          r"(SELECT explode(split(coalesce(t, ''), r'(?m)(?=^[ \t]*#)', -1)) AS c)) WHERE h <> '' OR b <> ''"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary functions in a session; returns their names."""
    names = []
    for name, (args, returns, body) in _functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
        names.append(name)
    for name, (args, columns, query) in _TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE ({columns}) RETURN {query}")
        names.append(name)
    return names
