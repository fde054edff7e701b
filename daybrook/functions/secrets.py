"""Secret redaction and clipboard typing as column expressions.

The patterns run in list order, each on the text the former left, so the step results are
chained through lambda variables: every step is evaluated once.  One alternation of all
patterns is tried first and most texts stop there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    CODE_HINT, ENTROPY_SLACK, LONG_TOKEN_ENTROPY, LONG_TOKEN_PATTERN, PREVIEW_CHARS,
    SECRET_PATTERNS, TOKEN_ENTROPY, TOKEN_NAME, TOKEN_PATTERN, URL_PATTERN,
)
from .core import ColumnLike, bind, col, py_trim
from .paths import home_to_tilde
from .text import entropy

ANY_SECRET = "|".join("(?:" + p + ")" for _, p, _ in SECRET_PATTERNS) + "|" + TOKEN_PATTERN
_NO_NAMES = "array<string>"


def _pair(text: Column, names: Column) -> Column:
    return F.struct(text.alias("text"), names.alias("names"))


def _mixed(token: Column) -> Column:
    """Holds a digit and a letter (any script)."""
    return token.rlike(r"\p{Nd}") & token.rlike(r"\p{L}")


def _is_random(token: Column) -> Column:
    return _mixed(token) & (entropy(token) >= TOKEN_ENTROPY - ENTROPY_SLACK)


def replace_tokens(text: Column, pattern: str, is_secret, placeholder: str) -> Column:
    """Replace the matches of ``pattern`` for which ``is_secret`` holds."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.transform(found, lambda t: F.when(is_secret(t), F.lit(placeholder)).otherwise(t))
    return F.array_join(F.zip_with(
        F.split(text, pattern, -1), kept,
        lambda gap, t: F.concat(gap, F.coalesce(t, F.lit("")))), "")


def _step(state: Column, name: str, pattern: str, replacement: str) -> Column:
    return bind(state, lambda s: _pair(
        F.regexp_replace(s["text"], pattern, replacement),
        F.when(s["text"].rlike(pattern), F.array_append(s["names"], F.lit(name))).otherwise(s["names"])))


def _redact(text: Column) -> Column:
    state = _pair(text, F.array().cast(_NO_NAMES))
    for name, pattern, replacement in SECRET_PATTERNS:
        state = _step(state, name, pattern, replacement)

    def tokens(s: Column) -> Column:
        hit = F.exists(F.regexp_extract_all(s["text"], F.lit(TOKEN_PATTERN), F.lit(0)), _is_random)
        return F.when(hit, _pair(
            replace_tokens(s["text"], TOKEN_PATTERN, _is_random, f"[REDACTED:{TOKEN_NAME}]"),
            F.array_append(s["names"], F.lit(TOKEN_NAME)))).otherwise(s)

    return bind(state, tokens)


def redact(text: ColumnLike) -> Column:
    """``struct<text, names>``: secrets blanked, names of what was found, sorted."""
    def run(t: Column) -> Column:
        done = bind(_redact(t), lambda s: _pair(s["text"], F.array_sort(s["names"])))
        return F.when(t.rlike(ANY_SECRET), done).otherwise(_pair(t, F.array().cast(_NO_NAMES)))
    return bind(col(text), run)


def scrub(text: ColumnLike) -> Column:
    """``struct<text, names>``: home prefixes first, then secrets; ``path`` leads the names."""
    def run(v: Column) -> Column:
        path = F.when(v["home"] != v["raw"], F.array(F.lit("path"))).otherwise(F.array().cast(_NO_NAMES))
        return bind(redact(v["home"]), lambda r: _pair(r["text"], F.concat(path, r["names"])))
    raw = col(text)
    return bind(F.struct(raw.alias("raw"), home_to_tilde(raw).alias("home")), run)


def has_secret(text: ColumnLike) -> Column:
    return F.coalesce(F.size(redact(text)["names"]) > 0, F.lit(False))


def is_credential(text: ColumnLike) -> Column:
    """A known secret anywhere, or one lone random-looking word."""
    def lone(t: Column) -> Column:
        return ~t.contains(" ") & F.length(t).between(12, 256) & _is_random(t)
    raw = F.coalesce(col(text), F.lit(""))
    return has_secret(raw) | bind(py_trim(raw), lone)


def clipboard_summary(text: ColumnLike) -> Column:
    """``struct<kind, length, host>``: what a clip was, never what it said."""
    raw = F.coalesce(col(text), F.lit(""))
    host = F.regexp_extract(raw, URL_PATTERN, 1)
    kind = F.when(is_credential(raw), F.lit("credential")) \
        .when(raw.rlike(URL_PATTERN), F.lit("url")) \
        .when(raw.contains("\n") | raw.rlike(CODE_HINT), F.lit("code_snippet")) \
        .otherwise(F.lit("text"))
    return bind(kind, lambda k: F.struct(
        k.alias("kind"), F.length(raw).alias("length"), F.when(k == "url", host).alias("host")))


def clipboard_preview(text: ColumnLike, chars: int = PREVIEW_CHARS) -> Column:
    """Scrubbed first characters, or null when anything in the whole clip looks secret."""
    raw = col(text)
    window = scrub(F.substring(raw, 1, max(0, chars)))["text"]
    return F.when((raw != "") & ~is_credential(raw), bind(
        window, lambda w: F.when(py_trim(w) != "", w)))


def hide_long_tokens(text: ColumnLike) -> Column:
    """Long random words without a digit, which the general rules leave alone."""
    def secret(t: Column) -> Column:
        return ~t.rlike(r"\p{Nd}") & (entropy(t) >= LONG_TOKEN_ENTROPY - ENTROPY_SLACK)
    return bind(col(text), lambda t: F.when(t.rlike(LONG_TOKEN_PATTERN), replace_tokens(
        t, LONG_TOKEN_PATTERN, secret, f"[REDACTED:{TOKEN_NAME}]")).otherwise(t))
