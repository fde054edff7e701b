"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``let v = value in body(v)``.

    A plain reuse of ``value`` would be inlined once per mention and evaluated as often;
    through the lambda variable it is evaluated once per row.
    """
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Add or replace columns whose expressions are costly.

    The values leave through a generator.  The optimiser does not copy expressions across a
    generator, so a later filter or a second mention reads the finished column; through a
    plain projection it would evaluate the whole expression again.
    """
    row = F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()])))
    others = [c for c in df.columns if c not in values]
    done = df.select(*others, row)
    return done.select(*df.columns, *[k for k in values if k not in df.columns])


def blank_to_null(value: ColumnLike) -> Column:
    c = col(value)
    return F.when(c != "", c)


def has_text(value: ColumnLike) -> Column:
    """True when not null and not empty (the truth value of a string)."""
    return F.coalesce(col(value) != "", F.lit(False))


def strings(values) -> Column:
    """A literal array of strings, typed even when it is empty."""
    values = [str(v) for v in values]
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def non_null(*values: Column) -> Column:
    return F.filter(F.array(*values), lambda v: v.isNotNull())


# Characters that end a line, with the two-character form first.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def splitlines(value: ColumnLike) -> Column:
    """Lines of a text; a line end at the very end opens no further line."""
    c = col(value)
    body = F.regexp_replace(c, "(?:" + LINE_END + r")\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_END, -1))


def py_trim(value: ColumnLike) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col(value), r"\A[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+\z", "")


def to_double(value: ColumnLike) -> Column:
    """Number or 0.0; never fails on text from outside."""
    return F.coalesce(col(value).try_cast("double"), F.lit(0.0))


def to_int(value: ColumnLike, default: int = 0) -> Column:
    """Truncated number or a default; accepts ``12``, ``12.5`` and numeric text."""
    d = col(value).try_cast("double")
    return F.coalesce(d.try_cast("bigint"), F.lit(default).cast("bigint"))


def est_tokens(value: ColumnLike) -> Column:
    """About four characters to a token, one at least."""
    n = F.coalesce(F.length(col(value)), F.lit(0))
    return F.greatest(F.lit(1), F.floor(n / 4)).cast("bigint")
