"""One definition each of "empty" and "unset"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonempty(c: Column | str, dtype: T.DataType) -> Column:
    """Null, the empty string and the empty array are empty; zero is a value."""
    col = as_col(c)
    if isinstance(dtype, T.StringType):
        return col.isNotNull() & (col != "")
    if isinstance(dtype, T.ArrayType):
        return col.isNotNull() & (F.size(col) > 0)
    return col.isNotNull()


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(as_col(c), F.lit(""))


def has_text(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit("")) != ""


def has_amount(c: Column | str) -> Column:
    """Where the rule tests truthiness, zero counts as unset."""
    return F.coalesce(as_col(c), F.lit(0)) != 0


def first_set(*cols: Column | str) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def case_when(branches: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """First true branch wins."""
    if not branches:
        return otherwise if otherwise is not None else F.lit(None)
    chain = F.when(*branches[0])
    for test, value in branches[1:]:
        chain = chain.when(test, value)
    return chain if otherwise is None else chain.otherwise(otherwise)


def spread_nulls(df: DataFrame, key: str) -> Column:
    """A text key for a left join in which rows without a key get keys of their own, so they do not share a task."""
    return F.coalesce(F.col(key), F.concat(F.lit("\u0000"), F.xxhash64(*df.columns).cast("string")))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression used inside a lambda is evaluated again for every element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that later filters and projections reuse.

    Catalyst copies an expression into every filter it moves below the projection that defines it. A
    generator is never copied, so a one-element array is exploded instead.
    """
    packed = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("_once")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, packed).select(*kept, "_once.*")
