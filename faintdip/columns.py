"""Column helpers: aliases, schemas, lenient numbers and truth, and NaN as null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as true, and as a placeholder.
TRUE_WORDS = ("true", "1", "yes", "y")
PLACEHOLDERS = ("", "nan", "none", "null", "n/a", "na", "-", "--", "<na>", "not_attempted", "unknown")


def pick(df: DataFrame, names: list[str]) -> str | None:
    """The first of names that df has, whatever its case; its real name."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n.lower()] for n in names if n.lower() in have), None)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the fields of schema: absent ones null, present ones cast where they can be."""
    have = set(df.columns)
    return df.select(*((F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def finite(c: Column) -> Column:
    """c, with null for NaN and infinities."""
    return F.when(F.abs(c) < float("inf"), c)


def number(c: Column) -> Column:
    """A lenient number: null where c is no finite number. c is written out once, as it may be long."""
    return F.get(F.filter(F.array(F.trim(c.cast("string")).try_cast("double")), lambda x: F.abs(x) < float("inf")), F.lit(0))


def truthy(c: Column, default: bool = False) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(default))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def first_of(df: DataFrame, names: list[str], default=None) -> Column:
    name = pick(df, names)
    return F.col(f"`{name}`") if name else F.lit(default)


def meaningful(c: Column) -> Column:
    """c, with null for placeholder words."""
    return F.when(~F.lower(F.trim(c.cast("string"))).isin(*PLACEHOLDERS), c)


def same_or_missing(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def beside(df: DataFrame, one: DataFrame, prefix: str = "") -> DataFrame:
    """df with the columns of a table of one row, as scalar subqueries: no join is planned."""
    return df.withColumns({prefix + c: one.select(c).scalar() for c in one.columns})
