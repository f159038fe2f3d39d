"""Column expressions that turn dirty listing fields into typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(value: Column, kind: T.DataType) -> Column:
    """Double from text, boolean or number; what cannot be read is 0."""
    if isinstance(kind, T.StringType):
        text = F.replace(value, F.lit(","), F.lit(""))
        parsed = (
            F.when(text == "True", F.lit(1.0))
            .when(text == "False", F.lit(0.0))
            # the cast would read Java's 12d and 12f as numbers
            .when(~text.rlike(r"\d[dDfF]\s*$"), text.try_cast("double"))
        )
    else:
        parsed = value.cast("double")
    return F.coalesce(F.when(~F.isnan(parsed), parsed), F.lit(0.0))


def first_digits(value: Column, default: int) -> Column:
    """The first run of digits as an integer."""
    return F.coalesce(F.regexp_extract(value.cast("string"), r"(\d+)", 1).try_cast("int"), F.lit(default))


def bedrooms(value: Column) -> Column:
    studio = F.lower(value.cast("string")).contains("studio")
    return F.when(studio, 0).otherwise(first_digits(value, 0))


def bathrooms(value: Column) -> Column:
    return first_digits(value, 1)


def text(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))), F.lit("unknown"))


def offering(value: Column) -> Column:
    """Clean text; a code that went through a float column loses its ``.0``."""
    return F.regexp_replace(text(value), r"\.0$", "")


def date(value: Column) -> Column:
    return value.try_cast("timestamp_ntz")


def furnished(value: Column) -> Column:
    """``1``, ``0``, ``partly``, or other words as they are; missing is ``0``."""
    word = F.lower(value.cast("string"))
    return (
        F.when(word.isin("yes", "furnished", "true"), "1")
        .when(word.isNull() | word.isin("no", "unfurnished", "false", "none", "nan"), "0")
        .otherwise(word)
    )


def completion(value: Column) -> Column:
    word = F.lower(value.cast("string"))
    return (
        F.when(word.isin("completed_primary", "ready"), "completed")
        .when(word == "off_plan_primary", "off_plan")
        .otherwise(word)
    )


def flag(value: Column) -> Column:
    return F.coalesce(value.try_cast("boolean"), F.lit(False))


def furnished_model_input(value: Column) -> Column:
    """As ``furnished``, but partly furnished counts as furnished."""
    plain = furnished(value)
    return F.when(plain == "partly", "1").otherwise(plain)


def completion_model_input(value: Column) -> Column:
    """The model's mapping does not know ``completed_primary``."""
    word = F.lower(value.cast("string"))
    return F.when(word == "off_plan_primary", "off_plan").when(word == "ready", "completed").otherwise(word)
