"""Text to typed metadata values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two literals of a boolean field.
TRUE, FALSE = "true", "false"
#: What may be a number, of any size.
NUMBER_RE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def stripped(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def decoded(text: Column, kind: Column) -> Column:
    """(text, number, exact, date, flag, error): the value of its kind, or the error says why there is none. Kinds: text, numeric, date, boolean.

    ``exact`` is a number's own text, whatever its size; ``number`` is set where 20 digits before and
    18 after the point hold all of it, and is never rounded.
    """
    bare = stripped(text)
    exact = F.when((kind == "numeric") & bare.rlike(NUMBER_RE), bare)
    held = exact.try_cast("decimal(38,18)")
    places = F.length(F.rtrim(F.regexp_extract(exact, r"\.([0-9]*)", 1), F.lit("0"))) - F.coalesce(F.regexp_extract(exact, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    number = F.when(places <= 18, held)
    date = F.when((kind == "date") & bare.rlike(r"^\d{4}-\d{2}-\d{2}$"), bare.try_cast("date"))
    flag = F.when(kind == "boolean", F.when(F.lower(bare) == TRUE, True).when(F.lower(bare) == FALSE, False))
    missing = (kind == "numeric") & exact.isNull() | (kind == "date") & date.isNull() | (kind == "boolean") & flag.isNull()
    return F.struct(F.when(kind == "text", bare).alias("text"), number.alias("number"), exact.alias("exact"), date.alias("date"), flag.alias("flag"), F.when(missing, F.concat(F.lit("not a "), kind, F.lit(": "), bare)).alias("error"))
