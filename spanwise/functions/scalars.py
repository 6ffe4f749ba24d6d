"""Column expressions for names, mode sets, typed values and ids."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modes that can be routed.
MODES = ("Barge", "IceRoad", "Plane", "Road")


def canon(name: Column) -> Column:
    """The key of a place name: upper case, no marks, SAINT as ST and MOUNT as MT, single spaces; null if nothing is left."""
    x = F.regexp_replace(F.upper(name), r"[.'`’,]", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\bSAINT\b", "ST"), r"\bMOUNT\b", "MT")
    return F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))


def collapsed(x: Column) -> Column:
    """Line breaks as spaced pipes, single spaces, null for nothing."""
    x = F.regexp_replace(x, r"[\r\n]+", " | ")
    return F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))


def typed(x: Column, kind: str) -> Column:
    """A text as one of the logical types; what doesn't read as it is null. Whole numbers round half to even."""
    x = collapsed(x.cast("string"))
    number = lambda c: c.try_cast("double")
    whole = F.bround(number(x), 0).try_cast("bigint")
    if kind == "int":
        return whole
    if kind == "float":
        return number(x)
    if kind == "zip":
        return F.when(F.length(whole.cast("string")) >= 5, whole.cast("string")).otherwise(F.lpad(whole.cast("string"), 5, "0"))
    if kind == "bool":
        up = F.upper(x)
        return F.when(up.isin("Y", "YES"), True).when(up.isin("N", "NO"), False)
    if kind == "date":
        return x.try_cast("date")
    if kind == "datetime":
        return x.try_cast("timestamp")
    if kind == "string":
        return x
    raise ValueError(f"unknown type {kind}")


def modes_in(text: Column, modes: Iterable[str] = MODES) -> Column:
    """The sorted routable modes named in a list such as ``Barge or Plane, Road``; an empty array for none."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r" or |,"), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.array_intersect(parts, F.array(*[F.lit(m) for m in modes]))))


def mode_text(modes: Column) -> Column:
    return F.nullif(F.array_join(modes, " or "), F.lit(""))


def union_modes(texts: Column) -> Column:
    """Aggregate: the union of the mode sets of a group, as text."""
    return mode_text(F.array_sort(F.array_distinct(F.flatten(F.collect_set(modes_in(texts))))))


def natural(name: Column) -> list[Column]:
    """Order keys by which Hub_2 stands before Hub_10; names without number, then nulls, last."""
    n = F.regexp_extract(name, r"(\d+)$", 1).try_cast("bigint")
    return [n.asc_nulls_last(), name.asc_nulls_last()]


def delivery_flag(method: Column, mode: str) -> Column:
    """Whether a method names a mode as a word; null if there is no method."""
    return F.when(collapsed(method).isNotNull(), F.rlike(method, F.lit(rf"\b{mode}\b")).cast("string"))


def one_digit_edits(value: Column) -> Column:
    """All (position, digit, value) that change one digit of a coordinate written with four decimals, in order."""
    text = F.format_string("%.4f", value)
    at = F.sequence(F.lit(1), F.length(text))
    tries = F.flatten(F.transform(at, lambda p: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.struct(p.alias("position"), d.alias("digit")))))
    tries = F.filter(tries, lambda t: F.rlike(F.substr(text, t["position"], F.lit(1)), F.lit("[0-9]")) & (F.substr(text, t["position"], F.lit(1)) != t["digit"].cast("string")))
    return F.transform(tries, lambda t: F.struct(t["position"], t["digit"], F.overlay(text, t["digit"].cast("string"), t["position"]).cast("double").alias("value")))


#: Endings of airport names that say nothing about the place.
ENDINGS = ("international airport", "municipal airport", "seaplane base", "airport", "airstrip", "airfield", "landing")


def base_name(name: Column) -> Column:
    """A place name in lower case without marks and without endings, however many follow each other."""
    x = F.translate(F.lower(name), "‘’“”", "''\"\"")
    x = F.trim(F.regexp_replace(x, r"[^a-z0-9]+", " "))
    return F.regexp_replace(x, rf"(?:\s+(?:{'|'.join(ENDINGS)}))+$", "")


def unquoted(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), r"^[\s'\"]+|[\s'\"]+$", "")


def snake(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"([a-z0-9])([A-Z])", "$1_$2"), r"[\s\-]+", "_"))


def map_link(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit("https://www.openstreetmap.org/?mlat="), lat.cast("string"), F.lit("&mlon="), lon.cast("string"))
