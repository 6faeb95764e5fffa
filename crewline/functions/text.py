"""Names, labels and lookups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def lookup(key: Column, mapping: Mapping) -> Column:
    """Value of a small fixed mapping, NULL for unknown keys and without a mapping."""
    if not mapping:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[key]


def map_company(company: Column, names: Mapping[str, str]) -> Column:
    """Display name, else the first 8 characters and an ellipsis."""
    return F.coalesce(lookup(company, names), F.concat(F.substring(company, 1, 8), F.lit("...")))


def map_companies(companies: Column, names: Mapping[str, str]) -> Column:
    """Display names of an id array, comma separated; ``N/A`` for no array."""
    shown = F.transform(companies, lambda one: map_company(one, names))
    return F.coalesce(F.array_join(shown, ", "), F.lit("N/A"))


def map_company_long(company: Column, names: Mapping[str, str]) -> Column:
    """Display name, else the first 20 characters, else ``N/A``."""
    absent = company.isNull() | company.isin("", "None")
    return F.coalesce(lookup(company, names), F.when(~absent, F.substring(company, 1, 20)), F.lit("N/A"))


def full_name(first: Column, last: Column) -> Column:
    """Both names with one blank between them, trimmed; a missing part counts as empty."""
    blank = F.lit("")
    return F.trim(F.concat(F.coalesce(first, blank), F.lit(" "), F.coalesce(last, blank)))


def zone_base_city(city: Column) -> Column:
    """``City_ST`` -> ``City``: underscores become blanks, the last word goes."""
    return F.regexp_replace(F.replace(F.coalesce(city, F.lit("")), F.lit("_"), F.lit(" ")), " [^ ]*$", "")


def other_cities(cities: Column, base: Column) -> Column:
    """The cities of an array that are not the zone's own, whatever their case."""
    return F.filter(cities, lambda city: F.lower(city) != F.lower(base))


def zone_label(city: Column, zone: Column, cities: Column) -> Column:
    """``City | Zone (incl. a, b, c)`` with up to three further store cities in order."""
    extra = F.slice(F.sort_array(other_cities(cities, zone_base_city(city))), 1, 3)
    plain = F.concat(F.coalesce(city, F.lit("None")), F.lit(" | "), zone)
    return F.when(
        F.size(extra) > 0, F.concat(plain, F.lit(" (incl. "), F.array_join(extra, ", "), F.lit(")"))
    ).otherwise(plain)


def progress(done: Column, required: Column) -> Column:
    """``done/required`` with 0 and ``?`` for what is unknown."""
    return F.concat(
        F.coalesce(done, F.lit(0)).cast("string"), F.lit("/"), F.coalesce(required.cast("string"), F.lit("?"))
    )


def roster_location(city: Column, state: Column) -> Column:
    return F.concat(city, F.lit(", "), state)
