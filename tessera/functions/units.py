"""Quantities in text: a number, a unit, and the unit's canonical name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, py_strip

#: Canonical unit -> the spellings that mean it.
UNITS: dict[str, tuple[str, ...]] = {
    "gram": ("g", "gm", "gms", "gram", "grams"),
    "kilogram": ("kg", "kgs", "kilogram", "kilograms"),
    "milligram": ("mg", "milligram"),
    "ounce": ("oz", "ounce", "ounces"),
    "pound": ("lb", "lbs", "pound", "pounds"),
    "millilitre": ("ml", "mls", "millilitre", "milliliter"),
    "litre": ("l", "liter", "litre", "litres"),
    "fluid ounce": ("fl oz", "fluid ounce"),
    "centimetre": ("cm", "centimetre", "centimeter"),
    "millimetre": ("mm", "millimetre", "millimeter"),
    "metre": ("m", "meter", "metre"),
    "inch": ("in", "inch", "inches"),
    "foot": ("ft", "foot", "feet"),
    "volt": ("v", "volt", "volts"),
    "watt": ("w", "watt", "watts"),
    "kilowatt": ("kw", "kilowatt"),
}


def spellings(units: dict[str, tuple[str, ...]] | None = None) -> dict[str, str]:
    return {s: unit for unit, forms in (units or UNITS).items() for s in forms}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def normalize_unit(c: Column, units: dict[str, tuple[str, ...]] | None = None) -> Column:
    key = F.lower(py_strip(c))
    return F.coalesce(_lookup(key, spellings(units)), key)


def quantity_pattern(units: dict[str, tuple[str, ...]] | None = None) -> str:
    """Number and unit: the leftmost number whose next two words, or next word, spell a unit. ASCII letters of either case."""

    def spelled(unit: str) -> str:
        return f"{WS}+".join("".join(f"[{a}{a.upper()}]" for a in word) for word in unit.split(" "))

    names = sorted(spellings(units), key=lambda s: (" " not in s, s))
    return rf"(?U)(\b\d+(?:\.\d+)?){WS}*({'|'.join(map(spelled, names))})(?![a-zA-Z])"


def extract_quantity(c: Column, units: dict[str, tuple[str, ...]] | None = None) -> Column:
    """'<number> <canonical unit>' of the first quantity in a text; null for none."""
    pattern = quantity_pattern(units)
    number = F.regexp_extract(c, pattern, 1)
    unit = F.lower(F.regexp_replace(F.regexp_extract(c, pattern, 2), rf"(?U){WS}+", " "))
    return F.when(number != "", F.concat(number, F.lit(" "), _lookup(unit, spellings(units))))
