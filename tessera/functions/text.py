"""String and number expressions with the semantics of Python's str(), strip() and float()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Python's strip() in Java's Unicode-aware syntax.
WS = r"[\s\x1c-\x1f]"
#: CSV cells read as missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
_DIGITS = "[0-9]+(?:_[0-9]+)*"
_FINITE = rf"(?i)^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?$"


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+$", "")


def py_str(c: Column, kind: str = "string") -> Column:
    """Text of a value as Python prints it; missing is 'nan'. kind: the column's simple type."""
    text = c.cast("string")
    if kind == "boolean":
        text = F.when(c, F.lit("True")).otherwise(F.lit("False"))
        text = F.when(c.isNull(), F.lit(None)).otherwise(text)
    elif kind in ("double", "float"):
        whole = (F.abs(c) < 1e16) & (c == F.floor(c))
        sign = F.when((c == 0) & text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
        mantissa = F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
        power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1)
        exponent = F.concat(F.when(power.startswith("-"), "-").otherwise("+"), F.lpad(F.regexp_replace(power, "-", ""), F.greatest(F.length(F.regexp_replace(power, "-", "")), F.lit(2)), F.lit("0")))
        small = F.regexp_replace(F.format_string("%.20f", c), "0+$", "")
        text = (
            F.when(F.isnan(c), "nan")
            .when(F.abs(c) == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
            .when(whole, F.concat(sign, c.cast("decimal(38,0)").cast("string"), F.lit(".0")))
            .when(text.contains("E") & (F.abs(c) >= 1e-4) & (F.abs(c) < 1e-3), F.concat(F.when(c < 0, "-").otherwise(""), F.lit("0.000"), F.regexp_replace(F.regexp_replace(mantissa, "-", ""), r"\.", "")))
            .when(text.contains("E") & (F.abs(c) < 1e16) & (F.abs(c) >= 1), small)
            .when(text.contains("E"), F.concat(mantissa, F.lit("e"), exponent))
            .otherwise(text)
        )
    return F.coalesce(text, F.lit("nan"))


def py_float(c: Column) -> Column:
    """float(text) as a double; null where Python raises ValueError."""
    s = py_strip(c)
    low = F.lower(s)
    return (
        F.when(low.rlike("^[+-]?nan$"), F.lit(float("nan")))
        .when(low.rlike("^[+]?inf(inity)?$"), F.lit(float("inf")))
        .when(low.rlike("^-inf(inity)?$"), F.lit(float("-inf")))
        .when(s.rlike(_FINITE), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
    )


def is_missing(c: Column, kind: str = "string") -> Column:
    return c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()


def cleaned(c: Column, kind: str = "string") -> Column:
    """A prediction's stripped text; null if missing, blank or 'nan' in any case."""
    s = py_strip(py_str(c, kind))
    return F.when(~is_missing(c, kind) & (s != "") & (F.lower(s) != "nan"), s)


def sanitized(c: Column, fallback: str = "", kind: str = "string") -> Column:
    return F.coalesce(cleaned(c, kind), F.lit(fallback))


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_TOKENS), c)
