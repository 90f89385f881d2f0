"""Code tables of vessel messages and price sheets as literal lookups."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (
    COUNTRY_CODES, EU_ALIASES, FLAG_DIGITS, HAZARD_SUFFIX, NAV_STATUS, PRODUCT_PATTERNS, SERVICE_TYPES,
    SHIP_TYPE_DECADES, SHIP_TYPE_NAMES,
)


def _lookup(table: dict, key: Column) -> Column:
    """Literal map lookup; null for keys that are not listed."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def ship_class(code: Column) -> Column:
    t = code.cast("int")
    return (F.when(t.isNull(), "unknown").when(t.between(80, 89), "tanker").when(t.between(70, 79), "cargo")
            .when(t.between(60, 69), "passenger").when(t == 30, "fishing").when(t.isin(SERVICE_TYPES), "service")
            .when(t == 35, "military").when(t.isin(36, 37), "leisure").when(t.between(40, 49), "high_speed")
            .otherwise("other"))


def ship_type_text(code: Column) -> Column:
    t = code.cast("int")
    decade = _lookup(SHIP_TYPE_DECADES, F.floor(t / 10).cast("int"))
    hazard = F.coalesce(_lookup(HAZARD_SUFFIX, F.pmod(t, F.lit(10))), F.lit(""))
    return (F.when(t.isNull(), "not reported yet")
            .otherwise(F.coalesce(_lookup(SHIP_TYPE_NAMES, t), F.concat(decade, hazard),
                                  F.concat(F.lit("code "), t.cast("string")))))


def nav_status_text(code: Column) -> Column:
    return _lookup(NAV_STATUS, code.cast("int"))


def flag_state(mmsi: Column) -> Column:
    """Registry of a nine-digit vessel number by its first three digits."""
    by_digits = {d: name for name, digits in FLAG_DIGITS.items() for d in digits}
    text = mmsi.cast("string")
    return F.when(F.length(text) == 9, _lookup(by_digits, F.substring(text, 1, 3).cast("int")))


def product_of(text: Column) -> Column:
    out = F
    for product, pattern in PRODUCT_PATTERNS.items():
        out = out.when(text.rlike(pattern), product)
    return out.otherwise(None)


def tax_basis(text: Column) -> Column:
    t = F.lower(text)
    without = t.rlike(r"(wo|without|w/o|excl|net)[\s_.]*tax") | t.contains("sans tax") | t.contains("ohne")
    return F.when(without, "without_tax").when(t.rlike(r"with[\s_]*tax") | t.contains("incl"), "with_tax")


def country_code(label: Column) -> Column:
    """ISO code from a country name, a bare code or one of the EU average labels."""
    s = F.trim(label)
    low = F.lower(s)
    eu = low.rlike("^(eu average|eu weighted|eu 27|eu27|moyenne)") | s.isin(EU_ALIASES)
    return F.when(eu, "EU").otherwise(
        F.coalesce(_lookup(COUNTRY_CODES, low), F.when(s.rlike("^[A-Z]{2}$"), s)))
