"""Unit conversion of capacitance (pF) and resistance (ohm). Unknown units leave values as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted spellings and their size in pF or ohm.
CAPACITANCE = {1.0: ("PF", "pf", "pF"), 1e3: ("NF", "nf", "nF"), 1e6: ("UF", "uf", "uF", "µF"), 1e-3: ("FF", "ff", "fF"), 1e12: ("F", "f")}
RESISTANCE = {1.0: ("OHM", "ohm"), 1e3: ("KOHM", "kohm"), 1e6: ("MOHM", "mohm")}


def _factor(unit: Column, sizes: dict[float, tuple[str, ...]]) -> Column:
    out = F.lit(1.0)
    for size, names in sizes.items():
        out = F.when(unit.isin(*names), F.lit(size)).otherwise(out)
    return out


def convert_capacitance(value: Column, unit: Column) -> Column:
    return value * _factor(unit, CAPACITANCE)


def convert_resistance(value: Column, unit: Column) -> Column:
    return value * _factor(unit, RESISTANCE)


def capacitance_from_pf(value: Column, unit: Column) -> Column:
    return value / _factor(unit, CAPACITANCE)


def resistance_from_ohm(value: Column, unit: Column) -> Column:
    return value / _factor(unit, RESISTANCE)
