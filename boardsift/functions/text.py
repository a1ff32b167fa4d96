"""Names, labels, units and numbers written by people."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Designator prefixes and the part classes they stand for.
DESIGNATOR_CLASSES = {
    "R": "resistor", "RN": "resistor", "RV": "potentiometer", "VR": "potentiometer", "POT": "potentiometer",
    "C": "capacitor", "CN": "connector", "L": "inductor", "FB": "inductor", "D": "diode", "DS": "led", "LED": "led",
    "U": "ic", "IC": "ic", "Q": "transistor", "F": "fuse", "J": "connector", "P": "connector", "JP": "connector",
    "CON": "connector", "SW": "switch", "S": "switch", "K": "relay", "RY": "relay", "Y": "clock", "X": "clock",
    "XTAL": "clock", "BT": "battery", "BAT": "battery", "LS": "buzzer", "SP": "buzzer", "BZ": "buzzer",
    "T": "transformer", "TR": "transformer", "TP": "pads", "HS": "heatsink", "M": "transducer",
}
# Millimetres in a unit.
UNITS = {"mm": 1.0, "millimeter": 1.0, "millimetre": 1.0, "cm": 10.0, "m": 1000.0, "in": 25.4, "inch": 25.4, "mil": 0.0254, "thou": 0.0254, "um": 0.001}
# Labels that name no class.
UNINFORMATIVE = ("", "component", "component_candidate", "candidate", "object", "unknown")
# Classes by the shape of their terminals; others have many pins.
TWO_TERMINAL = ("capacitor", "resistor", "diode", "led", "inductor", "fuse")
PAD_ONLY = ("pads",)
# Words for a board's sides.
TOP = ("top", "t", "1", "front", "topside", "top side", "smd_top")
BOTTOM = ("bottom", "b", "2", "back", "bot", "bottomside", "smd_bottom")
# Names that headers of placement and pad tables go by, the first match counts.
ALIASES = {
    "designator": ("designator", "refdes", "ref", "reference", "part", "component", "name", "id"),
    "pin": ("pin", "pinnumber", "pinnum", "padnumber", "pad", "padname", "terminal"),
    "x": ("xmm", "x", "midx", "centerx", "centrex", "posx", "positionx", "refx", "xloc"),
    "y": ("ymm", "y", "midy", "centery", "centrey", "posy", "positiony", "refy", "yloc"),
    "width": ("widthmm", "width", "padwidth", "sizex", "w"),
    "height": ("heightmm", "height", "padheight", "sizey", "h"),
    "rotation": ("rotationdeg", "rotation", "rot", "angle", "orientation", "theta"),
    "shape": ("shape", "padshape", "type", "padtype"),
    "net": ("net", "netname", "signal"),
    "side": ("side", "layer", "tb", "topbottom", "mountingside"),
    "footprint": ("footprint", "package", "pattern", "fp"),
    "value": ("value", "comment", "val", "partnumber", "description"),
}
QUANTITY = ("quantity", "qty", "count", "amount")
NUMBER = r"^[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"


def mapped(pairs: dict) -> Column:
    """A literal map column."""
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def plain_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]", "")


def plain_label(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def number(c: Column, default: float | None = 0.0) -> Column:
    """Leading number of a cell; a comma counts as a decimal point."""
    found = F.regexp_extract(F.replace(F.trim(c), F.lit(","), F.lit(".")), NUMBER, 0)
    value = F.when(found != "", found.cast("double"))
    return value if default is None else F.coalesce(value, F.lit(default))


def unit_scale(c: Column, fallback: float = 1.0) -> Column:
    """Millimetres per unit, by the letters a cell ends with."""
    return F.coalesce(F.try_element_at(mapped(UNITS), F.regexp_extract(F.lower(F.trim(c)), "([a-z]+)$", 1)), F.lit(fallback))


def side(c: Column, default: str = "top") -> Column:
    word = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(word.isin(*TOP), "top").when(word.isin(*BOTTOM), "bottom").otherwise(default)


def part_class(designator: Column) -> Column:
    """Class by the longest known prefix of the designator's letters."""
    letters = F.upper(F.regexp_extract(F.trim(designator), "^([A-Za-z]+)", 1))
    known = mapped(DESIGNATOR_CLASSES)
    longest = max(map(len, DESIGNATOR_CLASSES))
    return F.coalesce(*(F.when(F.length(letters) >= n, F.try_element_at(known, F.substring(letters, 1, n))) for n in range(longest, 0, -1)))


def informative(label: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(label, F.lit("")))).isin(*UNINFORMATIVE)


def agree(a: Column, b: Column) -> Column:
    """Unless both labels name a class and the classes differ."""
    return ~informative(a) | ~informative(b) | (F.lower(F.trim(a)) == F.lower(F.trim(b)))


def class_word(label: Column) -> Column:
    """A label in the form in which `agree` compares it: empty where it names no class."""
    return F.when(informative(label), F.lower(F.trim(label))).otherwise("")


def terminals(label: Column) -> Column:
    word = F.lower(F.trim(label))
    return F.when(word.isin(*TWO_TERMINAL), "two_terminal").when(word.isin(*PAD_ONLY), "pad_only").otherwise("multi_pin")


def designators(c: Column) -> Column:
    """Cells of a list of designators; a single space doesn't separate."""
    return F.filter(F.transform(F.split(c, r"[,;]|\s{2,}"), lambda x: F.trim(x)), lambda x: x != "")


def source_group(name: Column) -> Column:
    """File stem without the suffix of augmented copies."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")
    return F.regexp_replace(stem, r"(?i)(_(?:jpe?g|png|bmp))?\.rf\.[0-9a-f]{6,}$", "")


def safe_name(c: Column, most: int = 64, fallback: str = "item") -> Column:
    word = F.substring(F.btrim(F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_"), F.lit("._")), 1, most)
    return F.when(word == "", fallback).otherwise(word)


def guarded_cell(c: Column) -> Column:
    """A spreadsheet must not take the cell for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def column_names(headers: list[str]) -> dict[str, str]:
    """Which header holds each canonical field."""
    plain = {re.sub("[^a-z0-9]", "", h.strip().lower()): h for h in headers if h}
    return {field: next(plain[a] for a in names if a in plain) for field, names in ALIASES.items() if any(a in plain for a in names)}
