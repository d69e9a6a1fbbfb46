"""Scalar column functions and the strict parsers of option values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LONG = 2**63 - 1


def reverse_complement(seq: Column) -> Column:
    """Upper-case ACGTN only; other letters stay."""
    return F.translate(F.reverse(seq), "ACGTN", "TGCAN")


def tag_value(tags: Column, name: str) -> Column:
    """Value of the first XX:T:value tag of an array of tags, null if absent. Colons in the value stay."""
    return F.get(F.transform(F.filter(tags, lambda t: t.startswith(f"{name}:")), lambda t: F.substring(t, 6, 1 << 30)), F.lit(0))


def tag_map(tags: Column) -> Column:
    """Tags as a map from name to 'T:value'; of a repeated name the first."""
    ok = F.filter(tags, lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:"))
    names = F.transform(ok, lambda t: F.substring(t, 1, 2))
    first = F.filter(ok, lambda t, i: F.array_position(names, F.substring(t, 1, 2)) == i + 1)
    return F.map_from_arrays(F.transform(first, lambda t: F.substring(t, 1, 2)), F.transform(first, lambda t: F.substring(t, 4, 1 << 30)))


def walk_name(sample: Column, hap: Column, seq_id: Column, start: Column, end: Column) -> Column:
    """Canonical name of a walk; an unknown coordinate is *."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("*"))
    return F.concat_ws("|", sample, hap.cast("string"), seq_id, text(start), text(end))


_COORDS = r"(?s)^(.*):([0-9]+)-([0-9]+)$"


def name_base(name: Column) -> Column:
    """A path name without its :start-end suffix."""
    return F.when(name.rlike(_COORDS), F.regexp_extract(name, _COORDS, 1)).otherwise(name)


def name_start(name: Column) -> Column:
    """Start in the name's suffix, null without one; raises for an empty name before it or an end not beyond the start."""
    return _name_part(name, 2)


def name_end(name: Column) -> Column:
    return _name_part(name, 3)


def _name_part(name: Column, group: int) -> Column:
    start, end = (F.regexp_extract(name, _COORDS, k).cast("decimal(38,0)") for k in (2, 3))
    bad = (F.regexp_extract(name, _COORDS, 1) == "") | (end <= start) | (end > F.lit(MAX_LONG).cast("decimal(38,0)"))
    value = F.when(bad, F.raise_error(F.concat(F.lit("invalid coordinates in path name: "), name)).cast("bigint")).otherwise((start if group == 2 else end).cast("bigint"))
    return F.when(name.rlike(_COORDS), value)


def checked_int(text: str, lowest: int = 0, highest: int = MAX_LONG) -> int:
    """A whole string of ASCII digits within bounds."""
    if not re.fullmatch(r"[0-9]+", text, re.ASCII) or not lowest <= int(text) <= highest:
        raise ValueError(f"not a number from {lowest} to {highest}: {text!r}")
    return int(text)


def parse_region(text: str) -> tuple[str, int, int]:
    """'sequence:start-end', split at the last colon; digits may be grouped by commas; end > start."""
    sequence, colon, span = text.rpartition(":")
    start, dash, end = span.partition("-")
    if not colon or not dash or not sequence:
        raise ValueError(f"a region reads sequence:start-end, not {text!r}")
    a, b = (checked_int(x.replace(",", "")) for x in (start, end))
    if b <= a:
        raise ValueError(f"the end of a region lies beyond its start: {text!r}")
    return sequence, a, b


_UNITS = {"": 1, "bp": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9}


def parse_gap(text: str | None) -> int | None:
    """A gap in bases, with an optional unit (bp, kb, mb, gb; decimal); None and '' mean no gap option, which 0 doesn't."""
    if text is None or text == "":
        return None
    m = re.fullmatch(r"([0-9][0-9,]*)([a-zA-Z]*)", text)
    if not m or m[2].lower() not in _UNITS:
        raise ValueError(f"Invalid --haplotype_gap: {text!r}")
    return checked_int(str(int(m[1].replace(",", "")) * _UNITS[m[2].lower()]))
