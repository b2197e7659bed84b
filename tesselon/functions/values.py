"""Typed values from text, elevation codecs, varints, templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of values in the order in which mixed ones are sorted.
TYPE_ORDER = ("String", "Float", "Double", "Int", "UInt", "Bool", "Null")
#: Texts that are read as numbers. Leading zeros keep a text a string.
DOUBLE = r"^-?(?:0|[1-9]\d*)(?:(?:\.\d+)(?:[eE][+-]?\d+)?|[eE][+-]?\d+)$"
NEGATIVE = r"^-(?:0|[1-9]\d*)$"
UNSIGNED = r"^(?:0|[1-9]\d*)$"


def value_type(text) -> Column:
    """Kind of value that a text stands for."""
    t = F.col(text) if isinstance(text, str) else text
    return (
        F.when(t.isNull(), "Null")
        .when(t.isin("true", "false"), "Bool")
        .when(t.rlike(DOUBLE), "Double")
        .when(t.rlike(NEGATIVE) & t.try_cast("bigint").isNotNull(), "Int")
        .when(t.rlike(UNSIGNED) & t.try_cast("decimal(20,0)").isNotNull(), "UInt")
        .otherwise("String")
    )


def type_rank(kind) -> Column:
    """Place of a kind in the order of mixed values."""
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.array_position(F.array(*[F.lit(t) for t in TYPE_ORDER]), k) - 1


def as_number(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.when(value_type(t).isin("Double", "Int", "UInt"), t.try_cast("double"))


def varint_length(value) -> Column:
    """Bytes of an unsigned LEB128 number."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v < 0, 10).otherwise(F.greatest(F.lit(1), F.ceil(F.length(F.bin(v)) / 7).cast("int")))


# --- elevation -----------------------------------------------------------------------------------

ENCODINGS = ("mapbox", "terrarium")
RAW_MAX = (1 << 24) - 1


def elevation(raw, encoding: str = "mapbox") -> Column:
    r = F.col(raw) if isinstance(raw, str) else raw
    _check(encoding)
    return r * 0.1 - 10_000.0 if encoding == "mapbox" else r / 256.0 - 32_768.0


def elevation_raw(metres, encoding: str = "mapbox") -> Column:
    m = F.col(metres) if isinstance(metres, str) else metres
    _check(encoding)
    scaled = (m + 10_000.0) * 10.0 if encoding == "mapbox" else (m + 32_768.0) * 256.0
    return F.greatest(F.lit(0), F.least(F.lit(RAW_MAX), F.floor(scaled + 0.5))).cast("bigint")


def raw_unit(encoding: str) -> float:
    _check(encoding)
    return 0.1 if encoding == "mapbox" else 1 / 256


def _check(encoding: str) -> None:
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding}; one of {', '.join(ENCODINGS)}")


def quantize_bits(step_raw) -> Column:
    """Low bits that may be cleared for a step in raw units."""
    s = F.col(step_raw) if isinstance(step_raw, str) else step_raw
    return F.when(s >= 1, F.least(F.lit(24), F.floor(F.log2(s + 1)))).otherwise(0).cast("int")


def quantize(raw, bits) -> Column:
    """Rounds to a multiple of 2**bits, without leaving 24 bits."""
    r = (F.col(raw) if isinstance(raw, str) else raw).cast("bigint")
    step = F.pow(F.lit(2.0), bits).cast("bigint")
    rounded = F.least(r + F.floor(step / 2), F.lit(RAW_MAX).cast("bigint"))
    return (rounded - F.pmod(rounded, step)).cast("bigint")


# --- templates -----------------------------------------------------------------------------------

#: Names of grid cells by INSPIRE and GEOSTAT.
ID_PRESETS = {"inspire": "CRS{epsg}RES{size}mN{y}E{x}", "geostat": "{size_km}N{y/1000:04}E{x/1000:04}"}
_FIELD = re.compile(r"\{([a-z_]+)(?:/(\d+))?(?::0(\d+))?\}")


def format_template(template: str, fields: dict[str, Column]) -> Column:
    """Fills {name}, {name/divisor} and {name:0width}; divisions round down."""
    parts, at = [], 0
    for m in _FIELD.finditer(template):
        if m[1] not in fields:
            raise ValueError(f"unknown field {m[1]} in {template}")
        parts.append(F.lit(template[at : m.start()]))
        value = fields[m[1]]
        if m[2]:
            value = F.floor(value / int(m[2]))
        text = value.cast("string")
        parts.append(F.when(F.length(text) < int(m[3]), F.lpad(text, int(m[3]), "0")).otherwise(text) if m[3] else text)
        at = m.end()
    rest = template[at:]
    if "{" in rest or "}" in rest:
        raise ValueError(f"bad template {template}")
    return F.concat(*parts, F.lit(rest))
