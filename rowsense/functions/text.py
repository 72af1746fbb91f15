"""Column functions that bring printed names, units and flags to comparable forms. Each is null for null."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode's white space and the byte order mark; Java's own class has ASCII's alone.
SPACES = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = f"[{SPACES}]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}|{SPACE}$", "")


def no_space(x: Column) -> Column:
    return F.regexp_replace(x, SPACE, "")


def collapsed(x: Column) -> Column:
    """Runs of white space as one space, none at the ends, lower case."""
    return F.lower(F.regexp_replace(trimmed(x), SPACE, " "))


def norm_name(x: Column) -> Column:
    """A printed name for lookups: lower case, no white space, gamma as y, no colons, points, commas or brackets."""
    return F.regexp_replace(F.translate(no_space(F.lower(x)), "γ", "y"), r"[：:．.,()（）\[\]【】]", "")


def norm_unit(x: Column) -> Column:
    """A printed unit: micro signs as u, times signs and a leading star before a digit as x, brackets opened."""
    return F.regexp_replace(F.translate(no_space(F.lower(x)), "µμ×()（）", "uux"), r"^\*(?=\d)", "x")


def unit_key(x: Column) -> Column:
    """For comparison alone: letters that readers of scans confuse are folded."""
    return F.translate(norm_unit(x), "io", "l0")


def norm_flag(x: Column) -> Column:
    """A printed flag: lower case, no white space, neutral marks dropped at both ends only."""
    return F.regexp_replace(no_space(F.lower(x)), r"^[：:．.,()（）\[\]【】]+|[：:．.,()（）\[\]【】]+$", "")


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a of the code points; null for null."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295))
    return F.when(x.isNotNull(), F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step))


def client_ip(*headers: Column) -> Column:
    """The first header that names an address: its first part, at most 128 characters; else 'unknown'."""
    return F.substring(F.coalesce(*(F.nullif(F.trim(F.split_part(h, F.lit(","), F.lit(1))), F.lit("")) for h in headers), F.lit("unknown")), 1, 128)


@F.pandas_udf(StringType())
def composed(x: pd.Series) -> pd.Series:
    """Unicode's composed form, trimmed."""
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).strip())


@F.pandas_udf(StringType())
def _compatible(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def plain(x: Column) -> Column:
    """For safety rules: the compatibility form without format characters, fraction slashes as /, white space collapsed."""
    return F.regexp_replace(trimmed(F.regexp_replace(F.regexp_replace(_compatible(x), r"\p{Cf}", ""), "\u2044", "/")), SPACE, " ")


def pseudonym(x: Column, key: bytes, space: str = "") -> Column:
    """HMAC-SHA256 of an identifier, hex, behind a namespace; the key is at most a block long."""
    if len(key) > 64:
        raise ValueError("the key is longer than 64 bytes")
    pad = lambda b: F.unhex(F.lit("".join(f"{(k ^ b):02x}" for k in key.ljust(64, b"\0"))))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(x, "UTF-8")), 256))
    return F.concat(F.lit(space), F.sha2(F.concat(pad(0x5C), inner), 256))
